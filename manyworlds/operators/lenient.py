"""Delimited lines that fail to parse: valid rows are loaded, the rest are kept apart with the reason.

A line is parsed at minimum cost. The strict grammar reads a line at no cost if it is well formed; where it can't go on,
a quote or a delimiter may be inserted or deleted, and a field may be given up as a value of its type. Costs are ranked:
one quote edit outweighs any number of delimiter edits, and one of these any number of given-up values, so the cheapest
parse tells what is wrong with a line: it needs quote edits if and only if its quoting is broken, delimiter edits (and
no quote edits) if and only if its quoting is sound but it has the wrong number of fields, and otherwise only
given-up values. Rows of cost 0 load; the edit operations are the reason.

The dynamic programme runs over (position, state, fields so far) in one pass over the line with a constant number of
states, then over the pieces between delimiters for the columns; only lines that the strict grammar can't read at no
cost go through it. Lines without quotes whose fields all fit, nearly all of a sound file, are of cost 0 by columns alone
and never meet Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of the reader: at a field's start, inside a bare field, inside a quoted one, after its closing quote.
START, BARE, QUOTED, CLOSED = range(4)


@dataclass(frozen=True)
class Layout:
    """The fields of a kind of line: their names and the check of each value (None: any text). No checked value holds a
    delimiter. `columns` are the same checks as columns, where there are some: they may refuse more, never less."""

    names: tuple[str, ...]
    checks: tuple[Callable[[str], bool] | None, ...]
    sep: str = "|"
    quote: str = '"'
    required: frozenset[str] = frozenset()
    columns: tuple[Callable[[Column], Column] | None, ...] | None = None


@dataclass
class Parsed:
    """A line's fields (as many as its layout has, None for one that isn't there), and the edits that it took."""

    fields: list[str | None]
    quote_edits: list[str] = field(default_factory=list)
    column_edits: list[str] = field(default_factory=list)
    value_edits: list[str] = field(default_factory=list)

    @property
    def reason(self) -> str | None:
        return "quoting" if self.quote_edits else "columns" if self.column_edits else "value" if self.value_edits else None

    @property
    def edits(self) -> list[str]:
        return [*self.quote_edits, *self.column_edits, *self.value_edits]


def strict_fields(line: str, sep: str, quote: str) -> list[str] | None:
    """The fields of a well quoted line, quotes undone; None if its quoting is broken."""
    if quote not in line:
        return line.split(sep)
    out, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == quote:
            parts, i = [], i + 1
            while True:
                j = line.find(quote, i)
                if j < 0:
                    return None
                parts.append(line[i:j])
                if line[j + 1 : j + 2] != quote:
                    break
                parts.append(quote)
                i = j + 2
            out.append("".join(parts))
            i = j + 1
            if i < n and line[i] != sep:
                return None
        else:
            j = line.find(sep, i)
            j = n if j < 0 else j
            if line.find(quote, i, j) >= 0:
                return None
            out.append(line[i:j])
            i = j
        if i >= n:
            return out
        i += 1


def mended_quotes(line: str, sep: str, quote: str) -> tuple[list[str], list[str]]:
    """The fields of the reading with the fewest quote edits, and these edits.

    Dynamic programming over the line: for each state the cheapest way to be in it. A quote may be deleted where it
    stands or inserted before a character or at the end; ties prefer fewer delimiters swallowed by quotes, then
    deletions, so a stray quote is dropped before a closing one is made up.
    """
    inf = (1 << 60, 0)
    # One entry per state: the cost (edits, delimiters inside quotes) and a link (previous link, action, position).
    cost: list[tuple[int, int]] = [(0, 0), inf, inf, inf]
    link: list[tuple | None] = [None] * 4

    def inserted(cost: list, link: list, i: int) -> None:
        """A quote may be inserted before position i: it closes a quoted field, or opens one at a field's start."""
        for a, b in ((QUOTED, CLOSED), (START, QUOTED)):
            c = (cost[a][0] + 1, cost[a][1])
            if c < cost[b]:
                cost[b], link[b] = c, (link[a], "insert", i)

    for i, ch in enumerate(line):
        inserted(cost, link, i)
        new: list[tuple[int, int]] = [inf] * 4
        back: list[tuple | None] = [None] * 4

        def go(a: int, b: int, act: str, more: int = 0, within: int = 0, cost=cost, link=link, new=new, back=back, i=i) -> None:
            c = (cost[a][0] + more, cost[a][1] + within)
            if c < new[b]:
                new[b], back[b] = c, (link[a], act, i)

        if ch == quote:
            for s in (START, BARE, QUOTED, CLOSED):
                go(s, s, "delete", 1)
            go(START, QUOTED, "open")
            go(QUOTED, CLOSED, "close")
            go(CLOSED, QUOTED, "double")  # a doubled quote: the one before closed for a moment
        elif ch == sep:
            for s in (START, BARE, CLOSED):
                go(s, START, "next")
            go(QUOTED, QUOTED, "keep", 0, 1)
        else:
            go(START, BARE, "keep")
            go(BARE, BARE, "keep")
            go(QUOTED, QUOTED, "keep")
        cost, link = new, back
    inserted(cost, link, len(line))
    end = min((START, BARE, CLOSED), key=lambda s: cost[s])
    steps, at = [], link[end]
    while at is not None:
        steps.append(at[1:])
        at = at[0]
    fields, edits = [[]], []
    for act, i in reversed(steps):
        if act == "next":
            fields.append([])
        elif act == "keep":
            fields[-1].append(line[i])
        elif act == "double":
            fields[-1].append(quote)
        elif act in ("delete", "insert"):
            edits.append(f"{act} {quote} at {i}")
    return ["".join(f) for f in fields], edits


def fitted(pieces: list[str], layout: Layout) -> tuple[list[str | None], list[str]]:
    """The pieces as the layout's fields with the fewest delimiter edits, and these edits.

    Too many pieces: dynamic programming over which fields hold the excess delimiters (they are deleted there). Too few:
    over which fields are missing (a delimiter inserted). Among equals the one whose values fit their types best wins,
    then the one that spreads the excess over the fewest fields, the last ones.
    """
    k, n = len(layout.names), len(pieces)
    if n == k:
        return list(pieces), []
    fits = [c or (lambda v: True) for c in layout.checks]
    if n > k:
        # best[j]: (misfits, fields with excess, link) with j pieces used. A field takes any number of pieces; a checked
        # one holds no delimiter, so with more than one it is a misfit, and what came before j matters by its cost alone.
        best: list[tuple[int, int, tuple | None]] = [(0, 0, None)] + [(1 << 60, 0, None)] * n
        for f in range(k):
            after: list[tuple[int, int, tuple | None]] = [(1 << 60, 0, None)] * (n + 1)
            wide, start = (1 << 60, 0, None), 0  # the cheapest way to a start two pieces or more before
            for e in range(f + 1, n - (k - 1 - f) + 1):
                if e > 1 and best[e - 2][:2] < wide[:2]:
                    wide, start = best[e - 2], e - 2
                one, joined = best[e - 1], (wide[0] + (layout.checks[f] is not None), wide[1] + 1)
                one_cost = (one[0] + (one[0] < 1 << 60 and not fits[f](pieces[e - 1].strip(" "))), one[1])
                after[e] = (*one_cost, (one[2], e - 1, e)) if one_cost < joined else (*joined, (wide[2], start, e))
            best = after
        spans, at = [], best[n][2]
        while at is not None:
            spans.append(at[1:])
            at = at[0]
        spans.reverse()
        return [layout.sep.join(pieces[a:b]) for a, b in spans], [f"delete {layout.sep} after piece {i + 1}" for a, b in spans for i in range(a, b - 1)]
    row: dict[int, tuple[int, tuple]] = {0: (0, ())}
    for f in range(k):
        step: dict[int, tuple[int, tuple]] = {}
        for j, (bad, taken) in row.items():
            if k - f - 1 >= n - j:  # the field is missing
                step[j] = min(step.get(j, (1 << 30, ())), (bad, (*taken, -1)), key=lambda x: x[0])
            if j < n:
                miss = bad + (not fits[f](pieces[j].strip(" ")))
                step[j + 1] = min(step.get(j + 1, (1 << 30, ())), (miss, (*taken, j)), key=lambda x: x[0])
        row = step
    taken = row[n][1]
    return [pieces[j] if j >= 0 else None for j in taken], [f"insert {layout.sep} for field {layout.names[f]}" for f, j in enumerate(taken) if j < 0]


def parse_line(line: str | None, layout: Layout) -> Parsed:
    """The minimum-cost reading of a line. One carriage return at its end is dropped; no line at all (null) lacks all
    of its columns."""
    if line is None:
        return Parsed([None] * len(layout.names), column_edits=[f"insert {layout.sep} for field {n}" for n in layout.names])
    line = line.removesuffix("\r")
    pieces, quotes = strict_fields(line, layout.sep, layout.quote), []
    if pieces is None:
        pieces, quotes = mended_quotes(line, layout.sep, layout.quote)
    values, columns = fitted(pieces, layout)
    wrong = []
    for name, check, v in zip(layout.names, layout.checks, values):
        text = (v or "").strip(" ")
        if text == "" and name in layout.required or text != "" and check is not None and not check(text):
            wrong.append(f"give up {name}")
    return Parsed(values, quotes, columns, wrong)


# The checks of single values. The English month names in three letters.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_ISO, _US, _LONG = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})"), re.compile(r"([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})"), re.compile(r"([0-9]{1,2}) ([A-Z][a-z]{2}) ([0-9]{4})")


def _real(y: int, m: int, d: int) -> date | None:
    try:
        return date(y, m, d)
    except ValueError:
        return None


def iso_date(text: str) -> date | None:
    """A real day as yyyy-mm-dd."""
    m = _ISO.fullmatch(text)
    return _real(*map(int, m.groups())) if m else None


def birth_date(text: str) -> date | None:
    """A real day as yyyy-mm-dd, m/d/yyyy or d Mon yyyy, of 1950 to 2010."""
    if m := _US.fullmatch(text):
        found = _real(int(m[3]), int(m[1]), int(m[2]))
    elif m := _LONG.fullmatch(text):
        found = _real(int(m[3]), MONTHS.index(m[2]) + 1, int(m[1])) if m[2] in MONTHS else None
    else:
        found = iso_date(text)
    return found if found and 1950 <= found.year <= 2010 else None


def count_up_to(most: int) -> Callable[[str], bool]:
    """Digits only, at most `most`."""
    return lambda text: text.isascii() and text.isdigit() and int(text[-19:]) <= most and len(text.lstrip("0")) <= 19


def matchup(codes: Sequence[str]) -> Callable[[str], bool]:
    """@, vs or vs. (any case), optional spaces, then one of the codes in capitals."""
    known = re.compile(r"(?:@|[vV][sS]\.?) *(?:" + "|".join(map(re.escape, codes)) + ")") if codes else None
    return lambda text: known is not None and known.fullmatch(text) is not None


def sound_line(raw: Column, layout: Layout) -> tuple[Column, Column]:
    """Whether columns alone find that a line is good, and its fields."""
    line = F.regexp_replace(raw, r"\r\z", "")
    fields = F.split(line, r"\Q" + layout.sep + r"\E", -1)
    good = ~F.contains(line, F.lit(layout.quote)) & (F.size(fields) == len(layout.names))
    for i, (name, check) in enumerate(zip(layout.names, layout.columns or ())):
        text = F.trim(F.get(fields, F.lit(i)))
        fits = F.lit(True) if check is None else check(text)
        good &= F.when(text == "", F.lit(name not in layout.required)).otherwise(fits)
    return F.coalesce(good, F.lit(False)) if layout.columns else F.lit(False), fields


def load_lines(lines: DataFrame, row_id: str, kind: str, raw: str, layouts: dict[str, Layout]) -> DataFrame:
    """Each line's minimum-cost reading: ``row_id``, ``kind``, ``fields`` (an array in the layout's order), ``reason``
    (null: the row is good) and ``edits``.

    A row's layout is chosen by its `kind`; a null or unknown kind has no layout, so its line can't be split into known
    columns: ``columns``. A null line is ``columns``, an empty one is a single empty field. Texts of any length are read
    whole, in time proportional to it. Repeated lines are read each; other columns aren't read.
    """
    good, fields = F.lit(False), F.lit(None).cast("array<string>")
    for name, layout in layouts.items():
        sound, split = sound_line(F.col("raw"), layout)
        good, fields = F.when(F.col("kind") == name, sound).otherwise(good), F.when(F.col("kind") == name, split).otherwise(fields)
    cut = lines.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(kind).alias("kind"), F.col(raw).alias("raw"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for ident, which, text in zip(batch["row_id"], batch["kind"], batch["raw"]):
                if (layout := layouts.get(which)) is None:
                    out.append((ident, which, None if text is None else [text], "columns", ["no layout"]))
                    continue
                p = parse_line(text, layout)
                out.append((ident, which, p.fields, p.reason, p.edits))
            yield pd.DataFrame(out, columns=["row_id", "kind", "fields", "reason", "edits"])

    rest = cut.filter(~F.coalesce(good, F.lit(False))).mapInPandas(read, "row_id bigint, kind string, fields array<string>, reason string, edits array<string>")
    return cut.filter(good).select("row_id", "kind", fields.alias("fields"), F.lit(None).cast("string").alias("reason"), F.array().cast("array<string>").alias("edits")).unionByName(rest)


def iso_date_column(value: Column) -> Column:
    """The date of a text of :func:`iso_date`'s form, null if it isn't one."""
    text = F.trim(value)
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & ~text.startswith("0000"), text.try_cast("date"))


def count_up_to_column(most: int) -> Callable[[Column], Column]:
    """:func:`count_up_to` of up to nine digits as a column."""
    return lambda value: F.when(F.trim(value).rlike(r"^[0-9]{1,9}\z"), F.trim(value).try_cast("int") <= most).otherwise(F.lit(False))


def birth_date_column(value: Column) -> Column:
    """The date that a text of :func:`birth_date`'s forms states, null if it states none."""
    text = F.trim(value)
    day = F.coalesce(
        F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), text.try_cast("date")),
        F.when(text.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\z"), F.concat_ws("-", F.substring_index(text, "/", -1), F.substring_index(text, "/", 1), F.substring_index(F.substring_index(text, "/", 2), "/", -1)).try_cast("date")),
        F.when(
            text.rlike(r"^[0-9]{1,2} (" + "|".join(MONTHS) + r") [0-9]{4}\z"),
            F.concat_ws("-", F.substring_index(text, " ", -1), F.array_position(F.array(*map(F.lit, MONTHS)), F.substring_index(F.substring_index(text, " ", 2), " ", -1)).cast("string"), F.substring_index(text, " ", 1)).try_cast("date"),
        ),
    )
    return F.when(F.year(day).between(1950, 2010), day)


def matchup_column(value: Column, codes: Sequence[str]) -> Column:
    """Whether a text is of :func:`matchup`'s form."""
    return F.regexp_extract(F.trim(value), r"^(?:@|[vV][sS]\.?) *([^ ].*)\z", 1).isin(*codes) if codes else F.lit(False)


def bad_values(df: DataFrame, row_id: str, value: str, good: Column, label: str) -> DataFrame:
    """(src_table, row_id, reason) of the rows whose value is neither null nor blank nor `good`."""
    return df.filter((F.trim(F.col(value)) != "") & ~F.coalesce(good, F.lit(False))).select(F.lit(label).alias("src_table"), F.col(row_id).cast("bigint").alias("row_id"), F.lit("value").alias("reason"))
