"""Scalar functions of the SQL substrate that Spark has under another name, with other semantics, or not at all.

All are Column builders over built-in functions, so they stay in generated code.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = Column | str


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- strings --------------------------------------------------------------------------------------------------------


def similar_to(value: C, pattern: str, escape: str = "\\") -> Column:
    """SQL's SIMILAR TO: % and _ as in LIKE, | * + ? ( ) [ ] as in regular expressions, the whole text."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == escape and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif ch == "%":
            out.append(".*")
        elif ch == "_":
            out.append(".")
        elif ch in ".^$":
            out.append("\\" + ch)
        else:
            out.append(ch)
        i += 1
    return _c(value).rlike("(?s)^(?:" + "".join(out) + r")\z")


def regexp_replace_first(value: C, pattern: str, by: str) -> Column:
    """Replace the first match only (Spark's regexp_replace replaces all)."""
    at = F.regexp_instr(_c(value), F.lit(pattern))
    found = F.regexp_substr(_c(value), F.lit(pattern))
    return F.when(at > 0, F.concat(F.substring(_c(value), F.lit(1), at - 1), F.lit(by), F.substring(_c(value), at + F.length(found), F.length(_c(value))))).otherwise(_c(value))


def btrim(value: C, characters: str = " ") -> Column:
    """Without any of some characters at both ends."""
    return F.btrim(_c(value), F.lit(characters))


def strpos(value: C, part: C) -> Column:
    """The place of a part, 0 if it isn't there."""
    return F.instr(_c(value), part if isinstance(part, Column) else F.lit(part))


def quote_ident(value: C) -> Column:
    """As an identifier: in double quotes unless it is plain lower case."""
    v = _c(value)
    return F.when(v.rlike(r"^[a-z_][a-z0-9_]*\z"), v).otherwise(F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"')))


def quote_literal(value: C) -> Column:
    """As a string literal."""
    return F.concat(F.lit("'"), F.replace(_c(value), F.lit("'"), F.lit("''")), F.lit("'"))


def to_ascii(value: C) -> Column:
    """Latin letters without their marks."""
    marked, plain = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "AAAAAACEEEEIIIINOOOOOOUUUUYaaaaaaceeeeiiiinoooooouuuuyy"
    return F.translate(_c(value), marked, plain)


def trigrams(value: C) -> Column:
    """The distinct three-letter pieces of each word of a text, padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(_c(value)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))))))


def similarity(a: C, b: C) -> Column:
    """Shared trigrams over all trigrams; 0 for two empty texts."""
    x, y = trigrams(a), trigrams(b)
    return F.when(F.size(F.array_union(x, y)) > 0, F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(F.lit(0.0))


def soundex_difference(a: C, b: C) -> Column:
    """In how many of its four places the soundex codes agree."""
    x, y = F.soundex(_c(a)), F.soundex(_c(b))
    return sum((F.when(F.substring(x, i, 1) == F.substring(y, i, 1), 1).otherwise(0) for i in range(2, 5)), F.when(F.substring(x, 1, 1) == F.substring(y, 1, 1), 1).otherwise(0))


# --- numbers --------------------------------------------------------------------------------------------------------


def int_div(a: C, b: C) -> Column:
    """Integer division, towards zero (Spark's / is fractional)."""
    return F.call_function("div", _c(a), _c(b))


def trunc_to(value: C, places: int = 0) -> Column:
    """Cut after some decimal places, towards zero."""
    scale = F.lit(10.0**places)
    scaled = _c(value).cast("double") * scale
    return F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled)) / scale


# --- dates ----------------------------------------------------------------------------------------------------------


def date_part(field: str, when: C) -> Column:
    """EXTRACT with the fields that Spark lacks or counts otherwise: century, decade, millennium, dow (Sunday is 0),
    isodow, epoch; others as in Spark."""
    t = _c(when)
    year = F.year(t)
    special = {
        "century": F.floor((year - 1) / 100) + 1,
        "millennium": F.floor((year - 1) / 1000) + 1,
        "decade": F.floor(year / 10),
        "dow": F.dayofweek(t) - 1,
        "isodow": F.weekday(t) + 1,
        "epoch": F.unix_timestamp(t),
    }
    return special[field].cast("bigint") if field in special else F.extract(F.lit(field), t).cast("bigint")


def date_trunc(field: str, when: C) -> Column:
    """date_trunc with century, decade and millennium (Spark gives null for them)."""
    t = _c(when)
    if field in ("century", "millennium"):
        step = 100 if field == "century" else 1000
        return F.make_date((F.floor((F.year(t) - 1) / step) * step + 1).cast("int"), F.lit(1), F.lit(1)).cast("timestamp")
    if field == "decade":
        return F.make_date((F.floor(F.year(t) / 10) * 10).cast("int"), F.lit(1), F.lit(1)).cast("timestamp")
    return F.date_trunc(field, t)


def overlaps(a0: C, a1: C, b0: C, b1: C) -> Column:
    """Whether two periods share time; ends are exclusive, an empty period is its start, ends may be given either way."""
    s0, e0, s1, e1 = F.least(_c(a0), _c(a1)), F.greatest(_c(a0), _c(a1)), F.least(_c(b0), _c(b1)), F.greatest(_c(b0), _c(b1))
    return (s0 == s1) | ((s0 < s1) & (e0 > s1)) | ((s1 < s0) & (e1 > s0))


# --- arrays, maps ---------------------------------------------------------------------------------------------------


def array_idx(values: C, value: C) -> Column:
    """The first place of a value, 0 if it isn't there."""
    return F.array_position(_c(values), value)


def array_uniq(values: C) -> Column:
    """Without repetitions that follow each other."""
    v = _c(values)
    return F.filter(v, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(v, i - 1)))


def array_remove_all(values: C, other: C) -> Column:
    """Without the values of another."""
    return F.array_except(_c(values), _c(other))


def map_delete(m: C, key: C) -> Column:
    """Without a key."""
    return F.map_filter(_c(m), lambda k, v: k != key)


def map_defined(m: C, key: C) -> Column:
    """Whether a key is there with a value that isn't null."""
    return F.coalesce(F.map_contains_key(_c(m), key) & F.try_element_at(_c(m), key if isinstance(key, Column) else F.lit(key)).isNotNull(), F.lit(False))


def map_contains(m: C, other: C) -> Column:
    """Whether all entries of another are there."""
    return F.forall(F.map_entries(_c(other)), lambda e: F.try_element_at(_c(m), e["key"]).eqNullSafe(e["value"]) & F.map_contains_key(_c(m), e["key"]))


def map_concat(a: C, b: C) -> Column:
    """Both; the second's values win."""
    x, y = _c(a), _c(b)
    return F.map_concat(F.map_filter(x, lambda k, v: ~F.map_contains_key(y, k)), y)


# --- text search ----------------------------------------------------------------------------------------------------


def to_tsvector(text: C) -> Column:
    """The words of a text with their places: sorted ARRAY<STRUCT<term, pos>>."""
    words = F.filter(F.split(F.lower(_c(text)), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    return F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("term"), (i + 1).alias("pos"))))


def ts_match(vector: Column, query: str) -> Column:
    """Whether a text has the words of a query: & and, | or, ! not, parentheses."""
    ts = re.findall(r"[&|!()]|[^\s&|!()]+", query.lower())
    at = 0

    def either() -> Column:
        nonlocal at
        left = both()
        while at < len(ts) and ts[at] == "|":
            at += 1
            left = left | both()
        return left

    def both() -> Column:
        nonlocal at
        left = one()
        while at < len(ts) and ts[at] == "&":
            at += 1
            left = left & one()
        return left

    def one() -> Column:
        nonlocal at
        t = ts[at]
        at += 1
        if t == "!":
            return ~one()
        if t == "(":
            inside = either()
            at += 1
            return inside
        return F.exists(vector, lambda x: x["term"] == t)

    return either()


def ts_count(vector: Column, *terms: str) -> Column:
    """How often some words occur."""
    return F.size(F.filter(vector, lambda x: x["term"].isin(*terms)))


def ts_phrase(vector: Column, *terms: str) -> Column:
    """Whether some words follow each other in a text."""

    def follows(start: Column, k: int, term: str) -> Column:
        return F.exists(vector, lambda y: (y["term"] == term) & (y["pos"] == start["pos"] + k))

    def begins(x: Column) -> Column:
        found = x["term"] == terms[0]
        for k, term in enumerate(terms[1:], 1):
            found &= follows(x, k, term)
        return found

    return F.exists(vector, begins)


def ts_strip(vector: Column) -> Column:
    """The words of a text without their places, each once."""
    return F.array_sort(F.array_distinct(F.transform(vector, lambda x: x["term"])))


def ts_headline(text: C, *terms: str, start: str = "<b>", stop: str = "</b>") -> Column:
    """A text with some words marked."""
    words = "|".join(re.escape(t) for t in terms)
    return F.regexp_replace(_c(text), rf"(?i)(?<![\p{{L}}\p{{N}}_])({words})(?![\p{{L}}\p{{N}}_])", f"{start}$1{stop}")


def ts_stat(df: DataFrame, vector: str) -> DataFrame:
    """Per word of all texts: in how many texts it is, and how often (``word, ndoc, nentry``)."""
    v = F.col(vector)
    # A vector is sorted by word, so a word's first place in a text is where another stands before it.
    marked = F.transform(v, lambda x, i: F.struct(x["term"].alias("word"), ((i == 0) | (F.get(v, i - 1)["term"] != x["term"])).alias("first")))
    return df.select(F.explode(marked).alias("x")).groupBy("x.word").agg(F.count_if("x.first").alias("ndoc"), F.count(F.lit(1)).alias("nentry"))


# --- places, networks, trees, markup ----------------------------------------------------------------------------------


def earth_distance(lat1: C, lon1: C, lat2: C, lon2: C, radius: float = 6378168.0) -> Column:
    """Great-circle distance in metres."""
    a, b, d = F.radians(_c(lat1)), F.radians(_c(lat2)), F.radians(_c(lon2) - _c(lon1))
    h = F.sin((b - a) / 2) ** 2 + F.cos(a) * F.cos(b) * F.sin(d / 2) ** 2
    return F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def inet_number(address: C) -> Column:
    """An IPv4 address as a number."""
    host = F.split(F.split_part(_c(address), F.lit("/"), F.lit(1)), r"\.")
    return sum((F.get(host, F.lit(i)).cast("bigint") * F.lit(256 ** (3 - i)) for i in range(1, 4)), F.get(host, F.lit(0)).cast("bigint") * F.lit(256**3))


def inet_within(address: C, network: str) -> Column:
    """Whether an IPv4 address is in a network such as 10.0.0.0/8."""
    base, bits = network.split("/")
    size = 2 ** (32 - int(bits))
    number = sum(int(x) * 256 ** (3 - i) for i, x in enumerate(base.split("."))) // size * size
    return (inet_number(address) >= F.lit(number)) & (inet_number(address) < F.lit(number + size))


def inet_text(number: C) -> Column:
    """A number as an IPv4 address."""
    n = _c(number)
    return F.concat_ws(".", *(F.pmod(F.shiftright(n, 8 * i), F.lit(256)).cast("string") for i in (3, 2, 1, 0)))


def inet_bounds(network: C) -> tuple[Column, Column]:
    """The first and the last address of an IPv4 network such as 10.1.2.3/20 (alone: of itself)."""
    bits = F.when(F.contains(_c(network), F.lit("/")), F.split_part(_c(network), F.lit("/"), F.lit(2)).try_cast("int")).otherwise(F.lit(32))
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), 32 - bits)
    low = inet_number(network) - F.pmod(inet_number(network), size)
    return inet_text(low), inet_text(low + size - 1)


def label_level(path: C) -> Column:
    """How many labels a dotted path has."""
    return F.when(_c(path) == "", F.lit(0)).otherwise(F.size(F.split(_c(path), r"\.")))


def label_subpath(path: C, start: int, length: int) -> Column:
    """Some labels of a path, counted from 0."""
    return F.array_join(F.slice(F.split(_c(path), r"\."), start + 1, length), ".")


def label_common(a: C, b: C) -> Column:
    """The longest path that leads to both, themselves left out."""
    x, y = F.split(_c(a), r"\."), F.split(_c(b), r"\.")
    most = F.greatest(F.least(F.size(x), F.size(y)) - 1, F.lit(0))
    equal = F.filter(F.transform(F.sequence(F.lit(0), most), lambda n: n), lambda n: F.slice(x, F.lit(1), n) == F.slice(y, F.lit(1), n))
    return F.array_join(F.slice(x, F.lit(1), F.array_max(equal)), ".")


def is_ancestor(label: C, of: C) -> Column:
    """Whether a dotted label path is the other or leads to it."""
    return (_c(of) == _c(label)) | F.startswith(_c(of), F.concat(_c(label), F.lit(".")))


def xml_element(name: str, content: Column, **attributes: Column) -> Column:
    """An XML element with escaped text."""

    def escaped(c: Column) -> Column:
        return F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    head = [F.lit(f"<{name}")]
    for k, v in attributes.items():
        head += [F.lit(f' {k}="'), escaped(v), F.lit('"')]
    return F.concat(*head, F.lit(">"), F.coalesce(escaped(content), F.lit("")), F.lit(f"</{name}>"))


def xml_forest(**elements: Column) -> Column:
    """One element per value that isn't null, one after the other."""
    return F.concat(*(F.when(v.isNotNull(), xml_element(k, v)).otherwise(F.lit("")) for k, v in elements.items()))


def xml_agg(element: Column, order: Column) -> Column:
    """A group's elements one after the other: an aggregate."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), element.alias("e")))), lambda x: x["e"]), "")


def enum_range(values: list[str], value: C) -> Column:
    """The place of a value in a declared order (an enumeration), from 1; null if it isn't of it."""
    at = F.array_position(F.array(*map(F.lit, values)), _c(value))
    return F.when(at > 0, at)
