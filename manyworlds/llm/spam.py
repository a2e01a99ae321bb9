"""Keyword-stuffed and link-list pages, told by the shapes of their lines.

A page's lines are reduced to shapes: how many words (in steps), how capitals are used, which separators stand between
them, whether there are links and labels beside them, and how many of its words come again and again nearby. Words
themselves play no part, so the same few shapes cover endless variations of wording, language and addresses. The page's
words are summed by shape, and a page is flagged when a few shapes that aren't those of sentences hold more than half of
them. Records (logs, tables, schedules, issue lists, code) have shapes of their own and aren't flagged.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyworlds.llm import mail

#: Words of one line; longer lines are cut, as any program that wraps text would.
WRAP = 12
#: A word recurs if it stands three times within this many words.
NEAR = 80
#: The share of a line's long words that must recur for the line to be repetition; sentences of one author repeat less.
AGAIN = 0.85
#: Shapes that count as few.
FEW = 8

_URL = re.compile(r"<?\b(?:https?://|www\.)[^\s<>\"]+>?", re.I)
_WORD = re.compile(r"\w+")
_QUOTED = re.compile(r"(?:[>|][ \t]?)+")
_BULLET = re.compile(r"(?:\(?\d{1,3}[.)]|[-+*•·>|]+)(?=\s|$)\s*")
_END = re.compile(r"[.!?](?:\s+[^\W\d_a-zß-ÿ]|\s*$)")
_SEPARATED = re.compile(r"[,;|/•·]")
_RECORD = re.compile(r"\d{1,2}:\d\d|\d{4}-\d\d-\d\d|\w=\w|#\d|[{}\[\]()]\s*[:=]|\[\w|\w\(|\S {2,}\S|\t|@\w|\d-\d")
#: A paragraph of so many words with a sentence's end is prose: where it is quoted again, that is no repetition of keywords.
PROSE = 8
#: Terms that don't recur are stuffing from so many words on, in a part without a sentence.
STRUNG = 24
_RULE = re.compile(r"[*_\-=#~+]{3,}")
#: Openings and words of the notices that mail programs and lists add (fixed values, several languages).
_NOTICE = re.compile(r"confidential|privileged|intended (?:only )?for|meant only for|addressee|vertraulich|confidentiel|confidencial|riservat|you receive this (?:mail|message)|member of the list|before printing|scanned for", re.I)


class Shape(NamedTuple):
    """What is left of a line. kind: record, link, list, tags, recurring, words or sentence."""

    kind: str
    words: int
    capitals: str
    separators: int
    links: int


#: The kinds that aren't sentences and aren't records.
STUFFING = frozenset({"link", "list", "tags", "recurring"})


def body_lines(text: str, is_html: bool) -> list[str]:
    """The lines of a part without quote marks; HTML's links stand before their labels."""
    if is_html:
        return [line.strip() for line in mail.html_text(text, links=True).splitlines()]
    return [_QUOTED.sub("", line.lstrip(), count=1).strip() if line.lstrip()[:1] in (">", "|") and not _URL.match(line.lstrip(" \t>|")) else line.strip() for line in text.splitlines()]


def without_notices(lines: list[str]) -> list[str]:
    """The lines without disclaimers: a paragraph that opens like one, with the rule above it."""
    out, i, n = [], 0, len(lines)
    while i < n:
        line = lines[i]
        start = i if line else n
        if _RULE.fullmatch(line):
            start = i + 1
            while start < n and not lines[start]:
                start += 1
        elif i and lines[i - 1]:  # not the start of a paragraph
            start = n
        if start < n and any(_NOTICE.search(x) for x in lines[start : start + 2] if x):
            i = start
            while i < n and lines[i]:
                i += 1
            continue
        out.append(line)
        i += 1
    return out


def _capitals(line: str, words: list[str]) -> str:
    first = [w for w in words if w[0].isalpha()]
    upper = sum(w[0].isupper() for w in first)
    return "none" if not upper else "all" if upper == len(first) else "first" if upper == 1 and words[0][0].isupper() else "some"


def quoted_again(lines: list[str]) -> list[int]:
    """Of paragraphs of prose that stand more than once: the words of each line of all but the first; 0 elsewhere."""
    out, seen, i, n = [0] * len(lines), set(), 0, len(lines)
    while i < n:
        stop = i
        while stop < n and lines[stop]:
            stop += 1
        paragraph = " ".join(lines[i:stop]).lower().split()
        if len(paragraph) >= PROSE:
            if (key := " ".join(paragraph)) not in seen:
                seen.add(key)
            elif _END.search(" ".join(lines[i:stop])):
                out[i:stop] = [len(_WORD.findall(_URL.sub(" x ", x))) for x in lines[i:stop]]
        i = stop + 1
    return out


def line_shapes(lines: list[str]) -> list[Shape]:
    """The shape of each line (or piece of a long one) with words in it. A link is one word."""
    cut: list[tuple[str, list[str], int]] = []
    shapes: list[Shape] = []
    for line, again_words in zip(lines, quoted_again(lines)):
        if not line:
            continue
        if again_words:
            shapes.append(Shape("sentence", again_words, "", 0, 0))
            continue
        plain, links = _URL.subn(" ", line) if "://" in line or "www." in line.lower() else (line, 0)
        if links:
            bare = _BULLET.sub("", plain.strip(), count=1)
            found = _WORD.findall(bare)
            if len(found) <= 6 * links:
                cut.append((bare, found, links))
                continue
            # A text with links in it: the text in pieces, the links by themselves.
            cut += [("", [], 1)] * links
        short = _WORD.findall(plain)
        if len(short) <= WRAP:
            if short:
                cut.append((plain, short, 0))
            continue
        found = list(_WORD.finditer(plain))
        for k in range(0, len(found), WRAP):
            stop = found[k + WRAP].start() if k + WRAP < len(found) else len(plain)
            cut.append((plain[found[k].start() if k else 0 : stop], [m[0] for m in found[k : k + WRAP]], 0))
    # Words that come again and again: long ones, each three times within NEAR words.
    places: dict[str, list[int]] = {}
    at = 0
    for _, found, links in cut:
        if not links:
            for w in found:
                places.setdefault(w.lower(), []).append(at)
                at += 1
    again = bytearray(at)
    for ps in places.values():
        for k in range(len(ps) - 2):
            if ps[k + 2] - ps[k] <= NEAR:
                again[ps[k]] = again[ps[k + 1]] = again[ps[k + 2]] = 1
    at, told = 0, bool(shapes)
    for n, (line, found, links) in enumerate(cut):
        size = len(found)
        if links:
            shapes.append(Shape("link" if not _END.search(line) or size <= 2 * links else "sentence", size, "", 0, links))
            continue
        long = [k for k in range(size) if len(found[k]) > 3]
        some = long if len(long) > 1 else range(size)
        recurring = sum(again[at + k] for k in some) / max(1, len(some))
        at += size
        separators = len(_SEPARATED.findall(line))
        tags = line.count("#")
        step = min(3, size // 4)
        if size <= 6 and line.rstrip().endswith(":") and n + 1 < len(cut) and cut[n + 1][2] and len(cut[n + 1][1]) <= 1:
            kind = "link"  # the label of the link in the next line
        elif tags and 2 * tags >= size - 1 and not re.search(r"#\d", line):
            kind = "tags"
        elif recurring < 0.3:
            # A record of new words, or terms strung together: which of both, the rest of the part tells.
            strung = size >= 5 and separators >= 2 and size <= 4.6 * (separators + 1) and not _END.search(line[:-1]) and not _RECORD.search(line)
            kind = "terms" if strung else "sentence"
            told = told or size > 4 and bool(_END.search(line))
        elif _RECORD.search(line):
            kind = "record"
        elif size >= 5 and separators >= 2 and size <= 4.6 * (separators + 1) and not _END.search(line[:-1]):
            kind = "list"
        elif recurring >= AGAIN:
            kind = "recurring"
        else:
            kind = "sentence" if _END.search(line) or size > 4 else "words"
        shapes.append(Shape(kind, step if kind not in ("sentence", "link", "terms") else size, _capitals(line, found) if kind != "link" else "", min(3, separators), 0) if kind != "sentence" else Shape(kind, size, "", 0, 0))
        if kind in STUFFING and kind != "link":
            shapes[-1] = shapes[-1]._replace(words=size)
    told |= sum(x.words for x in shapes if x.kind == "terms") < STRUNG
    return [x._replace(kind="sentence" if told else "list") if x.kind == "terms" else x for x in shapes]


class Page(NamedTuple):
    """The words of a part, in all and by non-sentence shape (with their word counts in steps of four)."""

    total: int
    shapes: Counter[Shape]

    def share(self, few: int = FEW) -> float:
        """How much of the words the largest `few` non-sentence shapes hold."""
        return sum(n for _, n in self.shapes.most_common(few)) / self.total if self.total else 0.0


def part_page(text: str, is_html: bool) -> Page:
    """A text part by shapes."""
    per: Counter[Shape] = Counter()
    total = 0
    for s in line_shapes(without_notices(body_lines(text, is_html))):
        size = s.words + s.links
        total += size
        if s.kind in STUFFING:
            per[s._replace(words=min(3, s.words // 4), links=min(1, s.links))] += size
    return Page(total, per)


def mail_page(mail_text: str | None) -> Page:
    """The body of a mail: all of its parts together, but of alternatives, which say the same twice, the one with the
    largest share, because any of them may hide words."""
    nodes = mail.tree(mail_text)
    pages: dict[int, Page] = {}
    for node in reversed(nodes):  # what is inside a part comes before it
        inside = [pages[id(x)] for x in node.inside]
        if node.text is not None:
            page = part_page(node.text, node.is_html)
        elif node.alternatives:
            page = max(inside, key=lambda x: (x.share(), x.total), default=Page(0, Counter()))
        else:
            page = Page(sum(x.total for x in inside), sum((x.shapes for x in inside), Counter()))
        pages[id(node)] = page
    return pages[id(nodes[0])]


def stuffed_pages(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", above: float = 0.5) -> DataFrame:
    """``doc_id, share, words, shapes`` of the documents where few non-sentence shapes hold more than `above` of the words.

    A null or empty text, and one without words, isn't flagged; texts are read whole, a very long line in pieces;
    repeated documents are judged one by one; an empty table gives no rows. Other columns aren't read. Documents are
    judged where they lie: nothing is shuffled.
    """
    cut = documents.filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pages = [(i, mail_page(t)) for i, t in zip(batch["doc_id"], batch["text"])]
            rows = [(i, share, page.total, min(FEW, len(page.shapes))) for i, page in pages if (share := page.share()) > above]
            yield pd.DataFrame(rows, columns=["doc_id", "share", "words", "shapes"])

    return cut.mapInPandas(judge, "doc_id bigint, share double, words int, shapes int")
