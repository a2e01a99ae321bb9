"""Spellings of names typed by people, linked when they name the same person.

Every spelling is rewritten into all of its canonical forms: titles, notes and accents are dropped, generational
suffixes unified, tokens put in order, particles and second surnames left out, nicknames replaced by the names they
stand for, misspelt words by the established words one slip away, given names by their initials and by nothing. Forms
are exploded and joined on equality. How much a shared form says depends on how rare it is: a form that the fully
spelt names of exactly one person share identifies that person, and one that several share says nothing. So each
spelling takes its most specific form that anybody has, and is linked if that form is rare enough, which is alone.
Second surnames and middle initials are the most specific of all: spellings that have different ones are different
persons, and one that has none says nothing where others with its given name and surname have several.
Organisations are names with a legal form: the form's spellings are unified and the words put in one order.

Two passes come before: one finds which words are used as given names (by their places), the other which surnames are
slips of which (by forms with one letter left out, each group of equal forms being reduced to its most frequent word;
short surnames need the given name and a far more frequent word besides).
Groups are reduced by aggregation throughout, so no step pairs the members of a group but the last, which states the
result: each two spellings of one person.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyworlds.plans.runtime import bounded, checkpoint

# Fixed values of this operator: what English speakers call each other, and words around names.
NICKNAMES = {
    "abigail": "abby gail", "alexander": "alex alec sandy sasha xander", "alexandra": "alex alexa lexi sandra sasha", "andrew": "andy drew", "anthony": "tony ant", "benjamin": "ben benny benji",
    "charles": "charlie chuck chaz", "christopher": "chris kit topher", "daniel": "dan danny", "deborah": "deb debbie debby", "dmitri": "dima mitya", "dominic": "dom nic nick",
    "edward": "ed eddie ned ted teddy", "elizabeth": "beth betsy betty eliza libby liz lizzie", "eugene": "gene", "francis": "fran frank frankie", "frederick": "fred freddie freddy", "gabriel": "gabe",
    "gregory": "greg", "harold": "hal harry", "henry": "hal hank harry", "isaac": "ike zac", "jacob": "jake", "james": "jamie jim jimmy", "john": "jack johnny", "jonathan": "jon jonny nathan",
    "jose": "pepe", "joseph": "joe joey", "josephine": "jo josie", "joshua": "josh", "katherine": "kate kathy katie kay kit", "kenneth": "ken kenny", "lawrence": "larry laurie", "leonard": "len lenny leo",
    "margaret": "maggie marge meg peg peggy", "matthew": "matt", "maximilian": "max", "michael": "mick mickey mike", "nathaniel": "nate", "nicholas": "nic nick nico nicky", "patricia": "pat patsy tricia",
    "patrick": "paddy pat", "peter": "pete", "philip": "phil pip", "raymond": "ray", "rebecca": "becca becky", "richard": "dick rich rick ricky", "robert": "bob bobby rob robbie", "ronald": "ron ronnie",
    "samuel": "sam sammy", "samantha": "sam", "stephen": "steve stevie", "susannah": "sue susie", "theodore": "ted teddy theo", "thomas": "tom tommy", "timothy": "tim timmy", "ulrich": "uli", "victoria": "tori vicky vic",
    "vincent": "vin vince vinny", "walter": "wally walt", "william": "bill billy will", "zachary": "zac zach zack",
}
TITLES = frozenset("mr mrs ms miss dr prof capt captain coach sir".split())
SUFFIXES = {"jr": "jr", "junior": "jr", "sr": "sr", "senior": "sr", "ii": "ii", "2nd": "ii", "iii": "iii", "3rd": "iii", "iv": "iv", "4th": "iv"}
PARTICLES = frozenset("van von der den de di da del della la le al el bin ibn ter ten o mc mac st".split())
#: Legal forms at the end of an organisation's name, and words that its name may be without.
LEGAL_FORMS = {
    "ltd": "limited", "limited": "limited", "inc": "incorporated", "incorporated": "incorporated", "corp": "corporation", "corporation": "corporation", "llc": "llc", "llp": "llp", "plc": "plc", "gmbh": "gmbh",
    "pty ltd": "pty limited", "pty limited": "pty limited", "company": "company", "& co": "company", "and co": "company", "& company": "company", "and company": "company",
}
LINKING_WORDS = frozenset("the and of & und et y".split())
#: Letters that don't decompose into a base letter and marks, and digits that look like letters.
_LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ı": "i", "0": "o", "1": "l", "3": "e", "5": "s"})
#: A word is a given name of the vocabulary from this many uses on, whatever the size of the data.
LEAST_USES = 3
#: A frequent word that is one slip from one used this many times as often is taken for its slip.
SLIP = 8
#: Spellings of one person that are paired in one piece.
PIECE = 500
#: Surnames of so many letters, from and to, have too few to tell a slip by its letters alone.
SHORT = 3, 5

#: Stands for the given name of an organisation; no folded word has a blank.
ORGANISATION = "an organisation"

_MEANINGS: dict[str, tuple[str, ...]] = {}
for _full, _short in NICKNAMES.items():
    for _nick in _short.split():
        _MEANINGS[_nick] = (*_MEANINGS.get(_nick, ()), _full)

_NOTE = re.compile(r"#\s*\d+|\*+|\(([^()]*)\)|[\"“”]([^\"“”]*)[\"“”]|(?:(?<=\s)|^)['‘’]([^'‘’\s]+)['‘’](?=\s|$|,)")
_GLUED = re.compile(r"^(?:[OoDdLl]['’`]|(?:Mc|Mac|Van|Von|Di|De|Al|El)(?=[A-ZÀ-ÖØ-ÞŁ])|(?:al|el|Al|El|AL|EL)-|O(?=[A-ZÀ-ÖØ-ÞŁ][^\W\d_]*[a-zß-öø-ÿł]))")


def fold(word: str) -> str:
    """Lower case, without accents; digits inside a word as the letters they look like."""
    flat = "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))
    return "".join(c for c in flat.translate(_LETTERS) if c.isalpha())


def slips(word: str) -> Iterator[str]:
    """The word with one letter left out. Two words share one of these, or one is among the other's, exactly if they are
    one insertion, deletion, replacement or move of a letter apart."""
    for i in range(len(word)):
        if not i or word[i] != word[i - 1]:
            yield word[:i] + word[i + 1 :]


def edits(a: str, b: str) -> int:
    """How many letters inserted, deleted, replaced, or swapped with the next lead from one word to the other."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[-1] = min(row[-1], before[j - 2] + 1)
        before, last = last, row
    return last[-1]


class Reading(NamedTuple):
    """A spelling taken apart: all in folded form."""

    surname: list[str]
    given: str
    initial: str
    suffix: str
    ordered: bool
    middle: str = ""


class Vocabulary:
    """The given names in use: how often each is used, which nicknames they have, and what slips of them look like."""

    def __init__(self, uses: dict[str, int]) -> None:
        self.uses = dict(uses)
        for full in NICKNAMES:
            self.uses.setdefault(full, 0)
        index: dict[str, list[str]] = {}
        for w in self.uses:
            for s in (w, *slips(w)):
                index.setdefault(s, []).append(w)
        self.index = index
        self.found: dict[str, tuple[tuple[str, ...], int]] = {}

    def meanings(self, word: str) -> tuple[tuple[str, ...], int]:
        """The given names that a word may stand for, and how surely: 2 exactly, 1 as a slip, 0 not at all."""
        if (known := self.found.get(word)) is None:
            known = self._meanings(word)
            if len(self.found) > 300_000:
                self.found.clear()
            self.found[word] = known
        return known

    def _meanings(self, word: str) -> tuple[tuple[str, ...], int]:
        if len(word) < 2:
            return (), 0
        stands = tuple(f for f in _MEANINGS.get(word, ()) if self.uses.get(f))
        if stands:
            return stands, 2
        near = {w for s in (word, *slips(word)) for w in self.index.get(s, ()) if w != word and self.uses[w] and min(len(w), len(word)) > 2}
        own = self.uses.get(word, 0)
        if word in NICKNAMES or own and not any(self.uses[w] >= SLIP * own and w not in _MEANINGS for w in near):
            return (word,), 2
        if len(word) < 3:
            return (), 0
        # Of several, the nearest; the rarer by far of these are out: a slip is likelier of a common name.
        near = {w for w in near if self.uses[w] >= SLIP * own}
        least = min((edits(word, w) for w in near), default=0)
        full: dict[str, int] = {}
        for w in near:
            if edits(word, w) == least:
                for f in _MEANINGS.get(w, ()) or (w,):
                    if self.uses.get(f):
                        full[f] = max(full.get(f, 0), self.uses[w])
        most = max(full.values(), default=0)
        return tuple(sorted(f for f, n in full.items() if n * SLIP >= most)), (2 if own else 1) if full else 0


class Known:
    """The meanings of one spelling's words, as :class:`Vocabulary` gives them; without a table, any word has one."""

    def __init__(self, known: Iterable[dict] | None = None) -> None:
        self.known = None if known is None else {x["word"]: (tuple(x["means"]), x["sure"]) for x in known}

    def meanings(self, word: str) -> tuple[tuple[str, ...], int]:
        return ((word,), 2) if self.known is None else self.known.get(word, ((), 0))


def _words(text: str, vocabulary: Vocabulary | Known | None) -> list[tuple[str, bool]]:
    """(folded word, whether it is an initial) in order; particles left out, double names split."""
    out = []
    for raw in re.split(r"[\s./]+", text):
        raw = raw.strip("-,;:'’`")
        if not raw:
            continue
        raw = _GLUED.sub("", raw)
        for piece in re.split(r"[-–‐]", raw):
            w = fold(piece)
            if w.startswith("mc") and len(w) > 4 and w[2] not in "aeiou" and not (vocabulary is not None and vocabulary.meanings(w)[1]):
                w = w[2:]
            if w and w not in PARTICLES or len(w) == 1:
                out.append((w, len(w) == 1))
    return out


def asked_words(text: str) -> set[str]:
    """All words of a spelling whose meanings :func:`read_name` may ask for."""
    asked = {fold(m[1] or m[2] or m[3] or "") for m in _NOTE.finditer(text)}
    for segment in _NOTE.sub(" ", text.replace("\xa0", " ")).split(","):
        for known in (Known(), None):  # with and without a glued mc
            asked.update(w for w, _ in _words(segment, known))
    return {w for w in asked if len(w) > 1}


def organisation(text: str) -> tuple[str, str] | None:
    """The words of an organisation's name in one order, and its legal form; None if the text has none."""
    plain = re.sub(r"[.,]", " ", re.sub(r"(?<=\w)\.(?=\w)", "", text)).split()
    for size in (2, 1):
        form = LEGAL_FORMS.get(" ".join(plain[-size:]).lower()) if len(plain) > size else None
        if form:
            return "".join(sorted(filter(None, (fold(w) for w in plain[:-size] if w.lower() not in LINKING_WORDS)))), form
    return None


def read_name(text: str, vocabulary: Vocabulary | Known | None = None) -> Reading:
    """A spelling taken apart. Without a vocabulary the order of the tokens is taken as it stands."""
    nick = ""
    for m in _NOTE.finditer(text):
        inside = fold(m[1] or m[2] or m[3] or "")
        if inside and (inside in _MEANINGS or vocabulary is not None and vocabulary.meanings(inside)[1] == 2):
            nick = inside
    text = _NOTE.sub(" ", text.replace("\xa0", " "))
    suffix, segments = "", []
    for segment in text.split(","):
        kept = []
        for raw in segment.split():
            bare = raw.strip(".").lower()
            if bare in SUFFIXES and (kept or segments):
                suffix = SUFFIXES[bare]
            elif bare in TITLES and not kept and (raw.endswith(".") or not segments):
                continue
            else:
                kept.append(raw)
        if kept:
            segments.append(" ".join(kept))
    if len(segments) >= 2:
        last, first = _words(segments[0], vocabulary), _words(" ".join(segments[1:]), vocabulary)
        sur, given = [w for w, one in last if not one], [w for w, one in first if not one]
        initials = [w for w, one in first if one] or [w for w, one in last if one]
        ordered = True
    else:
        words = _words(segments[0], vocabulary) if segments else []
        names, initials = [w for w, one in words if not one], [w for w, one in words if one]
        ordered = False
        if len(names) < 2:
            sure = vocabulary is not None and names and not initials and vocabulary.meanings(names[0])[1] == 2
            sur, given = ([], names) if sure else (names, [])
        else:
            front, back = (vocabulary.meanings(names[0])[1], vocabulary.meanings(names[-1])[1]) if vocabulary is not None else (0, 0)
            if vocabulary is not None and not front and not back and (initials or " " not in segments[0]):
                sur, given = names, []  # a double surname alone, or behind or before an initial
            else:
                sur, given = (names[:-1], names[-1:]) if back > front else (names[1:], names[:1])
    word = given[0] if given else ""
    if not word and nick:
        word = nick
    elif nick and vocabulary is not None and not vocabulary.meanings(word)[1]:
        word = nick
    return Reading(sur, word, word[:1] or (initials[0] if initials else ""), suffix, ordered, initials[0] if word and initials else "")


def spellings(*columns: tuple[DataFrame, str]) -> DataFrame:
    """The distinct trimmed non-null values of some columns, as ``spelling``."""
    out = None
    for df, column in columns:
        one = df.filter(F.col(column).isNotNull()).select(F.trim(F.col(column)).alias("spelling"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def _left_out(word: str) -> Column:
    """A word and its forms with one letter left out."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), cut))


def given_names(names: DataFrame) -> DataFrame:
    """``word, uses``: the words used as given names, at least LEAST_USES times and twice as often as surnames.

    The number of uses that a word needs doesn't move with the size of the data, so there may be any number of words.
    """

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["spelling"]:
                r = read_name(text)
                if r.given and r.surname:
                    rows.append((r.given, 1, 0))
                    rows.append((r.surname[-1], 0, 1))
            yield pd.DataFrame(rows, columns=["word", "given", "surname"])

    used = names.mapInPandas(votes, "word string, given int, surname int").groupBy("word").agg(F.sum("given").alias("given"), F.sum("surname").alias("surname"))
    return used.filter((F.col("given") >= LEAST_USES) & (F.col("given") > 2 * F.col("surname"))).select("word", F.col("given").alias("uses"))


def with_meanings(names: DataFrame) -> DataFrame:
    """``spelling, known``: the spellings with those of their words that mean given names, and what they mean.

    The words of the spellings meet the vocabulary in forms with a letter left out; each is judged by the given names
    one slip away and by those of the fixed list of nicknames, which are all that :class:`Vocabulary` looks at.
    """

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"spelling": batch["spelling"], "words": [sorted(asked_words(text)) for text in batch["spelling"]]})

    used = checkpoint(given_names(names))
    fixed = {r["word"]: r["uses"] for r in bounded(used.filter(F.col("word").isin(list(NICKNAMES))), len(NICKNAMES))}
    asking = checkpoint(names.mapInPandas(asked, "spelling string, words array<string>")).select("spelling", F.explode_outer("words").alias("word"))
    words = asking.filter("word is not null").select("word").distinct()
    near = words.select("word", F.explode(_left_out("word")).alias("form")).join(used.select(F.col("word").alias("near"), "uses", F.explode(_left_out("word")).alias("form")), "form")
    judged = words.join(near.groupBy("word").agg(F.collect_set(F.struct("near", "uses")).alias("near")), "word", "left")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vocabulary = Vocabulary(fixed | {x["near"]: x["uses"] for near in batch["near"] if near is not None for x in near})
            rows = [(word, *vocabulary.meanings(word)) for word in batch["word"]]
            yield pd.DataFrame([(word, list(means), sure) for word, means, sure in rows if sure], columns=["word", "means", "sure"])

    meaning = judged.mapInPandas(judge, "word string, means array<string>, sure int")
    found = F.when(F.col("sure").isNotNull(), F.struct("word", "means", "sure"))
    return asking.join(meaning, "word", "left").groupBy("spelling").agg(F.collect_list(found).alias("known"))


def mended_surnames(read: DataFrame) -> DataFrame:
    """`read`, short surname words (SHORT letters) that are slips replaced by the word that was meant.

    Ordinary short surnames are often one letter apart, so a letter isn't evidence enough: the word that was meant must
    be in SLIP times as many spellings and be used with the same given name (with the same initial, where the spelling
    has no more). A spelling with neither says nothing and stays. Forms with a letter left out, each under its given
    names, are reduced to their most frequent word, as in :func:`surname_roots`.
    """
    low, high = SHORT
    short = read.filter(F.length("word").between(low, high))
    first = F.transform("given", lambda g: F.concat(F.lit("i:"), F.substring(g, 1, 1)))
    full = F.transform("given", lambda g: F.concat(F.lit("g:"), g))
    initial = F.when(F.col("initial") != "", F.array(F.concat(F.lit("i:"), F.col("initial")))).otherwise(F.array().cast("array<string>"))
    uses = short.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    known = short.select("word", F.explode(F.array_distinct(F.concat(full, first, initial))).alias("key")).distinct().join(uses, "word")
    spread = checkpoint(known.select("word", "key", "n", F.explode(_left_out("word")).alias("form")))
    best = spread.groupBy("form", "key").agg(F.max(F.struct("n", "word")).alias("top"))
    meant = spread.join(best, ["form", "key"]).filter(F.col("top.n") >= SLIP * F.col("n")).groupBy("word", "key").agg(F.max("top").alias("top"))
    asked = short.select("spelling", "word", F.explode(F.when(F.size("given") > 0, full).otherwise(initial)).alias("key"))
    found = asked.join(meant, ["word", "key"]).groupBy("spelling").agg(F.max("top")["word"].alias("meant"))
    return read.join(found, "spelling", "left").withColumn("word", F.coalesce("meant", "word")).drop("meant")


def surname_roots(read: DataFrame) -> DataFrame:
    """``word, root``: each surname word and the weightier word that it is a slip of (itself, if of none).

    Forms with a letter left out (and without a glued particle) are grouped; each group is reduced to its weightiest
    word, by its uses and the words that share forms with it, each word takes the weightiest of its groups' words, and
    roots of roots are followed to the end.
    """
    words = read.filter("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    bare = F.regexp_extract("word", r"^(?:van|al|de|di|o)([a-z]{5,})$", 1)
    forms = words.withColumn("bases", F.array_distinct(F.filter(F.array(F.col("word"), bare), lambda b: b != "")))
    base = forms.select("word", "n", F.explode("bases").alias("base"))
    left_out = F.when(F.length("base") >= 6, F.transform(F.sequence(F.lit(1), F.length("base")), lambda i: F.concat(F.substring("base", F.lit(1), i - 1), F.substring("base", i + 1, F.length("base"))))).otherwise(F.array())
    spread = base.select("word", "n", F.explode(F.array_distinct(F.concat(F.array("base"), left_out))).alias("form"))
    shared = spread.groupBy("form").agg(F.count(F.lit(1)).alias("sharing")).filter("sharing > 1")
    linkable = checkpoint(spread.join(shared, "form"))
    # The word that was meant is the one that most slips lead to, and most people get right.
    weights = linkable.groupBy("word").agg((F.first("n") + F.sum(F.col("sharing") - 1)).alias("weight"))
    weighed = linkable.join(weights, "word").select("form", F.struct("weight", "word").alias("self"))
    best = weighed.groupBy("form").agg(F.max("self").alias("top"))
    parent = weighed.join(best, "form").groupBy(F.col("self.word").alias("word")).agg(F.max("top").alias("top"), F.max("self").alias("own"))
    roots = checkpoint(words.select("word").join(parent.select("word", F.when(F.col("top") > F.col("own"), F.col("top.word")).alias("up")), "word", "left").select("word", F.coalesce("up", "word").alias("root")))
    # Each round doubles the hops followed; weights grow at every hop, so there are no circles.
    while True:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = checkpoint(roots.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        roots = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return roots


def linked(names: DataFrame) -> DataFrame:
    """``spelling, person``: the spellings that could be assigned, under one key per person.

    `names` has ``spelling`` (distinct, not null). A spelling that names nobody in particular (no word, or a form that
    several persons share) is left out; one that nobody else shares is a person of its own. Empty texts have no word;
    very long ones are read like any other. An empty table gives no rows.
    """
    names = checkpoint(names.select("spelling"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, own in zip(batch["spelling"], batch["known"]):
                if (firm := organisation(text)) and firm[0]:
                    rows.append((text, firm[0], [ORGANISATION], "", firm[1], None, None))
                    continue
                known = Known(own)
                r = read_name(text, known)
                given, sure = known.meanings(r.given)
                if r.given and not sure:
                    given = (r.given,)
                rows.append((text, r.surname[0] if r.surname else None, sorted(given), r.initial if not r.given else "", r.suffix, r.surname[1] if len(r.surname) > 1 else None, r.middle or None))
            yield pd.DataFrame(rows, columns=["spelling", "word", "given", "initial", "suffix", "second", "middle"])

    read = checkpoint(with_meanings(names).mapInPandas(parse, "spelling string, word string, given array<string>, initial string, suffix string, second string, middle string"))
    read = checkpoint(mended_surnames(read))
    placed = read.filter("word is not null").join(surname_roots(read), "word")
    # Forms, most specific first: each given name the spelling may mean, or its initial, or nothing.
    key = lambda part: F.concat_ws("|", part, F.col("root"), F.col("suffix"))
    full = F.transform("given", lambda g: key(F.concat(F.lit("g:"), g)))
    form = F.when(F.size("given") > 0, full).when(F.col("initial") != "", F.array(key(F.concat(F.lit("i:"), F.col("initial"))))).otherwise(F.array(key(F.lit("*"))))
    spelt = checkpoint(placed.select("spelling", "root", "given", "initial", "suffix", "second", "middle", form.alias("forms")))
    certain = checkpoint(apart(spelt.filter(F.size("given") == 1).withColumn("person", F.col("forms")[0]), "second"))
    certain = checkpoint(apart(certain, "middle"))
    # Whom fully spelt names stand for, and how many persons share each of their rewritings: with the given name, its
    # initial and neither, each with and without the second surname; an organisation also without its legal form.
    persons = certain.select("person", "root", "suffix", "second", F.col("given")[0].alias("g")).distinct()
    bare = F.array(key(F.concat(F.lit("g:"), F.col("g"))), key(F.concat(F.lit("i:"), F.substring("g", 1, 1))), key(F.lit("*")))
    bare = F.when(F.col("g") == ORGANISATION, F.array(bare[0], F.concat_ws("|", F.lit("*"), "root", F.lit("")))).otherwise(bare)
    with_second = lambda forms: F.when(F.col("second").isNull(), F.array().cast("array<string>")).otherwise(F.transform(forms, lambda f: F.concat(f, F.lit("&"), F.col("second"))))
    shorter = persons.select("person", F.explode(F.array_distinct(F.concat(bare, with_second(bare)))).alias("form"))
    rarity = shorter.groupBy("form").agg(F.count(F.lit(1)).alias("persons"), F.max("person").alias("person"))
    # Of a spelling's forms those with the second surname come first, if anybody has them.
    level = lambda forms, n: F.transform(forms, lambda f: F.struct(F.lit(n).alias("level"), f.alias("form")))
    open_ = spelt.filter(F.size("given") != 1).select("spelling", "forms", F.explode(F.concat(level(with_second(F.col("forms")), 0), level(F.col("forms"), 1))).alias("at")).select("spelling", "forms", "at.level", "at.form")
    found = open_.join(rarity, "form", "left").groupBy("spelling", "forms", "level").agg(F.coalesce(F.sum("persons"), F.lit(0)).alias("persons"), F.max("person").alias("person"))
    # A nickname of several names is one person if only one of these names is there; a form of several says nothing.
    judged = found.groupBy("spelling", "forms").agg(F.min_by(F.struct("persons", "person"), F.when(F.col("persons") > 0, F.col("level"))).alias("who")).select("spelling", "forms", F.coalesce("who.persons", F.lit(0)).alias("persons"), "who.person")
    # Where nobody is fully spelt, equal rewritings are each other's evidence.
    others = judged.filter("persons <= 1").select("spelling", F.coalesce("person", F.array_join(F.array_sort("forms"), "/")).alias("person"))
    return certain.select("spelling", "person").unionByName(others)


def apart(assigned: DataFrame, detail: str) -> DataFrame:
    """`assigned` (``person``, `detail`, ...) with the persons told apart by a detail of which their spellings have
    several: those without it are left out there. Elsewhere it becomes the detail of all of a person's spellings.

    Details one slip apart (a letter left out, put in, replaced or moved) are the one that more spellings have; initials
    are too short for slips. `assigned` is read more than once: pass a table or a checkpoint.
    """
    told = assigned.filter(F.col(detail).isNotNull()).groupBy("person", F.col(detail).alias("own")).agg(F.count(F.lit(1)).alias("n"))
    spread = told.select("person", "own", "n", F.explode(F.when(F.length("own") > 3, _left_out("own")).otherwise(F.array("own"))).alias("form"))
    best = spread.groupBy("person", "form").agg(F.max(F.struct("n", "own")).alias("top"))
    meant = spread.join(best, ["person", "form"]).groupBy("person", "own").agg(F.max("top")["own"].alias("meant"))
    span = meant.groupBy("person").agg(F.min("meant").alias("low"), F.max("meant").alias("high"))
    both = assigned.join(span, "person", "left").join(meant.withColumnRenamed("own", detail), ["person", detail], "left")
    several = F.coalesce(F.col("low") != F.col("high"), F.lit(False))
    kept = both.filter(~several | F.col("meant").isNotNull()).withColumn(detail, F.coalesce("meant", "low"))
    return kept.withColumn("person", F.when(several, F.concat_ws("&", "person", detail)).otherwise(F.col("person"))).drop("low", "high", "meant")


def variant_pairs(assigned: DataFrame) -> DataFrame:
    """``player_a, player_b``: each two different spellings of one person, in code point order.

    A person with more than PIECE spellings is paired in as many pieces as it takes, so no task has all of its pairs.
    `assigned` is read more than once: pass a table or a checkpoint.
    """
    large = assigned.groupBy("person").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces")).filter("pieces > 1")
    cut = assigned.join(large, "person", "left").select("person", "spelling", F.coalesce("pieces", F.lit(1)).alias("pieces"))
    a = cut.select("person", F.pmod(F.xxhash64("spelling"), F.col("pieces")).cast("int").alias("piece"), F.col("spelling").alias("player_a"))
    b = cut.select("person", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col("spelling").alias("player_b"))
    return a.join(b, ["person", "piece"]).filter("player_a < player_b").select("player_a", "player_b")
