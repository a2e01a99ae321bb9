"""Held-out test items that leaked into a corpus, whole or in part, word for word or altered.

Windows of a document are fingerprinted with SimHash over their shingles, each weighing the letters of its words, and
compared with the fingerprints of the items' windows. There are two sizes. Windows the size of the shortest passage that
counts find a part of an item like the whole. Windows the size of the item (its size class: the largest of a geometric
row of sizes that it fills) find the item where words of it were replaced, left out or put in, so that no short passage
of it stands word for word. Either way a multi-index finds every pair of fingerprints within the radius: two that differ
in at most `radius` bits differ in at most a block's share of them in at least one block. Candidates are verified by the
weighted similarity of their shingles, and for exact passages word by word.

The items are the query set: a bounded block of them is broadcast as one index and the corpus is scanned once per block
(and decoded once, however many there are), so nothing of the corpus is shuffled, collected or paired with itself; a
document costs the same wherever it lies.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyworlds.llm import mail
from manyworlds.plans.runtime import checkpoint, pieces

_WORD = re.compile(r"\w+")
#: Items of one broadcast index, and their characters.
BLOCK_ITEMS = 5_000
BLOCK_CHARS = 10_000_000
#: Each size class of item-sized windows is this many times the one before.
GROWTH = 1.25
#: Words fingerprinted at once; small enough for their bit matrix to stay in the cache.
CHUNK = 16_384
#: A word's letters count up to this, so that one endless string doesn't outweigh the rest of its shingle.
LONGEST = 31


def words(text: str) -> list[str]:
    """Runs of letters, digits and underscores, case ignored."""
    return _WORD.findall(text.lower())


class Hasher:
    """64-bit hashes and weights of words, with a bounded memory of the words seen."""

    def __init__(self, most: int = 500_000) -> None:
        self.seen: dict[str, int] = {}
        self.most = most

    def __call__(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        seen = self.seen
        if len(seen) > self.most:
            seen.clear()
        for w in set(tokens).difference(seen):
            seen[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(seen.__getitem__, tokens), np.uint64, len(tokens)), np.minimum(np.fromiter(map(len, tokens), np.int32, len(tokens)), LONGEST)


def _shingles(h: np.ndarray, weight: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and weight of each run of `size` words."""
    n = len(h) - size + 1
    s, w = np.zeros(n, np.uint64), np.zeros(n, np.int32)
    for j in range(size):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        w += weight[j : j + n]
    s ^= s >> np.uint64(31)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    return s ^ (s >> np.uint64(29)), w


def _running(s: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Running sums of the weighted signs of each bit: a window's SimHash is the signs of a difference of two rows."""
    signs = np.unpackbits(s.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    signs *= 2
    signs -= 1
    signs *= w[:, None]
    total = np.empty((len(s) + 1, 64), np.int32)
    total[0] = 0
    np.cumsum(signs, axis=0, out=total[1:])
    return total


def _fingerprints(total: np.ndarray, each: int, step: int = 1) -> np.ndarray:
    """SimHash of each run of `each` shingles, or of every `step`-th."""
    return np.packbits(total[each::step] > total[: len(total) - each : step], axis=1).view(np.uint64).ravel()


class ItemWindows:
    """The items' windows of one size class: two an item, at its start and at its end, findable by fingerprint.

    Four blocks of 16 bits: of two fingerprints within the radius one block differs in at most a fourth of it, so each
    window is filed under all values that near to its own. Documents are looked at in steps of a twelfth of the size;
    a candidate is then laid against its surroundings word by word.
    """

    def __init__(self, size: int, windows: list[tuple[int, list[str]]], shingle: int, radius: int, similarity: float, hasher: Hasher) -> None:
        self.size, self.radius, self.similarity = size, radius, similarity
        self.each, self.step = size - shingle + 1, max(1, size // 12)
        self.item = np.array([i for i, _ in windows])
        self.sets, prints = [], []
        for _, tokens in windows:
            s, w = _shingles(*hasher(tokens), shingle)
            prints.append(_fingerprints(_running(s, w), self.each)[0])
            u, first = np.unique(s, return_index=True)
            self.sets.append((u, int(w[first].sum())))
        self.prints = np.array(prints, np.uint64)
        near = np.flatnonzero(np.bitwise_count(np.arange(1 << 16, dtype=np.uint32)) <= radius // 4)
        self.blocks = []
        for b in range(4):
            filed = ((self.prints >> np.uint64(16 * b) & np.uint64(0xFFFF)).astype(np.int64)[:, None] ^ near).ravel()
            order = np.argsort(filed, kind="stable")
            self.blocks.append((np.uint64(16 * b), np.searchsorted(filed[order], np.arange((1 << 16) + 1)), order // len(near)))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (position, window) whose fingerprints are within the radius."""
        found = []
        for shift, first, windows in self.blocks:
            value = (prints >> shift & np.uint64(0xFFFF)).astype(np.int64)
            low = first[value]
            count = first[value + 1] - low
            at = np.repeat(np.arange(len(prints)), count)
            k = windows[np.arange(len(at)) + np.repeat(low - np.cumsum(count) + count, count)]
            close = np.bitwise_count(prints[at] ^ self.prints[k]) <= self.radius
            found.append(at[close] * len(self.prints) + k[close])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.prints), pairs % len(self.prints)

    def alike(self, s: np.ndarray, w: np.ndarray, k: int) -> float:
        """The weighted similarity of a window's shingles and those of window k."""
        u, first = np.unique(s, return_index=True)
        own, (held, total) = w[first], self.sets[k]
        place = np.minimum(np.searchsorted(held, u), len(held) - 1)
        both = int(own[held[place] == u].sum())
        return both / max(1, int(own.sum()) + total - both)

    def matches(self, total: np.ndarray, s: np.ndarray, w: np.ndarray, doc: np.ndarray, stop: int) -> Iterator[tuple[int, int, float]]:
        """(position, item, similarity) of the verified windows that start before `stop`; none spans two documents."""
        if len(s) < self.each:
            return
        at, k = self.near(_fingerprints(total[: stop + self.each], self.each, self.step))
        at = at * self.step
        whole = doc[at] == doc[at + self.size - 1]
        for p, window in zip(at[whole].tolist(), k[whole].tolist()):
            best = self.alike(s[p : p + self.each], w[p : p + self.each], window)
            if self.step > 1 and self.similarity > best >= self.similarity / 2:
                for q in range(max(0, p - self.step // 2), min(len(s) - self.each, p + self.step // 2) + 1):
                    if q != p and doc[q] == doc[q + self.size - 1] == doc[p]:
                        best = max(best, self.alike(s[q : q + self.each], w[q : q + self.each], window))
            if best >= self.similarity:
                yield p, int(self.item[window]), best


class PassageIndex:
    """All windows of some items, findable by fingerprint: the short ones and those of the items' own sizes."""

    def __init__(self, items: list[tuple[int, str]], window: int, shingle: int, radius: int, similarity: float, item_radius: int) -> None:
        self.window, self.shingle, self.radius, self.similarity = window, shingle, radius, similarity
        self.each = window - shingle + 1
        hasher, texts, owners = Hasher(), {}, []
        classes: dict[int, list[tuple[int, list[str]]]] = {}
        for item, text in items:
            tokens = words(text)
            size = window
            while (larger := round(size * GROWTH)) <= len(tokens):
                size = larger
            if size > window:
                classes.setdefault(size, []).extend((item, tokens[at : at + size]) for at in sorted({0, len(tokens) - size}))
            for at in range(len(tokens) - window + 1):
                key = tuple(tokens[at : at + window])
                owners.append((texts.setdefault(key, len(texts)), item, at))
        self.texts = list(texts)
        n = len(self.texts)
        self.s, self.w = np.zeros((n, self.each), np.uint64), np.zeros((n, self.each), np.int32)
        self.prints = np.zeros(n, np.uint64)
        for k, key in enumerate(self.texts):
            s, w = _shingles(*hasher(list(key)), shingle)
            self.s[k], self.w[k] = s, w
            self.prints[k] = _fingerprints(_running(s, w), self.each)[0]
        owners.sort()
        table = np.array(owners, np.int64).reshape(-1, 3)
        self.first = np.searchsorted(table[:, 0], np.arange(n + 1))
        self.item, self.offset = table[:, 1], table[:, 2]
        self.sized = [ItemWindows(size, windows, shingle, item_radius, similarity, hasher) for size, windows in sorted(classes.items())]
        # Blocks of 64 / (radius + 1) bits; the last takes what is left over.
        bits = 64 // (radius + 1)
        self.blocks = []
        for b in range(radius + 1):
            shift, mask = np.uint64(b * bits), np.uint64((1 << (bits if b < radius else 64 - b * bits)) - 1)
            value = (self.prints >> shift) & mask
            order = np.argsort(value, kind="stable")
            self.blocks.append((shift, mask, value[order], order))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (position, window) whose fingerprints are within the radius."""
        found = []
        for shift, mask, values, order in self.blocks:
            value = (prints >> shift) & mask
            low, high = np.searchsorted(values, value, "left"), np.searchsorted(values, value, "right")
            count = high - low
            hit = np.flatnonzero(count)
            if not len(hit):
                continue
            count = count[hit]
            at = np.repeat(hit, count)
            k = order[np.repeat(low[hit] - np.cumsum(count) + count, count) + np.arange(len(at))]
            close = np.bitwise_count(prints[at] ^ self.prints[k]) <= self.radius
            found.append(at[close] * len(self.prints) + k[close])
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pairs // max(1, len(self.prints)), pairs % max(1, len(self.prints))

    def matches(self, tokens: list[str], doc: np.ndarray, hasher: Hasher) -> Iterator[tuple[int, int, int, float, bool]]:
        """(position, window, item, similarity, whether word for word) of each verified window of the word stream; a
        window doesn't span two documents. Short windows come in order of position and have a number instead of an
        item, item-sized ones the other way round."""
        h, weight = hasher(tokens)
        largest = max([self.window, *(x.size for x in self.sized)])
        step = max(CHUNK, 2 * largest)
        for start in range(0, len(tokens) - self.window + 1, step):
            stop = min(len(tokens), start + step + largest - 1)
            s, w = _shingles(h[start:stop], weight[start:stop], self.shingle)
            total = _running(s, w)
            for kind in self.sized:
                for p, item, sim in kind.matches(total, s, w, doc[start:stop], step):
                    yield p + start, -1, item, sim, False
            at, k = self.near(_fingerprints(total[: step + self.each], self.each))
            whole = doc[start + at] == doc[start + at + self.window - 1]
            at, k = at[whole], k[whole]
            if not len(at):
                continue
            a = at[:, None] + np.arange(self.each)
            same = s[a][:, :, None] == self.s[k][:, None, :]
            both = (w[a] * same.any(2)).sum(1)
            union = w[a].sum(1) + (self.w[k] * ~same.any(1)).sum(1)
            sim = both / np.maximum(union, 1)
            for p, window, value in zip(at[sim >= self.similarity] + start, k[sim >= self.similarity], sim[sim >= self.similarity]):
                yield int(p), int(window), -1, float(value), tuple(tokens[p : p + self.window]) == self.texts[window]

    def leaks(self, doc_ids: list[int], texts: list[list[str]], hasher: Hasher) -> list[tuple[int, int, int, int, float]]:
        """(doc_id, item_id, words of the longest exact run, verified windows, best similarity)."""
        if not len(self.prints) or not texts:
            return []
        tokens = [w for t in texts for w in t]
        doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        found: dict[tuple[int, int], list] = {}
        runs: dict[tuple[int, int, int], tuple[int, int]] = {}  # (doc, item, diagonal): last position, windows in a row
        for p, k, item, sim, exact in self.matches(tokens, doc, hasher):
            if k < 0:
                entry = found.setdefault((int(doc[p]), item), [0, 0, 0.0])
                entry[1] += 1
                entry[2] = max(entry[2], sim)
                continue
            for o in range(self.first[k], self.first[k + 1]):
                key = (int(doc[p]), int(self.item[o]))
                entry = found.setdefault(key, [0, 0, 0.0])
                entry[1] += 1
                entry[2] = max(entry[2], sim)
                if exact:
                    line = (*key, p - int(self.offset[o]))
                    last, length = runs.get(line, (-2, 0))
                    length = length + 1 if last == p - 1 else 1
                    runs[line] = (p, length)
                    entry[0] = max(entry[0], length + self.window - 1)
        return [(doc_ids[d], i, run, n, sim) for (d, i), (run, n, sim) in found.items()]


def leaked_items(
    documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 12, shingle: int = 5, radius: int = 3, similarity: float = 0.8, item_radius: int = 15, body: Callable[[str | None], str] = mail.visible, block_items: int = BLOCK_ITEMS
) -> DataFrame:
    """One row per document and item of which it carries a passage: ``doc_id, item_id, longest_run, windows, similarity``.

    ``longest_run`` is the length in words of the longest passage carried word for word (0: only similar ones),
    ``windows`` how many verified windows of either size there are, ``similarity`` the best one. `radius` holds for the
    short windows, `item_radius` for the item-sized ones: shingles of which 0.8 are shared lead to fingerprints some 10
    of 64 bits apart, seldom more than 15. `body` turns a text into what counts of it. Items shorter than `window` words can't be carried. A null or empty text, on either side, matches nothing; a
    passage shared by several items counts for each; repeated documents are judged one by one; an empty table gives no
    rows. Texts are read whole. Other columns aren't read.
    """
    wanted = items.filter(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t"))
    size = wanted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("chars")).first()
    blocks = max(pieces(size["n"], block_items), pieces(size["chars"], BLOCK_CHARS))
    corpus = documents.filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    if blocks > 1:

        def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(text=[" ".join(words(body(t))) for t in batch["text"]])

        corpus, body = checkpoint(corpus.mapInPandas(decode, "doc_id bigint, text string")), lambda t: t  # read once, scanned often
    out = "doc_id bigint, item_id bigint, longest_run int, windows int, similarity double"
    result = None
    for b in range(blocks):
        part = wanted if blocks == 1 else wanted.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)
        held = documents.sparkSession.sparkContext.broadcast([(r["i"], r["t"]) for r in part.collect()])

        def scan(batches: Iterator[pd.DataFrame], held=held, body=body) -> Iterator[pd.DataFrame]:
            index, hasher = PassageIndex(held.value, window, shingle, radius, similarity, item_radius), Hasher()
            for batch in batches:
                rows, ids, texts, size = [], [], [], 0
                for ident, t in zip(batch["doc_id"], batch["text"]):
                    ids.append(ident)
                    texts.append(words(body(t)))
                    size += len(texts[-1])
                    if size > 200_000:
                        rows += index.leaks(ids, texts, hasher)
                        ids, texts, size = [], [], 0
                rows += index.leaks(ids, texts, hasher)
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "longest_run", "windows", "similarity"])

        one = corpus.mapInPandas(scan, out)
        result = one if result is None else result.unionByName(one)
    return result
