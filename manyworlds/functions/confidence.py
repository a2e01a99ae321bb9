"""Probability of a disjunction of conditions: exact, with guaranteed bounds, and by sampling.

Pure functions over the lineage of one group. A lineage is a list of clauses, a clause maps variables to values; the
probabilities of values are given beside it. What a variable's listed values leave of 1 belongs to values that no clause
mentions.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections import Counter
from collections.abc import Iterable

import numpy as np

Clause = frozenset  # of (variable, value)
Lineage = frozenset  # of clauses

#: Values of one variable may add up to this much before it counts as an error.
MOST = 1.01


class TooHard(RuntimeError):
    """The exact computation would take more steps than allowed."""


def lineage_of(variables: Iterable, values: Iterable, chances: Iterable) -> tuple[Lineage, dict[tuple[int, int], float]]:
    """The clauses of rows given as parallel arrays, without contradictory ones, and the probability of each atom."""
    p: dict[tuple[int, int], float] = {}
    clauses = set()
    for vs, ds, ps in zip(variables, values, chances):
        c: dict[int, int] = {}
        sound = True
        for v, d, x in zip(vs, ds, ps):
            v, d = int(v), int(d)
            p[v, d] = max(float(x), p.get((v, d), 0.0))
            sound &= c.setdefault(v, d) == d
        if sound and all(p[a] > 0 for a in c.items()):
            clauses.add(frozenset(c.items()))
    total: Counter[int] = Counter()
    for (v, _), x in p.items():
        total[v] += x
    for v, x in total.items():
        if x > MOST:
            raise ValueError(f"the values of variable {v} have probabilities that add up to {x:.4f}")
    return frozenset(clauses), p


def _absorbed(clauses: Iterable[Clause]) -> set[Clause]:
    """Without the clauses that another one's atoms already imply."""
    kept: list[Clause] = []
    by_atom: dict[tuple, list[Clause]] = {}
    for c in sorted(clauses, key=len):
        if any(k <= c for a in c for k in by_atom.get(a, ())):
            continue
        kept.append(c)
        if c:
            by_atom.setdefault(min(c), []).append(c)
    return set(kept)


def components(clauses: Iterable[Clause]) -> list[set[Clause]]:
    """Groups of clauses that share no variable with any other group."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    clauses = list(clauses)
    for c in clauses:
        first, *rest = [v for v, _ in c]
        for v in rest:
            parent[find(v)] = find(first)
    out: dict[int, set[Clause]] = {}
    for c in clauses:
        out.setdefault(find(next(iter(c))[0]), set()).add(c)
    return list(out.values())


def _pivot(clauses: Iterable[Clause]) -> int:
    """The variable in most clauses; the smallest of several."""
    seen = Counter(v for c in clauses for v, _ in c)
    return min(seen, key=lambda v: (-seen[v], v))


def _split(clauses: Iterable[Clause], v: int) -> tuple[dict[int, set[Clause]], set[Clause]]:
    """The clauses by their value of `v`, without that atom, and those without `v`."""
    by: dict[int, set[Clause]] = {}
    rest: set[Clause] = set()
    for c in clauses:
        d = next((d for w, d in c if w == v), None)
        if d is None:
            rest.add(c)
        else:
            by.setdefault(d, set()).add(c - {(v, d)})
    return by, rest


def exact(clauses: Lineage, p: dict[tuple[int, int], float], steps: int = 2_000_000) -> float:
    """The probability that at least one clause holds. Raises TooHard beyond `steps` decompositions.

    Independent components multiply; a common atom is taken out; otherwise the worlds are split by the values of the
    most frequent variable. Parts seen before aren't solved again.
    """
    memo: dict[Lineage, float] = {}
    left = steps

    def solve(clauses: set[Clause]) -> float:
        nonlocal left
        if not clauses:
            return 0.0
        if frozenset() in clauses:
            return 1.0
        if len(clauses) == 1:
            return math.prod(p[a] for a in next(iter(clauses)))
        key = frozenset(clauses)
        if (known := memo.get(key)) is not None:
            return known
        left -= 1
        if left < 0:
            raise TooHard(f"more than {steps} decompositions")
        clauses = _absorbed(clauses)
        parts = components(clauses)
        if len(parts) > 1:
            none = 1.0
            for part in parts:
                none *= 1.0 - solve(part)
            result = 1.0 - none
        elif common := frozenset.intersection(*clauses):
            result = math.prod(p[a] for a in common) * solve({c - common for c in clauses})
        else:
            v = _pivot(clauses)
            by, rest = _split(clauses, v)
            result, other = 0.0, 1.0
            for d, own in sorted(by.items()):
                result += p[v, d] * solve(own | rest)
                other -= p[v, d]
            if other > 1e-12:
                result += other * solve(rest)
        memo[key] = result
        return result

    import sys

    depth = sys.getrecursionlimit()
    sys.setrecursionlimit(max(depth, 20_000))
    try:
        return solve(set(clauses))
    finally:
        sys.setrecursionlimit(depth)


def bucket_bounds(clauses: Iterable[Clause], p: dict[tuple[int, int], float]) -> tuple[float, float]:
    """Bounds without decomposition: clauses are put, likeliest first, into buckets of independent ones; the likeliest
    bucket is a lower bound, the sum of the buckets an upper one."""
    buckets: list[tuple[set[int], float]] = []
    for c in sorted(clauses, key=lambda c: (-math.prod(p[a] for a in c), sorted(c))):
        chance, own = math.prod(p[a] for a in c), {v for v, _ in c}
        for k, (used, none) in enumerate(buckets):
            if not used & own:
                buckets[k] = (used | own, none * (1.0 - chance))
                break
        else:
            buckets.append((own, 1.0 - chance))
    held = [1.0 - none for _, none in buckets]
    return max(held, default=0.0), min(1.0, sum(held))


class _Node:
    """A part of the decomposition: a leaf has clauses, an inner node combines its children."""

    __slots__ = ("kind", "clauses", "children", "weights", "parent", "low", "high")

    def __init__(self, clauses: set[Clause], p: dict, parent: "_Node | None") -> None:
        self.kind, self.clauses, self.children, self.weights, self.parent = "leaf", clauses, [], [], parent
        if frozenset() in clauses:
            self.low = self.high = 1.0
        elif len(clauses) < 2:
            self.low = self.high = sum(math.prod(p[a] for a in c) for c in clauses)
        else:
            self.low, self.high = bucket_bounds(clauses, p)

    def refresh(self) -> None:
        if self.kind == "or":
            self.low, self.high = 1 - math.prod(1 - c.low for c in self.children), 1 - math.prod(1 - c.high for c in self.children)
        else:
            self.low, self.high = sum(w * c.low for w, c in zip(self.weights, self.children)), sum(w * c.high for w, c in zip(self.weights, self.children))


def bounded(clauses: Lineage, p: dict[tuple[int, int], float], epsilon: float, relative: bool, steps: int = 200_000) -> float:
    """An estimate within `epsilon` of the probability (of it, or of its `relative` size), guaranteed.

    The decomposition of :func:`exact` is unfolded only where its bounds are widest, until the whole is narrow enough.
    """
    root = _Node(_absorbed(clauses), p, None)
    order = itertools.count()
    open_ = [(-(root.high - root.low), next(order), root)]

    def done() -> bool:
        if relative:
            return (1 - epsilon) * root.high <= (1 + epsilon) * root.low + 1e-15
        return root.high - root.low <= 2 * epsilon + 1e-15

    while open_ and not done():
        steps -= 1
        if steps < 0:
            raise TooHard("the bounds don't close in time")
        _, _, node = heapq.heappop(open_)
        if node.high - node.low <= 0:
            continue
        clauses = _absorbed(node.clauses)
        parts = components(clauses)
        if len(parts) > 1:
            node.kind, node.children = "or", [_Node(part, p, node) for part in parts]
        elif common := frozenset.intersection(*clauses):
            node.kind, node.weights, node.children = "sum", [math.prod(p[a] for a in common)], [_Node({c - common for c in clauses}, p, node)]
        else:
            v = _pivot(clauses)
            by, rest = _split(clauses, v)
            node.kind, node.weights, node.children = "sum", [p[v, d] for d in sorted(by)], [_Node(by[d] | rest, p, node) for d in sorted(by)]
            if (other := 1.0 - sum(node.weights)) > 1e-12:
                node.weights.append(other)
                node.children.append(_Node(rest, p, node))
        node.clauses = set()
        at: _Node | None = node
        while at is not None:
            at.refresh()
            at = at.parent
        for child in node.children:
            if child.high > child.low:
                # How much of the whole the child's uncertainty can be, at most.
                share, at = child.high - child.low, child
                while at.parent is not None:
                    if at.parent.kind == "sum":
                        share *= at.parent.weights[at.parent.children.index(at)]
                    at = at.parent
                heapq.heappush(open_, (-share, next(order), child))
    if relative:
        return (root.high * (1 - epsilon) + root.low * (1 + epsilon)) / 2
    return (root.low + root.high) / 2


class _Sampler:
    """Draws of the estimator whose mean is the probability divided by the sum of the clauses' probabilities: a clause in
    proportion to its probability, a world in which it holds, and one over the number of clauses that hold there."""

    BATCH = 4096

    def __init__(self, clauses: Lineage, p: dict[tuple[int, int], float], seed: int) -> None:
        self.rng = np.random.Generator(np.random.Philox(key=seed & (2**64 - 1)))
        listed = sorted(clauses, key=sorted)
        chance = np.array([math.prod(p[a] for a in c) for c in listed])
        self.total = float(chance.sum())
        self.pick = np.cumsum(chance / self.total)
        variables = sorted({v for c in listed for v, _ in c})
        place = {v: k for k, v in enumerate(variables)}
        values: list[list[int]] = [[] for _ in variables]
        for v, d in sorted(p):
            if v in place:
                values[place[v]].append(d)
        number = {(v, d): n for v, k in place.items() for n, d in enumerate(values[k])}
        # Cumulated probabilities per variable, padded: a draw beyond the last is a value no clause mentions.
        width = max((len(x) for x in values), default=1)
        self.cum = np.full((len(variables), width), 2.0)
        for v, k in place.items():
            self.cum[k, : len(values[k])] = np.cumsum([p[v, d] for d in values[k]])
        flat = [(place[v], number[v, d]) for c in listed for v, d in sorted(c)]
        self.var, self.val = np.array([a for a, _ in flat]), np.array([b for _, b in flat], np.uint16)
        self.size = np.array([len(c) for c in listed])
        self.start = np.cumsum(self.size) - self.size
        # Clauses as rows of literal numbers, short ones padded with one that always holds.
        literals = {x: k for k, x in enumerate(dict.fromkeys(flat))}
        self.lit_var, self.lit_val = np.array([a for a, _ in literals]), np.array([b for _, b in literals], np.uint16)
        self.table = np.full((len(listed), int(self.size.max())), len(literals))
        for k, c in enumerate(listed):
            self.table[k, : len(c)] = [literals[place[v], number[v, d]] for v, d in sorted(c)]
        self.buffer = np.zeros(0)

    def draw(self, n: int) -> np.ndarray:
        out = [self.buffer]
        while sum(map(len, out)) < n:
            out.append(self._batch(max(64, min(self.BATCH, 20_000_000 // len(self.table)))))
        merged = np.concatenate(out)
        self.buffer = merged[n:]
        return merged[:n]

    def _batch(self, n: int) -> np.ndarray:
        chosen = np.minimum(np.searchsorted(self.pick, self.rng.random(n), side="right"), len(self.pick) - 1)
        u = self.rng.random((len(self.cum), n))
        world = np.zeros(u.shape, np.uint16)
        for column in self.cum.T:
            world += u >= column[:, None]
        # The chosen clause holds in its world.
        length = self.size[chosen]
        sample = np.repeat(np.arange(n), length)
        atom = np.repeat(self.start[chosen] - np.cumsum(length) + length, length) + np.arange(len(sample))
        world[self.var[atom], sample] = self.val[atom]
        # One bit per sample: which literals hold, then which clauses.
        holds = np.packbits(world[self.lit_var] == self.lit_val[:, None], axis=1)
        holds = np.vstack([holds, np.full((1, holds.shape[1]), 255, np.uint8)])
        met = holds[self.table[:, 0]]
        for column in self.table.T[1:]:
            met &= holds[column]
        return 1.0 / np.unpackbits(met, axis=1, count=n).sum(0, dtype=np.uint32)


def sampled(clauses: Lineage, p: dict[tuple[int, int], float], epsilon: float, delta: float, seed: int) -> float:
    """An estimate that is off by more than `epsilon` times the probability with a chance of at most `delta`.

    The optimal three-step stopping algorithm for means of variables in [0, 1] (stopping rule, variance, estimate),
    over the estimator of :class:`_Sampler`. The same seed gives the same result.
    """
    clauses = frozenset(_absorbed(clauses))
    if not clauses:
        return 0.0
    if frozenset() in clauses:
        return 1.0
    if len(clauses) == 1:
        return math.prod(p[a] for a in next(iter(clauses)))
    draws = _Sampler(clauses, p, seed)
    lam = math.e - 2

    def stopping(eps: float, dlt: float) -> float:
        need = 1 + (1 + eps) * 4 * lam * math.log(2 / dlt) / eps**2
        total, n = 0.0, 0
        while total < need:
            some = draws.draw(1024)
            upto = total + np.cumsum(some)
            if upto[-1] >= need:
                return need / (n + int(np.searchsorted(upto, need)) + 1)
            total, n = float(upto[-1]), n + len(some)
        return total / n

    wide = min(0.5, math.sqrt(epsilon))
    first = stopping(wide, delta / 3)
    upsilon = 4 * lam * math.log(2 / delta) / epsilon**2
    upsilon2 = 2 * (1 + math.sqrt(epsilon)) * (1 + 2 * math.sqrt(epsilon)) * (1 + math.log(1.5) / math.log(2 / delta)) * upsilon
    pairs = max(1, math.ceil(upsilon2 * epsilon / first))
    spread = 0.0
    for at in range(0, pairs, 50_000):
        some = draws.draw(2 * min(50_000, pairs - at))
        spread += float(((some[::2] - some[1::2]) ** 2).sum()) / 2
    rho = max(spread / pairs, epsilon * first)
    n = max(1, math.ceil(upsilon2 * rho / first**2))
    total = 0.0
    for at in range(0, n, 100_000):
        total += float(draws.draw(min(100_000, n - at)).sum())
    return draws.total * total / n
