"""Exact confidence of hierarchical joins by relational plans alone.

For independent tables joined on equal columns the probability factors if the join columns nest: for any two of them, the
sets of tables that have them are disjoint or one contains the other. Then the answer is a tree of two steps, both native
and combining on the map side: join independent parts and multiply, and project a column away with 1 - Π(1 - p). Nothing
is ever joined before what can be projected away has been.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyworlds.functions.conditions import disjunction
from manyworlds.model import NotSupported


class NotHierarchical(NotSupported):
    """The join columns don't nest: use UTable.conf."""


def _classes(tables: Sequence[str], equal: Sequence[tuple[str, str]], by: Sequence[str]) -> dict[str, set[str]]:
    """Equality classes of ``table.column`` names, by a representative."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in equal:
        parent[find(a)] = find(b)
    for b in by:
        find(b)
    out: dict[str, set[str]] = {}
    for x in list(parent):
        if x.split(".", 1)[0] not in tables:
            raise NotSupported(f"{x} is of no table of the query")
        out.setdefault(find(x), set()).add(x)
    return out


def is_hierarchical(tables: Sequence[str], equal: Sequence[tuple[str, str]], by: Sequence[str] = ()) -> bool:
    """Whether the join columns nest, those of `by` being constants of a group."""
    classes = _classes(tables, equal, by)
    head = {k for k, members in classes.items() if members & set(by)}
    held = [{x.split(".", 1)[0] for x in members} for k, members in classes.items() if k not in head]
    return all(not a & b or a <= b or b <= a for i, a in enumerate(held) for b in held[i + 1 :])


def safe_conf(tables: dict[str, tuple[DataFrame, str]], equal: Sequence[tuple[str, str]], by: Sequence[str] = (), name: str = "conf") -> DataFrame:
    """conf() of a join of independent tables.

    `tables` maps a name to a table and the column with its rows' probabilities, `equal` lists pairs of equal
    ``table.column``, `by` the columns to group by. Rows with a null join column match nothing; rows that are alike are
    independent of each other. Without `by` the result is one row, 0 if nothing can match. A table can't be joined with
    itself. Raises NotHierarchical if there is no such plan.
    """
    if not is_hierarchical(list(tables), equal, by):
        raise NotHierarchical("the join columns don't nest")
    classes = _classes(list(tables), equal, by)
    number = {k: f"_c{i}" for i, k in enumerate(sorted(classes))}
    leaves: dict[str, tuple[DataFrame, set[str]]] = {}
    for t, (df, p) in tables.items():
        columns = {}
        for k, members in classes.items():
            own = sorted(x.split(".", 1)[1] for x in members if x.split(".", 1)[0] == t)
            for extra in own[1:]:
                df = df.filter(F.col(own[0]) == F.col(extra))
            if own:
                columns[number[k]] = own[0]
                if len({x.split(".", 1)[0] for x in members}) > 1:
                    df = df.filter(F.col(own[0]).isNotNull())
        leaves[t] = df.select(*(F.col(c).alias(a) for a, c in columns.items()), F.col(p).cast("double").alias("_p")), set(columns)

    def project(df: DataFrame, keep: set[str]) -> DataFrame:
        keys = sorted(keep)
        return df.groupBy(*keys).agg(disjunction(F.col("_p")).alias("_p")) if keys else df.agg(disjunction(F.col("_p")).alias("_p"))

    def plan(rels: list[str], head: set[str]) -> tuple[DataFrame, set[str]]:
        if len(rels) == 1:
            df, own = leaves[rels[0]]
            return project(df, own & head), own & head
        groups: list[tuple[set[str], list[str]]] = []
        for r in rels:
            own, mates = leaves[r][1] - head, [r]
            for g in [g for g in groups if g[0] & own]:
                groups.remove(g)
                own, mates = own | g[0], g[1] + mates
            groups.append((own, mates))
        if len(groups) > 1:
            parts = [plan(g, head) for _, g in groups]

            def both(a: tuple[DataFrame, set[str]], b: tuple[DataFrame, set[str]]) -> tuple[DataFrame, set[str]]:
                right = b[0].withColumnRenamed("_p", "_q")
                shared = sorted(a[1] & b[1])
                joined = a[0].join(right, shared) if shared else a[0].crossJoin(right)
                return joined.withColumn("_p", F.col("_p") * F.col("_q")).drop("_q"), a[1] | b[1]

            return reduce(both, parts)
        root = set.intersection(*(leaves[r][1] for r in rels)) - head
        df, own = plan(rels, head | root)
        return project(df, own & head), own & head

    head = {number[k] for k, members in classes.items() if members & set(by)}
    result, _ = plan(list(tables), head)
    of = {x: number[k] for k, members in classes.items() for x in members}
    if by:
        result = result.filter(F.col("_p") > 0)
    return result.select(*(F.col(of[b]).alias(b.split(".", 1)[1]) for b in by), F.col("_p").alias(name))
