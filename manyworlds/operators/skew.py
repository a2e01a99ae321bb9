"""Per-key results when a few keys own most of the rows: eager aggregation through the join.

Joining two tables on a hot key first and aggregating afterwards costs rows(left, key) x rows(right, key) for that key,
all in one task. Counts and sums factor over an equi-join, so each side is aggregated by the join key before it: the map
side combines, at most one row per key and map task is shuffled, and the join itself meets one compact state per key
and side. Joined counts are products of counts, joined sums are sums times the other side's count. Anything coarser is
rolled up from those states.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_states(df: DataFrame, keys: Sequence[str], sums: dict[str, Column | str] | None = None, rows: str = "rows") -> DataFrame:
    """One compact state per key: the number of rows and the sum of each expression of `sums`.

    Null keys form a group of their own; nulls of a summed expression don't count, a sum of nothing is 0.
    An empty table gives no state. Columns beside the keys and the summed ones aren't read.
    """
    sums = {n: F.col(e) if isinstance(e, str) else e for n, e in (sums or {}).items()}
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(rows), *(F.coalesce(F.sum(e), F.lit(0)).alias(n) for n, e in sums.items()))


def times(a: str, b: str) -> Column:
    """The product of two counts as decimal(38,0): those of hot keys pass 64 bits; null beyond 38 digits, never an error."""
    return F.try_multiply(F.col(a).cast("decimal(19,0)"), F.col(b).cast("decimal(19,0)")).cast("decimal(38,0)")


def eager_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_sums: dict[str, Column | str] | None = None, right_sums: dict[str, Column | str] | None = None, how: str = "full") -> DataFrame:
    """Per key, what aggregating the joined rows would give, without ever forming them.

    Columns: the keys, ``left_rows``, ``right_rows``, each named sum of its own side, ``joined_rows`` (a decimal) and for each sum
    ``joined_<name>``, its total over the joined rows. With ``how="full"`` keys of either side stay with zeros for
    the missing side. Null keys are a group on each side but match nothing, as in any equi-join, so with ``full``
    they appear once for each side that has them.
    """
    left_sums, right_sums = dict(left_sums or {}), dict(right_sums or {})
    a = key_states(left, keys, left_sums, "left_rows")
    b = key_states(right, keys, right_sums, "right_rows")
    joined = a.join(b, list(keys), how)
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("left_rows", *left_sums, "right_rows", *right_sums)]
    state = joined.select(*keys, *zero)
    return state.select(
        "*",
        times("left_rows", "right_rows").alias("joined_rows"),
        *((F.col(n) * F.col("right_rows")).alias(f"joined_{n}") for n in left_sums),
        *((F.col(n) * F.col("left_rows")).alias(f"joined_{n}") for n in right_sums),
    )


def rolled_join(left: DataFrame, right: DataFrame, keys: Sequence[str], by: Sequence[str], left_sums: dict[str, Column | str] | None = None) -> DataFrame:
    """Joined row count and joined sums of `left` per `by` (columns of `left`), rolled up from states per key.

    The left state is kept per (key, by); the right one per key. Unmatched keys add nothing (inner join).
    """
    left_sums = dict(left_sums or {})
    a = key_states(left, [*keys, *by], left_sums, "left_rows")
    b = key_states(right, keys, None, "right_rows")
    state = a.join(b, list(keys))
    return state.groupBy(*by).agg(
        F.try_sum(times("left_rows", "right_rows")).alias("joined_rows"),
        *(F.sum(F.col(n) * F.col("right_rows")).alias(f"joined_{n}") for n in left_sums),
    )


def heavy_keys(left: DataFrame, right: DataFrame, key: str, labels: tuple[str, str], one_in: int = 50) -> DataFrame:
    """(src_table, key): the non-null keys that hold at least one `one_in`-th of the rows of a table.

    Both tables' counts come from the states of :func:`eager_join`; each table's total is a plain row count, which
    Parquet answers from its footers. A table without rows has no heavy key.
    """
    totals = [left.count(), right.count()]
    states = eager_join(left, right, [key])
    sides = F.array(*(F.struct(F.lit(label).alias("src_table"), F.col(c).alias("n"), F.lit(t).alias("total")) for label, c, t in zip(labels, ("left_rows", "right_rows"), totals)))
    each = states.filter(F.col(key).isNotNull()).select(key, F.explode(sides).alias("s"))
    return each.filter((F.col("s.n") > 0) & (F.col("s.n") * one_in >= F.col("s.total"))).select("s.src_table", key)
