"""Relational operators that Spark has no word for, each a composition of built-in ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from manyworlds.plans.runtime import checkpoint


def nulls_last(*columns: str) -> list[Column]:
    """Ascending order with nulls at the end, which is not Spark's default."""
    return [F.col(c).asc_nulls_last() for c in columns]


def placed(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """All rows in an order, each with its place in it, from 1 on.

    The rows are range-sorted and kept; a row's place is the number of rows in the partitions before its own and its
    place there. Only the partitions' counts are summed in one task. Rows that tie in the order are placed as they come.
    """
    part, before = "_part", "_before"
    kept = checkpoint(df.orderBy(*order)).select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias(name))
    counts = kept.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(part, F.coalesce(F.sum("_n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    return kept.join(F.broadcast(starts), part).select(*df.columns, (F.col(before) + F.col(name) + 1).alias(name))


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], descending: bool = False) -> DataFrame:
    """One row per key: the first in the order of some columns (the last, if `descending`).

    An aggregate rather than a numbering, so a hot key combines on the map side. Rows that tie in the order are told
    apart by their whole content. Nulls come first in ascending order.
    """
    row = F.struct(*df.columns)
    pick = F.max_by if descending else F.min_by
    return df.groupBy(*keys).agg(pick(row, F.struct(*order, row)).alias("_row")).select("_row.*")


def crosstab(df: DataFrame, row: str, category: str, value: str, categories: Sequence[str]) -> DataFrame:
    """One row per `row` with a column per category holding the (greatest) value; missing ones are null."""
    return df.filter(F.col(category).isin(*categories)).groupBy(row).pivot(category, list(categories)).agg(F.max(value))


def connect_by(edges: DataFrame, parent: str, child: str, start: Column, depth: int = 0) -> DataFrame:
    """The tree below a node: ``node, parent, level, branch``, level by level. `depth` 0 is unlimited.

    One join per level, with the lineage cut after each; a node that comes again on its own branch ends the branch.
    """
    step = edges.select(F.col(parent).alias("_p"), F.col(child).alias("_c"))
    level = edges.sparkSession.range(1).select(start.alias("node"), F.lit(None).cast(step.schema["_p"].dataType).alias("parent"), F.lit(0).alias("level"), F.array(start).alias("branch"))
    out, n = level, 0
    while depth == 0 or n < depth:
        below = level.join(step, level["node"] == step["_p"]).filter(~F.array_contains("branch", F.col("_c")))
        level = checkpoint(below.select(F.col("_c").alias("node"), F.col("_p").alias("parent"), (F.col("level") + 1).alias("level"), F.concat("branch", F.array("_c")).alias("branch")))
        if not level.limit(1).count():
            break
        out, n = out.unionByName(level), n + 1
    return out.withColumn("branch", F.array_join(F.col("branch").cast("array<string>"), "~"))


def normal_rand(df: DataFrame, mean: float, deviation: float, seed: int, key: Sequence[str], name: str = "value") -> DataFrame:
    """A normal value per row, from hashes of its key: the same on every attempt (Box-Muller)."""
    u = [(F.xxhash64(F.lit(seed), F.lit(i), *key).cast("double") / F.lit(2.0**64) + F.lit(0.5)) for i in (1, 2)]
    return df.withColumn(name, F.lit(mean) + F.lit(deviation) * F.sqrt(F.lit(-2.0) * F.log(F.greatest(u[0], F.lit(1e-300)))) * F.cos(F.lit(2) * F.pi() * u[1]))


def upsert(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of `target` replaced by those of `rows` with the same key, and the rest of `rows` added."""
    return target.join(rows.select(*keys).distinct(), list(keys), "left_anti").unionByName(rows.select(target.columns))
