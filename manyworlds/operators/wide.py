"""Entity, attribute, value rows reshaped into one typed row per entity.

The entity-by-attribute grid is completed, the latest values are joined to it from the left and collected as an array
in the order of the attributes' positions. The grid being complete, attribute i is always element i, so every column is
a fixed index with the cast of its type. The grid and its join are evaluated inside the entity's row (all positions on
the left, the entity's few values on the right): the same rows as a join of two tables, without shuffling the grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings of yes and no (fixed values of this operator, compared without case and outer blanks).
YES = ("y", "yes", "t", "true", "1")
NO = ("n", "no", "f", "false", "0")


def typed(value: Column, kind: str) -> Column:
    """`value` (a trimmed string) as `kind`; what doesn't fit is null, never an error. A decimal or double may end in ``%``."""
    if kind == "boolean":
        low = F.lower(value)
        return F.when(low.isin(*YES), F.lit(True)).when(low.isin(*NO), F.lit(False))
    if kind == "double" or kind.startswith("decimal"):
        share = F.regexp_extract(value, r"^([0-9]+(?:\.[0-9]*)?|\.[0-9]+)\s*%$", 1)
        wide = F.when(share != "", share.try_cast("decimal(38,10)") / 100).otherwise(value.try_cast("decimal(38,10)"))
        return wide.try_cast(kind)
    if kind == "date":
        return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value.try_cast("date"))
    if kind in ("int", "bigint"):
        return F.when(value.rlike(r"^[+-]?\d+$"), value.try_cast(kind))
    return value if kind == "string" else value.try_cast(kind)


#: Types that values are tried as, narrowest first.
KINDS = ("boolean", "int", "double", "date")


def attribute_kinds(df: DataFrame, attribute: str, value: str, share: float = 0.8) -> DataFrame:
    """``attribute, kind, filled, fitting``: the narrowest type of KINDS that at least `share` of an attribute's usable
    values fit, else string; and how many there are and fit. Names are matched as in :func:`widen`; blank and null ones
    are none, and neither are attributes without a usable value. Every row is looked at, on the map side."""
    told = F.trim(F.col(value))
    rows = df.select(F.lower(F.trim(F.col(attribute))).alias("attribute"), F.when(told != "", told).alias("val")).filter("attribute <> '' and val is not null")
    counts = rows.groupBy("attribute").agg(F.count(F.lit(1)).alias("filled"), *(F.count(typed(F.col("val"), k)).alias(f"as_{k}") for k in KINDS))
    best = F.coalesce(*(F.when(F.col(f"as_{k}") >= share * F.col("filled"), F.struct(F.lit(k).alias("kind"), F.col(f"as_{k}").alias("fitting"))) for k in KINDS), F.struct(F.lit("string").alias("kind"), F.col("filled").alias("fitting")))
    return counts.withColumn("best", best).select("attribute", "best.kind", "filled", "best.fitting")


def found_types(df: DataFrame, attribute: str, value: str, share: float = 0.8, most: int = 2000) -> dict[str, str]:
    """The attributes of a table that keeps changing, with their types, for :func:`widen`. A wide table can't have more
    than `most` columns: beyond that it is an error."""
    rows = attribute_kinds(df, attribute, value, share).select("attribute", "kind").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} attributes")
    return dict(sorted((r["attribute"], r["kind"]) for r in rows))


def widen(df: DataFrame, entity: str, attribute: str, value: str, types: dict[str, str], order: list[str]) -> DataFrame:
    """One row per trimmed, non-null `entity` with one column per attribute of `types` (name -> Spark type).

    Attribute names are matched without case and outer blanks. Of several rows of one entity and attribute the last by
    `order` counts (a revision replaces what it revises), rows with a null or blank value being passed over; a value
    that doesn't fit its type gives null. Attributes outside `types` add nothing, but their entity still has its row.
    Entities without a usable value have a row of nulls; an empty input gives no rows. Other columns of `df` are not
    read, so their names can't clash; a hot entity is reduced to one row per attribute before anything is shuffled.
    """
    names = list(types)
    where = F.array_position(F.array(*(F.lit(n.lower()) for n in names)), F.lower(F.trim(F.col(attribute)))) - 1
    told = F.trim(F.col(value))
    rows = df.filter(F.col(entity).isNotNull()).select(
        F.trim(F.col(entity)).alias("e"), F.coalesce(where, F.lit(-1)).cast("int").alias("pos"), F.when(told != "", told).alias("val"), F.struct(*(F.col(c) for c in order)).alias("at")
    )
    latest = rows.groupBy("e", "pos").agg(F.max_by("val", F.when(F.col("val").isNotNull(), F.struct("at", "val"))).alias("val"))
    kept = latest.groupBy("e").agg(F.collect_list(F.struct("pos", "val")).alias("kept"))
    # An entity's side of the grid is a null cell per position; its kept values (at most len(types) + 1) are joined to it
    # by sorting both by position, where a kept value comes behind the null of its cell: the last of a position stays.
    empty = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.struct(i.alias("pos"), F.lit(None).cast("string").alias("val"))) if names else F.array().cast("array<struct<pos:int,val:string>>")
    both = kept.select("e", F.array_sort(F.concat(empty, F.filter("kept", lambda k: k["pos"] >= 0))).alias("both"))
    grid = both.select("e", F.filter("both", lambda x, i: ~F.get("both", i + 1)["pos"].eqNullSafe(x["pos"])).alias("cells"))
    return grid.select(F.col("e").alias(entity), *(typed(F.get("cells", F.lit(i))["val"], kind).alias(n) for i, (n, kind) in enumerate(types.items())))
