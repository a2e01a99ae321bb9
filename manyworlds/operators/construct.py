"""From certain tables to uncertain ones.

Variables and values are named by hashes of what they stand for and of the operation that made them. A recomputed or
retried task finds the same names, and no coordination is needed; each call makes variables of its own, so two calls
over one table are independent, while a table used twice is the same in both places.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyworlds.functions.conditions import COND, atom, certain, probability, weight
from manyworlds.model import INDEPENDENT, UNCERTAIN, NotSupported, UTable

_calls, _run = itertools.count(1), uuid.uuid4().hex


def _salt(salt: str | None) -> str:
    return salt if salt is not None else f"{_run}/{next(_calls)}"


def _plain(source: DataFrame | UTable, what: str) -> DataFrame:
    if isinstance(source, UTable):
        if not source.is_certain:
            raise NotSupported(f"{what} isn't supported on uncertain tables")
        return source.data()
    return source


def repair_key(source: DataFrame | UTable, key: Sequence[str], by: str | Column | None = None, *, distinct: bool = False, salt: str | None = None) -> UTable:
    """In each world exactly one distinct row of each group that agrees in `key`.

    A row's chance is its weight over the sum of the group's distinct rows, or one over their number without `by`.
    Repeated rows stay, with one variable, value and chance between them. Rows of weight 0 or null are in no world;
    a negative weight is an error. Nulls are equal to each other, as in grouping. An empty key repairs the whole table.
    `distinct` states that no row is repeated, which spares comparing whole rows.
    """
    df = _plain(source, "repair_key")
    data, name = df.columns, _salt(salt)
    w = weight(F.col(by) if isinstance(by, str) else by) if by is not None else F.lit(1.0)
    weighed = df.withColumn("_w", w).filter(F.col("_w") > 0)
    # One row per distinct row, then one sum per key: both combine on the map side, and a key's sum joins as one row.
    sums = weighed.select(*(F.col(c).alias(f"_x{i}") for i, c in enumerate(data)), "_w")
    if not distinct:
        sums = sums.groupBy(*(f"_x{i}" for i in range(len(data)))).agg(F.first("_w").alias("_w"))
    places = [data.index(k) for k in key]
    sums = sums.groupBy(*(F.col(f"_x{i}").alias(f"_k{i}") for i in places)).agg(F.sum("_w").alias("_sum"))
    if key:
        joined = weighed.join(sums, reduce(lambda a, b: a & b, [F.col(data[i]).eqNullSafe(F.col(f"_k{i}")) for i in places]))
    else:
        joined = weighed.join(F.broadcast(sums))  # one row
    own = _hash(name, list(key))
    chance = F.col("_w") / F.col("_sum")
    # A single alternative is certain, and stays an atom all the same: the table's form doesn't depend on its rows.
    return UTable(joined.select(*data, atom(own, _hash(name, data), chance).alias(COND)), UNCERTAIN, 1, frozenset([name]))


def _hash(salt: str, columns: Sequence[str]) -> Column:
    """A 64-bit name that tells nulls and empty values apart."""
    return F.xxhash64(F.lit(salt), *(F.struct(F.col(c).isNull(), F.col(c)) for c in columns)) if columns else F.xxhash64(F.lit(salt), F.lit(0))


def pick_tuples(source: DataFrame | UTable, chance: str | float | Column = 0.5, *, row_id: Sequence[str] | None = None, salt: str | None = None) -> UTable:
    """Each row, repeated ones too, is there or not on its own, with its `chance` (0.5 unless stated).

    A chance outside [0, 1] is an error; rows of chance 0 or null are in no world. Rows need names: `row_id` columns that
    tell them apart spare the numbering of equal rows, which is done otherwise where a question needs the names (a join
    with another uncertain table, a union, a written table).
    """
    df = _plain(source, "pick_tuples")
    p = probability(F.col(chance) if isinstance(chance, str) else chance if isinstance(chance, Column) else F.lit(float(chance)))
    name, data = _salt(salt), df.columns
    picked = df.withColumn("_chance", p).filter(F.col("_chance") > 0)
    if row_id is not None:
        return UTable(picked.select(*data, atom(_hash(name, list(row_id)), F.lit(1), F.col("_chance")).alias(COND)), INDEPENDENT, 1, frozenset([name]))
    # Equal rows are interchangeable: each distinct one is kept once with its number of copies, which are numbered.
    copies = picked.groupBy(*data).agg(F.first("_chance").alias("_chance"), F.count(F.lit(1)).alias("_copies"))
    numbered = copies.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
    v = F.xxhash64(_hash(name, data), F.col("_copy"))
    light = picked.select(*data, atom(F.lit(0), F.lit(1), F.col("_chance")).alias(COND))
    return UTable(numbered.select(*data, atom(v, F.lit(1), F.col("_chance")).alias(COND)), INDEPENDENT, 1, frozenset([name]), light)


def as_certain(df: DataFrame) -> UTable:
    """A certain table among uncertain ones."""
    return UTable(df.withColumn(COND, certain()))
