"""Column expressions over conditions.

A row's condition is the conjunction of its atoms "variable v has value d", each with its probability p:
``ARRAY<STRUCT<v BIGINT, d BIGINT, p DOUBLE>>``, sorted by variable. The empty array is the condition of a certain row.
Everything here is built from Spark's higher-order functions and stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The name of the condition column.
COND = "_cond"
ATOM = "struct<v:bigint,d:bigint,p:double>"


def certain() -> Column:
    """The condition of a row that is in every world."""
    return F.array().cast(f"array<{ATOM}>")


def atom(v: Column, d: Column, p: Column) -> Column:
    """The condition with one atom."""
    return F.array(F.struct(v.cast("bigint").alias("v"), d.cast("bigint").alias("d"), p.cast("double").alias("p")))


def consistent(a: Column, b: Column) -> Column:
    """Whether no variable has one value in `a` and another in `b`."""
    return F.forall(a, lambda x: F.forall(b, lambda y: (x["v"] != y["v"]) | (x["d"] == y["d"])))


def merged(a: Column, b: Column) -> Column:
    """Both conditions, given that they are consistent: an atom of both counts once, with `a`'s probability. (The
    probabilities of one atom may differ in their last bits if it was computed twice, so atoms aren't compared by it.)"""
    return F.array_sort(F.concat(a, F.filter(b, lambda y: ~F.exists(a, lambda x: x["v"] == y["v"]))))


def tconf(cond: Column) -> Column:
    """The probability of a row's own condition: atoms repeated count once, contradictory ones give 0."""
    once = F.filter(F.transform(cond, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: ~F.exists(F.slice(cond, 1, y["i"]), lambda z: z["v"] == y["x"]["v"]))
    clash = F.exists(cond, lambda x: F.exists(cond, lambda y: (x["v"] == y["v"]) & (x["d"] != y["d"])))
    return F.when(clash, F.lit(0.0)).otherwise(F.aggregate(once, F.lit(1.0), lambda acc, y: acc * y["x"]["p"]))


def clean_tconf(cond: Column) -> Column:
    """The same for conditions made by this library, which are consistent and name no variable twice."""
    return F.aggregate(cond, F.lit(1.0), lambda acc, x: acc * x["p"])


def weight(w: Column) -> Column:
    """`w` as a double; negative weights are an error."""
    w = w.cast("double")
    return F.when(w < 0, F.raise_error(F.concat(F.lit("negative weight: "), w.cast("string")))).otherwise(w)


def probability(p: Column) -> Column:
    """`p` as a double; values outside [0, 1] are an error."""
    p = p.cast("double")
    return F.when((p < 0) | (p > 1) | F.isnan(p), F.raise_error(F.concat(F.lit("probability outside [0,1]: "), p.cast("string")))).otherwise(p)


def disjunction(p: Column) -> Column:
    """1 - Π(1 - p) over a group of independent events: an aggregate that combines on the map side. 0 for no rows."""
    return F.coalesce(F.lit(1.0) - F.product(F.lit(1.0) - p), F.lit(0.0))
