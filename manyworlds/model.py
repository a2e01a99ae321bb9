"""Uncertain tables: a DataFrame whose rows carry the condition under which they exist.

Worlds are never enumerated. A row's condition is one array column, relational operators carry it along, and questions
about probabilities are aggregates over it. Whether a table is uncertain is a property of the table, not of its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from manyworlds.functions import confidence
from manyworlds.functions.conditions import ATOM, COND, certain, clean_tconf, consistent, disjunction, merged
from manyworlds.plans.runtime import checkpoint

CERTAIN, INDEPENDENT, UNCERTAIN = "certain", "independent", "uncertain"
#: Clauses of one group that a task solves at once. Groups with more are split into independent parts first, by Spark.
GROUP_CLAUSES = 20_000


class NotSupported(ValueError):
    """The operation isn't defined for tables of this kind."""


def _columns(by: Sequence[str | Column]) -> list[Column]:
    return [F.col(b) if isinstance(b, str) else b for b in by]


class UTable:
    """A table with a condition column.

    `kind` is certain, independent (every row has a variable of its own) or uncertain; `width` bounds the number of atoms
    of a condition, `sources` names the operations that made its variables (None: not known), so that tables with
    different ones are known to be independent. `light` are the same rows with unnamed variables, where naming them costs
    a shuffle: as long as rows are independent of each other, their chances are all that most questions need. Duplicates
    are kept throughout: tables are bags.
    """

    def __init__(self, df: DataFrame, kind: str = CERTAIN, width: int | None = None, sources: frozenset[str] | None = None, light: DataFrame | None = None) -> None:
        if COND not in df.columns:
            df = df.withColumn(COND, certain())
        self.df, self.kind = df, kind
        self.sources, self.light = frozenset() if kind == CERTAIN else sources, light
        self.width = width if width is not None else {CERTAIN: 0, INDEPENDENT: 1}.get(kind)

    # --- what it is ---------------------------------------------------------------------------------------------

    @property
    def columns(self) -> list[str]:
        """The data columns."""
        return [c for c in self.df.columns if c != COND]

    @property
    def is_certain(self) -> bool:
        return self.kind == CERTAIN

    def data(self) -> DataFrame:
        """The data of a certain table."""
        if not self.is_certain:
            raise NotSupported("the rows of an uncertain table aren't data by themselves; ask for possible() or conf()")
        return self.df.drop(COND)

    def chance(self) -> Column:
        """The probability of a row's condition. Of one atom it is read off, so that the names in it needn't be made."""
        if self.width is not None and self.width <= 1:
            return F.coalesce(F.get(F.col(COND), F.lit(0))["p"], F.lit(1.0))
        return clean_tconf(F.col(COND))

    def _uncertain(self, what: str) -> None:
        if self.is_certain:
            raise NotSupported(f"{what} can't be used on a certain table")

    def mapped(self, f: Callable[[DataFrame], DataFrame]) -> UTable:
        """The table after a change that neither joins nor repeats rows."""
        return UTable(f(self.df), self.kind, self.width, self.sources, None if self.light is None else f(self.light))

    @property
    def chances(self) -> DataFrame:
        """The rows with conditions that are good for their probabilities, and for nothing else if rows are independent."""
        return self.df if self.light is None or self.kind != INDEPENDENT else self.light

    def explain(self, mode: str = "formatted") -> None:
        """The physical plan."""
        self.df.explain(mode)

    # --- relational algebra -------------------------------------------------------------------------------------

    def where(self, condition: Column | str) -> UTable:
        """Rows whose data satisfy a condition; theirs stay as they are."""
        return self.mapped(lambda df: df.filter(condition))

    def select(self, *columns: str | Column) -> UTable:
        """Projection; the condition always comes along. ``*`` stands for the data columns."""
        wanted: list = []
        for c in columns:
            wanted += self.columns if isinstance(c, str) and c == "*" else [c]
        return self.mapped(lambda df: df.select(*wanted, COND))

    def with_column(self, name: str, value: Column) -> UTable:
        """A computed column."""
        if name.lower() == COND:
            raise NotSupported("the condition can't be assigned")
        return self.mapped(lambda df: df.withColumn(name, value))

    def alias(self, name: str) -> UTable:
        """The data columns under qualified names ``name_column``."""
        return self.mapped(lambda df: df.select(*(F.col(c).alias(f"{name}_{c}") for c in self.columns), COND))

    def join(self, other: UTable, on: str | Sequence[str] | Column | None = None, how: str = "inner") -> UTable:
        """Rows of both that can exist together. Only inner, cross and (against a certain table) semi and anti joins: the
        missing side of an outer join isn't a condition that a conjunction can state."""
        if how in ("left_semi", "semi", "left_anti", "anti"):
            if not other.is_certain:
                raise NotSupported("sub-queries must be certain")
            return self.mapped(lambda df: df.join(other.df.drop(COND), on, how))
        if how not in ("inner", "cross"):
            if self.is_certain and other.is_certain:
                return UTable(self.data().join(other.data(), on, how))
            raise NotSupported("outer joins aren't supported on uncertain tables")
        left, right = self.df.withColumnRenamed(COND, "_cond_left"), other.df.withColumnRenamed(COND, "_cond_right")
        joined = left.crossJoin(right) if on is None else left.join(right, on, "inner")
        if self.is_certain or other.is_certain:
            cond = F.col("_cond_right") if self.is_certain else F.col("_cond_left")
        else:
            joined = joined.filter(consistent(F.col("_cond_left"), F.col("_cond_right")))
            cond = merged(F.col("_cond_left"), F.col("_cond_right"))
        width = None if self.width is None or other.width is None else self.width + other.width
        kind = CERTAIN if self.is_certain and other.is_certain else UNCERTAIN
        return UTable(joined.withColumn(COND, cond).drop("_cond_left", "_cond_right"), kind, width)

    def union_all(self, other: UTable) -> UTable:
        """All rows of both, by column name."""
        kind = self.kind if self.kind == other.kind == CERTAIN else UNCERTAIN
        return UTable(self.df.unionByName(other.df), kind, None if self.width is None or other.width is None else max(self.width, other.width))

    def _set_operation(self, name: str, other: UTable, operate: Callable[[DataFrame, DataFrame], DataFrame]) -> UTable:
        if not (self.is_certain and other.is_certain):
            raise NotSupported(f"{name} is only supported on certain tables")
        return UTable(operate(self.data(), other.data()))

    def union(self, other: UTable) -> UTable:
        return self._set_operation("union", other, lambda a, b: a.unionByName(b).distinct())

    def intersect(self, other: UTable) -> UTable:
        return self._set_operation("intersect", other, lambda a, b: a.intersect(b.select(a.columns)))

    def difference(self, other: UTable) -> UTable:
        return self._set_operation("except", other, lambda a, b: a.subtract(b.select(a.columns)))

    def distinct(self) -> UTable:
        if not self.is_certain:
            raise NotSupported("distinct and grouping aren't supported on uncertain tables; use possible() or conf()")
        return UTable(self.data().distinct())

    # --- changing rows ------------------------------------------------------------------------------------------

    def insert(self, rows: UTable | DataFrame) -> UTable:
        """With more rows; certain ones exist in every world. Their columns must be the data columns."""
        rows = rows if isinstance(rows, UTable) else UTable(rows)
        if set(rows.columns) != set(self.columns):
            raise NotSupported(f"rows to insert must have the columns {self.columns}")
        return UTable(self.df.unionByName(rows.df), self.kind if self.is_certain and rows.is_certain else UNCERTAIN, None if self.width is None or rows.width is None else max(self.width, rows.width))

    def update(self, values: dict[str, Column], where: Column | None = None) -> UTable:
        """With some columns set anew where a condition on the data holds (a null condition doesn't)."""
        if COND in values:
            raise NotSupported("the condition can't be updated")
        hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        return self.mapped(lambda df: df.select(*(F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns)))

    def delete(self, where: Column) -> UTable:
        """Without the rows where a condition on the data holds."""
        return self.mapped(lambda df: df.filter(~F.coalesce(where, F.lit(False))))

    # --- outside forms ------------------------------------------------------------------------------------------

    def flat(self) -> DataFrame:
        """The condition as columns ``_v0, _d0, _p0, _v1, ...``; shorter ones end with the certain atom (0, 0, 1)."""
        width = self.width if self.width is not None else (self.df.agg(F.max(F.size(COND))).first()[0] or 0)
        cells = []
        for i in range(width):
            a = F.get(F.col(COND), F.lit(i))
            cells += [F.coalesce(a["v"], F.lit(0)).alias(f"_v{i}"), F.coalesce(a["d"], F.lit(0)).alias(f"_d{i}"), F.coalesce(a["p"], F.lit(1.0)).alias(f"_p{i}")]
        return self.df.select(*self.columns, *cells)

    @staticmethod
    def from_flat(df: DataFrame) -> UTable:
        """The inverse: columns named ``_v<i>``, ``_d<i>``, ``_p<i>`` are the condition; variable 0 is always true."""
        numbers = sorted(int(c[2:]) for c in df.columns if c.startswith("_v") and c[2:].isdigit())
        atoms = [F.struct(F.col(f"_v{i}").cast("bigint").alias("v"), F.col(f"_d{i}").cast("bigint").alias("d"), F.col(f"_p{i}").cast("double").alias("p")) for i in numbers]
        data = [c for c in df.columns if c[:2] not in ("_v", "_d", "_p")]
        cond = F.array_sort(F.array_distinct(F.filter(F.array(*atoms), lambda a: a["v"].isNotNull() & (a["v"] != 0)))) if atoms else certain()
        return UTable(df.select(*data, cond.cast(f"array<{ATOM}>").alias(COND)), UNCERTAIN if atoms else CERTAIN, len(numbers))

    def save(self, path: str) -> None:
        """Write as Parquet; the kind goes into the metadata of the condition column."""
        self.df.withMetadata(COND, {"kind": self.kind, "width": -1 if self.width is None else self.width}).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> UTable:
        """What :meth:`save` wrote. A table without a condition column is certain."""
        df = spark.read.parquet(path)
        if COND not in df.columns:
            return UTable(df)
        about = df.schema[COND].metadata
        return UTable(df, about.get("kind", UNCERTAIN), None if about.get("width", -1) < 0 else about["width"])

    def worlds(self) -> DataFrame:
        """The world table: every variable, value and probability that the conditions mention."""
        return self.df.select(F.explode(COND).alias("a")).groupBy("a.v", "a.d").agg(F.max("a.p").alias("p"))

    def clashes(self) -> DataFrame:
        """Variables whose values' probabilities exceed 1: names are 64-bit hashes, and two that are equal are one
        variable. Of n variables a pair is equal with a chance of about n² / 2^65: 3 % of a billion, nearly sure of ten
        billion. Names of the same variable in several tables of one lineage aren't clashes."""
        return self.worlds().groupBy("v").agg(F.sum("p").alias("total")).filter("total > 1 + 1e-9")

    # --- questions ----------------------------------------------------------------------------------------------

    def possible(self, *columns: str | Column) -> DataFrame:
        """The distinct rows that some world has. On a certain table, its distinct rows."""
        some = self.chances.filter(~F.exists(COND, lambda a: a["p"] <= 0))
        return some.select(*(columns or self.columns)).distinct()

    def tconf(self, name: str = "tconf") -> DataFrame:
        """Each row, duplicates included, with the probability of its own condition."""
        return self.chances.select(*self.columns, self.chance().alias(name))

    def esum(self, value: str | Column, *by: str | Column, name: str = "esum") -> DataFrame:
        """The expected sum of a value per group: by linearity, whatever the conditions are."""
        value = F.col(value) if isinstance(value, str) else value
        return self._expected(value * self.chance(), by, name)

    def ecount(self, *by: str | Column, name: str = "ecount") -> DataFrame:
        """The expected number of rows per group."""
        return self._expected(self.chance(), by, name)

    def _expected(self, value: Column, by: Sequence[str | Column], name: str) -> DataFrame:
        self._uncertain("an expectation")
        total = F.sum(value)
        rows = self.chances
        return rows.groupBy(*_columns(by)).agg(total.alias(name)) if by else rows.agg(F.coalesce(total, F.lit(0.0)).alias(name))

    def conf(self, *by: str | Column, name: str = "conf", method: str = "auto", steps: int = 2_000_000, group_clauses: int = GROUP_CLAUSES) -> DataFrame:
        """The probability that a group has a row, exactly. Without `by`, of any row: 0 if there is none.

        Independent tables, and conditions of one atom in general, are native aggregates. Wider ones are solved by
        decomposition; `method` "native" and "solve" force one or the other. Raises confidence.TooHard (in a task) if a
        group takes more than `steps` decompositions: ask conf_bounds or aconf then.
        """
        self._uncertain("conf")
        if method == "native" or method == "auto" and self.width is not None and self.width <= 1:
            return self._conf_native(by, name)
        return self._conf_solved(by, name, lambda clauses, p, seed, parts: confidence.exact(clauses, p, steps), group_clauses)

    def conf_bounds(self, *by: str | Column, epsilon: float, relative: bool = True, name: str = "conf", group_clauses: int = GROUP_CLAUSES) -> DataFrame:
        """The probability within a guaranteed distance: `epsilon`, or `epsilon` of itself if `relative`."""
        self._uncertain("conf")
        if not 0 <= epsilon < 1:
            raise NotSupported("epsilon must be from 0 to less than 1")
        # Parts within epsilon of their size give a whole within epsilon of its size, which is at most 1.
        return self._conf_solved(by, name, lambda clauses, p, seed, parts: confidence.bounded(clauses, p, epsilon, relative or parts > 1), group_clauses)

    def aconf(self, *by: str | Column, epsilon: float, delta: float, name: str = "aconf", group_clauses: int = GROUP_CLAUSES) -> DataFrame:
        """The probability by sampling: off by more than `epsilon` of itself with a chance of at most `delta`. Seeded by
        the group, so a retry gives the same."""
        self._uncertain("aconf")
        if not (0 < epsilon < 1 and 0 < delta < 1):
            raise NotSupported("epsilon and delta must be between 0 and 1")
        # The parts of a split group share the chance to be off.
        return self._conf_solved(by, name, lambda clauses, p, seed, parts: confidence.sampled(clauses, p, epsilon, delta / parts, seed), group_clauses)

    def _keyed(self, by: Sequence[str | Column], rows: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
        """The lineage with grouping columns _g0, _g1, ..., their names, and the names to give them in the end."""
        cols = _columns(by)
        named = [rows.select(c).columns[0] for c in cols]
        keys = [f"_g{i}" for i in range(len(cols))]
        return rows.select(*(c.alias(k) for c, k in zip(cols, keys)), COND), keys, named

    def _conf_native(self, by: Sequence[str | Column], name: str) -> DataFrame:
        """Conditions of at most one atom: a variable's values exclude each other, variables are independent."""
        rows, keys, named = self._keyed(by, self.chances)
        a = F.get(F.col(COND), F.lit(0))
        atoms = rows.select(*keys, a["v"].alias("_v"), a["d"].alias("_d"), F.coalesce(a["p"], F.lit(1.0)).alias("_p"))
        if self.kind != INDEPENDENT:
            atoms = atoms.groupBy(*keys, "_v", "_d").agg(F.max("_p").alias("_p")).groupBy(*keys, "_v").agg(F.least(F.sum("_p"), F.lit(1.0)).alias("_p"))
        done = atoms.groupBy(*keys).agg(disjunction(F.col("_p")).alias(name)) if keys else atoms.agg(disjunction(F.col("_p")).alias(name))
        if keys:
            done = done.filter(F.col(name) > 0)
        return done.select(*(F.col(k).alias(n) for k, n in zip(keys, named)), name)

    def _conf_solved(self, by: Sequence[str | Column], name: str, solver: Callable, group_clauses: int) -> DataFrame:
        rows, keys, named = self._keyed(by, self.df)
        # Equal clauses are one; the map side drops most of them. Atoms are compared without their probabilities.
        shape = F.transform(COND, lambda a: F.struct(a["v"].alias("v"), a["d"].alias("d")))
        clauses = checkpoint(rows.withColumn("_shape", shape).groupBy(*keys, "_shape").agg(F.first(COND).alias(COND)).drop("_shape"))
        solve = _group_solver(solver)
        parts = [F.transform(COND, lambda a: a[f]).alias(f"_{f}") for f in "vdp"]

        def solved(part: DataFrame, groups: list[str], count: Column) -> DataFrame:
            ready = part.select(*groups, *parts, (F.xxhash64(*groups) if groups else F.lit(42).cast("bigint")).alias("_seed"), count.cast("bigint").alias("_count"))
            agg = solve("_v", "_d", "_p", "_seed", "_count").alias(name)
            return ready.groupBy(*groups).agg(agg) if groups else ready.groupBy(F.lit(1).alias("_one")).agg(agg).select(name)

        sizes = clauses.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        if sizes.filter(F.col("_n") > group_clauses).limit(1).count():
            labelled = _split_components(clauses, keys)
            counted = labelled.select(*keys, "_component").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_count"))
            same = [F.col(k).eqNullSafe(F.col(f"_same{k}")) for k in keys]
            counted = counted.withColumnsRenamed({k: f"_same{k}" for k in keys})  # without keys one row
            labelled = labelled.join(counted, reduce(lambda a, b: a & b, same)) if same else labelled.crossJoin(counted)
            per = solved(labelled, [*keys, "_component"], F.col("_count"))
            done = per.groupBy(*keys).agg(disjunction(F.col(name)).alias(name)) if keys else per.agg(disjunction(F.col(name)).alias(name))
        else:
            done = solved(clauses, keys, F.lit(1))
        if keys:
            done = done.filter(F.col(name) > 0)
        else:
            done = done.agg(F.coalesce(F.max(name), F.lit(0.0)).alias(name))
        return done.select(*(F.col(k).alias(n) for k, n in zip(keys, named)), name)

    def argmax(self, argument: str, value: str, *by: str, name: str = "argmax") -> DataFrame:
        """A group's `argument` with the greatest `value` (NaN is the greatest, nulls don't count)."""
        if not self.is_certain:
            raise NotSupported("argmax is only supported on certain tables")
        return argmax(self.data(), argument, value, *by, name=name)


def argmax(df: DataFrame, argument: str | Column, value: str | Column, *by: str | Column, name: str = "argmax") -> DataFrame:
    """A group's `argument` where `value` is greatest. Of equals any one; NaN is the greatest, nulls don't count."""
    best = F.max_by(argument, value).alias(name)
    return df.groupBy(*by).agg(best) if by else df.agg(best)


def _group_solver(solver: Callable) -> Callable:
    """A grouped aggregate over clauses given as three arrays, a seed, and how many parts the group was split into."""

    def solve(v: pd.Series, d: pd.Series, p: pd.Series, seed: pd.Series, parts: pd.Series) -> float:
        clauses, chances = confidence.lineage_of(v, d, p)
        return float(solver(clauses, chances, int(seed.iloc[0]), int(parts.iloc[0])))

    solve.__annotations__ = dict.fromkeys(("v", "d", "p", "seed", "parts"), pd.Series) | {"return": float}
    return F.pandas_udf(solve, "double")


def _split_components(clauses: DataFrame, keys: list[str]) -> DataFrame:
    """The clauses with the independent part of their group that they belong to (``_component``).

    Labels spread from clause to variable and back until none changes: each round is two aggregations by key, so no task
    holds a group. Clause and variable names are hashes that include the group, so nulls in keys need no care. Clauses
    without atoms are a part of their own.
    """
    numbered = checkpoint(clauses.withColumn("_clause", F.xxhash64(*(F.struct(F.col(k).isNull(), k) for k in keys), F.transform(COND, lambda a: F.struct(a["v"], a["d"])))))
    edges = checkpoint(numbered.select("_clause", F.explode(F.transform(COND, lambda a: F.xxhash64(*(F.struct(F.col(k).isNull(), k) for k in keys), a["v"]))).alias("_var")))
    labels = numbered.select("_clause", F.col("_clause").alias("_component"))
    changed = 1
    while changed:
        near = edges.join(labels, "_clause").groupBy("_var").agg(F.min("_component").alias("_least"))
        least = edges.join(near, "_var").groupBy("_clause").agg(F.min("_least").alias("_least"))
        step = labels.join(least, "_clause", "left").select("_clause", F.least("_component", F.coalesce("_least", "_component")).alias("_next"), "_component")
        # A label that is itself a clause with a smaller label leads on: halves the number of rounds again and again.
        onward = step.select(F.col("_clause").alias("_next"), F.col("_next").alias("_further"))
        step = checkpoint(step.join(onward, "_next", "left").select("_clause", F.least("_next", F.coalesce("_further", "_next")).alias("_component"), F.col("_component").alias("_before")))
        changed = step.filter("_component <> _before").limit(1).count()
        labels = step.drop("_before")
    return numbered.join(labels, "_clause").drop("_clause")


def posterior(prior: UTable, violations: UTable, *by: str, name: str = "posterior") -> DataFrame:
    """The probability of each group given that no row of `violations` exists: (P(group) - P(group and a violation)) /
    (1 - P(a violation)). `violations` are conditions only; groups that the evidence rules out have 0."""
    seen = UTable(violations.df.select(COND), UNCERTAIN, violations.width)
    before = prior.conf(*by, name="_prior")
    both = prior.join(seen).conf(*by, name="_both")
    against = seen.conf(name="_against").first()[0]
    if against >= 1:
        raise ValueError("the evidence is impossible")
    joined = before.join(both, reduce(lambda a, b: a & b, [before[k].eqNullSafe(both[k]) for k in by]), "left") if by else before.crossJoin(both)
    return joined.select(*(before[k] for k in by), ((F.col("_prior") - F.coalesce("_both", F.lit(0.0))) / (1 - F.lit(float(against)))).alias(name))


def posterior_within(prior: UTable, violations: UTable, within: Sequence[str], *by: str, name: str = "posterior") -> DataFrame:
    """:func:`posterior` for each value of the columns `within` by itself, given that no row of `violations` of that value
    exists. Values whose evidence is impossible have null."""
    seen = UTable(violations.df.select(*(F.col(k).alias(f"_seen_{k}") for k in within), COND), UNCERTAIN, violations.width)
    met = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_seen_{k}")) for k in within])
    keys = [*within, *by]
    before = prior.conf(*keys, name="_prior")
    both = prior.join(seen, met).conf(*keys, name="_both")
    against = seen.conf(*(f"_seen_{k}" for k in within), name="_against")
    joined = before.join(both, reduce(lambda a, b: a & b, [before[k].eqNullSafe(both[k]) for k in keys]), "left").select(*(before[k] for k in keys), "_prior", "_both")
    none = F.lit(0.0)
    rest = 1 - F.coalesce("_against", none)
    return joined.join(against, met, "left").select(*keys, F.when(rest > 1e-12, (F.col("_prior") - F.coalesce("_both", none)) / rest).alias(name))
