"""Expectation and confidence of expressions under constraints.

A row's constraints are split into groups that share no variable. A group over one variable that it bounds linearly is an
interval, whose probability the distribution function gives exactly; others are sampled, by inversion inside an interval
where there is one, by rejection otherwise. Values depend on the seed and the variable alone, so retries agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from manyworlds.plans.runtime import checkpoint
from manyworlds.variables.distributions import DISTRIBUTIONS, draws, generator
from manyworlds.variables.symbols import ATOM, ATOMS, EQN, _node, such_that

SAMPLES = 1000
#: Rejection gives up after this many tries; what it found counts from so many accepted ones on (within some 20 %).
TRIES = 10_000_000
LEAST_ACCEPTED = 100

Var = tuple  # (id, sub)


def variables(nodes) -> dict[Var, tuple[str, list[float]]]:
    """The variables of an expression with their distributions."""
    return {(n["id"], n["sub"]): (n["dist"], list(n["params"])) for n in nodes if n["op"] == "v"}


def evaluate(nodes, value) -> np.ndarray | float:
    """An expression under `value`, a function from variables to numbers or vectors."""
    stack: list = []
    for n in nodes:
        op = n["op"]
        if op == "c":
            stack.append(n["c"])
        elif op == "v":
            stack.append(value((n["id"], n["sub"])))
        elif op == "-":
            stack.append(-stack.pop())
        elif op == "?":
            r, left, v = stack.pop(), stack.pop(), stack.pop()
            stack.append(np.where(np.asarray(left) > np.asarray(r), v, 0.0))
        else:
            b, a = stack.pop(), stack.pop()
            stack.append(a + b if op == "+" else a * b)
    return stack.pop()


def linear(nodes) -> tuple[float, dict[Var, float]] | None:
    """Constant and coefficients of a linear expression; None if it isn't."""
    stack: list[tuple[float, dict]] = []
    for n in nodes:
        op = n["op"]
        if op == "c":
            stack.append((n["c"], {}))
        elif op == "v":
            stack.append((0.0, {(n["id"], n["sub"]): 1.0}))
        elif op == "-":
            c, k = stack.pop()
            stack.append((-c, {v: -x for v, x in k.items()}))
        elif op == "?":
            return None
        else:
            (b, bk), (a, ak) = stack.pop(), stack.pop()
            if op == "+":
                stack.append((a + b, {v: ak.get(v, 0.0) + bk.get(v, 0.0) for v in {*ak, *bk}}))
            elif ak and bk:
                return None
            else:
                stack.append((a * b, {v: x * b for v, x in ak.items()} | {v: x * a for v, x in bk.items()}))
    return stack.pop()


class Group:
    """Constraints that share variables."""

    def __init__(self, atoms: list, kinds: dict[Var, tuple[str, list[float]]]) -> None:
        self.atoms, self.kinds = atoms, kinds
        self.bounds = self._bounds() if len(kinds) == 1 else None

    def _bounds(self) -> tuple[float, float, bool] | None:
        """The open interval that linear constraints leave one variable that can be inverted (or counted)."""
        ((var, (dist, _)),) = self.kinds.items()
        if DISTRIBUTIONS[dist].cdf is None:
            return None
        low, high = -math.inf, math.inf
        for a in self.atoms:
            left, right = linear(a["l"]), linear(a["r"])
            if left is None or right is None:
                return None
            c, k = left[0] - right[0], left[1].get(var, 0.0) - right[1].get(var, 0.0)
            if k > 0:
                low = max(low, -c / k)
            elif k < 0:
                high = min(high, -c / k)
            elif not c > 0:
                return 0.0, 0.0, True
        return low, high, low >= high

    def probability(self, seed: int, n: int) -> float:
        if self.bounds is not None:
            low, high, empty = self.bounds
            if empty:
                return 0.0
            ((_, (dist, params)),) = self.kinds.items()
            d = DISTRIBUTIONS[dist]
            # Open ends: for whole numbers the last value inside.
            upper = d.cdf(math.ceil(high) - 1 if d.discrete and math.isfinite(high) else high, params)
            return max(0.0, upper - d.cdf(low, params))
        values = {v: draws(dist, p, seed, v[0], n, v[1]) for v, (dist, p) in self.kinds.items()}
        return float(self.holds(values, n).mean())

    def holds(self, values: dict[Var, np.ndarray], n: int) -> np.ndarray:
        good = np.ones(n, bool)
        for a in self.atoms:
            good &= np.asarray(evaluate(a["l"], values.__getitem__)) > np.asarray(evaluate(a["r"], values.__getitem__))
        return good

    def inside(self, seed: int, n: int) -> tuple[dict[Var, np.ndarray], float]:
        """`n` joint values that satisfy the constraints, and the constraints' probability. Impossible ones: no values and
        0. Rejection that accepts fewer than LEAST_ACCEPTED in TRIES says nothing: no values and NaN, which is null in a
        column; with more, but fewer than `n`, its values are repeated."""
        if self.bounds is not None and not DISTRIBUTIONS[next(iter(self.kinds.values()))[0]].discrete:
            p = self.probability(seed, n)
            ((var, (dist, params)),) = self.kinds.items()
            d = DISTRIBUTIONS[dist]
            a, b = d.cdf(self.bounds[0], params), d.cdf(self.bounds[1], params)
            if p <= 0:
                return {}, 0.0
            u = a + (b - a) * generator(seed, *var).random(n)
            return {var: np.array([d.icdf(x, params) for x in u])}, p
        kept: dict[Var, list[np.ndarray]] = {v: [] for v in self.kinds}
        streams = {v: generator(seed, *v) for v in self.kinds}
        got = tried = 0
        while got < n and tried < TRIES:
            size = max(n, 4096)
            values = {v: DISTRIBUTIONS[dist].draw(streams[v], p, size) for v, (dist, p) in self.kinds.items()}
            good = self.holds(values, size)
            for v in kept:
                kept[v].append(values[v][good])
            got += int(good.sum())
            tried += size
        if got < min(n, LEAST_ACCEPTED):
            return {}, (0.0 if self.bounds is not None and self.bounds[2] else math.nan)
        exact = self.probability(seed, n) if self.bounds is not None else got / tried
        return {v: np.resize(np.concatenate(x), n) for v, x in kept.items()}, exact


def groups(atoms) -> tuple[list[Group], bool]:
    """The constraints in groups, and whether those without variables hold."""
    parent: dict[Var, Var] = {}

    def find(x: Var) -> Var:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    kinds: dict[Var, tuple] = {}
    free = True
    placed = []
    for a in atoms if atoms is not None else ():
        if a is None or a["l"] is None or a["r"] is None:
            continue
        own = {**variables(a["l"]), **variables(a["r"])}
        if not own:
            free &= bool(evaluate(a["l"], None) > evaluate(a["r"], None))
            continue
        kinds |= own
        first, *rest = own
        for v in rest:
            parent[find(v)] = find(first)
        placed.append((first, a))
    by: dict[Var, list] = {}
    for first, a in placed:
        by.setdefault(find(first), []).append(a)
    return [Group(own, {v: kinds[v] for v in kinds if find(v) == root}) for root, own in by.items()], free


def clause_probability(atoms, seed: int, n: int, exact: bool = True, grouped: bool = True) -> float:
    """The probability that all constraints hold. Without `exact` intervals are sampled like everything else; without
    `grouped` all constraints are sampled jointly."""
    parts, free = groups(atoms)
    if not grouped and parts:
        parts = [Group([a for g in parts for a in g.atoms], {v: k for g in parts for v, k in g.kinds.items()})]
    if not exact:
        for g in parts:
            g.bounds = None
    return math.prod((g.probability(seed, n) for g in parts), start=float(free))


def clause_expectation(nodes, atoms, seed: int, n: int) -> float:
    """E[expression · 1(constraints)]: closed for unconstrained linear expressions, sampled otherwise; NaN where sampling
    accepts too little (:meth:`Group.inside`)."""
    if nodes is None:
        return math.nan
    parts, free = groups(atoms)
    if not free:
        return 0.0
    own = variables(nodes)
    plain = linear(nodes)
    bound = {v for g in parts for v in g.kinds}
    if plain is not None and not bound & set(plain[1]):
        mean = plain[0] + sum(k * DISTRIBUTIONS[own[v][0]].mean(own[v][1]) for v, k in plain[1].items())
        return mean * math.prod((g.probability(seed, n) for g in parts), start=1.0)
    values, chance = {}, 1.0
    for g in parts:
        if set(g.kinds) & set(own):
            inside, p = g.inside(seed, n)
            values |= inside
        else:
            p = g.probability(seed, n)
        chance *= p
        if chance <= 0:
            return 0.0
    for v, (dist, params) in own.items():
        if v not in values:
            values[v] = draws(dist, params, seed, v[0], n, v[1])
    return float(np.mean(evaluate(nodes, values.__getitem__))) * chance


def world_values(nodes, atoms, seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The expression in each of `n` worlds, and in which worlds the row exists."""
    kinds = dict(variables(nodes)) if nodes is not None else {}
    for a in atoms if atoms is not None else ():
        kinds |= {**variables(a["l"]), **variables(a["r"])}
    values = {v: draws(dist, p, seed, v[0], n, v[1]) for v, (dist, p) in kinds.items()}
    there = np.ones(n, bool)
    for a in atoms if atoms is not None else ():
        there &= np.asarray(evaluate(a["l"], values.__getitem__)) > np.asarray(evaluate(a["r"], values.__getitem__))
    got = np.broadcast_to(np.asarray(evaluate(nodes, values.__getitem__), float), n) if nodes is not None else np.zeros(n)
    return got, there


# --- columns ------------------------------------------------------------------------------------------------------


def _one_interval(atoms: Column) -> tuple[Column, Column]:
    """Whether the constraints are all comparisons of one uniform or exponential variable with constants, and then their
    probability: a difference of two values of the distribution function, without leaving the JVM."""
    first = F.get(atoms, F.lit(0))
    one = lambda e: F.get(e, F.lit(0))
    var = F.when(one(first["l"])["op"] == "v", one(first["l"])).otherwise(one(first["r"]))
    same = lambda n: (n["op"] == "v") & (n["id"] == var["id"]) & (n["sub"] == var["sub"])
    number = lambda n: n["op"] == "c"
    above = lambda a: same(one(a["l"])) & number(one(a["r"]))
    below = lambda a: number(one(a["l"])) & same(one(a["r"]))
    simple = (F.size(atoms) > 0) & var["dist"].isin("uniform", "exponential") & F.forall(atoms, lambda a: (F.size(a["l"]) == 1) & (F.size(a["r"]) == 1) & (above(a) | below(a)))
    low = F.array_max(F.transform(F.filter(atoms, above), lambda a: one(a["r"])["c"]))
    high = F.array_min(F.transform(F.filter(atoms, below), lambda a: one(a["l"])["c"]))
    p0, p1 = F.get(var["params"], F.lit(0)), F.get(var["params"], F.lit(1))

    def cdf(x: Column, at_infinity: float) -> Column:
        uniform = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - p0) / (p1 - p0)))
        return F.when(x.isNull(), F.lit(at_infinity)).when(var["dist"] == "uniform", uniform).when(x > 0, 1 - F.exp(-p0 * x)).otherwise(F.lit(0.0))

    return F.coalesce(simple, F.lit(False)), F.greatest(F.lit(0.0), cdf(high, 1.0) - cdf(low, 0.0))


def conf_one(atoms: str | Column = ATOMS, samples: int = SAMPLES, seed: int = 0, exact: bool = True, grouped: bool = True) -> Column:
    """The probability of a row's constraints; `exact` and `grouped` as in :func:`clause_probability`. Where the
    constraints are an interval of one uniform or exponential variable, nothing goes to Python."""

    @F.pandas_udf("double")
    def probability(a: pd.Series) -> pd.Series:
        return a.map(lambda x: math.nan if x is None else clause_probability(x, seed, samples, exact, grouped))

    given = F.coalesce(F.col(atoms) if isinstance(atoms, str) else atoms, F.array().cast(f"array<{ATOM}>"))
    if not exact:
        return probability(given)
    simple, closed = _one_interval(given)
    return F.when(simple, closed).otherwise(probability(F.when(~simple, given)))


def expectation(eqn: str | Column, atoms: str | Column = ATOMS, samples: int = SAMPLES, seed: int = 0) -> Column:
    """E[expression · 1(constraints)] per row."""

    @F.pandas_udf("double")
    def expected(e: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([clause_expectation(x, y, seed, samples) for x, y in zip(e, a)])

    return expected(eqn, atoms)


def expectation_sum(eqn: str | Column, atoms: str | Column = ATOMS, samples: int = SAMPLES, seed: int = 0) -> Column:
    """The expected sum over a group's rows, an aggregate: by linearity the sum of the rows' expectations."""
    return F.sum(expectation(eqn, atoms, samples, seed))


def row_worlds(eqn: str | Column, atoms: str | Column = ATOMS, samples: int = SAMPLES, seed: int = 0) -> Column:
    """Per row an array of the expression's value in each world, null where the row doesn't exist."""

    @F.pandas_udf("array<double>")
    def worlds(e: pd.Series, a: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(e, a):
            got, there = world_values(x, y, seed, samples)
            out.append([float(v) if t else None for v, t in zip(got, there)])
        return pd.Series(out)

    return worlds(eqn, atoms)


def per_world(df: DataFrame, eqn: str | Column, by: Sequence[str], how: str, samples: int = SAMPLES, seed: int = 0, atoms: str | Column = ATOMS) -> DataFrame:
    """Per group and world the sum, max or count of the rows that exist there: ``world, value``. Worlds with no row
    have 0. The rows of a group are combined batch by batch as vectors over the worlds; only these vectors are spread
    over worlds, where the aggregation combines on the map side whatever a group's size."""
    value = F.col(eqn) if isinstance(eqn, str) else eqn
    ready = df.select(*by, value.alias("_e"), (F.col(atoms) if isinstance(atoms, str) else atoms).alias("_a"), F.to_json(F.struct(*by) if by else F.struct(F.lit(1)), {"ignoreNullFields": "false"}).alias("_g"))
    start = {"sum": 0.0, "max": -np.inf, "count": 0.0}[how]

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column("_g").dictionary_encode()
            number = np.asarray(group.indices)
            size = len(group.dictionary)
            total, seen = np.full((size, samples), start), np.zeros((size, samples), np.int64)
            for k, x, y in zip(number, batch.column("_e").to_pylist(), batch.column("_a").to_pylist()):
                got, there = world_values(x, y, seed, samples)
                seen[k] += there
                if how == "sum":
                    total[k] += np.where(there, got, 0.0)
                elif how == "max":
                    np.maximum(total[k], got, out=total[k], where=there)
            first = pa.array(np.unique(number, return_index=True)[1])
            keys = [batch.column(c).take(first) for c in by]
            at = pa.array(np.arange(size + 1, dtype=np.int32) * samples)
            lists = [pa.ListArray.from_arrays(at, pa.array(x.ravel())) for x in (total, seen)]
            yield pa.RecordBatch.from_arrays([*keys, *lists], names=[*by, "_total", "_seen"])

    kinds = StructType([*(df.select(*by).schema.fields if by else []), StructField("_total", ArrayType(DoubleType())), StructField("_seen", ArrayType(LongType()))])
    spread = ready.mapInArrow(combine, kinds).select(*by, F.posexplode(F.arrays_zip("_total", "_seen")).alias("world", "v"))
    seen = F.sum("v._seen")
    value = {"sum": F.sum("v._total"), "max": F.max("v._total"), "count": seen.cast("double")}[how]
    return spread.groupBy(*by, "world").agg(F.when(seen > 0, value).otherwise(F.lit(0.0)).alias("value"))


def expectation_hist(df: DataFrame, eqn: str | Column, by: Sequence[str], how: str = "sum", samples: int = SAMPLES, seed: int = 0, name: str = "samples") -> DataFrame:
    """Per group the array of the worlds' values, in world order."""
    worlds = per_world(df, eqn, by, how, samples, seed)
    packed = F.transform(F.array_sort(F.collect_list(F.struct("world", "value"))), lambda x: x["value"]).alias(name)
    return worlds.groupBy(*by).agg(packed) if by else worlds.agg(packed)


def expectation_max(df: DataFrame, eqn: str | Column, by: Sequence[str] = (), samples: int = SAMPLES, seed: int = 0, name: str = "expectation_max") -> DataFrame:
    """The expected maximum of a group's rows, over sampled worlds; a world without rows counts as 0."""
    worlds = per_world(df, eqn, by, "max", samples, seed)
    return worlds.groupBy(*by).agg(F.avg("value").alias(name)) if by else worlds.agg(F.avg("value").alias(name))


def conf_naive(df: DataFrame, by: Sequence[str] = (), samples: int = SAMPLES, seed: int = 0, name: str = "conf") -> DataFrame:
    """The share of sampled worlds in which a group has a row."""
    worlds = per_world(df, F.lit(None).cast(EQN), by, "count", samples, seed)
    share = F.avg(F.when(F.col("value") > 0, 1.0).otherwise(0.0)).alias(name)
    return worlds.groupBy(*by).agg(share) if by else worlds.agg(share)


def _clause_mass(atoms, seed: int, n: int) -> float:
    """The probability of a row's constraints, by as many tries as it takes where they are sampled."""
    parts, free = groups(atoms)
    if not free:
        return 0.0
    # What is exactly impossible needs no tries for the rest.
    chances = [g.probability(seed, n) for g in parts if g.bounds is not None]
    if 0.0 in chances:
        return 0.0
    for g in parts:
        if g.bounds is None:
            p = g.inside(seed, n)[1]
            if not p > 0:
                raise ArithmeticError(f"no sample satisfies a row's constraints in {TRIES} tries")
            chances.append(p)
    return math.prod(chances)


def _values_inside(atoms, seed: int, n: int) -> dict[Var, np.ndarray]:
    """The values of a row's variables in `n` worlds in which its constraints hold."""
    values: dict[Var, np.ndarray] = {}
    for g in groups(atoms)[0]:
        inside, p = g.inside(seed, n)
        if not p > 0:
            raise ArithmeticError(f"no sample satisfies a row's constraints in {TRIES} tries")
        values |= inside
    return values


def conf_sample(df: DataFrame, by: Sequence[str] = (), samples: int = SAMPLES, seed: int = 0, name: str = "conf") -> DataFrame:
    """Confidence by counting coverage: the sum over rows of P(row) times the mean, over worlds with the row, of one over
    the number of the group's rows in that world. Rows of equal constraints are one event.

    Every row adds its probability, however small. A group has `samples` worlds, dealt to its rows in proportion to
    their probabilities; a row's worlds are conditioned on its own constraints, so it is in each, and all others are
    counted there. Constraints that are sampled and that no try satisfies are an error, as they would add nothing.
    """

    @F.pandas_udf("double")
    def mass(a: pd.Series) -> pd.Series:
        return a.map(lambda x: _clause_mass(x, seed, samples))

    @F.pandas_udf("array<struct<id:bigint,sub:bigint,world:int,value:double>>")
    def forced(a: pd.Series, first: pd.Series, end: pd.Series) -> pd.Series:
        out = []
        for x, i, k in zip(a, first, end):
            values = _values_inside(x, seed, samples)
            out.append([{"id": v[0], "sub": v[1], "world": w, "value": float(got[w])} for v, got in values.items() for w in range(i, k)])
        return pd.Series(out)

    @F.pandas_udf("array<struct<id:bigint,sub:bigint>>")
    def named(a: pd.Series) -> pd.Series:
        return pd.Series([[{"id": v[0], "sub": v[1]} for v in {v for c in x if c is not None for e in (c["l"], c["r"]) if e is not None for v in variables(e)}] for x in a])

    @F.pandas_udf("array<int>")
    def there(a: pd.Series, changes: pd.Series) -> pd.Series:
        out = []
        for x, changed in zip(a, changes):
            atoms = [c for c in x if c is not None and c["l"] is not None and c["r"] is not None]
            kinds = {v: k for c in atoms for e in (c["l"], c["r"]) for v, k in variables(e).items()}
            values = {v: draws(dist, p, seed, v[0], samples, v[1]) for v, (dist, p) in kinds.items()}
            for c in changed if changed is not None else ():
                values[c["id"], c["sub"]][c["world"]] = c["value"]
            good = np.ones(samples, bool)
            for c in atoms:
                good &= np.asarray(evaluate(c["l"], values.__getitem__)) > np.asarray(evaluate(c["r"], values.__getitem__))
            out.append(np.flatnonzero(good).tolist())
        return pd.Series(out)

    # Groups by number, as group keys may be null.
    keys = F.xxhash64(F.to_json(F.struct(*by), {"ignoreNullFields": "false"})) if by else F.lit(0).cast("bigint")
    atoms = F.coalesce(F.col(ATOMS), F.array().cast(df.schema[ATOMS].dataType))
    events = df.select(*by, atoms.alias(ATOMS)).withColumn("_id", F.xxhash64(F.to_json(ATOMS))).withColumn("_group", keys).dropDuplicates(["_group", "_id"])
    events = checkpoint(events.withColumn("_p", mass(ATOMS)))
    within = Window.partitionBy("_group")
    upto = F.sum("_p").over(within.orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    dealt = events.filter("_p > 0").withColumn("_upto", upto).withColumn("_all", F.max("_upto").over(within))
    # World w goes to the row that holds the point (w + 1/2) / samples of the group's mass.
    dealt = dealt.withColumn("_end", F.floor(F.col("_upto") / F.col("_all") * samples + 0.5).cast("int"))
    dealt = dealt.withColumn("_first", F.coalesce(F.lag("_end").over(within.orderBy("_id")), F.lit(0))).filter("_end > _first")
    changes = dealt.select("_group", F.explode(forced(ATOMS, "_first", "_end")).alias("c")).select("_group", "c.*")
    uses = events.select("_group", "_id", F.explode(named(ATOMS)).alias("v")).select("_group", "_id", "v.*")
    own = uses.join(changes, ["_group", "id", "sub"]).groupBy("_group", "_id").agg(F.collect_list(F.struct("id", "sub", "world", "value")).alias("_changes"))
    present = events.filter("_p > 0").join(own, ["_group", "_id"], "left").select("_group", F.explode(there(ATOMS, "_changes")).alias("world"))
    tally = present.groupBy("_group", "world").agg(F.count(F.lit(1)).alias("_n"))
    # A row is in its own worlds, also where rounding at the end of an interval says otherwise.
    worlds = dealt.select("_group", F.explode(F.sequence("_first", F.col("_end") - 1)).alias("world"))
    share = worlds.join(tally, ["_group", "world"], "left").groupBy("_group").agg(F.avg(1 / F.greatest(F.coalesce("_n", F.lit(1)), F.lit(1))).alias("_share"))
    total = events.groupBy("_group", *by).agg(F.sum("_p").alias("_mass")).join(share, "_group", "left")
    conf = F.least(F.lit(1.0), F.col("_mass") * F.coalesce("_share", F.lit(0.0))).alias(name)
    return total.select(*by, conf) if by else total.agg(F.coalesce(F.max(conf), F.lit(0.0)).alias(name))


def max_of_constants(df: DataFrame, value: str, chance: str | Column, by: Sequence[str] = (), name: str = "expected_max") -> DataFrame:
    """E[max] of constants whose rows exist independently with probability `chance`; a world without rows counts as 0.

    Rows of equal value are combined first, so the order runs over a group's distinct values, largest first: each adds
    its value times the chance that it is there and no larger one is.
    """
    p = F.col(chance) if isinstance(chance, str) else chance
    per = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.product(1 - p).alias("_none"))
    before = Window.partitionBy(*by).orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, -1)
    parts = per.withColumn("_larger", F.coalesce(F.product("_none").over(before), F.lit(1.0)))
    total = F.sum(F.col(value) * (1 - F.col("_none")) * F.col("_larger")).alias(name)
    return parts.groupBy(*by).agg(total) if by else parts.agg(total)


def symbolic_sum(df: DataFrame, eqn: str, by: Sequence[str] = (), name: str = "total") -> DataFrame:
    """A group's sum as one expression; each row counts where its constraints hold. The expression is as long as the
    group, which is meant for groups that are read or evaluated as a whole."""
    kept = df.select(*by, such_that(F.col(eqn), F.col(ATOMS)).alias("_e"))
    plus = F.array(_node("+")).cast(EQN)
    listed = F.collect_list("_e")
    total = F.concat(F.flatten(listed), F.flatten(F.array_repeat(plus, F.greatest(F.size(listed) - 1, F.lit(0))))).alias(name)
    return kept.groupBy(*by).agg(total) if by else kept.agg(total)


# --- sample sets, bundles and presence ------------------------------------------------------------------------------


def sample_set(atoms: str | Column, eqn: str | Column, samples: int = SAMPLES, seed: int = 0) -> Column:
    """`samples` values of an expression in worlds that satisfy the constraints (an empty array if there are none)."""

    @F.pandas_udf("array<double>")
    def generate(e: pd.Series, a: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(e, a):
            parts, free = groups(y)
            values: dict = {}
            alive = free
            for g in parts:
                inside, p = g.inside(seed, samples)
                values |= inside
                alive &= p > 0
            for v, (dist, params) in variables(x).items():
                if v not in values:
                    values[v] = draws(dist, params, seed, v[0], samples, v[1])
            out.append(np.broadcast_to(np.asarray(evaluate(x, values.__getitem__), float), samples).tolist() if alive else [])
        return pd.Series(out)

    return generate(eqn, atoms)


def sample_set_explode(df: DataFrame, samples: str, name: str = "value", index: str = "world") -> DataFrame:
    """One row per value of a sample set, numbered; rows with an empty or null set have none."""
    return df.select(*(c for c in df.columns if c != samples), F.posexplode(samples).alias(index, name))


def sample_set_expect(samples: str | Column) -> Column:
    """The mean of a sample set; null for an empty one."""
    s = F.col(samples) if isinstance(samples, str) else samples
    return F.when(F.size(s) > 0, F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s))


def value_bundle(eqn: str | Column, worlds: int = SAMPLES, seed: int = 0) -> Column:
    """An expression's values in `worlds` worlds."""
    return F.transform(row_worlds(eqn, F.array().cast(f"array<struct<l:{EQN},r:{EQN}>>"), worlds, seed), lambda x: x)


def bundle_add(a: Column, b: Column | float) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y) if isinstance(b, Column) else F.transform(a, lambda x: x + F.lit(float(b)))


def bundle_mul(a: Column, b: Column | float) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y) if isinstance(b, Column) else F.transform(a, lambda x: x * F.lit(float(b)))


def bundle_max(a: Column, b: Column | float) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y)) if isinstance(b, Column) else F.transform(a, lambda x: F.greatest(x, F.lit(float(b))))


def presence(worlds: int = SAMPLES) -> Column:
    """A row that exists in all worlds."""
    return F.array_repeat(F.lit(True), worlds)


def presence_where(there: Column, a: Column, b: Column | float) -> Column:
    """Without the worlds in which a isn't greater than b."""
    ok = F.zip_with(a, b, lambda x, y: x > y) if isinstance(b, Column) else F.transform(a, lambda x: x > F.lit(float(b)))
    return F.zip_with(there, ok, lambda t, k: t & k)


def presence_union(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x | y)


def presence_share(there: Column) -> Column:
    """The share of worlds with the row."""
    return F.size(F.filter(there, lambda t: t)) / F.size(there)


def bundle_expect(bundle: Column, there: Column | None = None, low: int = 0, high: int | None = None) -> Column:
    """The mean over worlds low to high (exclusive) of the value where the row exists, 0 elsewhere."""
    kept = bundle if there is None else F.zip_with(bundle, there, lambda x, t: F.when(t, x).otherwise(0.0))
    size = F.size(kept) - low if high is None else F.lit(high - low)
    return F.aggregate(F.slice(kept, low + 1, size), F.lit(0.0), lambda a, x: a + x) / size


def bundle_sum(df: DataFrame, bundle: str, by: Sequence[str] = (), there: str | None = None, name: str = "bundle") -> DataFrame:
    """Per group the element-wise sum of bundles, rows counting in the worlds in which they exist."""
    kept = F.col(bundle) if there is None else F.zip_with(bundle, there, lambda x, t: F.when(t, x).otherwise(0.0))
    spread = df.select(*by, F.posexplode(kept).alias("world", "v")).groupBy(*by, "world").agg(F.sum("v").alias("v"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("world", "v"))), lambda x: x["v"]).alias(name)
    return spread.groupBy(*by).agg(packed) if by else spread.agg(packed)
