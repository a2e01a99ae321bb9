"""Queries over continuous random variables, with their closed forms in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from manyworlds.queries.worlds import r6
from manyworlds.sources import table
from manyworlds.variables import CTable, add, const, from_text, gt, lt, mul, neg, rv, structurally_equal, sub, subscript, to_text
from manyworlds.variables import integrate as I


def _parts(spark: SparkSession, root: str) -> CTable:
    parts = table(spark, root, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return CTable(parts.withColumn("demand", rv("uniform", 0, F.col("p_retailprice"), key=["p_partkey"], salt="demand")))


def _suppliers(spark: SparkSession, root: str) -> CTable:
    suppliers = table(spark, root, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return CTable(suppliers.withColumn("delay", rv("exponential", F.expr("0.1 + s_nationkey * 0.05"), key=["s_suppkey"], salt="delay")).withColumn("drift", rv("normal", F.col("s_acctbal"), 100, key=["s_suppkey"], salt="drift")))


def rv_conf_uniform_gt(spark: SparkSession, root: str) -> DataFrame:
    rows = _parts(spark, root).where(gt(F.col("demand"), 950)).df.withColumn("p", I.conf_one())
    return rows.select("p_partkey", r6(F.col("p") + 1e-10, "p"))


def rv_conf_exponential_between(spark: SparkSession, root: str) -> DataFrame:
    rows = _suppliers(spark, root).where(gt(F.col("delay"), 1), lt(F.col("delay"), 3)).df.withColumn("p", I.conf_one())
    return rows.select("s_suppkey", r6("p", "p"))


def rv_expectation_linear(spark: SparkSession, root: str) -> DataFrame:
    e = I.expectation(add(mul(F.col("drift"), 2), F.col("delay")))
    return _suppliers(spark, root).df.withColumn("e", e).select("s_suppkey", F.round("e", 4).alias("e"))


def rv_expectation_sum(spark: SparkSession, root: str) -> DataFrame:
    return _suppliers(spark, root).df.groupBy("s_nationkey").agg(F.round(I.expectation_sum("drift"), 2).alias("e"))


def rv_max_const(spark: SparkSession, root: str) -> DataFrame:
    out = I.max_of_constants(table(spark, root, "supplier").withColumn("p", F.expr("0.2 + (s_suppkey % 5) * 0.1")), "s_suppkey", "p", ["s_nationkey"], name="e")
    return out.select("s_nationkey", F.round("e", 4).alias("e"))


def near(df: DataFrame, keys: list[str], estimate: str, want: Column, tolerance: Column | float) -> DataFrame:
    """An estimate beside its closed form: the keys, ``want``, ``tolerance`` (both also in SQL), and whether the estimate is
    within the tolerance of what is wanted."""
    wide = tolerance if isinstance(tolerance, Column) else F.lit(tolerance)
    return df.select(*keys, F.round(want, 4).alias("want"), F.round(wide, 4).alias("tolerance"), F.coalesce(F.abs(F.col(estimate) - want) <= wide, F.lit(False)).alias("good"))


_RATE = "(0.1 + s_nationkey * 0.05)"
#: Four standard errors of a mean of 2000 worlds, as a share of the standard deviation.
_FOUR = 4 / 2000**0.5


def rv_mc_within_tol(spark: SparkSession, root: str) -> DataFrame:
    """Sampling by inversion inside an interval: an expectation under a constraint on the variable itself, part by part."""
    rows = _parts(spark, root).where(gt(F.col("demand"), 300)).df.withColumn("e", I.expectation("demand"))
    # E[X · 1(X > c)] = (b² - c²) / 2b; the values inside spread over b - c, over 1000 of them.
    want = (F.col("p_retailprice") ** 2 - 300.0**2) / (2 * F.col("p_retailprice"))
    return near(rows, ["p_partkey"], "e", want, 5 * (F.col("p_retailprice") - 300) / 12**0.5 / 1000**0.5)


def rv_conf_any_row(spark: SparkSession, root: str) -> DataFrame:
    """The share of sampled worlds in which a nation has a supplier with a delay over 5: 1 - Π(1 - e^(-5λ))."""
    rows = _suppliers(spark, root).where(gt(F.col("delay"), 5)).df
    exact = rows.groupBy("s_nationkey").agg((1 - F.product(1 - F.exp(F.expr(f"-5 * {_RATE}")))).alias("p"))
    return near(I.conf_naive(rows, ["s_nationkey"], samples=2000, name="q").join(exact, "s_nationkey"), ["s_nationkey"], "q", F.col("p"), 0.05)


def rv_conf_coverage(spark: SparkSession, root: str) -> DataFrame:
    """The same by counting coverage, for a delay over 8: down to rows of a chance of 3e-5, which no plain sample shows."""
    rows = _suppliers(spark, root).where(gt(F.col("delay"), 8)).df
    exact = rows.groupBy("s_nationkey").agg((1 - F.product(1 - F.exp(F.expr(f"-8 * {_RATE}")))).alias("p"))
    sampled = I.conf_sample(rows, ["s_nationkey"], samples=2000, name="q")
    return near(exact.join(sampled, "s_nationkey", "left"), ["s_nationkey"], "q", F.col("p"), 0.1 * F.col("p") + 1e-6)


def rv_difference(spark: SparkSession, root: str) -> DataFrame:
    """Minus and negation: E[drift - 3 delay] and E[-drift]."""
    rows = _suppliers(spark, root).df
    return rows.select("s_suppkey", F.round(I.expectation(sub(F.col("drift"), mul(3, F.col("delay")))), 4).alias("difference"), F.round(I.expectation(neg(F.col("drift"))), 4).alias("negated"))


def rv_structure(spark: SparkSession, root: str) -> DataFrame:
    """Structural equality and subscripts: a variable is itself, its components are others."""
    rows = _suppliers(spark, root).df
    x, y = F.col("delay"), F.col("drift")
    return rows.select(
        "s_suppkey", structurally_equal(add(x, y), add(x, y)).alias("same"), structurally_equal(add(x, y), add(y, x)).alias("swapped"),
        structurally_equal(subscript(x, 1), subscript(x, 1)).alias("component"), structurally_equal(subscript(x, 1), subscript(x, 2)).alias("components"), structurally_equal(const(2), const(2)).alias("numbers"),
    )


def rv_text(spark: SparkSession, root: str) -> DataFrame:
    """Expressions as text, read back and evaluated; names of variables, which are hashes, left out of what is shown."""
    rows = _parts(spark, root).df.withColumn("e", sub(mul(F.col("demand"), 0.5), 3)).withColumn("text", to_text("e"))
    back = rows.withColumn("again", from_text("text"))
    return back.select("p_partkey", F.regexp_replace("text", r"\[-?\d+:", "[").alias("text"), structurally_equal(F.col("e"), F.col("again")).alias("same"), F.round(I.expectation("again"), 4).alias("e"))


def rv_poisson_zero(spark: SparkSession, root: str) -> DataFrame:
    """Counted and constant distributions: P(Poisson(μ) > 1), P(zero > -1), P(zero > 0)."""
    rows = _suppliers(spark, root).df.withColumn("calls", rv("poisson", F.expr("1 + s_nationkey * 0.1"), key=["s_suppkey"], salt="calls")).withColumn("none", rv("zero", key=["s_suppkey"], salt="none"))
    p = lambda a: I.conf_one(F.array(a))
    return rows.select("s_suppkey", r6(p(gt(F.col("calls"), 1)), "more"), r6(p(gt(F.col("none"), -1)), "surely"), r6(p(gt(F.col("none"), 0)), "never"))


def rv_conf_normal(spark: SparkSession, root: str) -> DataFrame:
    """A linear constraint on a normal variable, 2 drift + 100 > 2 balance, which is P(Z > -1/2) for every supplier."""
    rows = _suppliers(spark, root).where(gt(add(mul(F.col("drift"), 2), 100), const(F.col("s_acctbal") * 2)))
    return rows.df.select("s_suppkey", r6(I.conf_one(), "p"))


def rv_rejection(spark: SparkSession, root: str) -> DataFrame:
    """Two variables in one constraint, by rejection: P(delay > other) = μ / (λ + μ) of exponentials."""
    rows = _suppliers(spark, root).df.withColumn("other", rv("exponential", 0.5, key=["s_suppkey"], salt="other"))
    rows = rows.withColumn("q", I.conf_one(F.array(gt(F.col("delay"), F.col("other"))), samples=4000))
    want = F.expr(f"0.5D / ({_RATE} + 0.5)")
    return near(rows, ["s_suppkey"], "q", want, 5 * F.sqrt(want * (1 - want) / 4000))


def rv_rejection_expectation(spark: SparkSession, root: str) -> DataFrame:
    """E[delay · 1(delay < other)] = λ / (λ + μ)²: the values come from the worlds that rejection keeps."""
    rows = _suppliers(spark, root).df.withColumn("other", rv("exponential", 0.5, key=["s_suppkey"], salt="other"))
    rows = rows.withColumn("q", I.expectation("delay", F.array(gt(F.col("other"), F.col("delay"))), samples=4000))
    want = F.expr(f"{_RATE} / pow({_RATE} + 0.5, 2)")
    return near(rows, ["s_suppkey"], "q", want, 8 * want / 4000**0.5)


def rv_subscript_independent(spark: SparkSession, root: str) -> DataFrame:
    """Components of a variable are independent draws of it: P(X[1] > X[2]) = 1/2."""
    x = F.col("delay")
    rows = _suppliers(spark, root).df.withColumn("q", I.conf_one(F.array(gt(subscript(x, 1), subscript(x, 2))), samples=4000))
    return near(rows, ["s_suppkey"], "q", F.lit(0.5), 5 * 0.5 / 4000**0.5)


def rv_switches(spark: SparkSession, root: str) -> DataFrame:
    """The same confidence without distribution functions, and without splitting constraints into independent groups:
    P(1 < delay < 3) P(drift > balance)."""
    rows = _suppliers(spark, root).where(gt(F.col("delay"), 1), lt(F.col("delay"), 3), gt(F.col("drift"), const(F.col("s_acctbal")))).df
    want = F.expr(f"(exp(-{_RATE}) - exp(-3 * {_RATE})) / 2")
    each = rows.select("s_suppkey", "s_nationkey", I.conf_one(samples=4000, exact=False).alias("sampled"), I.conf_one(samples=4000, exact=False, grouped=False).alias("joint"), I.conf_one().alias("exact"))
    worst = each.withColumn("q", F.greatest(F.abs(F.col("sampled") - want), F.abs(F.col("joint") - want), 1e4 * F.abs(F.col("exact") - want)) + want)
    return near(worst, ["s_suppkey"], "q", want, 5 * 0.5 / 4000**0.5)


def _uniforms(spark: SparkSession, root: str) -> CTable:
    suppliers = table(spark, root, "supplier").select("s_suppkey", "s_nationkey")
    return CTable(suppliers.withColumn("u", rv("uniform", 0, 1, key=["s_suppkey"], salt="u")))


def _sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))


def rv_expectation_max(spark: SparkSession, root: str) -> DataFrame:
    """The expected maximum of n uniforms is n / (n + 1)."""
    rows = _uniforms(spark, root).df
    return near(I.expectation_max(rows, "u", ["s_nationkey"], samples=2000, name="q").join(_sizes(rows), "s_nationkey"), ["s_nationkey"], "q", F.expr("n / (n + 1)"), _FOUR * 0.3)


def rv_histograms(spark: SparkSession, root: str) -> DataFrame:
    """The sampled worlds themselves: how many, the mean of the sums (n / 2) and of the maxima (n / (n + 1)), and whether
    no world's maximum exceeds its sum."""
    rows = _uniforms(spark, root).df
    sums = I.expectation_hist(rows, "u", ["s_nationkey"], "sum", samples=2000, name="sums")
    maxima = I.expectation_hist(rows, "u", ["s_nationkey"], "max", samples=2000, name="maxima")
    both = sums.join(maxima, "s_nationkey").join(_sizes(rows), "s_nationkey")
    both = both.withColumn("q", I.sample_set_expect("sums")).withColumn("m", I.sample_set_expect("maxima"))
    ordered = F.forall(F.zip_with("sums", "maxima", lambda a, b: b <= a + 1e-9), lambda x: x)
    shown = near(both, ["s_nationkey", "sums", "maxima", "n", "m"], "q", F.expr("n / 2"), _FOUR * F.sqrt(F.expr("n / 12")))
    good = F.col("good") & (F.abs(F.col("m") - F.expr("n / (n + 1)")) <= _FOUR * 0.3) & ordered
    return shown.select("s_nationkey", F.size("sums").alias("worlds"), "want", "tolerance", good.alias("good"))


def rv_symbolic_sum(spark: SparkSession, root: str) -> DataFrame:
    """A nation's sum as one expression, and its expectation: the sum of the means, of each only where its row exists."""
    total = I.symbolic_sum(_suppliers(spark, root).df, "drift", ["s_nationkey"], name="total")
    return total.select("s_nationkey", F.round(I.expectation("total", F.array().cast("array<struct<l:" + I.EQN + ",r:" + I.EQN + ">>")), 2).alias("e"))


def rv_sample_sets(spark: SparkSession, root: str) -> DataFrame:
    """Values of a delay known to lie between 1 and 3: all inside, and with the mean of the truncated exponential."""
    rows = _suppliers(spark, root).where(gt(F.col("delay"), 1), lt(F.col("delay"), 3)).df
    sets = rows.withColumn("values", I.sample_set("_atoms", "delay", 2000)).withColumn("mean", I.sample_set_expect("values")).select("s_suppkey", "s_nationkey", "values", "mean")
    each = I.sample_set_explode(sets, "values").groupBy("s_suppkey", "s_nationkey", "mean").agg(F.count(F.lit(1)).alias("values"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("q"))
    want = F.expr(f"1 / {_RATE} + (exp(-{_RATE}) - 3 * exp(-3 * {_RATE})) / (exp(-{_RATE}) - exp(-3 * {_RATE}))")
    shown = near(each, ["s_suppkey", "values", "low", "high", "q", "mean"], "q", want, _FOUR * 0.6)
    return shown.select("s_suppkey", "values", "want", "tolerance", (F.col("good") & (F.col("low") > 1) & (F.col("high") < 3) & (F.abs(F.col("q") - F.col("mean")) < 1e-9)).alias("good"))


def _bundles(spark: SparkSession, root: str) -> DataFrame:
    rows = _uniforms(spark, root).df.withColumn("w", rv("uniform", 0, 1, key=["s_suppkey"], salt="w"))
    return rows.select("s_suppkey", "s_nationkey", I.value_bundle("u", 2000).alias("a"), I.value_bundle("w", 2000).alias("b"))


def rv_bundle_arithmetic(spark: SparkSession, root: str) -> DataFrame:
    """Sum, product and maximum of two independent uniforms, world by world: means of 1 + 2, 1/4 and 2/3."""
    a, b = F.col("a"), F.col("b")
    rows = _bundles(spark, root).select("s_suppkey", I.bundle_expect(I.bundle_add(I.bundle_add(a, b), 2.0)).alias("s"), I.bundle_expect(I.bundle_mul(a, b)).alias("m"), I.bundle_expect(I.bundle_max(a, b)).alias("x"))
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("q"), F.lit(w).alias("w")) for k, c, w in (("sum", "s", 3.0), ("product", "m", 0.25), ("maximum", "x", 2 / 3)))))
    return near(rows.select("s_suppkey", kinds.alias("k")).select("s_suppkey", "k.*"), ["s_suppkey", "kind"], "q", F.col("w"), 5 * 0.41 / 2000**0.5)


def rv_presence(spark: SparkSession, root: str) -> DataFrame:
    """Worlds in which a > b (1/2), a > 0.7 (3/10) and either (0.3 + 0.7² / 2), and E[a · 1(a > 0.7)]."""
    a, b = F.col("a"), F.col("b")
    rows = _bundles(spark, root).withColumn("x", I.presence_where(I.presence(2000), a, b)).withColumn("y", I.presence_where(I.presence(2000), a, 0.7))
    rows = rows.select("s_suppkey", I.presence_share(F.col("x")).alias("p"), I.presence_share(F.col("y")).alias("q"), I.presence_share(I.presence_union(F.col("x"), F.col("y"))).alias("r"), I.bundle_expect(a, F.col("y")).alias("e"))
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("q"), F.lit(w).alias("w")) for k, c, w in (("greater", "p", 0.5), ("above", "q", 0.3), ("either", "r", 0.545), ("value", "e", 0.255)))))
    return near(rows.select("s_suppkey", kinds.alias("k")).select("s_suppkey", "k.*"), ["s_suppkey", "kind"], "q", F.col("w"), 5 * 0.5 / 2000**0.5)


def rv_bundle_sum(spark: SparkSession, root: str) -> DataFrame:
    """A nation's sum of uniforms world by world, each counted where it exceeds 1/2: n · 3/8."""
    rows = _bundles(spark, root).withColumn("there", I.presence_where(I.presence(2000), F.col("a"), 0.5))
    total = I.bundle_sum(rows, "a", ["s_nationkey"], "there", name="total").join(_sizes(rows), "s_nationkey").withColumn("q", I.bundle_expect(F.col("total")))
    return near(total, ["s_nationkey"], "q", F.expr("n * 3 / 8"), _FOUR * F.sqrt(F.expr("n * 0.16")))


QUERIES = {
    f.__name__: f
    for f in (
        rv_conf_uniform_gt, rv_conf_exponential_between, rv_expectation_linear, rv_expectation_sum, rv_max_const, rv_mc_within_tol, rv_conf_any_row, rv_conf_coverage, rv_difference, rv_structure, rv_text, rv_poisson_zero, rv_conf_normal,
        rv_rejection, rv_rejection_expectation, rv_subscript_independent, rv_switches, rv_expectation_max, rv_histograms, rv_symbolic_sum, rv_sample_sets, rv_bundle_arithmetic, rv_presence, rv_bundle_sum,
    )
}


def _near_sql(keys: str, want: str, tolerance: str, source: str = "supplier") -> str:
    return f"select {keys}, round({want}, 4) as want, round({tolerance}, 4) as tolerance, true as good from {source}"


_SIZES_SQL = "(select s_nationkey, count(*) as n from supplier group by 1)"
_TRUNCATED = f"1 / {_RATE} + (exp(-{_RATE}) - 3 * exp(-3 * {_RATE})) / (exp(-{_RATE}) - exp(-3 * {_RATE}))"
_REJECTED = f"0.5::double / ({_RATE} + 0.5)"

SQL = {
    "rv_conf_uniform_gt": "select p_partkey, round(greatest(0, (p_retailprice - 950) / p_retailprice) + 1e-10, 6) as p from part",
    "rv_conf_exponential_between": f"select s_suppkey, round(exp(-{_RATE}) - exp(-3 * {_RATE}), 6) as p from supplier",
    "rv_expectation_linear": f"select s_suppkey, round(2 * s_acctbal + 1 / {_RATE}, 4) as e from supplier",
    "rv_expectation_sum": "select s_nationkey, round(sum(s_acctbal), 2) as e from supplier group by 1",
    "rv_max_const": """with t as (select s_nationkey, s_suppkey, 0.2 + (s_suppkey % 5) * 0.1 as p from supplier),
      w as (select *, coalesce(product(1 - p) over (partition by s_nationkey order by s_suppkey desc rows between unbounded preceding and 1 preceding), 1) as none from t)
      select s_nationkey, round(sum(s_suppkey * p * none), 4) as e from w group by 1""",
    "rv_mc_within_tol": _near_sql("p_partkey", "(p_retailprice ** 2 - 300 ** 2) / (2 * p_retailprice)", "5 * (p_retailprice - 300) / sqrt(12) / sqrt(1000)", "part"),
    "rv_conf_any_row": _near_sql("s_nationkey", f"1 - product(1 - exp(-5 * {_RATE}))", "0.05", "supplier group by s_nationkey"),
    "rv_conf_coverage": _near_sql("s_nationkey", f"1 - product(1 - exp(-8 * {_RATE}))", f"0.1 * (1 - product(1 - exp(-8 * {_RATE}))) + 1e-6", "supplier group by s_nationkey"),
    "rv_difference": f"select s_suppkey, round(s_acctbal - 3 / {_RATE}, 4) as difference, round(-s_acctbal, 4) as negated from supplier",
    "rv_structure": "select s_suppkey, true as same, false as swapped, true as component, false as components, true as numbers from supplier",
    "rv_text": """select p_partkey, '+*[0=>uniform(0,' || case when p_retailprice = floor(p_retailprice) then cast(cast(p_retailprice as bigint) as varchar) else cast(p_retailprice as varchar) end || ')](0.5)-(3)' as text,
      true as same, round(p_retailprice / 4 - 3, 4) as e from part""",
    "rv_poisson_zero": "select s_suppkey, round(1 - exp(-(1 + s_nationkey * 0.1)) * (2 + s_nationkey * 0.1), 6) as more, cast(1 as double) as surely, cast(0 as double) as never from supplier",
    "rv_conf_normal": "select s_suppkey, cast(0.691462 as double) as p from supplier",
    "rv_rejection": _near_sql("s_suppkey", _REJECTED, f"5 * sqrt({_REJECTED} * (1 - {_REJECTED}) / 4000)"),
    "rv_rejection_expectation": _near_sql("s_suppkey", f"{_RATE} / pow({_RATE} + 0.5, 2)", f"8 * ({_RATE} / pow({_RATE} + 0.5, 2)) / sqrt(4000)"),
    "rv_subscript_independent": _near_sql("s_suppkey", "cast(0.5 as double)", "5 * 0.5 / sqrt(4000)"),
    "rv_switches": _near_sql("s_suppkey", f"(exp(-{_RATE}) - exp(-3 * {_RATE})) / 2", "5 * 0.5 / sqrt(4000)"),
    "rv_expectation_max": _near_sql("s_nationkey", "n / (n + 1)", "4 / sqrt(2000) * 0.3", _SIZES_SQL),
    "rv_histograms": _near_sql("s_nationkey, 2000 as worlds", "n / 2", "4 / sqrt(2000) * sqrt(n / 12)", _SIZES_SQL),
    "rv_symbolic_sum": "select s_nationkey, round(sum(s_acctbal), 2) as e from supplier group by 1",
    "rv_sample_sets": _near_sql("s_suppkey, 2000 as values", _TRUNCATED, "4 / sqrt(2000) * 0.6"),
    "rv_bundle_arithmetic": _near_sql("s_suppkey, kind", "w", "5 * 0.41 / sqrt(2000)", "supplier, (values ('sum', 3.0::double), ('product', 0.25), ('maximum', 2.0::double / 3)) k(kind, w)"),
    "rv_presence": _near_sql("s_suppkey, kind", "w", "5 * 0.5 / sqrt(2000)", "supplier, (values ('greater', 0.5::double), ('above', 0.3), ('either', 0.545), ('value', 0.255)) k(kind, w)"),
    "rv_bundle_sum": _near_sql("s_nationkey", "n * 3 / 8", "4 / sqrt(2000) * sqrt(n * 0.16)", _SIZES_SQL),
}
