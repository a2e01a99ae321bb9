"""Random variables: closed forms, and sampling within its tolerance."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from manyworlds.variables import CTable, add, const, from_text, gt, lt, mul, neg, rv, structurally_equal, sub, subscript, to_text
from manyworlds.variables import integrate as I


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 0.5), (3, 1.0)], "k int, rate double")
    return CTable(df.withColumn("u", rv("uniform", 0, 10, key=["k"], salt="u")).withColumn("e", rv("exponential", F.col("rate"), key=["k"], salt="e")).withColumn("n", rv("normal", F.col("k"), 2.0, key=["k"], salt="n")).withColumn("q", rv("poisson", 3.0, key=["k"], salt="q")))


def column(table, c):
    return [r[0] for r in table.df.select("k", c.alias("x")).orderBy("k").select("x").collect()]


def test_intervals_are_exact(table):
    assert column(table.where(gt(F.col("u"), 7)), I.conf_one()) == pytest.approx([0.3] * 3)
    assert column(table.where(gt(F.col("u"), 7), lt(F.col("u"), 9)), I.conf_one()) == pytest.approx([0.2] * 3)
    assert column(table.where(gt(F.col("e"), 1)), I.conf_one()) == pytest.approx([math.exp(-2), math.exp(-0.5), math.exp(-1)])
    assert column(table.where(gt(F.col("n"), const(F.col("k")))), I.conf_one()) == pytest.approx([0.5] * 3)
    assert column(table.where(gt(add(mul(F.col("u"), -2), 10), 4)), I.conf_one()) == pytest.approx([0.3] * 3)
    both = table.where(gt(F.col("u"), 5), gt(F.col("e"), 1))
    assert column(both, I.conf_one(samples=20_000, exact=False))[0] == pytest.approx(0.5 * math.exp(-2), abs=0.01)
    assert column(both, I.conf_one(samples=20_000, grouped=False))[0] == pytest.approx(0.5 * math.exp(-2), abs=0.01)
    # Whole numbers: more than 2, less than 5 is 3 or 4.
    want = math.exp(-3) * (27 / 6 + 81 / 24)
    assert column(table.where(gt(F.col("q"), 2), lt(F.col("q"), 5)), I.conf_one()) == pytest.approx([want] * 3)
    # Independent groups multiply; a contradiction has no world.
    assert column(table.where(gt(F.col("u"), 5), gt(F.col("e"), 1)), I.conf_one())[0] == pytest.approx(0.5 * math.exp(-2))
    assert column(table.where(gt(F.col("u"), 5), lt(F.col("u"), 5)), I.conf_one()) == [0.0] * 3
    assert column(table, I.conf_one()) == [1.0] * 3


def test_expectation(table):
    assert column(table, I.expectation(add(mul(F.col("u"), 3), neg(F.col("n"))))) == pytest.approx([14.0, 13.0, 12.0])
    got = column(table.where(gt(F.col("u"), 5)), I.expectation(F.col("u"), samples=20_000))
    assert got == pytest.approx([7.5 * 0.5] * 3, rel=0.02)
    got = column(table.where(gt(F.col("u"), F.col("n"))), I.expectation(mul(F.col("u"), F.col("u")), samples=20_000))
    assert all(10 < x < 40 for x in got)
    assert column(table.where(gt(F.col("u"), 11)), I.expectation(F.col("u"))) == [0.0] * 3
    assert table.df.agg(I.expectation_sum("u")).first()[0] == pytest.approx(15.0)


def test_world_aggregates(table):
    some = table.where(gt(F.col("u"), 5)).df
    assert I.expectation_hist(some, "u", [], samples=500).first()[0].__len__() == 500
    assert I.expectation_max(some, "u", samples=4000).first()[0] == pytest.approx(3 / 4000 * (10**4 - 5**4), abs=0.2)  # the density of the largest of three, above 5
    assert I.conf_naive(some, samples=4000).first()[0] == pytest.approx(1 - 0.5**3, abs=0.03)
    assert I.conf_sample(some, samples=4000).first()[0] == pytest.approx(1 - 0.5**3, abs=0.03)
    assert I.conf_sample(some.union(some), samples=4000).first()[0] == pytest.approx(1 - 0.5**3, abs=0.03)


def test_coverage_counts_rare_rows_and_shared_variables(spark):
    df = spark.createDataFrame([(g, i) for g in ("a", None) for i in range(2000)], "g string, i int")
    rare = CTable(df.withColumn("u", rv("uniform", 0, 1, key=["g", "i"], salt="rare"))).where(lt(F.col("u"), 1e-4)).df
    got = {r["g"]: r["conf"] for r in I.conf_sample(rare, ["g"]).collect()}
    assert got == {g: pytest.approx(1 - (1 - 1e-4) ** 2000, rel=0.05) for g in ("a", None)}
    # One variable for all rows: the widest interval holds the others.
    one = CTable(spark.range(1, 6).withColumn("u", rv("uniform", 0, 1, salt="one"))).where(lt(F.col("u"), const(F.col("id") * 0.001))).df
    assert I.conf_sample(one, samples=4000).first()[0] == pytest.approx(0.005, rel=0.1)
    # Two variables are sampled, one of them shared by all rows.
    two = CTable(spark.range(3).withColumn("u", rv("uniform", 0, 1, salt="shared")).withColumn("v", rv("uniform", 0, 20, key=["id"], salt="own"))).where(gt(F.col("u"), F.col("v"))).df
    assert I.conf_sample(two, samples=4000).first()[0] == pytest.approx(1 - 5 * (1 - 0.95**4), rel=0.1)
    never = CTable(spark.range(2).withColumn("u", rv("uniform", 0, 1, key=["id"], salt="never"))).where(gt(F.col("u"), 2)).df
    assert I.conf_sample(never).first()[0] == 0 and I.conf_sample(never.limit(0)).first()[0] == 0


def test_max_of_constants(spark):
    df = spark.createDataFrame([(5.0, 0.5), (3.0, 0.5), (3.0, 0.5), (1.0, 1.0)], "v double, p double")
    assert I.max_of_constants(df, "v", "p").first()[0] == pytest.approx(5 * 0.5 + 3 * 0.5 * 0.75 + 1 * 0.5 * 0.25)


def test_symbols(table):
    x = F.col("u")
    assert column(table, to_text(sub(mul(const(2.0), const(3.0)), 1)))[0] == "+*(2)(3)-(1)"
    assert column(table, structurally_equal(add(x, 1), add(x, 1))) == [True] * 3
    assert column(table, structurally_equal(x, subscript(x, 1))) == [False] * 3
    total = I.symbolic_sum(table.where(gt(F.col("u"), 5)).df, "u")
    total = total.select(I.expectation("total", F.array().cast("array<" + "struct<l:%s,r:%s>" % (I.EQN, I.EQN) + ">"), samples=20_000))
    assert total.first()[0] == pytest.approx(3 * 7.5 * 0.5, rel=0.05)
    with pytest.raises(ValueError, match="unknown distribution"):
        rv("cauchy", 1)
    with pytest.raises(ValueError, match="parameters"):
        rv("normal", 1)


def test_sets_bundles_presence(table):
    df = table.where(gt(F.col("u"), 5)).df
    s = df.select("k", I.sample_set("_atoms", "u", 200).alias("s"))
    assert s.select(F.array_min("s")).first()[0] > 5 and s.select(I.sample_set_expect("s")).first()[0] == pytest.approx(7.5, abs=0.5)
    b = table.df.select("k", I.value_bundle("u", 400).alias("b"))
    here = I.presence_where(I.presence(400), F.col("b"), 5.0)
    assert b.select(I.presence_share(here)).first()[0] == pytest.approx(0.5, abs=0.1)
    assert b.select(I.presence_share(I.presence_union(here, I.presence(400)))).first()[0] == 1.0
    assert b.select(I.bundle_expect(I.bundle_mul(I.bundle_add(F.col("b"), 1.0), 2.0))).first()[0] == pytest.approx(12, abs=1)
    assert b.select(I.bundle_expect(I.bundle_max(F.col("b"), 20.0), low=10, high=20)).first()[0] == 20.0
    total = I.bundle_sum(b.withColumn("t", here), "b", there="t")
    assert total.select(I.bundle_expect(F.col("bundle"))).first()[0] == pytest.approx(3 * 3.75, abs=1)


def test_joins_keep_constraints(table):
    a = table.where(gt(F.col("u"), 5)).select("k", "u")
    both = a.join(table.where(gt(F.col("e"), 1)).select("k", "e"), "k")
    assert column(both, I.conf_one())[0] == pytest.approx(0.5 * math.exp(-2))
    assert a.union_all(a).df.count() == 6 and a.where(F.col("k") > 1).df.count() == 2


def test_text_is_read_back(table):
    table, x = table.df, F.col("n")
    e = sub(mul(add(x, 0.1), const(-3.0)), neg(subscript(x, 2)))
    out = table.withColumn("e", e).withColumn("t", to_text("e")).withColumn("again", from_text("t"))
    assert all(r[0] for r in out.select(structurally_equal(F.col("e"), F.col("again"))).collect())
    guarded = table.withColumn("e", I.such_that(add(x, 1), F.array(gt(x, 2)))).withColumn("again", from_text(to_text("e")))
    assert all(r[0] for r in guarded.select(structurally_equal(F.col("e"), F.col("again"))).collect())
    for bad in ("(1", "+(1)", "(1)(2)", "hello"):
        with pytest.raises(Exception, match="not an expression"):
            table.limit(1).select(from_text(F.lit(bad))).collect()


def test_one_interval_needs_no_python(spark):
    df = spark.createDataFrame([(2.0,)], "a double")
    u, e = rv("uniform", 0, 4, salt="u"), rv("exponential", 2, salt="e")
    cases = [(u, [gt(u, 1)], 0.75), (u, [lt(u, 1)], 0.25), (u, [gt(u, 1), lt(u, 3), gt(u, 2)], 0.25), (u, [gt(u, 5)], 0.0), (u, [gt(u, 3), lt(u, 1)], 0.0), (u, [gt(u, -1)], 1.0), (e, [gt(e, 1)], 0.135335), (e, [lt(e, -1)], 0.0), (e, [lt(2, e), lt(e, 3)], 0.015837)]
    got = df.select(*(F.round(I.conf_one(F.array(*atoms)), 6) for _, atoms, _ in cases)).first()
    assert list(got) == [p for *_, p in cases]
    slow = df.select(*(F.round(I.conf_one(F.array(*atoms), exact=True, grouped=False), 6) for _, atoms, _ in cases)).first()
    assert list(slow) == list(got)
