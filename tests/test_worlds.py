"""Uncertain tables against enumerated worlds and the published examples."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from manyworlds.functions import confidence
from manyworlds.functions.conditions import COND, tconf
from manyworlds.model import NotSupported, UTable, argmax, posterior, posterior_within
from manyworlds.operators.construct import pick_tuples, repair_key


def enumerated(clauses, p):
    """The probability by going through all worlds."""
    values = {}
    for (v, d), x in p.items():
        values.setdefault(v, {})[d] = x
    for v, ds in values.items():
        ds[None] = 1 - sum(ds.values())
    total = 0.0
    for world in itertools.product(*(ds.items() for ds in values.values())):
        chosen = dict(zip(values, (d for d, _ in world)))
        if any(all(chosen[v] == d for v, d in c) for c in clauses):
            q = 1.0
            for _, x in world:
                q *= x
            total += q
    return total


def random_lineage(rng):
    p = {}
    for v in range(rng.randint(1, 6)):
        cuts = [rng.random() for _ in range(rng.randint(2, 4))]
        for d, x in enumerate(cuts[:-1]):
            p[v, d] = x / sum(cuts)
    atoms = list(p)
    clauses = set()
    for _ in range(rng.randint(0, 8)):
        c = {}
        for v, d in rng.sample(atoms, min(len(atoms), rng.randint(1, 3))):
            c.setdefault(v, d)
        clauses.add(frozenset(c.items()))
    return frozenset(clauses), p


def test_solvers_agree_with_enumerated_worlds():
    rng = random.Random(7)
    for _ in range(150):
        clauses, p = random_lineage(rng)
        want = enumerated(clauses, p)
        assert confidence.exact(clauses, p) == pytest.approx(want, abs=1e-9)
        assert abs(confidence.bounded(clauses, p, 0.05, True) - want) <= 0.05 * want + 1e-9
        assert abs(confidence.bounded(clauses, p, 0.01, False) - want) <= 0.01 + 1e-9
        assert confidence.bounded(clauses, p, 0.0, True) == pytest.approx(want, abs=1e-9)


def test_sampling_is_within_epsilon_mostly():
    rng, off = random.Random(3), 0
    for k in range(20):
        clauses, p = random_lineage(rng)
        want = enumerated(clauses, p)
        off += abs(confidence.sampled(clauses, p, 0.1, 0.05, k) - want) > 0.1 * want + 1e-12
        assert confidence.sampled(clauses, p, 0.2, 0.1, k) == confidence.sampled(clauses, p, 0.2, 0.1, k)
    assert off <= 3


def test_walkthrough_and_hardness():
    p = {("x", 1): 0.1, ("x", 2): 0.4, ("y", 1): 0.2, ("z", 1): 0.4, ("u", 1): 0.7, ("u", 2): 0.3, ("v", 1): 0.5}
    c = [{("x", 1)}, {("x", 2), ("y", 1)}, {("x", 2), ("z", 1)}, {("u", 1), ("v", 1)}, {("u", 2)}]
    assert confidence.exact(frozenset(map(frozenset, c)), p) == pytest.approx(0.7578)
    with pytest.raises(confidence.TooHard):
        confidence.exact(frozenset(frozenset([(i, 1), (j, 1)]) for i in range(12) for j in range(i)), {(i, 1): 0.5 for i in range(12)}, steps=3)


def rows(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_repair_key(spark):
    r = spark.createDataFrame([(1, 1, 1, 0), (2, 1, 1, 1), (2, 1, 2, 1), (3, 1, 1, 0), (1, 1, 2, 2)], "a int, b int, c int, w int")
    s = repair_key(r, ["a", "b"], "w")
    assert rows(s.tconf().select("a", "b", "c", "tconf")) == [(1, 1, 2, 1.0), (2, 1, 1, 0.5), (2, 1, 2, 0.5)]
    with pytest.raises(Exception, match="negative weight"):
        repair_key(spark.createDataFrame([(1, -1.0)], "a int, w double"), ["a"], "w").df.collect()
    assert rows(repair_key(r, ["a", "b"], "w", distinct=True).tconf()) == rows(s.tconf())
    # Repeated rows share their variable; nulls are a key like any other.
    d = repair_key(spark.createDataFrame([(0.5, "x"), (0.5, "x"), (1.0, "y"), (None, "z"), (None, "u")], "p double, t string"), ["p"])
    assert sorted(r["tconf"] for r in d.tconf().collect()) == [0.5, 0.5, 1.0, 1.0, 1.0]
    assert rows(d.where("p = 0.5").conf()) == [(1.0,)]
    with pytest.raises(NotSupported):
        repair_key(s, ["a"])
    assert repair_key(r.limit(0), ["a"]).df.count() == 0
    assert rows(repair_key(r.select("a").distinct(), []).conf("a")) == [(1, 0.333333), (2, 0.333333), (3, 0.333333)]


def test_pick_tuples(spark):
    r = spark.createDataFrame([(1, 2.0), (1, 3.0), (1, 3.0), (2, 0.0)], "a int, b real")
    assert pick_tuples(r).worlds().count() == 4
    assert rows(pick_tuples(r, F.col("b") / 10).conf("a")) == [(1, round(1 - 0.8 * 0.7 * 0.7, 6))]
    with pytest.raises(Exception, match="probability outside"):
        pick_tuples(r, "b").df.collect()
    assert rows(pick_tuples(r.limit(0)).conf()) == [(0.0,)]


def test_joins_keep_what_can_exist_together(spark):
    r = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2)], "a int, b int")
    s = repair_key(r, ["a"])
    twice = s.alias("x").join(s.alias("y"))
    assert twice.df.count() == 12
    assert twice.join(s.alias("z")).df.count() == 28
    assert rows(s.alias("x").join(s.alias("y"), F.col("x_a") == F.col("y_a")).conf("x_a", "x_b", "y_b")) == [(1, 1, 1, 0.5), (1, 2, 2, 0.5), (2, 1, 1, 0.5), (2, 2, 2, 0.5)]
    # Two calls are independent of each other.
    assert s.alias("x").join(repair_key(r, ["a"]).alias("y")).df.count() == 16
    # conf over a mixed join: pick tuples and repair key.
    assert rows(pick_tuples(r).alias("x").join(s.alias("y")).conf()) == [(0.9375,)]
    for how in ("left", "full"):
        with pytest.raises(NotSupported):
            s.join(s, ["a"], how)


def triangle(spark, n):
    order = spark.createDataFrame([(i, j) for i in range(n) for j in range(i + 1, n)], "u int, v int").crossJoin(spark.createDataFrame([(1, 0.5), (0, 0.5)], "bit int, p double"))
    edge = repair_key(order, ["u", "v"], "p").where("bit = 1").select("u", "v")
    a, b, c = edge.alias("a"), edge.alias("b"), edge.alias("c")
    return a.join(b, F.col("a_v") == F.col("b_u")).join(c, (F.col("c_u") == F.col("a_u")) & (F.col("c_v") == F.col("b_v")))


@pytest.mark.parametrize(("n", "want"), [(3, 0.125), (4, 0.359375), (5, 0.621094), (6, 0.823334)])
def test_triangles(spark, n, want):
    t = triangle(spark, n)
    assert rows(t.conf()) == [(want,)]
    assert abs(t.conf_bounds(epsilon=0.05).first()[0] - want) <= 0.05 * want
    assert abs(t.aconf(epsilon=0.05, delta=0.01).first()[0] - want) <= 0.06 * want


def test_large_groups_are_split_by_spark(spark):
    left = pick_tuples(spark.range(40).select((F.col("id") % 2).alias("g"), F.floor(F.col("id") / 2).alias("k")), 0.3)
    right = pick_tuples(spark.range(60).select(F.floor(F.col("id") / 3).alias("k"), "id"), 0.2)
    both = left.join(right, "k")
    assert rows(both.conf("g", group_clauses=5)) == rows(both.conf("g"))
    want = 1 - (1 - 0.3 * (1 - 0.8**3)) ** 20
    assert rows(both.conf("g"))[0][1] == pytest.approx(want, abs=1e-6)
    assert rows(both.conf(group_clauses=5))[0][0] == pytest.approx(1 - (1 - (1 - 0.7**2) * (1 - 0.8**3)) ** 20, abs=1e-6)
    assert all(abs(r[1] - want) <= 0.1 * want for r in both.conf_bounds("g", epsilon=0.1, group_clauses=5).collect())
    assert all(abs(r[1] - want) <= 0.15 * want for r in both.aconf("g", epsilon=0.1, delta=0.01, group_clauses=5).collect())
    # A group whose key is null is split like any other; one that is a chain of shared variables stays whole.
    chain = pick_tuples(spark.range(30).select(F.lit(None).cast("string").alias("g"), "id"), 0.5)
    pairs = chain.alias("a").join(chain.alias("b"), F.col("b_id") == F.col("a_id") + 1)
    assert rows(pairs.conf("a_g", group_clauses=3)) == rows(pairs.conf("a_g"))


def test_expectations(spark):
    s = repair_key(spark.createDataFrame([(a, b) for a in (1, 2) for b in (1, 2, 3)], "a int, b int"), ["a"], "b")
    assert rows(s.esum("b", "a")) == [(1, 2.333333), (2, 2.333333)]
    assert rows(s.esum("b")) == [(4.666667,)]
    assert rows(s.ecount("a")) == [(1, 1.0), (2, 1.0)]
    sales = pick_tuples(spark.createDataFrame([(1, 5000.0, 0.7), (2, 2000.0, 0.4)], "id int, amount double, prob double"), "prob")
    assert rows(sales.esum("amount")) == [(4300.0,)]


def test_certain_tables_have_no_confidence(spark):
    for ask in (lambda t: t.conf(), lambda t: t.esum("id"), lambda t: t.aconf(epsilon=0.1, delta=0.1), lambda t: t.conf_bounds(epsilon=0.1)):
        with pytest.raises(NotSupported):
            ask(UTable(spark.range(3)))


def test_changes_and_set_operations(spark):
    s = repair_key(spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "a int, b int"), ["a"])
    more = s.insert(spark.createDataFrame([(3, 3)], "a int, b int"))
    assert rows(more.conf("a")) == [(1, 1.0), (2, 1.0), (3, 1.0)]
    assert rows(more.update({"b": F.lit(9)}, F.col("a") == 3).possible()) == [(1, 1), (1, 2), (2, 1), (3, 9)]
    assert rows(more.delete(F.col("a") < 3).possible()) == [(3, 3)]
    assert more.union_all(s).df.count() == 7
    for bad in (lambda: s.union(s), lambda: s.intersect(s), lambda: s.difference(s), lambda: s.distinct(), lambda: s.update({COND: F.lit(1)}), lambda: s.insert(spark.range(1)), lambda: s.data(), lambda: s.argmax("a", "b")):
        with pytest.raises(NotSupported):
            bad()
    c = UTable(spark.createDataFrame([(1,), (2,), (2,)], "a int"))
    assert rows(c.union(c).data()) == [(1,), (2,)]
    assert rows(c.difference(UTable(spark.createDataFrame([(2,)], "a int"))).data()) == [(1,)]


def test_flat_form_and_files(spark, tmp_path):
    s = repair_key(spark.createDataFrame([(1, 1), (1, 2)], "a int, b int"), ["a"])
    j = s.alias("x").join(s.alias("y"))
    flat = j.flat()
    assert flat.columns == ["x_a", "x_b", "y_a", "y_b", "_v0", "_d0", "_p0", "_v1", "_d1", "_p1"]
    assert rows(UTable.from_flat(flat).conf("x_b")) == rows(j.conf("x_b")) == [(1, 0.5), (2, 0.5)]
    s.save(str(tmp_path / "t"))
    back = UTable.load(spark, str(tmp_path / "t"))
    assert (back.kind, back.width) == (s.kind, s.width) and rows(back.conf("b")) == rows(s.conf("b"))


def test_coins_posterior(spark):
    coins = spark.createDataFrame([("fair", 2), ("2headed", 1)], "type string, cnt int")
    faces = spark.createDataFrame([("fair", "H", 0.5), ("fair", "T", 0.5), ("2headed", "H", 1.0)], "type string, face string, fprob double")
    picked = repair_key(coins, [], "cnt").select("type")
    assert rows(picked.conf("type")) == [("2headed", 0.333333), ("fair", 0.666667)]
    outcome = repair_key(faces.crossJoin(spark.createDataFrame([(1,), (2,)], "toss int")), ["toss", "type"], "fprob")
    tossed = picked.join(outcome, "type")
    violations = tossed.where("face <> 'H'")
    assert rows(posterior(picked, violations, "type")) == [("2headed", 0.666667), ("fair", 0.333333)]
    assert argmax(posterior(picked, violations, "type"), "type", "posterior").first()[0] == "2headed"


def test_tconf_of_any_condition(spark):
    df = spark.createDataFrame([([(1, 1, 0.5), (1, 1, 0.5), (2, 1, 0.25)],), ([(1, 1, 0.5), (1, 2, 0.5)],), ([],)], "c array<struct<v:bigint,d:bigint,p:double>>")
    assert [r[0] for r in df.select(tconf(F.col("c"))).collect()] == [0.125, 0.0, 1.0]


def test_argmax(spark):
    df = spark.createDataFrame([(1, "x", -3.0), (1, "y", -1.0), (2, "z", float("nan")), (2, "u", 5.0), (2, None, None)], "a int, b string, c double")
    assert rows(argmax(df, "b", "c", "a")) == [(1, "y"), (2, "z")]


def test_posterior_of_each_nation(spark):
    counts = spark.createDataFrame([(0, "BUILDING", 1), (0, "AUTO", 3), (1, "BUILDING", 6), (1, "AUTO", 1), (1, "FOOD", 3), (2, "FOOD", 4), (3, "BUILDING", 2), (None, "BUILDING", 1), (None, "FOOD", 1)], "nation int, segment string, n int")
    chosen = repair_key(counts, ["nation"], "n")
    got = [(r[0], r[1], r[2] if r[2] is None else round(r[2], 6)) for r in posterior_within(chosen, chosen.where("segment = 'BUILDING'"), ["nation"], "segment").collect()]
    want = [(0, "BUILDING", 0.0), (0, "AUTO", 1.0), (1, "BUILDING", 0.0), (1, "AUTO", 0.25), (1, "FOOD", 0.75), (2, "FOOD", 1.0), (3, "BUILDING", None), (None, "BUILDING", 0.0), (None, "FOOD", 1.0)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_clashing_names_show(spark):
    r = repair_key(spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "a int, b int"), ["a"])
    assert r.clashes().count() == 0
    same = r.mapped(lambda df: df.withColumn(COND, F.transform(COND, lambda x: x.withField("v", F.lit(7).cast("bigint")).withField("d", F.xxhash64("a", "b")))))
    assert [x["v"] for x in same.clashes().collect()] == [7]
