"""Safe plans against the solver."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from manyworlds.operators.construct import pick_tuples
from manyworlds.plans.safe import NotHierarchical, is_hierarchical, safe_conf


def test_which_joins_nest():
    assert is_hierarchical(["r", "s"], [("r.a", "s.a")])
    assert not is_hierarchical(["r", "s", "t"], [("r.a", "s.a"), ("s.b", "t.b")])
    assert is_hierarchical(["r", "s", "t"], [("r.a", "s.a"), ("s.b", "t.b")], ["s.b"])


def test_safe_plans_agree_with_the_solver(spark):
    rng = random.Random(5)
    r = spark.createDataFrame([(i, rng.choice("xy"), rng.random()) for i in range(6)], "a int, g string, p double")
    s = spark.createDataFrame([(rng.randrange(6), rng.randrange(3), rng.random()) for _ in range(12)], "a int, b int, p double")
    t = spark.createDataFrame([(rng.randrange(6), rng.random()) for _ in range(5)], "a int, p double")
    tables = {"r": (r, "p"), "s": (s, "p"), "t": (t, "p")}
    equal = [("r.a", "s.a"), ("r.a", "t.a")]
    u = {n: pick_tuples(df, p).alias(n) for n, (df, p) in tables.items()}
    joined = u["r"].join(u["s"], F.col("r_a") == F.col("s_a")).join(u["t"], F.col("r_a") == F.col("t_a"))
    for by, names in (([], []), (["r.g"], ["r_g"]), (["r.g", "s.b"], ["r_g", "s_b"])):
        got = sorted(tuple(x) for x in safe_conf(tables, equal, by).collect())
        want = sorted(tuple(x) for x in joined.conf(*names).collect())
        assert [x[:-1] for x in got] == [x[:-1] for x in want] and [x[-1] for x in got] == pytest.approx([x[-1] for x in want])
    with pytest.raises(NotHierarchical):
        safe_conf({"r": (s, "p"), "s": (s, "p"), "t": (t, "p")}, [("r.a", "s.a"), ("s.b", "t.a")])
    assert safe_conf({"r": (r.limit(0), "p"), "s": (s, "p")}, [("r.a", "s.a")]).first()[0] == 0.0
