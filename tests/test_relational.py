"""Relational helpers, scalar functions, sources, streaming and the entry points."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from manyworlds.functions import scalar as S
from manyworlds.operators import relational as R
from manyworlds.sources import delimited, generate_series, values, write_delimited
from manyworlds.streaming import windowed_confidence


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_strings(spark):
    L = F.lit
    assert one(spark, S.similar_to(L("abc"), "(a|b)%c")) and not one(spark, S.similar_to(L("abcd"), "a_c")) and one(spark, S.similar_to(L("a.c"), "a.c")) and not one(spark, S.similar_to(L("abc"), "a.c"))
    assert one(spark, S.regexp_replace_first(L("banana"), "an", "-")) == "b-ana" and one(spark, S.regexp_replace_first(L("x"), "an", "-")) == "x"
    assert one(spark, S.quote_ident(L('A"b'))) == '"A""b"' and one(spark, S.quote_literal(L("it's"))) == "'it''s'"
    assert one(spark, S.to_ascii(L("Zoë Łé"))) == "Zoe Łe"
    assert one(spark, S.similarity(L("word"), L("two words"))) == pytest.approx(4 / 11) and one(spark, S.similarity(L(""), L(""))) == 0
    assert one(spark, S.soundex_difference(L("Anne"), L("Ann"))) == 4


def test_numbers_dates_collections(spark):
    L = F.lit
    assert one(spark, S.int_div(L(-7), L(2))) == -3 and one(spark, S.trunc_to(L(-1.27), 1)) == pytest.approx(-1.2)
    t = L("2001-01-01 10:00:00").cast("timestamp")
    assert [one(spark, S.date_part(f, t)) for f in ("century", "millennium", "decade", "dow", "isodow", "year")] == [21, 3, 200, 1, 1, 2001]
    assert str(one(spark, S.date_trunc("century", L("2000-12-31").cast("timestamp")))) == "1901-01-01 00:00:00"
    d = lambda x: L(x).cast("date")
    assert one(spark, S.overlaps(d("2001-01-01"), d("2001-02-01"), d("2001-01-31"), d("2001-03-01"))) and not one(spark, S.overlaps(d("2001-01-01"), d("2001-02-01"), d("2001-02-01"), d("2001-03-01")))
    assert one(spark, S.array_uniq(F.array(L(1), L(1), L(2), L(1)))) == [1, 2, 1]
    m = F.create_map(L("a"), L("1"), L("b"), L(None).cast("string"))
    assert one(spark, S.map_delete(m, "a")) == {"b": None} and not one(spark, S.map_defined(m, "b")) and one(spark, S.map_defined(m, "a"))
    assert one(spark, S.map_contains(m, F.create_map(L("a"), L("1")))) and not one(spark, S.map_contains(m, F.create_map(L("a"), L("2"))))
    assert one(spark, S.map_concat(m, F.create_map(L("a"), L("9")))) == {"a": "9", "b": None}
    v = S.to_tsvector(L("The fat cat"))
    assert one(spark, S.ts_match(v, "fat & (cat | dog)")) and not one(spark, S.ts_match(v, "!fat"))
    assert one(spark, S.inet_within(L("10.1.2.3"), "10.1.0.0/16")) and one(spark, S.is_ancestor(L("a.b"), L("a.b.c"))) and not one(spark, S.is_ancestor(L("a.b"), L("a.bc")))
    assert one(spark, S.xml_element("e", L("a<b"), k=L(1))) == '<e k="1">a&lt;b</e>' and one(spark, S.enum_range(["x", "y"], L("y"))) == 2


def test_order_nulls_last_places_every_row(spark, tmp_path):
    points = [None if i % 7 == 0 else i % 5 for i in range(60)]
    spark.createDataFrame(list(enumerate(points)), "perf_id int, points int").repartition(5).write.parquet(str(tmp_path / "performance.parquet"))
    want = sorted(enumerate(points), key=lambda x: (x[1] is None, x[1] or 0, x[0]))
    got = [tuple(r) for r in entry.queries()["order_nulls_last_places"](spark, str(tmp_path)).collect()]
    assert got == [(*x, i) for i, x in enumerate(want, 1)]
    empty = spark.createDataFrame([], "v int")
    assert R.placed(empty, *R.nulls_last("v")).count() == 0


def test_relational(spark):
    df = spark.createDataFrame([(1, 3, "a"), (1, 5, "b"), (2, None, "c"), (2, 1, "d")], "k int, v int, t string")
    assert rows(R.distinct_on(df, ["k"], ["v"])) == [(1, 3, "a"), (2, None, "c")] and rows(R.distinct_on(df, ["k"], ["v"], descending=True)) == [(1, 5, "b"), (2, 1, "d")]
    assert [r["v"] for r in df.orderBy(*R.nulls_last("v")).collect()] == [1, 3, 5, None]
    tree = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 4)], "p int, c int")
    assert rows(R.connect_by(tree, "p", "c", F.lit(1)).select("node", "branch")) == [(1, "1"), (2, "1~2"), (3, "1~2~3"), (4, "1~4")]
    assert R.connect_by(tree, "p", "c", F.lit(1), depth=1).count() == 3
    n = R.normal_rand(spark.range(20_000), 5, 2, 1, ["id"])
    assert n.agg(F.avg("value"), F.stddev("value")).first() == pytest.approx((5, 2), abs=0.1)
    assert rows(R.upsert(df, df.filter("k = 1").limit(1), ["k"]).groupBy("k").count()) == [(1, 1), (2, 2)]


def test_sources(spark, tmp_path):
    df = values(spark, [(1, "a\tb"), (2, None), (3, 'q"')], "n int, t string")
    write_delimited(df, str(tmp_path / "x"))
    assert rows(delimited(spark, str(tmp_path / "x"), "n int, t string")) == rows(df)
    assert [r[0] for r in generate_series(spark, 5, 1, -2).collect()] == [5, 3, 1] and generate_series(spark, 5, 1).count() == 0
    with pytest.raises(ValueError, match="step"):
        generate_series(spark, 1, 2, 0)


def test_streaming_agrees_with_the_table(spark, tmp_path):
    events = spark.createDataFrame([(f"2024-01-01 00:0{i}:00", 0.1 * i, float(i)) for i in range(9)], "ts string, p double, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = windowed_confidence(stream, "ts", "p", "3 minutes", value="v", late="1 hour").writeStream.format("memory").queryName("conf_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    time.sleep(0.1)
    q.stop()
    got, want = rows(spark.table("conf_out")), rows(windowed_confidence(events, "ts", "p", "3 minutes", value="v"))
    assert len(got) == 3 and [x[:2] for x in got] == [x[:2] for x in want]
    for a, b in zip(got, want):
        assert a[2:] == pytest.approx(b[2:])


def test_entry_points(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(f"p{n}_found" in entry.queries() for n in (3, 4, 6))
    with pytest.raises(KeyError):
        entry.queries()["nothing"]


def test_templates_intervals_bits(spark):
    from datetime import datetime

    from manyworlds.functions import formats as X

    t = F.lit(datetime(2024, 2, 9, 15, 4, 5)).cast("timestamp")
    for template, text in (("YYYY-MM-DD HH24:MI:SS", "2024-02-09 15:04:05"), ("FMMonth FMDD, YYYY", "February 9, 2024"), ("Month|", "February |"), ("DY MON HH12 PM", "FRI FEB 03 PM"), ('DDD "day" Q', "040 day 1")):
        assert one(spark, X.to_char(t, template)) == text
    assert one(spark, X.to_timestamp(F.lit("09.02.2024 15:04"), "DD.MM.YYYY HH24:MI").cast("string")) == "2024-02-09 15:04:00" and one(spark, X.to_timestamp(F.lit("nonsense"), "YYYY")) is None
    for x, template, text in ((1234.5, "9,999.99", " 1,234.50"), (-1234.5, "9,999.99", "-1,234.50"), (0.5, "0.99", " 0.50"), (7, "099", " 007"), (12345, "999", " ###"), (485, "999", " 485"), (None, "9", None)):
        assert one(spark, X.number_to_char(F.lit(x).cast("double"), template)) == text
    assert [str(one(spark, X.to_number(F.lit(x), 2))) for x in ("1,234.50-", " $12 ", "<3>", "x")] == ["-1234.50", "12.00", "-3.00", "None"]
    iv = one(spark, X.justify_days(X.justify_hours(X.interval(0, 29, 49 * 3_600_000_000))))
    assert (iv["months"], iv["days"], iv["micros"]) == (1, 1, 3_600_000_000)
    back = one(spark, X.justify_hours(X.interval(0, 0, -25 * 3_600_000_000)))
    assert (back["days"], back["micros"]) == (-1, -3_600_000_000)
    assert one(spark, X.plus_interval(F.lit("2024-01-31").cast("timestamp"), X.interval(1)).cast("string")) == "2024-02-29 00:00:00"
    assert one(spark, X.bits_op(F.lit("101"), F.lit("10"), "and")) is None and one(spark, X.bits_shift(F.lit("1011"), -1)) == "0101"
    assert one(spark, X.hmac_sha256(F.lit("what do ya want for nothing?"), b"Jefe")) == "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"
    assert one(spark, X.as_uuid(F.lit("nope"))) is None
    assert one(spark, S.label_common(F.lit("a.b.c"), F.lit("a.b"))) == "a" and one(spark, S.label_level(F.lit(""))) == 0
