"""The data-preparation operators against brute force, and what they do with awkward rows."""

from __future__ import annotations

import itertools
import random
import re
from datetime import date, datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from manyworlds.operators import lenient, orphans, rolling, skew, wide
from manyworlds.queries.prep import QUERIES, SKILL_TYPES, line_layouts


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- a few keys holding most records ---------------------------------------------------------------------------------


def test_eager_join_is_the_join(spark):
    rng = random.Random(1)
    left = [(rng.choice(["hot", "hot", "a", "b", None]), rng.choice([None, 1.0, 2.5])) for _ in range(60)]
    right = [(rng.choice(["hot", "a", "c", None]), rng.choice([None, 0.5, 4.0])) for _ in range(40)]
    a, b = spark.createDataFrame(left, "k string, x double"), spark.createDataFrame(right, "k string, y double")
    got = {r["k"]: r for r in skew.eager_join(a, b, ["k"], {"x": "x"}, {"y": "y"}).collect() if r["k"] is not None}
    for k in ("hot", "a", "b", "c"):
        pairs = [(x, y) for u, x in left for v, y in right if u == v == k]
        r = got[k]
        assert (r["joined_rows"], r["joined_x"], r["joined_y"]) == (len(pairs), sum(x or 0 for x, _ in pairs), sum(y or 0 for _, y in pairs))
        assert (r["left_rows"], r["right_rows"]) == (sum(u == k for u, _ in left), sum(v == k for v, _ in right))
    nulls = [r for r in skew.eager_join(a, b, ["k"]).collect() if r["k"] is None]
    assert sorted((r["left_rows"], r["right_rows"], r["joined_rows"]) for r in nulls) == sorted([(sum(u is None for u, _ in left), 0, 0), (0, sum(v is None for v, _ in right), 0)])


def test_rolled_join_and_heavy_keys(spark):
    a = spark.createDataFrame([("h", 1, 1.0)] * 60 + [(f"k{i}", 0, 2.0) for i in range(40)] + [(None, 1, 1.0)] * 5, "u string, bit int, p double")
    b = spark.createDataFrame([("h", 1)] * 3 + [("k1", 2)], "u string, bit int")
    assert rows(skew.rolled_join(a, b, ["u"], ["bit"], {"s": "p"})) == [(0, 1, 2.0), (1, 180, 180.0)]
    assert rows(skew.heavy_keys(a, b, "u", ("a", "b"))) == [("a", "h"), ("b", "h"), ("b", "k1")]
    assert rows(skew.heavy_keys(a.limit(0), b.limit(0), "u", ("a", "b"))) == []


def test_joined_rows_pass_64_bits(spark):
    a = spark.createDataFrame([("h", 4_000_000_000), ("n", None)], "u string, left_rows bigint").withColumn("right_rows", F.col("left_rows"))
    assert [r[0] for r in a.select(skew.times("left_rows", "right_rows")).collect()] == [16 * 10**18, None]


# --- attribute-value rows --------------------------------------------------------------------------------------------


def test_widen(spark):
    data = [
        (1, " A ", "Pass ", "N", 1, "x"), (2, "A", "pass", "y", 2, "x"), (3, "A", "PASS", "  ", 3, "x"),  # the last usable one counts
        (4, "A", "shoot_pct", "45%", 1, "x"), (5, "B", "shoot_pct", ".5", 1, "x"), (6, "B", "vertical_cm", "7O", 1, "x"), (7, "B", "assessed_on", "2022-13-01", 1, "x"),
        (8, "C", "nobody knows", "1", 1, "x"), (9, None, "pass", "y", 1, "x"), (10, "D", None, None, 1, "x"), (11, "A", "vertical_cm", "70", 1, "x"), (11, "A", "vertical_cm", "70", 1, "x"),
        (12, "", "pass", "true", 1, "x"),
    ]
    df = spark.createDataFrame(data, "skill_id int, player string, skill string, has string, loaded_at int, e string")
    got = {r["player"]: r for r in wide.widen(df, "player", "skill", "has", SKILL_TYPES, ["loaded_at", "skill_id"]).collect()}
    assert set(got) == {"A", "B", "C", "D", ""}
    assert (got["A"]["pass"], got["A"]["shoot_pct"], got["A"]["vertical_cm"]) == (True, 0.45, 70)
    assert (got["B"]["shoot_pct"], got["B"]["vertical_cm"], got["B"]["assessed_on"]) == (0.5, None, None)
    assert all(v is None for k, v in got["C"].asDict().items() if k != "player") and got[""]["pass"] is True
    assert wide.widen(df.limit(0), "player", "skill", "has", SKILL_TYPES, ["skill_id"]).count() == 0
    dec = wide.widen(df, "player", "skill", "has", {"shoot_pct": "decimal(5,2)"}, ["skill_id"]).filter("player = 'A'").first()
    assert str(dec["shoot_pct"]) == "0.45"


def test_found_types(spark):
    data = [("A", " N", "1"), ("A", "n", "12"), ("B", "n", "x"), ("A", "n", "7"), ("A", "n", "8"), ("A", "N ", "9"), ("A", "d", "2024-01-01"), ("A", "f", "yes"), ("A", "t", "hello"), ("A", "q", "1.5"), ("A", "", "1"), (None, None, "1"), ("A", "void", " ")]
    df = spark.createDataFrame(data, "e string, a string, v string")
    types = wide.found_types(df, "a", "v")
    assert types == {"d": "date", "f": "boolean", "n": "int", "q": "double", "t": "string"}
    got = {r["e"]: r for r in wide.widen(df.withColumn("i", F.monotonically_increasing_id()), "e", "a", "v", types, ["i"]).collect()}
    assert (got["A"]["n"], got["A"]["q"], got["A"]["t"], got["B"]["n"]) == (9, 1.5, "hello", None)
    assert wide.found_types(df.limit(0), "a", "v") == {}
    with pytest.raises(ValueError, match="more than"):
        wide.found_types(df, "a", "v", most=2)


def test_a_new_attribute_gets_a_column(spark, tmp_path):
    data = [(1, "A", "pass", "y", at(1)), (2, "A", "Sprint", "12", at(1)), (3, "B", "sprint ", "9", at(1)), (4, "B", "zone_defence", "n", at(1))]
    spark.createDataFrame(data, "skill_id bigint, player string, skill string, has string, loaded_at timestamp_ntz").write.parquet(f"{tmp_path}/skills.parquet")
    got = {r["player"]: r for r in QUERIES["p2_skills_wide"](spark, str(tmp_path)).collect()}
    assert (got["A"]["sprint"], got["B"]["sprint"], got["A"]["pass"], got["B"]["zone_defence"], got["B"]["pass"]) == (12, 9, True, False, None)


# --- references ------------------------------------------------------------------------------------------------------

DAY = datetime(2024, 1, 1)


def at(n):
    return None if n is None else DAY + timedelta(days=n)


@pytest.mark.parametrize("bounds", [{}, {"range_rows": 20, "slice_rows": 30}, {"range_rows": 3, "slice_rows": 10}])
def test_missing_references(spark, bounds):
    rng = random.Random(2)
    names = [f"n{i}" for i in range(25)]
    parents = [(rng.choice([*names, None, ""]), at(rng.choice([None, *range(40)])), at(rng.choice([None, None, *range(60)])), 1) for _ in range(60)]
    refs = [(i, rng.choice([" n1", "n1", *names, "nobody", None, " "]), at(rng.choice([None, *range(60)]))) for i in range(300)]
    p = spark.createDataFrame(parents, "player string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, part int")
    r = spark.createDataFrame(refs, "perf_id int, player string, loaded_at timestamp_ntz").withColumn("k", F.lit(1)).withColumn("part", F.lit(1))
    got = rows(orphans.missing_references([("t", r, "perf_id", "player", "loaded_at")], p, "player", "loaded_at", "deleted_at", **bounds))
    want = [
        ("t", t.strftime("%Y-%m") if t else None, i)
        for i, k, t in refs
        if k is not None and not (t and any(q is not None and q.strip(" ") == k.strip(" ") and a and a <= t and (b is None or b > t) for q, a, b, _ in parents))
    ]
    assert got == sorted(want, key=str)
    empty = orphans.missing_references([("t", r, "perf_id", "player", "loaded_at")], p.limit(0), "player", "loaded_at", "deleted_at", **bounds)
    assert empty.count() == sum(k is not None for _, k, _ in refs)
    assert orphans.missing_references([("t", r.limit(0), "perf_id", "player", "loaded_at")], p, "player", "loaded_at", "deleted_at", **bounds).count() == 0
    assert sum(x["orphans"] for x in orphans.orphan_report(empty).collect()) == empty.count()


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_without_zone_stand_as_they_are(spark, zone):
    was = spark.conf.get("spark.sql.session.timeZone")
    p = spark.createDataFrame([("a", datetime(2024, 3, 10, 2, 15), None), ("b", datetime(2024, 3, 10, 3, 15), None)], "k string, s timestamp_ntz, e timestamp_ntz")
    r = spark.createDataFrame([(1, "a", datetime(2024, 3, 10, 2, 45)), (2, "b", datetime(2024, 3, 10, 2, 45)), (3, "c", datetime(2024, 3, 31, 23, 59))], "i int, k string, t timestamp_ntz")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = rows(orphans.missing_references([("r", r, "i", "k", "t")], p, "k", "s", "e"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
    assert got == [("r", "2024-03", 2), ("r", "2024-03", 3)]


def test_a_parent_with_very_many_spans_is_split_by_time(spark):
    rng = random.Random(8)
    spans = [("hot", at(n), at(n + rng.choice([1, 2, 3, 400]) if n % 7 else None if n > 900 else n + 1), 0) for n in range(0, 1000, 3)] + [(f"k{i}", at(i), None, 0) for i in range(30)]
    refs = [(i, rng.choice(["hot", "hot", "hot", "k3", "no"]), at(rng.randint(0, 1100))) for i in range(500)]
    p = spark.createDataFrame(spans, "k string, s timestamp_ntz, e timestamp_ntz, piece int")
    r = spark.createDataFrame(refs, "i int, k string, t timestamp_ntz")
    got = rows(orphans.missing_references([("r", r, "i", "k", "t")], p, "k", "s", "e", range_rows=40, slice_rows=60))
    assert got == sorted([("r", t.strftime("%Y-%m"), i) for i, k, t in refs if not any(q == k and a <= t and (b is None or b > t) for q, a, b, _ in spans)], key=str)


def test_excess_delimiters_may_be_spread_over_fields():
    layout = lenient.Layout(("a", "n", "b", "m"), (None, str.isdigit, None, str.isdigit))
    rng = random.Random(5)
    for _ in range(300):
        pieces = [rng.choice(["1", "22", "x", "y y", ""]) for _ in range(rng.randint(5, 8))]
        values, edits = lenient.fitted(pieces, layout)
        costs = []
        for cuts in itertools.combinations(range(1, len(pieces)), 3):
            edges = [0, *cuts, len(pieces)]
            spans = ["|".join(pieces[i:j]) for i, j in zip(edges, edges[1:])]
            costs.append((sum(c is not None and not c(v) for c, v in zip(layout.checks, spans)), sum(j - i > 1 for i, j in zip(edges, edges[1:]))))
        got = (sum(c is not None and not c(v) for c, v in zip(layout.checks, values)), sum("|" in v for v in values))
        assert got == min(costs) and "|".join(values) == "|".join(pieces) and len(edits) == len(pieces) - 4
    assert lenient.fitted(["x"] * 20_000 + ["1"], layout)[0][-1] == "1"


# --- trailing periods ------------------------------------------------------------------------------------------------


def test_rolling_totals(spark):
    rng = random.Random(3)
    data = [(rng.choice(["hot", " hot", "a", "b", None]), rng.choice([None, *range(90)]), rng.choice([None, 0, 3, 7, 7])) for _ in range(200)]
    data.append(("far", 0, 1))
    data.append(("far", 12_000, 2))
    df = spark.createDataFrame([(e, at(d).date() if d is not None else None, v, "m") for e, d, v in data], "player string, match_date date, points int, day string")
    got = {(r["player"], r["match_date"]): r for r in rolling.rolling_totals(df, "player", "match_date", "points", (7, 30)).collect()}
    per: dict = {}
    for e, d, v in data:
        if e is not None and d is not None:
            per.setdefault(e.strip(), {}).setdefault(d, 0)
            per[e.strip()][d] += v or 0
    assert len(got) == sum(max(d) - min(d) + 1 for d in per.values())
    for e, days in per.items():
        first = min(days)
        for d in [*range(first, min(max(days), first + 120) + 1), max(days)]:
            r = got[e, (DAY + timedelta(days=d)).date()]
            for n in (7, 30):
                seen = [days.get(x, 0) for x in range(max(first, d - n + 1), d + 1)]
                assert r[f"total_{n}"] == sum(seen) and r[f"average_{n}"] == pytest.approx(sum(seen) / len(seen))
    once = rolling.rolling_totals(df, "player", "match_date", "points", (7,), once=["day", "points"]).agg(F.sum("total")).first()[0]
    assert once == sum(v or 0 for e, d, v in {(e.strip(), d, v) for e, d, v in data if e is not None and d is not None})
    assert rolling.rolling_totals(df.limit(0), "player", "match_date", "points").count() == 0


def test_rolling_totals_over_small_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    df = spark.createDataFrame([(f"p{i % 3}", (DAY + timedelta(days=i)).date(), 1) for i in range(40)], "player string, day date, points int")
    want = rows(rolling.rolling_totals(df, "player", "day", "points"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert rows(rolling.rolling_totals(df, "player", "day", "points")) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


# --- lines that fail to parse ----------------------------------------------------------------------------------------

LAYOUTS = line_layouts(["ABC", "XYZ"])
FIELD = r'(?:"(?:[^"]|"")*"|[^"|]*)'


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet='a"| 1', max_size=14))
def test_the_strict_grammar(line):
    sound = re.fullmatch(rf"{FIELD}(?:\|{FIELD})*", line, re.S) is not None
    pieces = lenient.strict_fields(line, "|", '"')
    assert (pieces is not None) == sound
    if not sound:
        fields, edits = lenient.mended_quotes(line, "|", '"')
        assert edits and len(edits) <= line.count('"')
        # No reading of fewer edits exists: every line that fewer edits lead to is broken too.
        if len(edits) > 1 and len(line) <= 8:
            for i in range(len(line) + 1):
                assert lenient.strict_fields(line[:i] + '"' + line[i:], "|", '"') is None
                if i < len(line) and line[i] == '"':
                    assert lenient.strict_fields(line[:i] + line[i + 1 :], "|", '"') is None


@pytest.mark.parametrize(
    ("kind", "line", "reason"),
    [
        ("performance", 'A|2024-01-31|vs. ABC|12', None), ("performance", '"A | b"|2024-01-31|@XYZ|\r', None), ("performance", '"A ""b"""| 2024-01-31 ||200', None),
        ("performance", 'A|2024-02-30|vs ABC|1', "value"), ("performance", 'A||vs ABC|1', "value"), ("performance", 'A|2024-01-31|vs.. ABC|1', "value"), ("performance", 'A|2024-01-31|vs abc|1', "value"),
        ("performance", 'A|2024-01-31|VS ABC|201', "value"), ("performance", 'A|2024-01-31|vs ABC|1O', "value"), ("performance", 'A|2024-01-31|vs ABC|١', "value"), ("performance", 'A|2024-01-31|vs ABC', "columns"),
        ("performance", 'A|2024-01-31|vs ABC|1|2', "columns"), ("performance", '"A|2024-01-31|vs ABC|1', "quoting"), ("performance", 'A "b"|2024-01-31|vs ABC|1', "quoting"), ("performance", '"A" |2024-01-31|vs ABC|1', "quoting"),
        ("performance", ' "A"|2024-01-31|vs ABC|1|2', "quoting"), ("performance", "", "columns"), ("performance", None, "columns"), ("performance", '"A\nb"|2024-01-31|vs ABC|1', None),
        ("playerinfo", 'T|A|4/15/1992|6-1|200', None), ("playerinfo", 'T|A|5 Nov 1981|6-1|200', None), ("playerinfo", 'T|A|5 nov 1981|6-1|200', "value"), ("playerinfo", 'T|A|1949-12-31|6-1|200', "value"), ("playerinfo", 'T|A||6-1|', None),
        ("playerinfo", 'T|A|13/1/1992|6-1|200', "value"), ("other", "a|b", "columns"), (None, "a|b", "columns"),
    ],
)
def test_reasons(spark, kind, line, reason):
    if kind in LAYOUTS:
        assert lenient.parse_line(line, LAYOUTS[kind]).reason == reason


def test_load_lines(spark):
    big = "x" * 200_000
    data = [(1, "performance", "A|2024-01-31|vs ABC|1", 7), (2, "performance", 'A"|2024-01-31|vs ABC|1', 7), (3, "other", "a", 7), (4, None, None, 7), (5, "playerinfo", f'{big}"|a|||', 7), (6, "performance", "A|vs ABC|1", 7)]
    df = spark.createDataFrame(data, "rec_id int, src_file string, raw string, reason int")
    got = {r["row_id"]: r for r in lenient.load_lines(df, "rec_id", "src_file", "raw", LAYOUTS).collect()}
    assert [got[i]["reason"] for i in range(1, 7)] == [None, "quoting", "columns", "columns", "quoting", "columns"]
    assert got[1]["fields"] == ["A", "2024-01-31", "vs ABC", "1"] and got[2]["edits"] == ['delete " at 1'] and len(got[5]["fields"][0]) == 200_000
    # The missing field is the one whose absence lets the others fit.
    assert got[6]["fields"] == ["A", None, "vs ABC", "1"] and "match_date" in got[6]["edits"][0]
    assert lenient.load_lines(df.limit(0), "rec_id", "src_file", "raw", LAYOUTS).count() == 0


def test_good_lines_of_both_files_are_loaded(spark, tmp_path):
    lines = [("performance", "A|2024-01-31|vs ABC|1"), ("playerinfo", 'T|"A ""b"" | c"| 4/15/1992 |6-1|'), ("playerinfo", "|B|5 Nov 1981|185 cm|200\r"), ("playerinfo", "T|A||6-1|200"), ("playerinfo", "T|A|1949-12-31|6-1|200"), ("playerinfo", "T|A|6-1|200"), ("other", "a")]
    spark.createDataFrame([(i, *x) for i, x in enumerate(lines)], "rec_id bigint, src_file string, raw string").write.parquet(str(tmp_path / "raw_record.parquet"))
    spark.createDataFrame([("ABC",)], "team_code string").write.parquet(str(tmp_path / "teams.parquet"))
    want = [(1, "T", 'A "b" | c', date(1992, 4, 15), "6-1", None), (2, None, "B", date(1981, 11, 5), "185 cm", "200"), (3, "T", "A", None, "6-1", "200")]
    assert rows(QUERIES["p6_loaded_playerinfo"](spark, str(tmp_path))) == want
    assert rows(QUERIES["p6_loaded_performance"](spark, str(tmp_path))) == [(0, "A", date(2024, 1, 31), "vs ABC", 1)]


def test_columns_agree_with_the_line_checks(spark):
    texts = ["2001-02-29", "2000-02-29", "1/2/1990", "01/02/1990", "1/2/90", "12/31/2010", "1/1/2011", "5 Nov 1981", "05 Nov 1981", "5 NOV 1981", "31 Feb 1990", " 1990-01-01 ", "", " ", None, "1950-01-01", "1990-1-1", "19900101", "1990-01-01\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["row_id"] for r in lenient.bad_values(df, "i", "t", lenient.birth_date_column(F.col("t")).isNotNull(), "x").collect()}
    assert got == {i for i, t in enumerate(texts) if t is not None and t.strip(" ") and lenient.birth_date(t.strip(" ")) is None}
    assert lenient.birth_date("12/31/2010") == date(2010, 12, 31)
    matches = ["@ABC", "@ ABC", "vs ABC", "Vs.   XYZ", "vs", "@", "ABC", "@ vs. ABC", "vs.. ABC", "@ABCD", "@abc", "", None, "vs.\tABC"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(matches)], "i int, t string")
    got = {r["row_id"] for r in lenient.bad_values(df, "i", "t", lenient.matchup_column(F.col("t"), ["ABC", "XYZ"]), "x").collect()}
    check = lenient.matchup(["ABC", "XYZ"])
    assert got == {i for i, t in enumerate(matches) if t and not check(t.strip(" "))}
