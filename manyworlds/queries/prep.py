"""Queries of the data-preparation operators (pN_...), with the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyworlds.operators import lenient, orphans, rolling, skew, wide
from manyworlds.plans.runtime import bounded
from manyworlds.sources import table

# The attributes of skills and the types of their values: the yes/no ones first.
SKILL_TYPES = {k: "boolean" for k in ("pass", "shoot", "block", "steal", "rebound", "dunk", "postup", "freethrow", "threepoint", "zone_defence")} | {"shoot_pct": "double", "vertical_cm": "int", "assessed_on": "date"}


def p2_skills_wide(spark: SparkSession, root: str) -> DataFrame:
    """One row per trimmed player, one typed column per skill, the latest usable value of each. A skill that SKILL_TYPES
    doesn't know gets a column too, of the type that its values fit."""
    skills = table(spark, root, "skills")
    return wide.widen(skills, "player", "skill", "has", SKILL_TYPES | {n: k for n, k in wide.found_types(skills, "skill", "has").items() if n not in SKILL_TYPES}, ["loaded_at", "skill_id"])


def p2_attribute_types(spark: SparkSession, root: str) -> DataFrame:
    """The skills there are, and the type that most of each one's values fit."""
    return wide.attribute_kinds(table(spark, root, "skills"), "skill", "has")


def _missing(spark: SparkSession, root: str) -> DataFrame:
    refs = [(t, table(spark, root, t), i, "player", "loaded_at") for t, i in (("performance", "perf_id"), ("skills", "skill_id"), ("participationrate", "rate_id"))]
    return orphans.missing_references(refs, table(spark, root, "playerinfo"), "player", "loaded_at", "deleted_at")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Rows that name nobody registered when they were loaded."""
    return _missing(spark, root)


def p3_orphans_per_month(spark: SparkSession, root: str) -> DataFrame:
    """The same, counted per table and month."""
    return orphans.orphan_report(_missing(spark, root))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Nodes that own at least a fiftieth of total_order or edge."""
    return skew.heavy_keys(table(spark, root, "total_order"), table(spark, root, "edge"), "u", ("total_order", "edge"), 50)


def p4_node_totals(spark: SparkSession, root: str) -> DataFrame:
    """Every node's row counts and probability sums in both tables, and what their join on u would give for it."""
    joined = skew.eager_join(table(spark, root, "total_order"), table(spark, root, "edge"), ["u"], {"sum_p": "p"}, {"sum_p0": "_p0"})
    return joined.select("u", F.col("left_rows").alias("order_rows"), F.round("sum_p", 4).alias("sum_p"), F.col("right_rows").alias("edge_rows"), F.round("sum_p0", 4).alias("sum_p0"), F.col("joined_rows").cast("bigint"), F.round("joined_sum_p", 2).alias("joined_sum_p"))


def p4_bit_rollup(spark: SparkSession, root: str) -> DataFrame:
    """Rows and probability of total_order joined to edge on u, per bit, from states per node."""
    rolled = skew.rolled_join(table(spark, root, "total_order"), table(spark, root, "edge"), ["u"], ["bit"], {"sum_p": "p"})
    return rolled.select("bit", F.col("joined_rows").cast("bigint"), F.round("joined_sum_p", 0).alias("joined_sum_p"))


def _rolling(spark: SparkSession, root: str, once: list[str] | None) -> DataFrame:
    r = rolling.rolling_totals(table(spark, root, "performance"), "player", "match_date", "points", (7, 30), once=once)
    return r.select("player", F.col("match_date").alias("day"), F.col("total").alias("points"), F.col("total_7").alias("points_7"), F.round("average_7", 6).alias("average_7"), F.col("total_30").alias("points_30"), F.round("average_30", 6).alias("average_30"))


def p5_rolling_points(spark: SparkSession, root: str) -> DataFrame:
    """Points over the trailing 7 and 30 days for each player and calendar day, all rows as delivered."""
    return _rolling(spark, root, None)


def p5_rolling_points_once(spark: SparkSession, root: str) -> DataFrame:
    """The same, rows delivered again under a new id counting once."""
    return _rolling(spark, root, ["match", "points"])


def line_layouts(codes: list[str]) -> dict[str, lenient.Layout]:
    """The two import files."""
    any_text = None
    return {
        "performance": lenient.Layout(
            ("player", "match_date", "match", "points"), (any_text, lambda v: lenient.iso_date(v) is not None, lenient.matchup(codes), lenient.count_up_to(200)),
            columns=(any_text, lambda v: lenient.iso_date_column(v).isNotNull(), lambda v: lenient.matchup_column(v, codes), lenient.count_up_to_column(200)), required=frozenset({"match_date"}),
        ),
        "playerinfo": lenient.Layout(
            ("team", "player", "dob", "height", "weight"), (any_text, any_text, lambda v: lenient.birth_date(v) is not None, any_text, any_text),
            columns=(any_text, any_text, lambda v: lenient.birth_date_column(v).isNotNull(), any_text, any_text),
        ),
    }


def _codes(spark: SparkSession, root: str) -> list[str]:
    """The team codes: a fixed table of 30 rows."""
    return sorted(r[0] for r in bounded(table(spark, root, "teams").select("team_code").filter("team_code is not null").distinct(), 10_000))


def _lines(spark: SparkSession, root: str) -> DataFrame:
    return lenient.load_lines(table(spark, root, "raw_record"), "rec_id", "src_file", "raw", line_layouts(_codes(spark, root)))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Rows that fail to parse, with the reason: lines, dates of birth, matches."""
    lines = _lines(spark, root).filter("reason is not null").select(F.lit("raw_record").alias("src_table"), "row_id", "reason")
    births = lenient.bad_values(table(spark, root, "playerinfo"), "info_id", "dob", lenient.birth_date_column(F.col("dob")).isNotNull(), "playerinfo")
    matches = lenient.bad_values(table(spark, root, "performance"), "perf_id", "match", lenient.matchup_column(F.col("match"), _codes(spark, root)), "performance")
    return lines.unionByName(births).unionByName(matches)


def _good(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """The good lines of a file: ``row_id, f``, the trimmed fields, null where blank."""
    f = F.transform("fields", lambda x: F.when(F.trim(x) != "", F.trim(x)))
    return _lines(spark, root).filter((F.col("kind") == kind) & F.col("reason").isNull()).select("row_id", f.alias("f"))


def p6_loaded_performance(spark: SparkSession, root: str) -> DataFrame:
    """The good lines of the performance file, typed."""
    good = _good(spark, root, "performance")
    return good.select(F.col("row_id").alias("rec_id"), F.col("f")[0].alias("player"), F.col("f")[1].cast("date").alias("match_date"), F.col("f")[2].alias("match"), F.col("f")[3].cast("int").alias("points"))


def p6_loaded_playerinfo(spark: SparkSession, root: str) -> DataFrame:
    """The good lines of the playerinfo file, dates of birth typed; heights and weights mix units and stay as written."""
    f = F.col("f")
    return _good(spark, root, "playerinfo").select(F.col("row_id").alias("rec_id"), f[0].alias("team"), f[1].alias("player"), lenient.birth_date_column(f[2]).alias("dob"), f[3].alias("height"), f[4].alias("weight"))


def p6_repairs(spark: SparkSession, root: str) -> DataFrame:
    """The bad lines with the edits of their cheapest parse."""
    return _lines(spark, root).filter("reason is not null").select(F.col("row_id").alias("rec_id"), F.col("kind").alias("src_file"), "reason", F.array_join("edits", "; ").alias("edits"))


QUERIES = {f.__name__: f for f in (p2_skills_wide, p2_attribute_types, p3_found, p3_orphans_per_month, p4_found, p4_node_totals, p4_bit_rollup, p5_rolling_points, p5_rolling_points_once, p6_found, p6_loaded_performance, p6_loaded_playerinfo, p6_repairs)}


def _typed_sql(kind: str, v: str) -> str:
    if kind == "boolean":
        return f"case when lower({v}) in ('y','yes','t','true','1') then true when lower({v}) in ('n','no','f','false','0') then false end"
    if kind == "int":
        return f"case when regexp_full_match({v}, '[+-]?[0-9]+') then try_cast({v} as integer) end"
    if kind == "date":
        return f"case when regexp_full_match({v}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then try_cast({v} as date) end"
    return f"try_cast(case when {v} like '%\\%' escape '\\' then try_cast(rtrim({v}, '% ') as decimal(38,10)) / 100 else try_cast({v} as decimal(38,10)) end as {kind})"


def _wide_sql() -> str:
    cells = ", ".join(f"max(val) filter (k = '{n}') as v_{n}" for n in SKILL_TYPES)
    out = ", ".join(f"{_typed_sql(t, f'v_{n}')} as {n}" for n, t in SKILL_TYPES.items())
    return f"""with r as (select trim(player, ' ') as player, lower(trim(skill, ' ')) as k, nullif(trim(has, ' '), '') as val, loaded_at, skill_id from skills where player is not null),
    best as (select player, k, arg_max(val, (loaded_at, skill_id)) filter (val is not null) as val from r group by 1, 2),
    w as (select player, {cells} from best group by player)
    select player, {out} from w"""


def _kinds_sql() -> str:
    counts = ", ".join(f"count({_typed_sql(k, 'val')}) as as_{k}" for k in wide.KINDS)
    kind = " ".join(f"when as_{k} >= 0.8 * filled then '{k}'" for k in wide.KINDS)
    fitting = " ".join(f"when as_{k} >= 0.8 * filled then as_{k}" for k in wide.KINDS)
    return f"""with r as (select lower(trim(skill, ' ')) as attribute, nullif(trim(has, ' '), '') as val from skills),
    c as (select attribute, count(*) as filled, {counts} from r where attribute <> '' and val is not null group by 1)
    select attribute, case {kind} else 'string' end as kind, filled, case {fitting} else filled end as fitting from c"""


_MISSING_SQL = """with parent as (select trim(player, ' ') as player, loaded_at, deleted_at from playerinfo where player is not null),
    ref as (select 'performance' as src_table, perf_id as row_id, trim(player, ' ') as player, loaded_at from performance where player is not null
      union all select 'skills', skill_id, trim(player, ' '), loaded_at from skills where player is not null
      union all select 'participationrate', rate_id, trim(player, ' '), loaded_at from participationrate where player is not null),
    found as (select src_table, strftime(loaded_at, '%Y-%m') as period, row_id from ref r where not exists (
      select 1 from parent p where p.player = r.player and p.loaded_at <= r.loaded_at and (p.deleted_at is null or p.deleted_at > r.loaded_at)))"""

_STATES_SQL = """with a as (select u, count(*) as n, coalesce(sum(p), 0) as s from total_order group by u),
    b as (select u, count(*) as n, coalesce(sum(_p0), 0) as s from edge group by u)"""


def _rolling_sql(rows: str) -> str:
    return f"""with r as ({rows}), d as (select player, day, sum(points) as points from r group by 1, 2),
    span as (select player, min(day) as a, max(day) as b from d group by 1),
    grid as (select player, cast(unnest(generate_series(a, b, interval 1 day)) as date) as day from span),
    dense as (select player, day, coalesce(points, 0) as points from grid left join d using (player, day))
    select player, day, cast(points as bigint) as points, cast(sum(points) over w7 as bigint) as points_7, round(avg(points) over w7, 6) as average_7,
      cast(sum(points) over w30 as bigint) as points_30, round(avg(points) over w30, 6) as average_30 from dense
    window w7 as (partition by player order by day rows between 6 preceding and current row), w30 as (partition by player order by day rows between 29 preceding and current row)"""


# A field of a well quoted line, and one that is quoted.
_FIELD, _QUOTED = '(?:"(?:[^"]|"")*"|[^"|]*)', '"(?:[^"]|"")*"'


def _field_sql(i: int, n: int) -> str:
    pattern = "^" + r"\|".join(f"({_FIELD})" if k == i else _FIELD for k in range(n)) + "$"
    got = f"regexp_extract(line, '{pattern}', 1)"
    return f"trim(case when {got} like '\"%' then replace(substring({got}, 2, length({got}) - 2), '\"\"', '\"') else {got} end, ' ')"


_BIRTH_SQL = """case when regexp_full_match({v}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then try_cast({v} as date)
    when regexp_full_match({v}, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') then cast(try_strptime({v}, '%m/%d/%Y') as date)
    when regexp_full_match({v}, '[0-9]{{1,2}} (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [0-9]{{4}}') then cast(try_strptime({v}, '%d %b %Y') as date) end"""


def _birth_ok(v: str) -> str:
    return f"coalesce(year({_BIRTH_SQL.format(v=v)}) between 1950 and 2010, false)"


def _match_ok(v: str) -> str:
    return f"(regexp_full_match({v}, '(?:@|[vV][sS]\\.?) *[^ ].*') and regexp_extract({v}, '^(?:@|[vV][sS]\\.?) *([^ ].*)$', 1) in (select team_code from teams))"


_LINES_SQL = f"""with l as (select rec_id, src_file, case when right(raw, 1) = chr(13) then left(raw, length(raw) - 1) else raw end as line from raw_record),
    shaped as (select *, regexp_full_match(line, '{_FIELD}(?:\\|{_FIELD})*', 's') as sound, length(regexp_replace(line, '{_QUOTED}', 'q', 'g')) - length(replace(regexp_replace(line, '{_QUOTED}', 'q', 'g'), '|', '')) + 1 as n from l),
    f as (select *, {", ".join(f"case when src_file = 'performance' then {_field_sql(i, 4)} end as p{i}" for i in range(4))}, case when src_file = 'playerinfo' then {_field_sql(2, 5)} end as i2 from shaped),
    judged as (select *, case when not sound then 'quoting' when n <> case src_file when 'performance' then 4 else 5 end then 'columns'
      when src_file = 'performance' and (not (regexp_full_match(p1, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') and try_cast(p1 as date) is not null) or (p2 <> '' and not {_match_ok("p2")}) or (p3 <> '' and not (regexp_full_match(p3, '[0-9]+') and coalesce(try_cast(p3 as hugeint), 1000) <= 200))) then 'value'
      when src_file = 'playerinfo' and i2 <> '' and not {_birth_ok("i2")} then 'value' end as reason from f)"""

SQL = {
    "p2_skills_wide": _wide_sql(),
    "p2_attribute_types": _kinds_sql(),
    "p3_found": _MISSING_SQL + " select * from found",
    "p3_orphans_per_month": _MISSING_SQL + " select src_table, period, count(*) as orphans from found group by 1, 2",
    "p4_found": """select 'total_order' as src_table, u from total_order where u is not null group by u having count(*) * 50 >= (select count(*) from total_order)
      union all select 'edge', u from edge where u is not null group by u having count(*) * 50 >= (select count(*) from edge)""",
    "p4_node_totals": _STATES_SQL
    + """ select coalesce(a.u, b.u) as u, coalesce(a.n, 0) as order_rows, round(coalesce(a.s, 0), 4) as sum_p, coalesce(b.n, 0) as edge_rows, round(coalesce(b.s, 0), 4) as sum_p0,
      coalesce(a.n * b.n, 0) as joined_rows, round(coalesce(a.s * b.n, 0), 2) as joined_sum_p from a full join b on a.u = b.u""",
    "p4_bit_rollup": """with a as (select u, bit, count(*) as n, coalesce(sum(p), 0) as s from total_order group by 1, 2), b as (select u, count(*) as n from edge group by 1)
      select bit, cast(sum(a.n * b.n) as bigint) as joined_rows, round(sum(a.s * b.n), 0) as joined_sum_p from a join b on a.u = b.u group by bit""",
    "p5_rolling_points": _rolling_sql("select trim(player, ' ') as player, match_date as day, coalesce(points, 0) as points from performance where player is not null and match_date is not null"),
    "p5_rolling_points_once": _rolling_sql("select player, day, coalesce(points, 0) as points from (select distinct trim(player, ' ') as player, match_date as day, match, points from performance where player is not null and match_date is not null)"),
    "p6_found": _LINES_SQL
    + f""" select 'raw_record' as src_table, rec_id as row_id, reason from judged where reason is not null
      union all select 'playerinfo', info_id, 'value' from playerinfo where trim(dob, ' ') <> '' and not {_birth_ok("trim(dob, ' ')")}
      union all select 'performance', perf_id, 'value' from performance where trim(match, ' ') <> '' and not {_match_ok("trim(match, ' ')")}""",
    "p6_loaded_performance": _LINES_SQL + " select rec_id, nullif(p0, '') as player, cast(p1 as date) as match_date, nullif(p2, '') as match, cast(nullif(p3, '') as integer) as points from judged where src_file = 'performance' and reason is null",
    "p6_loaded_playerinfo": _LINES_SQL
    + f""", good as (select rec_id, {", ".join(f"nullif({_field_sql(i, 5)}, '') as {n}" for i, n in enumerate(("team", "player", "born", "height", "weight")))} from judged where src_file = 'playerinfo' and reason is null)
      select rec_id, team, player, {_BIRTH_SQL.format(v="born")} as dob, height, weight from good""",
}
