"""Queries of the relational and scalar substrate. Where Spark's SQL and the standard agree, one text serves both."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyworlds.functions import formats as X
from manyworlds.functions import scalar as S
from manyworlds.operators import relational as R
from manyworlds.sources import generate_series, table, values

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Statements that mean the same in both engines.
SAME = {
    "scan_project_filter": "select o_orderkey, o_totalprice * 2 as double_price from orders where o_orderpriority = '1-URGENT' and o_totalprice between 1000 and 200000",
    "filter_case_coalesce": "select c_custkey, case when c_acctbal < 0 then 'debt' when c_acctbal < 5000 then 'some' else 'much' end as class, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') as segment from customer",
    "filter_like_in": "select p_partkey, p_name from part where p_brand in ('Brand#1', 'Brand#12', 'Brand#20') and p_type like '%A%' and p_name not like 'x%'",
    "filter_ilike_escape": "select p_partkey from part where p_type ilike '%A%' and not p_name ilike 'X%' and p_brand like 'Brand#_%' and not p_name like '%!%%' escape '!'",
    "string_layout": "select p_partkey, bit_length(p_name) as bits, rpad(p_brand, 12, ' ') as fixed, lower(hex(p_size)) as hexed, left(p_name, 3) || right(p_name, 2) as ends, reverse(p_brand) as turned, repeat('ab', 2) as twice from part",
    "filter_distinct_from": "select n_nationkey from nation where (n_regionkey is distinct from 1) is true and n_name is not null",
    "filter_row_comparison": "select n_nationkey from nation where (n_regionkey, n_nationkey) > (2, 10)",
    "subquery_in": "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)",
    "subquery_not_in": "select s_suppkey from supplier where s_suppkey not in (select l_suppkey from lineitem where l_quantity = 50 and l_discount = 0.1)",
    "subquery_exists": "select o_orderkey from orders o where exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_quantity > 49)",
    "subquery_not_exists": "select c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey)",
    "subquery_scalar": "select p_partkey from part where p_retailprice > (select avg(p_retailprice) from part)",
    "subquery_correlated": "select o_orderkey from orders o where o_totalprice > (select 2 * avg(o_totalprice) from orders i where i.o_custkey = o.o_custkey)",
    "join_inner": "select n_name, r_name from nation join region on n_regionkey = r_regionkey",
    "join_left": "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 350000",
    "join_right": "select c_custkey, o_orderkey from (select * from orders where o_totalprice > 350000) o right join customer on c_custkey = o_custkey",
    "join_full": "select s_suppkey, c_custkey from (select * from supplier where s_nationkey < 15) s full join (select * from customer where c_acctbal > 9000 and c_nationkey > 5) c on s_nationkey = c_nationkey",
    "join_using": "select n_nationkey, n_name, s_suppkey from nation join (select s_nationkey as n_nationkey, s_suppkey from supplier) s using (n_nationkey)",
    "join_natural": "select * from (select n_nationkey, n_name from nation) a natural join (select n_nationkey, n_regionkey from nation) b",
    "join_cross": "select a.r_name as x, b.r_name as y from region a, region b",
    "join_theta": "select a.n_nationkey as x, b.n_nationkey as y from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey",
    "join_three_way": "select r_name, n_name, count(*) as suppliers from region, nation, supplier where r_regionkey = n_regionkey and n_nationkey = s_nationkey group by r_name, n_name",
    "agg_basic": "select l_returnflag, count(*) as n, count(distinct l_suppkey) as suppliers, min(l_quantity) as low, max(l_quantity) as high, round(avg(l_quantity), 6) as mean, round(sum(l_quantity), 2) as total from lineitem group by l_returnflag",
    "agg_statistics": "select l_returnflag, round(var_pop(l_quantity), 6) as vp, round(var_samp(l_quantity), 6) as vs, round(stddev_pop(l_quantity), 6) as sp, round(stddev_samp(l_quantity), 6) as ss, round(covar_pop(l_quantity, l_discount), 6) as cp, round(covar_samp(l_quantity, l_tax), 6) as cs, round(corr(l_quantity, l_extendedprice), 6) as c from lineitem group by l_returnflag",
    "agg_regression": "select l_linestatus, cast(regr_count(l_extendedprice, l_quantity) as bigint) as n, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 2) as intercept, round(regr_r2(l_extendedprice, l_quantity), 6) as r2, round(regr_avgx(l_extendedprice, l_quantity), 6) as ax, round(regr_avgy(l_extendedprice, l_quantity), 4) as ay from lineitem group by l_linestatus",
    "agg_regression_sums": "select l_linestatus, round(regr_sxx(l_extendedprice, l_quantity), 2) as sxx, round(regr_syy(l_extendedprice, l_quantity) / 1000000, 2) as syy, round(regr_sxy(l_extendedprice, l_quantity) / 1000, 2) as sxy from lineitem group by l_linestatus",
    "agg_filter": "select o_orderpriority, count(*) filter (where o_totalprice > 200000) as large, count(o_custkey) as n from orders group by o_orderpriority",
    "agg_boolean_bits": "select o_orderpriority, bool_and(o_totalprice > 0) as all_positive, bool_or(o_totalprice > 400000) as some_large, bit_and(o_custkey) as ba, bit_or(o_custkey) as bo from orders group by o_orderpriority",
    "agg_having": "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 15",
    "agg_expression_keys": "select year(o_orderdate) as y, o_orderpriority as p, count(*) as n from orders group by year(o_orderdate), o_orderpriority",
    "agg_distinct_sum": "select l_returnflag, round(sum(distinct l_quantity), 2) as s from lineitem group by l_returnflag",
    "agg_empty": "select count(*) as n, cast(sum(n_nationkey) as bigint) as s, max(n_name) as m from nation where n_nationkey < 0",
    "sort_limit_offset": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 5",
    "distinct_rows": "select distinct l_returnflag, l_linestatus from lineitem",
    "setop_union": "select n_regionkey as k from nation union select r_regionkey from region",
    "setop_union_all": "select n_regionkey as k from nation union all select r_regionkey from region",
    "setop_intersect": "select o_custkey as k from orders where o_totalprice > 200000 intersect select c_custkey from customer where c_acctbal > 0",
    "setop_except": "select c_custkey as k from customer except select o_custkey from orders",
    "setop_except_all": "select n_regionkey as k from nation except all select r_regionkey from region",
    "setop_intersect_all": "select n_regionkey as k from nation intersect all select n_regionkey from nation where n_nationkey > 5",
    "recursion": "with recursive t(n, f) as (select 1, cast(1 as bigint) union all select n + 1, f * (n + 1) from t where n < 12) select n, f from t",
    "math_functions": "select s_suppkey, round(sqrt(abs(s_acctbal)), 6) as a, ceil(s_acctbal) as b, floor(s_acctbal) as c, round(ln(s_suppkey + 1), 6) as d, round(exp(s_suppkey % 5), 6) as e, round(power(s_nationkey, 2), 6) as f, sign(s_acctbal) as g, s_suppkey % 7 as h, round(sin(s_suppkey), 6) as i, s_nationkey & 5 as j, s_nationkey | 5 as k from supplier",
    "string_functions": "select p_partkey, upper(p_name) as a, lower(p_brand) as b, length(p_name) as c, substring(p_name, 2, 3) as d, replace(p_name, 'a', 'b') as e, concat(p_brand, '/', p_type) as f, lpad(p_type, 12, '*') as g, rpad(p_type, 12, '*') as h, repeat(p_type, 2) as i, reverse(p_brand) as j, ascii(p_type) as k, translate(p_name, 'aeiou', 'AEIOU') as l, left(p_name, 2) as m, right(p_name, 2) as n, trim(p_name) as o from part",
    "date_functions": "select o_orderkey, year(o_orderdate) as y, month(o_orderdate) as m, day(o_orderdate) as d, quarter(o_orderdate) as q, cast(date_trunc('month', o_orderdate) as date) as dm, cast(o_orderdate as date) + interval 1 day > date '2000-01-01' as late from orders",
    "window_moving": "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row), 2) as s from orders",
    "tpch_q1": "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as q, round(sum(l_extendedprice), 2) as base, round(sum(l_extendedprice * (1 - l_discount)), 2) as disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as charge, round(avg(l_discount), 6) as d, count(*) as n from lineitem where l_shipdate <= timestamp '2001-09-02' group by l_returnflag, l_linestatus",
    "tpch_q5": "select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer, orders, lineitem, supplier, nation, region where c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey and c_nationkey = s_nationkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'ASIA' group by n_name",
}


def _spark_sql(text: str):
    def run(spark: SparkSession, root: str) -> DataFrame:
        for t in TABLES:
            if re.search(rf"\b{t}\b", text):
                table(spark, root, t).createOrReplaceTempView(t)
        return spark.sql(text)

    return run


def distinct_on_latest_order(spark: SparkSession, root: str) -> DataFrame:
    return R.distinct_on(table(spark, root, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], descending=True).select("o_custkey", "o_orderkey", "o_totalprice")


def order_nulls_last_places(spark: SparkSession, root: str) -> DataFrame:
    """All rows in that order, each with its place; the null points have the last ones."""
    rows = table(spark, root, "performance").select("perf_id", "points")
    return R.placed(rows, *R.nulls_last("points", "perf_id"))


def crosstab_pivot(spark: SparkSession, root: str) -> DataFrame:
    counts = table(spark, root, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return R.crosstab(counts, "l_returnflag", "l_linestatus", "n", ["F", "O"])


def connect_by_tree(spark: SparkSession, root: str) -> DataFrame:
    edges = generate_series(spark, 2, 40, name="c").select(F.floor(F.col("c") / 2).cast("bigint").alias("p"), "c")
    return R.connect_by(edges, "p", "c", F.lit(1).cast("bigint"))


def generate_series_step(spark: SparkSession, root: str) -> DataFrame:
    return generate_series(spark, 10, -10, -3, "n")


def values_list(spark: SparkSession, root: str) -> DataFrame:
    return values(spark, [(1, "one"), (2, "two"), (3, None)], "n int, name string")


def upsert_rows(spark: SparkSession, root: str) -> DataFrame:
    rows = spark.createDataFrame([(0, "changed"), (7, "new")], "r_regionkey int, r_name string")
    return R.upsert(table(spark, root, "region").select("r_regionkey", "r_name"), rows, ["r_regionkey"])


def prepared_statement(spark: SparkSession, root: str) -> DataFrame:
    table(spark, root, "orders").createOrReplaceTempView("orders")
    return spark.sql("select o_orderpriority, count(*) as n from orders where o_totalprice > :least group by 1", args={"least": 250000})


def regex_similar(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "part")
    return p.filter(S.similar_to("p_brand", "Brand#(1|2)_?")).select("p_partkey", S.regexp_replace_first("p_name", "[aeiou]", "*").alias("once"), F.regexp_replace("p_name", "[aeiou]", "*").alias("every"), F.split_part(F.col("p_brand"), F.lit("#"), F.lit(2)).alias("number"), S.strpos("p_name", "e").alias("at"), S.btrim("p_type", "AEIOU").alias("trimmed"))


def quoting_functions(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "nation").select("n_nationkey", S.quote_ident("n_name").alias("ident"), S.quote_literal(F.concat("n_name", F.lit("'s"))).alias("literal"))


def fuzzy_matching(spark: SparkSession, root: str) -> DataFrame:
    n = table(spark, root, "nation")
    a, b = n.select(F.col("n_name").alias("a"), "n_regionkey"), n.select(F.col("n_name").alias("b"), "n_regionkey")
    return a.join(b, "n_regionkey").filter("a < b").select("a", "b", F.levenshtein("a", "b").alias("edits"), F.size(S.trigrams("a")).alias("trigrams"), F.round(S.similarity("a", "b"), 6).alias("similar"))


def date_parts(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "orders").select("o_orderkey", "o_orderdate")
    parts = [S.date_part(f, "o_orderdate").alias(f) for f in ("century", "millennium", "decade", "dow", "isodow")]
    return o.select("o_orderkey", *parts, S.date_trunc("century", "o_orderdate").cast("date").alias("c"), S.date_trunc("decade", "o_orderdate").cast("date").alias("d"), S.overlaps("o_orderdate", F.col("o_orderdate") + F.expr("interval 10 days"), F.lit("2000-01-05").cast("timestamp"), F.lit("2000-01-01").cast("timestamp")).alias("overlapping"))


def number_functions(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "supplier").select("s_suppkey", S.int_div(F.col("s_suppkey") * -7, F.lit(2)).alias("q"), F.round(S.trunc_to("s_acctbal", 1), 1).alias("t"), F.round(F.cbrt("s_acctbal"), 6).alias("c"), F.width_bucket("s_acctbal", F.lit(0.0), F.lit(10000.0), F.lit(5)).cast("int").alias("w"))


def array_functions(spark: SparkSession, root: str) -> DataFrame:
    lines = table(spark, root, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("a"))
    return lines.select("l_orderkey", F.size("a").alias("n"), F.size(S.array_uniq("a")).alias("u"), S.array_idx("a", 3).cast("int").alias("i"), F.size(S.array_remove_all("a", F.array(F.lit(1), F.lit(2)))).alias("r"), F.array_contains("a", 5).alias("has5"), F.exists("a", lambda x: x > 6).alias("any"), F.forall("a", lambda x: x < 7).alias("all"))


def map_functions(spark: SparkSession, root: str) -> DataFrame:
    m = F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.col("n_regionkey").cast("string"), F.lit("none"), F.lit(None).cast("string"))
    n = table(spark, root, "nation").select("n_nationkey", m.alias("m"))
    return n.select("n_nationkey", F.size(S.map_delete("m", "none")).alias("n"), S.map_defined("m", "none").alias("d"), S.map_contains("m", F.create_map(F.lit("region"), F.lit("1"))).alias("c"), F.element_at(S.map_concat("m", F.create_map(F.lit("name"), F.lit("x"))), "name").alias("x"))


def text_search(spark: SparkSession, root: str) -> DataFrame:
    v = S.to_tsvector("text")
    docs = table(spark, root, "eval_item").select("item_id", v.alias("v"))
    return docs.select("item_id", S.ts_match(F.col("v"), "(twice | coins) & !orchard").alias("hit"), S.ts_count(F.col("v"), "the", "and").alias("n"), F.size("v").alias("words"))


def delimited_text(spark: SparkSession, root: str) -> DataFrame:
    """Rows to delimited text and back, with nulls, quotes and separators in them."""
    options = {"sep": "|", "nullValue": "\\N", "escape": '"'}
    rows = table(spark, root, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 3 > 0, F.concat("n_name", F.lit('|"x"'))).alias("name"))
    text = rows.select(F.to_csv(F.struct("n_nationkey", "name"), options).alias("line"))
    return text.select(F.from_csv("line", F.lit("n_nationkey int, name string"), options).alias("r")).select("r.*")


def array_aggregate(spark: SparkSession, root: str) -> DataFrame:
    n = table(spark, root, "nation")
    return n.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_nationkey")).cast("array<string>"), ",").alias("keys"))


def xml_functions(spark: SparkSession, root: str) -> DataFrame:
    n = table(spark, root, "nation")
    return n.groupBy("n_regionkey").agg(S.xml_agg(S.xml_element("n", F.col("n_name"), id=F.col("n_nationkey")), F.col("n_nationkey")).alias("x"))


def network_functions(spark: SparkSession, root: str) -> DataFrame:
    a = generate_series(spark, 0, 300, name="i").select("i", F.concat(F.lit("10.0."), F.floor(F.col("i") / 256).cast("string"), F.lit("."), (F.col("i") % 256).cast("string")).alias("address"))
    return a.select("i", S.inet_number("address").alias("number"), S.inet_within("address", "10.0.0.128/25").alias("inside"))


def geo_functions(spark: SparkSession, root: str) -> DataFrame:
    n = generate_series(spark, -8, 8, name="i")
    return n.select("i", F.round(S.earth_distance(F.lit(10), F.lit(20), F.col("i") * 10, F.col("i") * 20), 2).alias("metres"))


def tree_labels(spark: SparkSession, root: str) -> DataFrame:
    r = table(spark, root, "region").join(table(spark, root, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.concat_ws(".", F.lit("world"), "r_name", "n_name").alias("path"), "r_name")
    return r.select("path", S.is_ancestor(F.lit("world.ASIA"), "path").alias("asian"), F.coalesce(S.enum_range(["AFRICA", "AMERICA", "ASIA"], "r_name"), F.lit(0)).cast("int").alias("place"))


def encoding_functions(spark: SparkSession, root: str) -> DataFrame:
    n = table(spark, root, "nation")
    return n.select("n_nationkey", F.md5("n_name").alias("md5"), F.sha2("n_name", 256).alias("sha"), F.lower(F.hex("n_name")).alias("hex"), F.base64("n_name").alias("b64"), F.decode(F.unbase64(F.base64("n_name")), "UTF-8").alias("back"))


def format_functions(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "orders")
    return o.select("o_orderkey", F.date_format("o_orderdate", "yyyy/MM/dd HH:mm").alias("t"), F.to_date(F.date_format("o_orderdate", "yyyyMMdd"), "yyyyMMdd").alias("d"), F.date_diff(F.lit("2002-01-01").cast("date"), F.col("o_orderdate").cast("date")).cast("bigint").alias("days"), F.last_day("o_orderdate").alias("last"))


def regex_functions(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "part")
    return p.select("p_partkey", F.array_join(F.regexp_extract_all("p_name", F.lit("([aeiou])"), 1), "").alias("vowels"), F.size(F.split("p_name", " ")).alias("words"), F.regexp_count("p_name", F.lit("[a-m]")).alias("early"), F.col("p_brand").rlike("#[0-9]$").alias("short"))


def sql_function(spark: SparkSession, root: str) -> DataFrame:
    """A function defined in SQL."""
    spark.sql("create or replace temporary function mw_net(price double, discount double) returns double return price * (1 - discount)")
    table(spark, root, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql("select l_returnflag, round(sum(mw_net(l_extendedprice, l_discount)), 2) as net from lineitem group by l_returnflag")


def python_aggregate(spark: SparkSession, root: str) -> DataFrame:
    """A user-defined aggregate over Arrow batches: the geometric mean."""

    def geometric(v: pd.Series) -> float:
        return float(np.exp(np.log(v).mean()))

    geometric.__annotations__ = {"v": pd.Series, "return": float}
    mean = F.pandas_udf(geometric, "double")
    return table(spark, root, "part").groupBy("p_brand").agg(F.round(mean("p_retailprice"), 4).alias("g"))


def table_function(spark: SparkSession, root: str) -> DataFrame:
    """A user-defined table function: the letters of a name with their counts."""

    class Letters:
        def eval(self, text: str):
            for c in sorted(set(text.lower())):
                yield c, text.lower().count(c)

    spark.udtf.register("mw_letters", F.udtf(Letters, returnType="letter string, n int"))
    table(spark, root, "region").createOrReplaceTempView("region")
    return spark.sql("select r_regionkey, l.letter, l.n from region, lateral mw_letters(r_name) l")


def quantified_comparison(spark: SparkSession, root: str) -> DataFrame:
    """Comparison with all, and with any, rows of a sub-query: as there is none, or one, for which it fails or holds."""
    for t in ("part", "customer", "orders"):
        table(spark, root, t).createOrReplaceTempView(t)
    every = spark.sql("select p_partkey as k, 'all' as kind from part p where not exists (select 1 from part q where q.p_brand = 'Brand#3' and not coalesce(p.p_retailprice >= q.p_retailprice, false))")
    some = spark.sql("select c_custkey as k, 'any' as kind from customer where c_custkey in (select o_custkey from orders where o_totalprice > 400000)")
    return every.unionByName(some)


def template_formats(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "orders")
    return o.select("o_orderkey", X.to_char("o_orderdate", "Dy, DD Mon YYYY HH24:MI").alias("t"), X.to_char("o_orderdate", 'FMDD.FMMM "in" Q').alias("q"), X.to_timestamp(X.to_char("o_orderdate", "YYYYMMDD HH24:MI:SS"), "YYYYMMDD HH24:MI:SS").alias("back"), X.number_to_char("o_totalprice", "9,999,990.00").alias("price"), X.to_number(X.number_to_char(-F.col("o_totalprice"), "9,999,990.00"), 2).cast("double").alias("number"))


def interval_functions(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "orders")
    iv = X.justify_days(X.justify_hours(X.interval(1, F.col("o_orderkey") % 100, (F.col("o_orderkey") % 1000) * 3_600_000_000)))
    return o.select("o_orderkey", iv["months"].alias("months"), iv["days"].alias("days"), (iv["micros"] / 3_600_000_000).cast("bigint").alias("hours"), X.plus_interval("o_orderdate", X.interval(1, 3, 7_200_000_000)).alias("later"), X.at_time_zone("o_orderdate", "Asia/Kolkata").cast("string").alias("there"))


def bit_strings(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "supplier").select("s_suppkey", F.lpad(F.bin(F.col("s_suppkey") % 1024), 10, "0").alias("b"))
    mask = F.lit("0110011010")
    return s.select("s_suppkey", *(X.bits_op("b", mask, k).alias(f"b_{k}") for k in ("and", "or", "xor")), X.bits_not("b").alias("b_not"), X.bits_shift("b", 3).alias("b_left"), X.bits_shift("b", -2).alias("b_right"), X.bits_count("b").alias("ones"), X.bits_number("b").alias("n"))


def keyed_hashes(spark: SparkSession, root: str) -> DataFrame:
    n = table(spark, root, "nation")
    return n.select("n_nationkey", X.hmac_sha256("n_name", b"key").alias("mac"), X.as_uuid(F.md5("n_name")).alias("id"), X.as_uuid(F.concat(F.lit("{"), F.upper(F.md5("n_name")), F.lit("}"))).alias("again"))


def text_search_phrases(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "eval_item").select("item_id", "text", S.to_tsvector("text").alias("v"))
    return docs.select("item_id", S.ts_phrase(F.col("v"), "of", "the").alias("phrase"), F.size(S.ts_strip(F.col("v"))).alias("words"), S.ts_headline("text", "the", "and").alias("marked"))


def text_search_statistics(spark: SparkSession, root: str) -> DataFrame:
    return S.ts_stat(table(spark, root, "eval_item").select(S.to_tsvector("text").alias("v")), "v")


def xml_paths(spark: SparkSession, root: str) -> DataFrame:
    n = table(spark, root, "nation").select("n_nationkey", S.xml_element("n", F.lit("")).alias("empty"), F.concat(F.lit("<r>"), S.xml_forest(name=F.col("n_name"), region=F.when(F.col("n_regionkey") > 0, F.col("n_regionkey"))), F.lit("</r>")).alias("x"))
    return n.select("n_nationkey", "empty", "x", F.xpath_string("x", F.lit("/r/name")).alias("name"), F.xpath_int("x", F.lit("count(/r/*)")).alias("parts"))


def network_bounds(spark: SparkSession, root: str) -> DataFrame:
    a = generate_series(spark, 0, 300, name="i").select("i", F.concat(F.lit("10.1."), F.floor(F.col("i") / 256).cast("string"), F.lit("."), (F.col("i") % 256).cast("string"), F.lit("/26")).alias("network"))
    low, high = S.inet_bounds("network")
    return a.select("i", low.alias("low"), high.alias("high"))


def tree_paths(spark: SparkSession, root: str) -> DataFrame:
    r = table(spark, root, "region").join(table(spark, root, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", F.concat_ws(".", F.lit("world"), "r_name", "n_name").alias("path"))
    return r.select("n_nationkey", S.label_level("path").alias("level"), S.label_subpath("path", 1, 1).alias("region"), S.label_common("path", F.lit("world.ASIA.somewhere")).alias("common"))


_OWN = (quantified_comparison, template_formats, interval_functions, bit_strings, keyed_hashes, text_search_phrases, text_search_statistics, xml_paths, network_bounds, tree_paths, encoding_functions, format_functions, regex_functions, sql_function, python_aggregate, table_function, distinct_on_latest_order, order_nulls_last_places, crosstab_pivot, connect_by_tree, generate_series_step, values_list, upsert_rows, prepared_statement, regex_similar, quoting_functions, fuzzy_matching, date_parts, number_functions, array_functions, map_functions, text_search, delimited_text, array_aggregate, xml_functions, network_functions, geo_functions, tree_labels)
QUERIES = {name: _spark_sql(text) for name, text in SAME.items()} | {f.__name__: f for f in _OWN}

_TRIGRAMS = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, cast(length(w) + 2 as bigint)), lambda i: substring('  ' || w || ' ', i, 3)))))"
_A, _B = _TRIGRAMS.format("x.n_name"), _TRIGRAMS.format("y.n_name")

_PADS = [bytes(b ^ pad for b in b"key".ljust(64, b"\0")).hex() for pad in (0x36, 0x5C)]

SQL = dict(SAME) | {
    "distinct_on_latest_order": "select distinct on (o_custkey) o_custkey, o_orderkey, o_totalprice from orders order by o_custkey, o_orderdate desc, o_orderkey desc",
    "order_nulls_last_places": "select perf_id, points, row_number() over (order by points nulls last, perf_id) as place from performance",
    "crosstab_pivot": "select l_returnflag, nullif(count(*) filter (l_linestatus = 'F'), 0) as \"F\", nullif(count(*) filter (l_linestatus = 'O'), 0) as \"O\" from lineitem group by 1",
    "connect_by_tree": "with recursive t as (select cast(1 as bigint) as node, cast(null as bigint) as parent, 0 as level, '1' as branch union all select c, node, level + 1, branch || '~' || c from t join (select range // 2 as p, range as c from range(2, 41)) e on p = node) select * from t",
    "generate_series_step": "select generate_series as n from generate_series(10, -10, -3)",
    "values_list": "select * from (values (1, 'one'), (2, 'two'), (3, null)) t(n, name)",
    "upsert_rows": "select r_regionkey, case when r_regionkey = 0 then 'changed' else r_name end as r_name from region union all select 7, 'new'",
    "prepared_statement": "select o_orderpriority, count(*) as n from orders where o_totalprice > 250000 group by 1",
    "regex_similar": "select p_partkey, regexp_replace(p_name, '[aeiou]', '*') as once, regexp_replace(p_name, '[aeiou]', '*', 'g') as every, split_part(p_brand, '#', 2) as number, strpos(p_name, 'e') as at, trim(p_type, 'AEIOU') as trimmed from part where regexp_full_match(p_brand, 'Brand#(1|2).?')",
    "quoting_functions": "select n_nationkey, case when regexp_full_match(n_name, '[a-z_][a-z0-9_]*') then n_name else '\"' || n_name || '\"' end as ident, '''' || n_name || '''''s''' as literal from nation",
    "fuzzy_matching": f"select x.n_name as a, y.n_name as b, levenshtein(x.n_name, y.n_name) as edits, len({_A}) as trigrams, round(len(list_intersect({_A}, {_B})) / len(list_distinct(list_concat({_A}, {_B}))), 6) as similar from nation x join nation y using (n_regionkey) where x.n_name < y.n_name",
    "date_parts": "select o_orderkey, extract(century from o_orderdate) as century, extract(millennium from o_orderdate) as millennium, extract(decade from o_orderdate) as decade, extract(dow from o_orderdate) as dow, extract(isodow from o_orderdate) as isodow, case when year(o_orderdate) <= 2000 then date '1901-01-01' else date '2001-01-01' end as c, cast(date_trunc('decade', o_orderdate) as date) as d, (o_orderdate < timestamp '2000-01-05' and o_orderdate + interval 10 days > timestamp '2000-01-01') as overlapping from orders",
    "number_functions": "select s_suppkey, cast(trunc(s_suppkey * -7 / 2) as bigint) as q, round(trunc(s_acctbal * 10) / 10, 1) as t, round(cbrt(s_acctbal), 6) as c, case when s_acctbal < 0 then 0 when s_acctbal >= 10000 then 6 else cast(floor(s_acctbal / 2000) as int) + 1 end as w from supplier",
    "array_functions": "select l_orderkey, count(*) as n, count(distinct l_linenumber) as u, cast(coalesce(list_position(list_sort(list(l_linenumber)), 3), 0) as int) as i, len(list_filter(list_distinct(list(l_linenumber)), lambda x: x not in (1, 2))) as r, bool_or(l_linenumber = 5) as has5, bool_or(l_linenumber > 6) as any, bool_and(l_linenumber < 7) as all from lineitem group by 1",
    "map_functions": "select n_nationkey, 2 as n, false as d, n_regionkey = 1 as c, 'x' as x from nation",
    "text_search": "with w as (select item_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') as v from eval_item) select item_id, (list_contains(v, 'twice') or list_contains(v, 'coins')) and not list_contains(v, 'orchard') as hit, len(list_filter(v, lambda x: x in ('the', 'and'))) as n, len(v) as words from w",
    "encoding_functions": "select n_nationkey, md5(n_name) as md5, sha256(n_name) as sha, lower(hex(n_name)) as hex, to_base64(encode(n_name)) as b64, n_name as back from nation",
    "format_functions": "select o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M') as t, cast(o_orderdate as date) as d, date_diff('day', cast(o_orderdate as date), date '2002-01-01') as days, last_day(o_orderdate) as last from orders",
    "regex_functions": "select p_partkey, array_to_string(regexp_extract_all(p_name, '[aeiou]'), '') as vowels, len(string_split(p_name, ' ')) as words, len(regexp_extract_all(p_name, '[a-m]')) as early, regexp_matches(p_brand, '#[0-9]$') as short from part",
    "sql_function": "select l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) as net from lineitem group by 1",
    "python_aggregate": "select p_brand, round(exp(avg(ln(p_retailprice))), 4) as g from part group by 1",
    "table_function": "select r_regionkey, letter, count(*) as n from (select r_regionkey, unnest(string_split(lower(r_name), '')) as letter from region) group by 1, 2",
    "delimited_text": "select n_nationkey, case when n_nationkey % 3 > 0 then n_name || '|\"x\"' end as name from nation",
    "array_aggregate": "select n_regionkey, string_agg(cast(n_nationkey as varchar), ',' order by n_nationkey) as keys from nation group by 1",
    "xml_functions": "select n_regionkey, string_agg('<n id=\"' || n_nationkey || '\">' || n_name || '</n>', '' order by n_nationkey) as x from nation group by 1",
    "network_functions": "select range as i, 167772160 + range as number, range between 128 and 255 as inside from range(0, 301)",
    "geo_functions": "select i, round(2 * 6378168.0 * asin(least(1.0, sqrt(power(sin((radians(i * 10) - radians(10)) / 2), 2) + cos(radians(10)) * cos(radians(i * 10)) * power(sin(radians(i * 20 - 20) / 2), 2)))), 2) as metres from (select range - 8 as i from range(0, 17))",
    "tree_labels": "select 'world.' || r_name || '.' || n_name as path, r_name = 'ASIA' as asian, case r_name when 'AFRICA' then 1 when 'AMERICA' then 2 when 'ASIA' then 3 else 0 end as place from region join nation on r_regionkey = n_regionkey",
    "quantified_comparison": "select p_partkey as k, 'all' as kind from part where p_retailprice >= all (select p_retailprice from part where p_brand = 'Brand#3') union all select c_custkey, 'any' from customer where c_custkey = any (select o_custkey from orders where o_totalprice > 400000)",
    "template_formats": "select o_orderkey, strftime(o_orderdate, '%a, %d %b %Y %H:%M') as t, day(o_orderdate) || '.' || month(o_orderdate) || ' in ' || quarter(o_orderdate) as q, o_orderdate as back, lpad(format('{:,.2f}', o_totalprice), 13, ' ') as price, -round(o_totalprice, 2) as number from orders",
    "interval_functions": """with h as (select o_orderkey, o_orderdate, o_orderkey % 100 + (o_orderkey % 1000) // 24 as d, (o_orderkey % 1000) % 24 as hours from orders)
      select o_orderkey, 1 + d // 30 as months, d % 30 as days, hours, o_orderdate + interval 1 month + interval 3 day + interval 2 hour as later, strftime(o_orderdate + interval 330 minute, '%Y-%m-%d %H:%M:%S') as there from h""",
    "bit_strings": """with s as (select s_suppkey, lpad(bin(s_suppkey % 1024), 10, '0') as t from supplier), b as (select s_suppkey, t::bit as b, '0110011010'::bit as m from s)
      select s_suppkey, (b & m)::varchar as b_and, (b | m)::varchar as b_or, xor(b, m)::varchar as b_xor, (~b)::varchar as b_not, (b << 3)::varchar as b_left, (b >> 2)::varchar as b_right, cast(bit_count(b) as int) as ones, s_suppkey % 1024 as n from b""",
    "keyed_hashes": f"""with h as (select n_nationkey, n_name, md5(n_name) as m from nation), u as (select *, substring(m, 1, 8) || '-' || substring(m, 9, 4) || '-' || substring(m, 13, 4) || '-' || substring(m, 17, 4) || '-' || substring(m, 21) as id from h)
      select n_nationkey, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(n_name)))) as mac, id, id as again from u""",
    "text_search_phrases": """with w as (select item_id, text, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') as v from eval_item)
      select item_id, contains(' ' || array_to_string(v, ' ') || ' ', ' of the ') as phrase, len(list_distinct(v)) as words, regexp_replace(regexp_replace(text, '(?i)\\b(the)\\b', '<b>\\1</b>', 'g'), '(?i)\\b(and)\\b', '<b>\\1</b>', 'g') as marked from w""",
    "text_search_statistics": """with w as (select item_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')) as word from eval_item)
      select word, count(distinct item_id) as ndoc, cast(count(*) as bigint) as nentry from w group by 1""",
    "xml_paths": "select n_nationkey, '<n></n>' as empty, '<r><name>' || n_name || '</name>' || case when n_regionkey > 0 then '<region>' || n_regionkey || '</region>' else '' end || '</r>' as x, n_name as name, case when n_regionkey > 0 then 2 else 1 end as parts from nation",
    "network_bounds": "select range as i, '10.1.' || range // 256 || '.' || (range % 256) // 64 * 64 as low, '10.1.' || range // 256 || '.' || ((range % 256) // 64 * 64 + 63) as high from range(0, 301)",
    "tree_paths": "select n_nationkey, 3 as level, r_name as region, case when r_name = 'ASIA' then 'world.ASIA' else 'world' end as common from region join nation on r_regionkey = n_regionkey",
}
