"""Queries over uncertain tables, with closed forms in SQL. Probabilities are rounded: sums have no fixed order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from manyworlds.model import UTable, argmax, posterior, posterior_within
from manyworlds.operators.construct import pick_tuples, repair_key
from manyworlds.plans.safe import safe_conf
from manyworlds.plans.sql import Worlds
from manyworlds.sources import table
from manyworlds.streaming import windowed_confidence

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    """Register a function under its name, with the SQL that states its result."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c: str | Column, name: str) -> Column:
    return F.round(c, 6).alias(name)


def some(p: str = "p", by: str = "") -> str:
    """SQL of 1 - Π(1 - p)."""
    return f"round(1 - product(1 - {p}), 6)"


_SMALL = "l_discount * 0.001"


@query(f"select {some(_SMALL)} as p from lineitem where l_discount > 0 and l_quantity < 24 and l_shipdate >= timestamp '1996-01-01'")
def conf_independent_b6(spark: SparkSession, root: str) -> DataFrame:
    lines = table(spark, root, "lineitem").filter("l_quantity < 24 and l_shipdate >= timestamp '1996-01-01'")
    return pick_tuples(lines, F.expr(_SMALL), row_id=lines.columns).conf(name="p").select(r6("p", "p"))


@query(f"select l_returnflag, l_linestatus, {some(_SMALL)} as p from lineitem where l_discount > 0 and l_shipdate <= timestamp '2001-09-02' group by 1, 2")
def conf_grouped_q1(spark: SparkSession, root: str) -> DataFrame:
    lines = table(spark, root, "lineitem").filter("l_shipdate <= timestamp '2001-09-02'")
    return pick_tuples(lines, F.expr(_SMALL), row_id=lines.columns).conf("l_returnflag", "l_linestatus", name="p").withColumn("p", F.round("p", 6))


@query("select o_orderkey, round(1 / (1 + o_orderkey % 7), 6) as p from orders")
def tconf_rows(spark: SparkSession, root: str) -> DataFrame:
    orders = table(spark, root, "orders").select("o_orderkey")
    return pick_tuples(orders, F.expr("1 / (1 + o_orderkey % 7)"), row_id=["o_orderkey"]).tconf("p").select("o_orderkey", r6("p", "p"))


@query("select l_returnflag, round(sum(l_extendedprice * l_discount), 2) as revenue from lineitem where l_discount > 0 group by 1")
def esum_revenue(spark: SparkSession, root: str) -> DataFrame:
    lines = table(spark, root, "lineitem")
    return pick_tuples(lines, "l_discount", row_id=lines.columns).esum("l_extendedprice", "l_returnflag", name="revenue").withColumn("revenue", F.round("revenue", 2))


@query("select o_orderpriority, round(sum(1 / (1 + o_orderkey % 7)), 4) as n from orders group by 1")
def ecount_orders(spark: SparkSession, root: str) -> DataFrame:
    orders = table(spark, root, "orders")
    return pick_tuples(orders, F.expr("1 / (1 + o_orderkey % 7)"), row_id=["o_orderkey"]).ecount("o_orderpriority", name="n").withColumn("n", F.round("n", 4))


@query("select c_custkey, c_nationkey, round((c_acctbal + 1000) / sum(c_acctbal + 1000) over (partition by c_nationkey), 6) as p from customer where c_acctbal + 1000 > 0")
def repair_key_weighted(spark: SparkSession, root: str) -> DataFrame:
    customers = table(spark, root, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return repair_key(customers, ["c_nationkey"], F.col("c_acctbal") + 1000, distinct=True).tconf("p").select("c_custkey", "c_nationkey", r6("p", "p"))


@query("select s_suppkey, round(1.0 / count(*) over (partition by s_nationkey), 6) as p from supplier")
def repair_key_uniform(spark: SparkSession, root: str) -> DataFrame:
    return repair_key(table(spark, root, "supplier").select("s_suppkey", "s_nationkey"), ["s_nationkey"], distinct=True).tconf("p").select("s_suppkey", r6("p", "p"))


@query("""with d as (select distinct l_returnflag, l_linestatus, l_quantity from lineitem), w as (select *, l_quantity / sum(l_quantity) over (partition by l_returnflag, l_linestatus) as p from d)
  select l_returnflag, l_linestatus, l_quantity, round(p, 6) as p, count(*) as copies from lineitem join w using (l_returnflag, l_linestatus, l_quantity) group by 1, 2, 3, 4""")
def repair_key_duplicates(spark: SparkSession, root: str) -> DataFrame:
    """Repeated rows keep their chance between them."""
    lines = table(spark, root, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    rows = repair_key(lines, ["l_returnflag", "l_linestatus"], "l_quantity").tconf("p")
    return rows.groupBy("l_returnflag", "l_linestatus", "l_quantity", r6("p", "p")).agg(F.count(F.lit(1)).alias("copies"))


@query("""with a as (select cast(o_orderdate as date) as day, o_custkey, o_totalprice / sum(o_totalprice) over (partition by o_custkey) as p from orders),
  b as (select day, o_custkey, least(sum(p), 1) as p from a group by 1, 2) select day, round(1 - product(1 - p), 5) as p from b group by 1""")
def repair_key_marginal(spark: SparkSession, root: str) -> DataFrame:
    """One order of each customer: the chance that a day has one. Within a customer orders exclude each other."""
    orders = table(spark, root, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("day"))
    return repair_key(orders, ["o_custkey"], "o_totalprice", distinct=True).conf("day", name="p").select("day", F.round("p", 5).alias("p"))


@query("""with t as (select distinct u, v, bit, p from total_order where p is not null and p > 0), w as (select *, p / sum(p) over (partition by u, v) as q from t)
  select u, v, round(q, 6) as p from w where bit = 1""")
def edges_of_total_order(spark: SparkSession, root: str) -> DataFrame:
    """The random graph: of each pair's bits one is chosen; edges are the pairs whose bit is 1."""
    order = table(spark, root, "total_order").select("u", "v", "bit", "p").distinct()
    return repair_key(order, ["u", "v"], "p", distinct=True).where("bit = 1").select("u", "v").tconf("p").select("u", "v", r6("p", "p"))


@query("select u, round(1 - product(1 - _p0) + 1e-10, 6) as p, round(sum(_p0), 4) as n from (select u, v, _v0, _d0, max(_p0) as _p0 from edge group by all) group by u")
def edge_out_degree(spark: SparkSession, root: str) -> DataFrame:
    """A stored uncertain table in flat form: the chance that a node has an edge, and how many it has."""
    edges = UTable.from_flat(table(spark, root, "edge"))
    return edges.conf("u", name="p").join(edges.ecount("u", name="n"), "u").select("u", r6(F.col("p") + 1e-10, "p"), F.round("n", 4).alias("n"))


@query("select distinct l_returnflag, l_linestatus, l_tax from lineitem where l_discount > 0.05")
def possible_distinct(spark: SparkSession, root: str) -> DataFrame:
    lines = table(spark, root, "lineitem")
    return pick_tuples(lines, F.greatest(F.col("l_discount") - 0.05, F.lit(0.0)), row_id=lines.columns).where("l_discount > 0.05").possible("l_returnflag", "l_linestatus", "l_tax")


@query("select s_nationkey, arg_max(s_name, s_acctbal) as best from supplier group by 1")
def argmax_supplier(spark: SparkSession, root: str) -> DataFrame:
    return argmax(table(spark, root, "supplier"), "s_name", "s_acctbal", "s_nationkey", name="best")


@query("select o_custkey, count(*) as pairs, round(sum(1.0 / n), 6) as p from (select o_custkey, o_orderkey, count(*) over (partition by o_custkey) as n from orders) group by 1")
def consistency_self_join(spark: SparkSession, root: str) -> DataFrame:
    """A table joined with itself: only equal choices can exist together."""
    orders = repair_key(table(spark, root, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], distinct=True)
    both = orders.alias("a").join(orders.alias("b"), F.col("a_o_custkey") == F.col("b_o_custkey"))
    return both.tconf("p").groupBy(F.col("a_o_custkey").alias("o_custkey")).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum("p"), 6).alias("p"))


@query("select o_orderpriority, round(1 - product(1 - 0.0001), 6) as p from (select * from orders union all select * from orders) group by 1")
def union_all_uncertain(spark: SparkSession, root: str) -> DataFrame:
    orders = table(spark, root, "orders").select("o_orderkey", "o_orderpriority")
    both = pick_tuples(orders, 0.0001, row_id=["o_orderkey"]).union_all(pick_tuples(orders, 0.0001, row_id=["o_orderkey"]))
    return both.conf("o_orderpriority", name="p").withColumn("p", F.round("p", 6))


def _nations(spark: SparkSession, root: str) -> UTable:
    return repair_key(table(spark, root, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_regionkey"])


@query("select n_name, round(1.0 / count(*) over (partition by n_regionkey), 6) as p from nation union all select 'nowhere', cast(1 as double)")
def insert_uncertain(spark: SparkSession, root: str) -> DataFrame:
    more = spark.createDataFrame([(99, "nowhere", 9)], "n_nationkey int, n_name string, n_regionkey int")
    return _nations(spark, root).insert(more).conf("n_name", name="p").withColumn("p", F.round("p", 6))


@query("select case when n_regionkey = 1 then 'one' else n_name end as n_name, round(sum(1.0 / n), 6) as p from (select *, count(*) over (partition by n_regionkey) as n from nation) group by 1")
def update_uncertain(spark: SparkSession, root: str) -> DataFrame:
    return _nations(spark, root).update({"n_name": F.lit("one")}, F.col("n_regionkey") == 1).conf("n_name", name="p").withColumn("p", F.round("p", 6))


@query("select n_name, round(1.0 / n, 6) as p from (select *, count(*) over (partition by n_regionkey) as n from nation) where n_regionkey <> 2")
def delete_uncertain(spark: SparkSession, root: str) -> DataFrame:
    return _nations(spark, root).delete(F.col("n_regionkey") == 2).conf("n_name", name="p").withColumn("p", F.round("p", 6))


_ORDER_P, _LINE_P = "0.0005 + (o_orderkey % 10) * 0.0001", "0.1 + l_discount"


def _probable(spark: SparkSession, root: str, name: str, p: str, where: str = "true") -> tuple[DataFrame, str]:
    return table(spark, root, name).filter(where).withColumn("_chance", F.expr(p)), "_chance"


@query(f"""with l as (select l_orderkey, 1 - product(1 - ({_LINE_P})) as p from lineitem where l_quantity > 30 group by 1)
  select o_orderpriority, round(1 - product(1 - ({_ORDER_P}) * p), 6) as conf from orders join l on l_orderkey = o_orderkey where o_orderdate >= timestamp '1997-01-01' group by 1""")
def conf_q4_hier(spark: SparkSession, root: str) -> DataFrame:
    tables = {"o": _probable(spark, root, "orders", _ORDER_P, "o_orderdate >= timestamp '1997-01-01'"), "l": _probable(spark, root, "lineitem", _LINE_P, "l_quantity > 30")}
    return safe_conf(tables, [("o.o_orderkey", "l.l_orderkey")], ["o.o_orderpriority"]).withColumn("conf", F.round("conf", 6))


@query(f"""with l as (select l_orderkey, 1 - product(1 - ({_LINE_P})) as p from lineitem where l_quantity > 30 group by 1)
  select round(1 - product(1 - ({_ORDER_P}) * 0.1 * p), 6) as conf from orders join l on l_orderkey = o_orderkey where o_orderdate >= timestamp '1997-01-01'""")
def conf_b4_hier(spark: SparkSession, root: str) -> DataFrame:
    tables = {"o": _probable(spark, root, "orders", f"({_ORDER_P}) * 0.1", "o_orderdate >= timestamp '1997-01-01'"), "l": _probable(spark, root, "lineitem", _LINE_P, "l_quantity > 30")}
    return safe_conf(tables, [("o.o_orderkey", "l.l_orderkey")]).select(r6("conf", "conf"))


@query("""with l as (select l_suppkey, 1 - product(1 - l_discount * 0.01) as p from lineitem where l_shipdate >= timestamp '1997-01-01' group by 1)
  select s_suppkey, s_name, round((0.5 + s_nationkey * 0.01) * p, 6) as conf from supplier join l on l_suppkey = s_suppkey where p > 0""")
def conf_q15_hier(spark: SparkSession, root: str) -> DataFrame:
    tables = {"s": _probable(spark, root, "supplier", "0.5 + s_nationkey * 0.01"), "l": _probable(spark, root, "lineitem", "l_discount * 0.01", "l_shipdate >= timestamp '1997-01-01'")}
    return safe_conf(tables, [("s.s_suppkey", "l.l_suppkey")], ["s.s_suppkey", "s.s_name"]).withColumn("conf", F.round("conf", 6))


@query("""with l as (select l_suppkey, 1 - product(1 - l_discount * 0.0001) as p from lineitem where l_shipdate >= timestamp '1997-01-01' group by 1)
  select round(1 - product(1 - (0.5 + s_nationkey * 0.01) * p), 6) as conf from supplier join l on l_suppkey = s_suppkey""")
def conf_b15_hier(spark: SparkSession, root: str) -> DataFrame:
    tables = {"s": _probable(spark, root, "supplier", "0.5 + s_nationkey * 0.01"), "l": _probable(spark, root, "lineitem", "l_discount * 0.0001", "l_shipdate >= timestamp '1997-01-01'")}
    return safe_conf(tables, [("s.s_suppkey", "l.l_suppkey")]).select(r6("conf", "conf"))


@query("""with l as (select l_partkey, 1 - product(1 - l_discount * 0.001) as p from lineitem where l_shipdate >= timestamp '2000-01-01' group by 1)
  select round(1 - product(1 - 0.01 * p_size * p), 6) as conf from part join l on l_partkey = p_partkey""")
def conf_b14(spark: SparkSession, root: str) -> DataFrame:
    tables = {"p": _probable(spark, root, "part", "0.01 * p_size"), "l": _probable(spark, root, "lineitem", "l_discount * 0.001", "l_shipdate >= timestamp '2000-01-01'")}
    return safe_conf(tables, [("p.p_partkey", "l.l_partkey")]).select(r6("conf", "conf"))


@query("""with l as (select l_partkey, 1 - product(1 - l_tax * 0.01) as p from lineitem where l_quantity < 5 group by 1)
  select p_brand, round(1 - product(1 - 0.01 * p_size * p), 6) as conf from part join l on l_partkey = p_partkey where p > 0 group by 1""")
def conf_b17(spark: SparkSession, root: str) -> DataFrame:
    tables = {"p": _probable(spark, root, "part", "0.01 * p_size"), "l": _probable(spark, root, "lineitem", "l_tax * 0.01", "l_quantity < 5")}
    return safe_conf(tables, [("p.p_partkey", "l.l_partkey")], ["p.p_brand"]).withColumn("conf", F.round("conf", 6))


def _suppliers_of_nations(spark: SparkSession, root: str) -> UTable:
    nations = pick_tuples(table(spark, root, "nation"), F.expr("0.1 + n_nationkey * 0.02"), row_id=["n_nationkey"])
    suppliers = pick_tuples(table(spark, root, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")), F.expr("0.01 + (s_suppkey % 5) * 0.01"), row_id=["s_suppkey"])
    return nations.join(suppliers, "n_nationkey")


_NATIONS_SQL = """with s as (select s_nationkey, 1 - product(1 - (0.01 + (s_suppkey % 5) * 0.01)) as p from supplier group by 1)
  select n_regionkey, round(1 - product(1 - (0.1 + n_nationkey * 0.02) * p), 6) as p from nation join s on s_nationkey = n_nationkey group by 1"""


@query(_NATIONS_SQL)
def conf_general_small(spark: SparkSession, root: str) -> DataFrame:
    """The decomposition solver on a join whose answer has a closed form."""
    return _suppliers_of_nations(spark, root).conf("n_regionkey", name="p").withColumn("p", F.round("p", 6))


@query(_NATIONS_SQL.replace("as p from nation", "as p, true as good from nation"))
def dtree_within_eps(spark: SparkSession, root: str) -> DataFrame:
    u = _suppliers_of_nations(spark, root)
    both = u.conf("n_regionkey", name="p").join(u.conf_bounds("n_regionkey", epsilon=0.05, name="q"), "n_regionkey")
    return both.select("n_regionkey", r6("p", "p"), (F.abs(F.col("p") - F.col("q")) <= 0.05 * F.col("p") + 1e-9).alias("good"))


@query(_NATIONS_SQL.replace("as p from nation", "as p, true as good from nation"))
def aconf_within_eps(spark: SparkSession, root: str) -> DataFrame:
    u = _suppliers_of_nations(spark, root)
    both = u.conf("n_regionkey", name="p").join(u.aconf("n_regionkey", epsilon=0.1, delta=0.001, name="q"), "n_regionkey")
    return both.select("n_regionkey", r6("p", "p"), (F.abs(F.col("p") - F.col("q")) <= 0.1 * F.col("p")).alias("good"))


def random_graph(spark: SparkSession, nodes: DataFrame, chance: float = 0.5) -> UTable:
    """Three edges that close a triangle, over the pairs of some nodes, each an edge with a chance."""
    pairs = nodes.select(F.col("node").alias("u")).crossJoin(nodes.select(F.col("node").alias("v"))).filter("u < v")
    bits = spark.createDataFrame([(1, chance), (0, 1 - chance)], "bit int, p double")
    edge = repair_key(pairs.crossJoin(bits), ["u", "v"], "p").where("bit = 1").select("u", "v")
    a, b, c = edge.alias("a"), edge.alias("b"), edge.alias("c")
    return a.join(b, F.col("a_v") == F.col("b_u")).join(c, (F.col("c_u") == F.col("a_u")) & (F.col("c_v") == F.col("b_v")))


@query("select cast(0.621094 as double) as p")
def randgraph_triangle_exact(spark: SparkSession, root: str) -> DataFrame:
    """Regions as the five nodes of a random graph: the chance of a triangle."""
    return random_graph(spark, table(spark, root, "region").select(F.col("r_regionkey").alias("node"))).conf(name="p").select(r6("p", "p"))


@query("select round(1 - exp(-2.3 + 0.759), 6) as low, round(1 - 0.999 ** 2300, 6) as high, true as good")
def randgraph_triangle_aconf(spark: SparkSession, root: str) -> DataFrame:
    """Nations as the 25 nodes of one with an edge chance of 0.1, by sampling. Of 2,300 possible triangles, 75,900 pairs
    share an edge, so P(none) is between (1 - 0.1³)^2300 and e^(-2.3 + 0.759): bounds that need no solver."""
    triangles = random_graph(spark, table(spark, root, "nation").select(F.col("n_nationkey").alias("node")), 0.1)
    low, high = 1 - F.exp(F.lit(-2.3 + 0.759)), 1 - F.pow(F.lit(0.999), F.lit(2300))
    return triangles.aconf(epsilon=0.05, delta=0.05, name="p").select(r6(low, "low"), r6(high, "high"), F.col("p").between(low * 0.95, high * 1.05).alias("good"))


@query("""with n as (select c_nationkey, c_mktsegment, count(*) as n from customer group by 1, 2), w as (select *, n / sum(n) over (partition by c_nationkey) as p from n),
  b as (select c_nationkey, p as b from w where c_mktsegment = 'BUILDING')
  select c_nationkey, c_mktsegment, round(case when coalesce(b, 0) > 1 - 1e-12 then null when c_mktsegment = 'BUILDING' then 0 else p / (1 - coalesce(b, 0)) end, 6) as p from w left join b using (c_nationkey)""")
def posterior_by_nation_segment(spark: SparkSession, root: str) -> DataFrame:
    """A customer of each nation, given that its segment isn't building."""
    counts = table(spark, root, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    chosen = repair_key(counts, ["c_nationkey"], "n", distinct=True)
    out = posterior_within(chosen, chosen.where("c_mktsegment = 'BUILDING'"), ["c_nationkey"], "c_mktsegment", name="p")
    return out.select("c_nationkey", "c_mktsegment", r6("p", "p"))


@query("select c_mktsegment, round(max(p), 6) as p, round(sum(x), 4) as s from (select c_mktsegment, sum(p) as p, sum(p * c_acctbal) as x from (select *, 1.0 / count(*) over () as p from customer) group by 1) group by 1")
def sql_repair_key_conf(spark: SparkSession, root: str) -> DataFrame:
    """The SQL front end: one customer of all."""
    w = Worlds(spark)
    w.register("customers", table(spark, root, "customer"))
    w.sql("create table one as select c_mktsegment, c_acctbal from (repair key dummy in (select 0 as dummy, c_custkey, c_mktsegment, c_acctbal from customers)) r")
    return w.sql("select c_mktsegment, round(conf(), 6) as p, round(esum(c_acctbal), 4) as s from one group by c_mktsegment").data()


@query("select s_nationkey, round(1 - product(1 - 0.01 * (s_suppkey % 10)), 6) as p from supplier where s_suppkey % 10 > 0 group by 1")
def sql_pick_tuples_conf(spark: SparkSession, root: str) -> DataFrame:
    w = Worlds(spark)
    w.register("suppliers", table(spark, root, "supplier"))
    w.sql("create table s as pick tuples from suppliers independently with probability 0.01 * (s_suppkey % 10)")
    return w.sql("select s_nationkey, round(conf(), 6) as p from s group by s_nationkey").data()


@query("select distinct n_regionkey from nation")
def sql_possible(spark: SparkSession, root: str) -> DataFrame:
    w = Worlds(spark)
    w.register("nations", table(spark, root, "nation"))
    w.sql("create table n as repair key n_regionkey in nations")
    return w.sql("select possible n_regionkey from n").data()


@query("""select time_bucket(interval 1 day, ts) as start, event_type, round(1 - product(1 - p), 6) as conf, round(sum(p), 4) as ecount, round(sum(value * p) + 1e-8, 4) as esum
  from (select *, (event_id % 100) / 1000.0 as p from events) group by 1, 2""")
def windowed_event_confidence(spark: SparkSession, root: str) -> DataFrame:
    """The streaming aggregate, on the stored events."""
    events = table(spark, root, "events").withColumn("p", F.expr("(event_id % 100) / 1000"))
    out = windowed_confidence(events, "ts", "p", "1 day", by=["event_type"], value="value")
    return out.select("start", "event_type", r6("conf", "conf"), F.round("ecount", 4).alias("ecount"), F.round(F.col("esum") + 1e-8, 4).alias("esum"))


# --- worked examples: small literal tables, known answers -------------------------------------------------------------


@query("select ssn, cast(p as double) as p from (values (185, 0.75), (186, 0.416667), (785, 0.833333)) t(ssn, p)")
def example_census(spark: SparkSession, root: str) -> DataFrame:
    """Two ambiguous numbers, cleaned by the rule that no two persons share one."""
    w = Worlds(spark)
    w.register("readings", spark.createDataFrame([(1, 185, 0.4), (1, 785, 0.6), (2, 185, 0.7), (2, 186, 0.3)], "tid int, ssn int, p double"))
    w.sql("create table ssn as select tid, ssn from (repair key tid in readings weight by p) r")
    w.sql("create table shared as select a.tid from ssn a, ssn b where a.tid < b.tid and a.ssn = b.ssn")
    prior, violations = w.tables["ssn"], w.tables["shared"]
    return posterior(prior, violations, "ssn", name="p").select("ssn", r6("p", "p"))


@query("select type, cast(p as double) as p from (values ('2headed', 0.666667), ('fair', 0.333333)) t(type, p)")
def example_coins(spark: SparkSession, root: str) -> DataFrame:
    """Which of three coins was picked, after two heads."""
    picked = repair_key(spark.createDataFrame([("fair", 2), ("2headed", 1)], "type string, cnt int"), [], "cnt").select("type")
    faces = spark.createDataFrame([("fair", "H", 0.5), ("fair", "T", 0.5), ("2headed", "H", 1.0)], "type string, face string, fprob double")
    tosses = repair_key(faces.crossJoin(spark.createDataFrame([(1,), (2,)], "toss int")), ["toss", "type"], "fprob")
    return posterior(picked, picked.join(tosses, "type").where("face <> 'H'"), "type", name="p").select("type", r6("p", "p"))


@query("select cast(t as double) as t, cast(p as double) as p from (values (6.5, 0.125), (7.0, 0.375), (7.5, 0.375), (8.0, 0.125), (8.5, 0.0)) t(t, p)")
def example_sensors(spark: SparkSession, root: str) -> DataFrame:
    """A temperature from the sums of noisy pairs of sensors."""
    sensors = spark.createDataFrame([(1,), (2,), (3,)], "sid int").crossJoin(spark.createDataFrame([(-1, 0.25), (0, 0.5), (1, 0.25)], "delta int, p double"))
    noise = repair_key(sensors, ["sid"], "p").select("sid", "delta")
    temperature = repair_key(spark.createDataFrame([(6.5,), (7.0,), (7.5,), (8.0,), (8.5,)], "t double"), [])
    evidence = UTable(spark.createDataFrame([(1, 2, 14.0), (2, 3, 15.0)], "si int, sj int, v double"))
    a, b = noise.alias("a"), noise.alias("b")
    seen = evidence.join(a, F.col("si") == F.col("a_sid")).join(b, F.col("sj") == F.col("b_sid")).join(temperature)
    return posterior(temperature, seen.where("2 * t + a_delta + b_delta <> v"), "t", name="p").select("t", r6("p", "p"))


@query("select cast(0.7578 as double) as p")
def example_walkthrough(spark: SparkSession, root: str) -> DataFrame:
    """Exact confidence of five clauses over five variables."""
    clauses = [[(1, 1, 0.1)], [(1, 2, 0.4), (2, 1, 0.2)], [(1, 2, 0.4), (3, 1, 0.4)], [(4, 1, 0.7), (5, 1, 0.5)], [(4, 2, 0.3)]]
    df = spark.createDataFrame([(c,) for c in clauses], "_cond array<struct<v:bigint,d:bigint,p:double>>")
    return UTable(df, "uncertain").conf(name="p").select(r6("p", "p"))


@query("select cast(4300 as double) as amount")
def example_expected_sales(spark: SparkSession, root: str) -> DataFrame:
    w = Worlds(spark)
    w.register("sales", spark.createDataFrame([(1, 5000.0, 0.7), (2, 2000.0, 0.4)], "transact_id int, amount double, prob double"))
    w.sql("create table s as pick tuples from sales independently with probability prob")
    return w.sql("select esum(amount) as amount from s").data()


@query("select 12 as pairs, 28 as triples, cast(0.9375 as double) as mixed")
def example_consistency(spark: SparkSession, root: str) -> DataFrame:
    r = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2)], "a int, b int")
    s = repair_key(r, ["a"])
    two = s.alias("x").join(s.alias("y"))
    three = two.join(s.alias("z"))
    mixed = pick_tuples(r).alias("p").join(s.alias("q")).conf(name="mixed")
    counts = two.df.agg(F.count(F.lit(1)).cast("int").alias("pairs")).crossJoin(three.df.agg(F.count(F.lit(1)).cast("int").alias("triples")))
    return counts.crossJoin(mixed)


@query("select c_mktsegment, round(p + 1, 6) as x, round(p / 8, 6) as y, round(s, 4) as s from (select c_mktsegment, sum(q) as p, sum(q * c_acctbal) as s from (select *, 1.0 / count(*) over () as q from customer) group by 1)")
def sql_conf_in_arithmetic(spark: SparkSession, root: str) -> DataFrame:
    w = Worlds(spark)
    w.register("customers", table(spark, root, "customer"))
    w.sql("create table one as repair key dummy in (select 0 as dummy, c_custkey, c_mktsegment, c_acctbal from customers)")
    return w.sql("select c_mktsegment, round(conf() + 1, 6) as x, round(conf() / 8, 6) as y, round(esum(c_acctbal), 4) as s from one group by c_mktsegment").data()


@query(_NATIONS_SQL.replace("as p from nation", "as p, true as r, true as a, true as m from nation"))
def sql_approximate_conf(spark: SparkSession, root: str) -> DataFrame:
    """The approximations by their SQL names, against the exact value."""
    w = Worlds(spark)
    w.register("nation", table(spark, root, "nation"))
    w.register("supplier", table(spark, root, "supplier"))
    w.sql("create table n as pick tuples from nation with probability 0.1 + n_nationkey * 0.02")
    w.sql("create table s as pick tuples from supplier with probability 0.01 + (s_suppkey % 5) * 0.01")
    w.sql("create table j as select n.n_regionkey, s.s_suppkey from n, s where n.n_nationkey = s.s_nationkey")
    out = w.sql("select n_regionkey, conf() as p, conf('R', 0.02) as r, conf('A', 0.02) as a, aconf(0.1, 0.001) as m from j group by n_regionkey").data()
    return out.select("n_regionkey", r6("p", "p"), (F.abs(F.col("r") - F.col("p")) <= 0.02 * F.col("p") + 1e-9).alias("r"), (F.abs(F.col("a") - F.col("p")) <= 0.02 + 1e-9).alias("a"), (F.abs(F.col("m") - F.col("p")) <= 0.1 * F.col("p")).alias("m"))


@query(f"""with l as (select l_orderkey, 1 - product(1 - ({_LINE_P})) as p from lineitem where l_quantity > 30 group by 1)
  select o_orderpriority, round(1 - product(1 - ({_ORDER_P}) * p), 6) as p from orders join l on l_orderkey = o_orderkey where o_orderdate >= timestamp '1997-01-01' group by 1""")
def sql_hierarchical_conf(spark: SparkSession, root: str) -> DataFrame:
    """The SQL front end finds the safe plan of a hierarchical join by itself."""
    w = Worlds(spark)
    w.register("orders", table(spark, root, "orders"))
    w.register("lineitem", table(spark, root, "lineitem"))
    w.sql(f"create table o as pick tuples from orders with probability {_ORDER_P}")
    w.sql(f"create table l as pick tuples from lineitem with probability {_LINE_P}")
    return w.sql("select o_orderpriority, round(conf(), 6) as p from o, l where o_orderkey = l_orderkey and l_quantity > 30 and o_orderdate >= timestamp '1997-01-01' group by o_orderpriority").data()
