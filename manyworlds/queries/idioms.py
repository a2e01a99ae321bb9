"""What uncertain tables allow and refuse, worked examples in SQL, and more of the hierarchical headline queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyworlds.model import UTable, argmax, posterior
from manyworlds.operators.construct import pick_tuples, repair_key
from manyworlds.plans.safe import safe_conf
from manyworlds.plans.sql import Worlds
from manyworlds.queries.worlds import r6
from manyworlds.sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    """Register a function under its name, with the SQL that states its result."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


# --- allowed and refused ---------------------------------------------------------------------------------------------

#: Statements over a certain table r(type, p) and an uncertain one c of the same columns: the rule they belong to, and
#: whether they are refused.
STATEMENTS = (
    ("outer join", "select a.type from c a left join c b on a.p = b.p", True),
    ("join", "select a.type from c a, c b where a.p = b.p", False),
    ("set operation", "select type from c union select type from c", True),
    ("set operation", "select type from c intersect select type from c", True),
    ("set operation", "select type from c except select type from c", True),
    ("union all", "select type from c union all select type from c", False),
    ("set operation of certain results", "select possible type from c union select type from r", False),
    ("sub-query", "select type from r, c where r.type in (select type from c)", True),
    ("certain sub-query", "select type from c where type in (select type from r)", False),
    ("distinct", "select distinct type from c", True),
    ("grouping", "select type from c group by type", True),
    ("functions in the select list", "select upper(type) as t, p + 1 as q from c", False),
    ("nested constructor", "repair key type in c", True),
    ("nested constructor", "pick tuples from c", True),
    ("alteration", "alter table c add column x int", True),
    ("explanation", "explain select type, conf() from c group by type", False),
    ("confidence of a certain table", "select conf() from r", True),
    ("confidence of a certain table", "select esum(p) from r", True),
    ("confidence", "select type, conf() as x, ecount() as n from c group by type", False),
    ("possible and confidence", "select possible type, conf() from c group by type", True),
    ("change of conditions", "update c set _v0 = 1", True),
    ("change of conditions", "insert into c (type, _d0) values ('a', 1)", True),
    ("negative weight", "select possible type from (repair key type in r weight by p - 2) x", True),
    ("probability above one", "select possible type from (pick tuples from r with probability p) x", True),
    ("unknown approach", "select conf('X', 0.1) from c", True),
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("select * from (values " + ", ".join(f"({_quoted(rule)}, {_quoted(text)}, {str(refused).lower()})" for rule, text, refused in STATEMENTS) + ") t(rule, statement, refused)")
def refused_statements(spark: SparkSession, root: str) -> DataFrame:
    """Which statements over uncertain tables are refused, found by running them."""
    w = Worlds(spark)
    w.register("r", spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "type string, p int"))
    out = []
    for rule, text, _ in STATEMENTS:
        w.sql("create table c as repair key type in r weight by p")
        try:
            found = w.sql(text)
            if isinstance(found, UTable):
                found.df.count()
                found.df.write.format("noop").mode("overwrite").save()
        except Exception:  # noqa: BLE001  a refusal, in the plan or in a task
            out.append((rule, text, True))
        else:
            out.append((rule, text, False))
    return spark.createDataFrame(out, "rule string, statement string, refused boolean")


# --- worked examples: small literal tables, known answers --------------------------------------------------------------


@query("select ground, weather, cast(p as double) as p from (values ('dry', 'no rain', 1.0), ('wet', 'no rain', 0.2), ('wet', 'rain', 0.8)) t(ground, weather, p)")
def example_weather(spark: SparkSession, root: str) -> DataFrame:
    """The weather given the ground, as a ratio of two confidences."""
    w = Worlds(spark)
    w.register("r", spark.createDataFrame([("x", "rain", "wet", 0.4), ("x", "no rain", "wet", 0.1), ("x", "no rain", "dry", 0.5)], "dummy string, weather string, ground string, p double"))
    w.sql("create table s as repair key dummy in r weight by p")
    both, one = w.sql("select weather, ground, conf() as p1 from s group by weather, ground").data(), w.sql("select ground, conf() as p2 from s group by ground").data()
    return both.join(one, "ground").select("ground", "weather", r6(F.col("p1") / F.col("p2"), "p"))


@query("""select cid, skill, cast(p1 as double) as p1, cast(p2 as double) as p2, cast(p as double) as p from (values ('Google', 'Segway', 0.2, 0.4, 0.5), ('Google', 'Web', 0.4, 0.4, 1.0),
  ('Yahoo', 'DB', 0.6, 0.6, 1.0), ('Yahoo', 'Search', 0.4, 0.6, 0.666667), ('Yahoo', 'Web', 0.4, 0.6, 0.666667)) t(cid, skill, p1, p2, p)""")
def example_companies(spark: SparkSession, root: str) -> DataFrame:
    """One company is bought and one of its employees leaves: the skills that are gained, given the company."""
    w = Worlds(spark)
    w.register("staff", spark.createDataFrame([("Google", "Larry"), ("Google", "Sergey"), ("Yahoo", "Raghu"), ("Yahoo", "Chris"), ("Yahoo", "Phil")], "cid string, eid string"))
    w.register("skilled", spark.createDataFrame([("Larry", "Web"), ("Sergey", "Web"), ("Sergey", "Segway"), ("Raghu", "DB"), ("Raghu", "Web"), ("Chris", "Search"), ("Phil", "DB")], "eid string, skill string"))
    w.sql("create table choices as repair key dummy in (select 1 as dummy, * from staff)")
    w.sql("create table remaining as select s.cid, s.eid from staff s, choices c where c.cid = s.cid and c.eid <> s.eid")
    gained = w.sql("select r.cid, k.skill, conf() as p1 from remaining r, skilled k where r.eid = k.eid group by r.cid, k.skill").data()
    bought = w.sql("select cid, conf() as p2 from remaining group by cid").data()
    return gained.join(bought, "cid").select("cid", "skill", r6("p1", "p1"), r6("p2", "p2"), r6(F.col("p1") / F.col("p2"), "p"))


@query("select disease, cast(prior as double) as prior, cast(p as double) as p from (values ('gastritis', 0.333333, 0.555556), ('migraine', 0.666667, 0.444444)) t(disease, prior, p)")
def example_medical(spark: SparkSession, root: str) -> DataFrame:
    """Diagnoses of a symptom, before and after a treatment that didn't help."""
    w = Worlds(spark)
    seen = [("migraine", "nausea", 0.4), ("migraine", "headache", 0.5), ("migraine", "unknown", 0.1), ("gastritis", "nausea", 0.2), ("gastritis", "indigestion", 0.6), ("gastritis", "unknown", 0.2)]
    w.register("diseases", spark.createDataFrame(seen, "disease string, symptom string, freq double"))
    w.register("treatments", spark.createDataFrame([("migraine", "paracetamol", True, 0.6), ("migraine", "paracetamol", False, 0.4), ("gastritis", "pca", True, 0.7), ("gastritis", "pca", False, 0.3)], "disease string, treat string, result boolean, p double"))
    w.sql("create table diagnosis as select disease, symptom from (repair key symptom in diseases weight by freq) r")
    w.sql("create table treated as select disease, treat, result from (repair key disease, treat in treatments weight by p) r")
    nausea = w.tables["diagnosis"].where("symptom = 'nausea'").select("disease")
    # The patient took paracetamol without improvement: with migraine, worlds in which it would have helped are out.
    failed = w.tables["treated"].where("treat = 'paracetamol' and not result").select(F.col("disease").alias("ill"))
    prior = nausea.conf("disease", name="prior")
    against = failed.conf("ill", name="p2")
    total = failed.conf(name="p3")
    joined = prior.join(against, F.col("disease") == F.col("ill"), "left").join(total)
    return joined.select("disease", r6("prior", "prior"), r6((F.col("prior") - F.coalesce("p2", F.lit(0.0))) / (1 - F.col("p3")), "p"))


@query("select '2headed' as most_likely, '2headed' as best_explanation")
def most_likely(spark: SparkSession, root: str) -> DataFrame:
    """The coin of greatest posterior and the one of greatest likelihood, by argmax over confidences."""
    picked = repair_key(spark.createDataFrame([("fair", 2), ("2headed", 1)], "type string, cnt int"), [], "cnt").select("type")
    faces = spark.createDataFrame([("fair", "H", 0.5), ("fair", "T", 0.5), ("2headed", "H", 1.0)], "type string, face string, fprob double")
    tosses = repair_key(faces.crossJoin(spark.createDataFrame([(1,), (2,)], "toss int")), ["toss", "type"], "fprob")
    after = posterior(picked, picked.join(tosses, "type").where("face <> 'H'"), "type", name="p")
    heads = tosses.where("face = 'H'").select("type", "toss")
    a, b = heads.where("toss = 1").alias("a"), heads.where("toss = 2").alias("b")
    likelihood = a.join(b, F.col("a_type") == F.col("b_type")).conf("a_type", name="p")
    return argmax(after, "type", "p", name="most_likely").crossJoin(argmax(likelihood, "a_type", "p", name="best_explanation"))


@query("select n_regionkey, max(n_name) as likeliest from (select n_regionkey, n_name, row_number() over (partition by n_regionkey order by n_nationkey desc) as k from nation) where k = 1 group by 1")
def likeliest_nation(spark: SparkSession, root: str) -> DataFrame:
    """A nation of each region, weighted by its key, and the likeliest of them: argmax over a conf result."""
    chosen = repair_key(table(spark, root, "nation").select("n_regionkey", "n_name", (F.col("n_nationkey") + 1).alias("w")), ["n_regionkey"], "w")
    return argmax(chosen.conf("n_regionkey", "n_name", name="p"), "n_name", "p", "n_regionkey", name="likeliest")


def _bits(spark: SparkSession, nodes: DataFrame) -> UTable:
    """The pairs of some nodes, each with one of two bits."""
    pairs = nodes.select(F.col("node").alias("u")).crossJoin(nodes.select(F.col("node").alias("v"))).filter("u < v")
    return repair_key(pairs.crossJoin(spark.createDataFrame([(1, 0.5), (0, 0.5)], "bit int, p double")), ["u", "v"], "p").select("u", "v", "bit")


@query("select round(0.0644531, 6) as p")
def randgraph_four_clique(spark: SparkSession, root: str) -> DataFrame:
    """Regions as the five nodes of a random graph: the chance of four nodes that are all joined."""
    edge = _bits(spark, table(spark, root, "region").select(F.col("r_regionkey").alias("node"))).where("bit = 1").select("u", "v")
    a, b, c, d, e, f = (edge.alias(x) for x in "abcdef")
    three = a.join(b, F.col("a_v") == F.col("b_u")).join(c, (F.col("c_u") == F.col("a_u")) & (F.col("c_v") == F.col("b_v")))
    four = three.join(d, F.col("d_u") == F.col("b_v")).join(e, (F.col("e_u") == F.col("a_v")) & (F.col("e_v") == F.col("d_v"))).join(f, (F.col("f_u") == F.col("a_u")) & (F.col("f_v") == F.col("d_v")))
    return four.conf(name="p").select(F.round("p", 6).alias("p"))


@query("select 3 as n, cast(0.375 as double) as p union all select 4, cast(0.765625 as double)")
def randgraph_induced_path(spark: SparkSession, root: str) -> DataFrame:
    """The chance that a random graph of three or four nodes has two edges that share a node and aren't closed."""
    out = None
    for n in (3, 4):
        bits = _bits(spark, spark.range(n).withColumnRenamed("id", "node"))
        a, b, c = (bits.alias(x) for x in "abc")
        paths = a.join(b, F.col("a_v") == F.col("b_u")).join(c, (F.col("c_u") == F.col("a_u")) & (F.col("c_v") == F.col("b_v"))).where("a_bit + b_bit + c_bit = 2")
        one = paths.conf(name="p").select(F.lit(n).alias("n"), r6("p", "p"))
        out = one if out is None else out.unionByName(one)
    return out


# --- more of the hierarchical headline queries ---------------------------------------------------------------------------

_ORDER_P, _LINE_P = "0.0005 + (o_orderkey % 10) * 0.0001", "0.1 + l_discount"
_RARE = "0.00001 * (1 + l_linenumber)"


@query(f"select round(1 - product(1 - {_RARE}), 6) as p from lineitem where l_shipdate <= timestamp '2001-09-02'")
def conf_b1(spark: SparkSession, root: str) -> DataFrame:
    """Whether any line was shipped by a day."""
    lines = table(spark, root, "lineitem").filter("l_shipdate <= timestamp '2001-09-02'")
    return pick_tuples(lines, F.expr(_RARE), row_id=lines.columns).conf(name="p").select(r6("p", "p"))


def _late(spark: SparkSession, root: str, chance: str) -> dict[str, tuple[DataFrame, str]]:
    orders, lines = table(spark, root, "orders"), table(spark, root, "lineitem").filter("l_shipdate >= timestamp '1997-01-01' and l_shipdate < timestamp '1998-01-01'")
    return {"o": (orders.withColumn("_chance", F.expr(chance)), "_chance"), "l": (lines.withColumn("_chance", F.expr(_LINE_P)), "_chance")}


_LATE_SQL = f"""with l as (select l_orderkey, l_returnflag, 1 - product(1 - ({_LINE_P})) as p from lineitem where l_shipdate >= timestamp '1997-01-01' and l_shipdate < timestamp '1998-01-01' group by 1, 2)"""


@query(f"{_LATE_SQL} select l_returnflag, round(1 - product(1 - ({_ORDER_P}) * p), 6) as conf from orders join l on l_orderkey = o_orderkey group by 1")
def conf_q12_hier(spark: SparkSession, root: str) -> DataFrame:
    """Orders with a line shipped in a year, by the line's flag."""
    return safe_conf(_late(spark, root, _ORDER_P), [("o.o_orderkey", "l.l_orderkey")], ["l.l_returnflag"]).withColumn("conf", F.round("conf", 6))


@query(f"""with l as (select l_orderkey, 1 - product(1 - ({_LINE_P})) as p from lineitem where l_shipdate >= timestamp '1997-01-01' and l_shipdate < timestamp '1998-01-01' group by 1)
  select round(1 - product(1 - ({_ORDER_P}) * 0.1 * p), 6) as conf from orders join l on l_orderkey = o_orderkey""")
def conf_b12_hier(spark: SparkSession, root: str) -> DataFrame:
    """Whether there is any."""
    return safe_conf(_late(spark, root, f"({_ORDER_P}) * 0.1"), [("o.o_orderkey", "l.l_orderkey")]).select(r6("conf", "conf"))


@query("""with s as (select l_partkey, 1 - product(1 - 0.00002 * (l_suppkey % 5)) as p from lineitem group by 1)
  select round(1 - product(1 - 0.01 * p_size * p), 6) as conf from part join s on l_partkey = p_partkey where p_brand <> 'Brand#45' and p_size >= 10""")
def conf_b16(spark: SparkSession, root: str) -> DataFrame:
    """Whether a part of some brands and sizes is supplied: lines stand for what suppliers offer."""
    parts, lines = table(spark, root, "part").filter("p_brand <> 'Brand#45' and p_size >= 10"), table(spark, root, "lineitem")
    tables = {"p": (parts.withColumn("_chance", F.expr("0.01 * p_size")), "_chance"), "s": (lines.withColumn("_chance", F.expr("0.00002 * (l_suppkey % 5)")), "_chance")}
    return safe_conf(tables, [("p.p_partkey", "s.l_partkey")]).select(r6("conf", "conf"))


@query("""with first as (select u, v, 1 - product(1 - _p0) as p from edge where v is not null and u <> v group by 1, 2), second as (select u, 1 - product(1 - _p0) as p from edge where v is not null and u <> v group by 1)
  select f.u, round(1 - product(1 - f.p * s.p) + 1e-10, 5) as conf from first f join second s on f.v = s.u group by 1""")
def conf_two_steps(spark: SparkSession, root: str) -> DataFrame:
    """The uncertain graph of stored edges: the chance that a node has a path of two edges. Without loops the edges of a
    node's neighbours are none of its own, so the join is hierarchical."""
    edges = table(spark, root, "edge").filter("v is not null and u <> v").select("u", "v", "_p0")
    return safe_conf({"a": (edges, "_p0"), "b": (edges, "_p0")}, [("a.v", "b.u")], ["a.u"]).select("u", F.round(F.col("conf") + 1e-10, 5).alias("conf"))
