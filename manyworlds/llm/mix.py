"""Sources mixed to target shares of the total size by weighted fair queueing.

Each source's documents are shuffled and queue up; a source that runs out starts again, in a new order, as often as its
repeats allow. A document leaves its queue at a virtual finish time, the tokens of its source up to and including it
divided by the source's target weight, and the mixture takes documents in the order of finish times until the budget is
spent. At any cut of that order each source that still has documents is within one document of its share.

The running sums are distributed: the shuffle key is a uniform hash, so equal slices of its range are a range partition
that needs no sampling and comes out the same on every attempt. Slices are summed on the map side, the sums of earlier
slices are added up over one small row per slice, and only the running sum inside a slice needs an order. A source with
most of the rows has as many more slices, so no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from manyworlds.plans.runtime import bounded, checkpoint

#: Targeted sources there may be.
MOST_SOURCES = 100_000
#: Rows that one slice of a source, or of the finish times, holds on average.
SLICE_ROWS = 20_000


def _slice(key: str, slices: str) -> Column:
    """The slice of a 64-bit hash: the range of all hashes cut evenly."""
    at = F.floor((F.col(key).cast("double") / F.lit(2.0**64) + F.lit(0.5)) * F.col(slices))
    return F.least(F.greatest(at, F.lit(0)), F.col(slices) - 1).cast("int")


def horizon(plan: list[dict], limit: float) -> float:
    """The virtual time at which the sources have spent `limit` tokens: each min(all it has, share x time)."""
    time, spent, left = 0.0, 0.0, sorted(plan, key=lambda r: r["repeats"] * r["total"] / r["share"])
    for k, r in enumerate(left):
        rate, ends = sum(x["share"] for x in left[k:]), r["repeats"] * r["total"] / r["share"]
        if spent + rate * (ends - time) >= limit:
            return time + (limit - spent) / rate
        spent, time = spent + rate * (ends - time), ends
    return time


def mixture(sized: DataFrame, targets: DataFrame, *, budget: int | None = None, seed: int = 0, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The chosen documents, one row per use: ``doc_id, source, pass, tokens, finish``.

    `sized` has ``doc_id, source, tokens``; `targets` has ``source, target_share, max_repeats`` (one row per source, a
    bounded table). Without `budget` it is the largest total at which every source can reach its share within its
    repeats. With a larger one, sources that run out stay short and the others fill the total; the shares reached are
    :func:`shares`. ``pass`` counts a document's uses from 1.

    Documents of null or untargeted sources aren't used, nor sources with a share or repeats of 0 or null. A source
    without documents (or with none but empty ones) makes every share unreachable: it is left out of the budget's
    minimum, so the rest is mixed and the report shows it at 0. Documents without tokens take no room and are chosen
    with their neighbours. Ties in the shuffle are broken by ``doc_id``; repeated rows queue up each. Empty tables give
    no rows. Other columns aren't read. `sized` is read more than once: pass a table or a checkpoint.
    """
    sized = sized.select("doc_id", "source", "tokens")
    wanted = targets.filter("source is not null and target_share > 0 and max_repeats > 0").select("source", F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("repeats"))
    totals = sized.groupBy("source").agg(F.sum("tokens").alias("total"), F.max("tokens").alias("longest"), F.count(F.lit(1)).alias("docs")).join(wanted, "source").filter("total > 0")
    # One row per targeted source: as many as the bounded table of targets has.
    plan = [r.asDict() for r in bounded(totals, MOST_SOURCES)]
    if not plan:
        return sized.limit(0).select("doc_id", "source", F.lit(1).alias("pass"), "tokens", F.lit(0.0).alias("finish"))
    limit = int(min(r["repeats"] * r["total"] / r["share"] for r in plan)) if budget is None else budget
    # By `end` each source has spent what it has, or its part of the budget and a document more: the cut lies before.
    end = horizon(plan, limit) + max(r["longest"] / r["share"] for r in plan)
    for r in plan:
        r["passes"] = min(r["repeats"], int(r["share"] * end / r["total"]) + 1)
        r["slices"] = max(1, -(-r["docs"] // slice_rows))
    rule = sized.sparkSession.createDataFrame([(r["source"], r["share"], r["passes"], r["slices"]) for r in plan], "source string, share double, passes int, slices int")
    queued = (
        sized.join(rule, "source")
        .withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("passes"))))
        .withColumn("key", F.xxhash64("doc_id", "pass", F.lit(seed)))
        .withColumn("slice", _slice("key", "slices"))
    )
    # A pass is a source's pieces pass 1 slice 0, 1, ..., pass 2 slice 0, ...: small sums, one row per slice.
    sums = queued.groupBy("source", "pass", "slice").agg(F.sum("tokens").alias("n"))
    before = sums.select("source", "pass", "slice", (F.sum("n").over(Window.partitionBy("source").orderBy("pass", "slice")) - F.col("n")).alias("before"))
    # Slices that begin beyond the end are dropped before their rows are moved and sorted: of a source with much more
    # than its share most are.
    begins = before.join(rule.select("source", F.col("share").alias("part")), "source").filter(F.col("before") / F.col("part") <= end).drop("part")
    inner = Window.partitionBy("source", "pass", "slice").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    few = sum(r["passes"] * r["slices"] for r in plan) <= MOST_SOURCES
    timed = queued.join(F.broadcast(begins) if few else begins, ["source", "pass", "slice"]).withColumn("inside", F.sum("tokens").over(inner))
    timed = timed.select("doc_id", "source", "pass", "tokens", "key", ((F.col("before") + F.col("inside")) / F.col("share")).alias("finish"))
    # The order of finish times is cut where the running total passes the budget: sums per slice of time, and an order
    # only inside the slice with the cut. While sources last, even slices of time hold about as many documents each.
    slices = max(1, int(sum(min(r["docs"] * r["passes"], r["docs"] * r["share"] * end / r["total"]) for r in plan) / slice_rows))
    timed = timed.filter(F.col("finish") <= end).withColumn("at", F.least(F.floor(F.col("finish") / F.lit(end) * slices), F.lit(slices - 1)).cast("int"))
    timed = checkpoint(timed)
    running = Window.orderBy("at")
    cut = timed.groupBy("at").agg(F.sum("tokens").alias("n")).withColumn("upto", F.sum("n").over(running)).withColumn("before", F.col("upto") - F.col("n"))
    edge = cut.filter(F.col("upto") > limit).orderBy("at").limit(1).collect()
    if not edge:
        chosen = timed
    else:
        at, done = edge[0]["at"], edge[0]["before"]
        inside = timed.filter(F.col("at") == at).withColumn("sum", F.sum("tokens").over(Window.orderBy("finish", "source", "key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        chosen = timed.filter(F.col("at") < at).unionByName(inside.filter(F.col("sum") + done <= limit).drop("sum"))
    return chosen.select("doc_id", "source", "pass", "tokens", "finish")


def ordered(chosen: DataFrame) -> DataFrame:
    """The mixture in the order of finish times, by a range sort."""
    return chosen.orderBy("finish", "source", "pass", "doc_id")


def repeats(chosen: DataFrame) -> DataFrame:
    """One row per chosen document: ``doc_id, source, tokens, repeats``."""
    return chosen.groupBy("doc_id", "source", "tokens").agg(F.count(F.lit(1)).alias("repeats"))


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """Per targeted source: target and reached share, tokens, uses and the most uses of one document."""
    used = chosen.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), F.max("pass").alias("most_repeats"))
    per = targets.filter("source is not null").select("source", "target_share").join(used, "source", "left").fillna(0, ["tokens", "uses", "most_repeats"])
    # One row per source: a window over all of them is small.
    return per.withColumn("reached_share", F.when(F.sum("tokens").over(Window.partitionBy()) > 0, F.col("tokens") / F.sum("tokens").over(Window.partitionBy())).otherwise(F.lit(0.0)))
