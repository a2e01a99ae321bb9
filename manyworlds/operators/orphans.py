"""References to records that don't exist, or don't exist yet or any more, at the time of the reference.

Keys are partitioned into ranges of their 64-bit hash. The parents of one range are kept as sorted arrays: the keys, the
composite of key number and rank of the start, and the running maximum of the ends. References are brought to their
range as Arrow tables and probed by vectorised binary search; a hit's key is compared as a string too, so a hash
collision can't hide an orphan. A range with many references is split into slices and its parents, some `range_rows`
of them, repeated for each slice, so a hot reference key is spread over tasks. A parent key with more spans than a range
holds is a range of its own that is split by time; what still covers the start of a piece is carried into it as one span.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyworlds.plans.runtime import checkpoint, pieces

#: An open end, in microseconds.
FOREVER = np.iinfo(np.int64).max
#: Parents of one range: what a task holds as sorted arrays.
RANGE_ROWS = 5_000
#: References of one slice of a range.
SLICE_ROWS = 50_000
#: Ranges whose sizes, one small row each, may be broadcast.
SIZE_ROWS = 1_000_000


def micros(column: pa.ChunkedArray, missing: int) -> np.ndarray:
    """Microseconds since 1970 of timestamps; zone-less ones are taken as they stand, whatever the session's zone."""
    return pc.fill_null(one_array(column).cast(pa.timestamp("us", column.type.tz)).cast(pa.int64()), missing).to_numpy(zero_copy_only=False)


def month(when: Column) -> Column:
    """yyyy-MM of a timestamp, by date arithmetic alone."""
    return F.when(when.isNotNull(), F.concat_ws("-", F.lpad(F.year(when).cast("string"), 4, "0"), F.lpad(F.month(when).cast("string"), 2, "0")))


class SortedParents:
    """The parents of a range: distinct keys in hash order and, in the order of (key, start), how long they cover."""

    def __init__(self, keys: pa.Array, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        text = np.asarray(pc.rank(keys, sort_keys="ascending", tiebreaker="dense")) if len(keys) else np.empty(0, np.int64)
        order = np.lexsort((start, text, hashes))
        h, text, start, end = hashes[order], text[order], start[order], end[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        self.number = np.cumsum(new) - 1
        self.hashes, self.keys = h[new], keys.take(pa.array(order[new]))
        self.starts = np.unique(start)
        self.place = self.number << 32 | np.searchsorted(self.starts, start, "right")
        # The running maximum of the ends within a key: one pass, each key's block lifted above the one before by rank.
        ends = np.unique(end)
        lifted = np.maximum.accumulate(self.number << 32 | np.searchsorted(ends, end))
        self.end = ends[lifted & 0xFFFFFFFF] if len(ends) else end

    def covers(self, keys: pa.Array, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each reference, whether a parent of its key was there at its time."""
        out = np.zeros(len(at), bool)
        if not len(self.hashes):
            return out
        left, right = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        rank = np.searchsorted(self.starts, at, "right")
        for step in range(int((right - left).max(initial=0))):  # one step, but for colliding hashes
            number = left + step
            live = np.flatnonzero(number < right)
            same = np.asarray(pc.equal(keys.take(pa.array(live)), self.keys.take(pa.array(number[live]))), bool)
            live, number = live[same], number[live][same]
            found = np.searchsorted(self.place, number << 32 | rank[live], "right") - 1
            there = found >= 0
            there[there] = self.number[found[there]] == number[there]
            out[live[there]] |= self.end[found[there]] > at[live[there]]
        return out


def one_array(column: pa.ChunkedArray) -> pa.Array:
    """A table's column in one piece."""
    whole = column.combine_chunks()
    return whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks) if whole.num_chunks else pa.array([], column.type)


def missing_references(
    references: Sequence[tuple[str, DataFrame, str, str, str]], parents: DataFrame, key: str, since: str, until: str, *, range_rows: int = RANGE_ROWS, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """(src_table, period, row_id) of each reference without a live parent.

    `references` are (name, table, id column, key column, time column). A parent is live from `since` (inclusive) to
    `until` (exclusive, null: for ever) under the trimmed `key`; a reference's key is trimmed too. References with a
    null key refer to nothing and are passed over; an empty key is a key. A reference whose time is null can't be placed
    in any parent's life: it is an orphan, with a null period. Times without zone are compared as they stand; only where
    a table has times with a zone do those without go through the session's.
    Parents with a null key or null `since` are never live. No parents: all references are orphans. Repeated rows are
    judged one by one. Other columns aren't read.
    """
    zoned = any(dict(df.dtypes)[c] == "timestamp" for df, c in [(parents, since), (parents, until), *((df, at) for _, df, _, _, at in references)])
    when = lambda c: F.col(c).cast("timestamp" if zoned else "timestamp_ntz")
    # A parent's spans are merged by start first, on the map side: a key registered very often shrinks before it moves.
    spans = (
        parents.filter(F.col(key).isNotNull() & F.col(since).isNotNull())
        .select(F.trim(F.col(key)).alias("k"), when(since).alias("s"), when(until).alias("e"))
        .groupBy("k", "s")
        .agg(F.when(~F.bool_or(F.col("e").isNull()), F.max("e")).alias("e"))
        .select("k", F.xxhash64("k").alias("h"), "s", "e")
    )
    probes = None
    for n, (_, df, row_id, ref_key, at) in enumerate(references):
        one = df.filter(F.col(ref_key).isNotNull()).select(F.lit(n).cast("tinyint").alias("src"), F.col(row_id).cast("bigint").alias("id"), F.trim(F.col(ref_key)).alias("k"), when(at).alias("t"))
        probes = one if probes is None else probes.unionByName(one)
    probes = probes.withColumn("h", F.xxhash64("k"))

    spans = checkpoint(spans)  # counted, then read
    size = spans.count()
    ranges = pieces(size, range_rows)
    even = F.least(F.greatest(F.floor((F.col("h").cast("double") / F.lit(2.0**64) + F.lit(0.5)) * ranges), F.lit(0)), F.lit(ranges - 1)).cast("bigint")
    # Keys that would fill a range alone: at most size / range_rows of them.
    hot = spans.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > range_rows) if size > range_rows else None
    most = hot.agg(F.max("n")).first()[0] if hot is not None else None
    if most is None:
        probes, spans = (df.select("*", even.alias("part"), F.lit(0).alias("piece")) for df in (probes, spans))
    else:
        cuts = [i / pieces(most, range_rows) for i in range(1, pieces(most, range_rows))]
        bounds = checkpoint(spans.join(hot, "k", "left_semi").groupBy("k").agg(F.array_distinct(F.percentile_approx("s", cuts, 10_000)).alias("bounds")))
        placed = lambda df, at: df.join(bounds, "k", "left").select(*df.columns, "bounds", F.when(F.col("bounds").isNull(), even).otherwise(F.col("h")).alias("part"), F.coalesce(F.size(F.filter("bounds", lambda b: b <= F.col(at))), F.lit(0)).alias("piece"))
        probes, spans = placed(probes, "t").drop("bounds"), placed(spans, "s")
        # What covers the start of a later piece: one span per key and piece.
        later = spans.filter("bounds is not null").select("k", "h", "part", "e", F.col("piece").alias("own"), F.posexplode("bounds").alias("at", "s")).filter((F.col("at") >= F.col("own")) & (F.col("e").isNull() | (F.col("e") > F.col("s"))))
        carried = later.groupBy("k", "h", "s", "part", (F.col("at") + 1).alias("piece")).agg(F.when(~F.bool_or(F.col("e").isNull()), F.max("e")).alias("e"))
        spans = spans.drop("bounds").unionByName(carried)
    # Slices per range, from exact counts; one small row per range.
    sizes = probes.groupBy("part", "piece").count().select("part", "piece", F.greatest(F.lit(1), F.ceil(F.col("count") / slice_rows)).cast("int").alias("slices"))
    sizes = F.broadcast(sizes) if most is None and ranges <= SIZE_ROWS else sizes
    left = probes.join(sizes, ["part", "piece"]).withColumn("slice", F.pmod(F.xxhash64("id", "src", "t"), F.col("slices")).cast("int")).drop("slices")
    right = spans.join(sizes, ["part", "piece"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")

    def orphans(refs: pa.Table, held: pa.Table) -> pa.Table:
        parents = SortedParents(one_array(held.column("k")), held.column("h").to_numpy(), micros(held.column("s"), 0), micros(held.column("e"), FOREVER))
        lost = ~parents.covers(one_array(refs.column("k")), refs.column("h").to_numpy(), micros(refs.column("t"), -FOREVER)) if len(refs) else np.zeros(0, bool)
        return refs.filter(pa.array(lost)).select(["src", "t", "id"])

    grouped = ("part", "piece", "slice")
    lost = left.groupBy(*grouped).cogroup(right.groupBy(*grouped)).applyInArrow(orphans, f"src tinyint, t {'timestamp' if zoned else 'timestamp_ntz'}, id bigint")
    names = F.array(*(F.lit(name) for name, *_ in references))
    return lost.select(names[F.col("src").cast("int")].alias("src_table"), month(F.col("t")).alias("period"), F.col("id").alias("row_id"))


def orphan_report(found: DataFrame) -> DataFrame:
    """Misses per table and period, aggregated on the map side first."""
    return found.groupBy("src_table", "period").agg(F.count(F.lit(1)).alias("orphans"))
