"""Rolling totals over trailing periods, days without activity included.

Rows are aggregated to one per entity and day first (on the map side too, so a hot entity moves at most one row per day
and task), brought together by entity in day order, and streamed through Arrow: each entity is crossed with the
calendar days from its first to its last, and the totals of a trailing period are window sums over a fixed number of
preceding rows of that dense grid. A window in SQL over the same grid would sort every dense row again and add up
every frame row by row; here the grid never leaves the task that makes it, and a frame is the difference of two
running sums. State is one entity's days, so memory doesn't depend on how many rows an entity has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dense rows handed on at once.
CHUNK = 100_000


def _dense(names: pa.Array, begin: np.ndarray, first: np.ndarray, lengths: np.ndarray, places: np.ndarray, totals: np.ndarray, periods: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """The grid of some entities (their names, and where each begins in it) with its window sums."""
    size = int(lengths.sum())
    day = np.zeros(size, np.int64)
    day[places] = totals
    total = np.concatenate([[0], np.cumsum(day)])
    row = np.arange(size, dtype=np.int64)
    start = np.repeat(begin, lengths)
    date = (np.repeat(first - begin, lengths) + row).astype(np.int32)
    which = np.repeat(np.arange(len(lengths)), lengths)
    columns = [date, day]
    for n in periods:
        lower = np.maximum(row + 1 - n, start)
        part = total[1:] - total[lower]
        columns += [part, part / (row + 1 - lower)]
    for at in range(0, size, CHUNK):
        piece = slice(at, at + CHUNK)
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(which[piece])), pa.array(columns[0][piece], pa.date32()), *(pa.array(c[piece]) for c in columns[1:])],
            ["entity", "day", "total", *(f"{kind}_{n}" for n in periods for kind in ("total", "average"))],
        )


def rolling_totals(df: DataFrame, entity: str, day: str, value: str | Column, periods: Sequence[int] = (7, 30), *, once: Sequence[str] | None = None) -> DataFrame:
    """Per entity and calendar day from the entity's first to its last: the day's total of `value`, and for each of
    `periods` the total and the average per day over that many days ending with it.

    Columns: `entity`, `day`, ``total`` and per period ``total_<n>``, ``average_<n>``. Before the n-th day the period is
    what there is of it, as in a frame of n - 1 preceding rows. Entities are trimmed. Rows without an entity or a day
    can't be placed and are passed over; a null value adds nothing but its day counts as one of activity, so it can be
    the first or the last. Values are whole numbers. Repeated rows count each, unless `once` names columns: of rows that
    agree in the trimmed entity, the day and these, one counts. An empty table gives no rows; columns beside the named
    ones aren't read.
    """
    amount = F.col(value) if isinstance(value, str) else value
    rows = df.filter(F.col(entity).isNotNull() & F.col(day).isNotNull()).select(F.trim(F.col(entity)).alias("entity"), F.col(day).cast("date").alias("day"), amount.cast("bigint").alias("value"), *(F.col(c).alias(f"once_{i}") for i, c in enumerate(once or ())))
    if once is not None:
        rows = rows.distinct()
    daily = rows.groupBy("entity", "day").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("total"))
    ordered = daily.repartition("entity").sortWithinPartitions("entity", "day")
    periods = tuple(periods)
    schema = "entity string, day date, total bigint" + "".join(f", total_{n} bigint, average_{n} double" for n in periods)

    def densify(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """All rows of some entities, in order."""
        names, days, totals = t.column("entity").combine_chunks(), t.column("day").to_numpy().astype("datetime64[D]").astype(np.int64), t.column("total").to_numpy()
        names = names if isinstance(names, pa.Array) else pa.concat_arrays(names.chunks)
        new = np.concatenate([[0], np.flatnonzero(_changes(names)) + 1])
        last = np.concatenate([new[1:], [len(days)]]) - 1
        first, lengths = days[new], days[last] - days[new] + 1
        group = (np.cumsum(lengths) - lengths) // CHUNK
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(new)]])
        for a, b in zip(bounds[:-1], bounds[1:]):
            begin = np.cumsum(lengths[a:b]) - lengths[a:b]
            rows_of = slice(new[a], last[b - 1] + 1)
            place = np.repeat(begin - first[a:b], last[a:b] - new[a:b] + 1) + days[rows_of]
            yield from _dense(names.take(pa.array(new[a:b])), begin, first[a:b], lengths[a:b], place, totals[rows_of], periods)

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the entity that the last batch ended with may go on in the next
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = np.flatnonzero(_changes(batch.column("entity")))
            if held and held[-1].column("entity")[-1] != batch.column("entity")[0]:
                yield from densify(pa.Table.from_batches(held))
                held = []
            if len(ends):
                cut = int(ends[-1]) + 1
                yield from densify(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, batch = [], batch.slice(cut)
            held.append(batch)
        if held:
            yield from densify(pa.Table.from_batches(held))

    return ordered.mapInArrow(roll, schema).withColumnsRenamed({"entity": entity, "day": day})


def _changes(names: pa.Array) -> np.ndarray:
    """Where element i differs from element i + 1."""
    import pyarrow.compute as pc

    return np.asarray(pc.not_equal(names[:-1], names[1:]), bool) if len(names) > 1 else np.zeros(0, bool)
