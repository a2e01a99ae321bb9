"""Expectation and confidence over streams of independent uncertain rows.

Expected sums and counts are sums, and the confidence of independent rows is 1 - Π(1 - p): all of them combine, so a
watermarked window is enough state. The same call works on a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyworlds.functions.conditions import disjunction, probability


def windowed_confidence(rows: DataFrame, time: str, chance: str, width: str, *, by: Sequence[str] = (), value: str | None = None, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Per time window and group: ``start, end``, the confidence that a row exists (``conf``), the expected number of rows
    (``ecount``) and, with a `value`, its expected sum (``esum``). `late` is the watermark on a stream: rows that come
    later than that after the newest are left out. Rows with a null time are in no window; a null chance adds nothing."""
    if late is not None:
        rows = rows.withWatermark(time, late)
    p = F.coalesce(probability(F.col(chance)), F.lit(0.0))
    parts = [disjunction(p).alias("conf"), F.sum(p).alias("ecount")]
    if value is not None:
        parts.append(F.sum(F.col(value) * p).alias("esum"))
    framed = rows.groupBy(F.window(time, width, slide or width), *by).agg(*parts)
    return framed.select("window.start", "window.end", *by, *[c for c in framed.columns if c not in ("window", *by)])
