"""Latest preferred row per key, kept up by a running stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _better(a: tuple, b: tuple | None) -> bool:
    return b is None or a > b


def stream_compact(stream: DataFrame, key: str, ok: str, at: str, value: str) -> DataFrame:
    """``(key, ok, at, value)`` whenever a better row of a key arrives.

    A row is better if it is ok and the kept one is not, or if both agree and it
    is later; equal rows keep the larger value. State holds one row per key.
    Rows with a null key form a key of their own. Run it in update mode.
    """
    kinds = dict(stream.dtypes)
    schema = f"{key} {kinds[key]}, ok boolean, at bigint, value {kinds[value]}"

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        before = best
        for batch in batches:
            for o, t, v in zip(batch[ok], batch[at], batch[value]):
                row = (bool(o), int(t), v)
                if _better(row, best):
                    best = row
        if best != before and best is not None:
            state.update(best)
            yield pd.DataFrame([(group[0], *best)], columns=[key, "ok", "at", "value"])

    return stream.groupBy(key).applyInPandasWithState(run, schema, f"ok boolean, at bigint, value {kinds[value]}", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, at: str, by: str, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts by tumbling window; rows later than ``late`` are left to the next run."""
    from pyspark.sql import functions as F

    return stream.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
