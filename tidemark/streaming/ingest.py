"""Polling ingestion as Structured Streaming: landed files to idempotent appends.

Late versions are new rows and win for later as_of instants; so there is no watermark on this path, and
nothing is dropped for being late. Overlapping re-reads are harmless, because keys that exist are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.writes import Store, append_new


def landed_stream(spark: SparkSession, path: str) -> DataFrame:
    """New whole files as path, payload and received_at."""
    return (
        spark.readStream.format("text").option("wholetext", "true").load(path)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"), F.current_timestamp().alias("received_at"))
    )


def ingest(payloads: DataFrame, parse: Callable[[DataFrame], DataFrame], store: Store, table: str, key: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Parse what has landed, append the new keys, and stop; a failed batch is repeated without doubling rows."""

    def write(batch: DataFrame, _: int) -> None:
        append_new(store, table, parse(batch), key)

    return payloads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, time: str, width: str, late: str, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Windowed aggregates for derived streams that may close: a watermark bounds their state."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(*aggregates)


def sessions(events: DataFrame, time: str, gap: str, late: str, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(*aggregates)


WEALTH = "test_id string, week int, wealth_index double, wealth_quant double, wealth_mirror double, status string"
_STATE = "a array<double>, b array<double>, m array<double>, week int, status string"


def sequential_stream(weeks: DataFrame) -> DataFrame:
    """The weekly test as a stateful operator over (test_id, week, vs_index, vs_quant).

    State is six numbers for each of three bets; a terminal status absorbs. Weeks of one batch are taken in order.
    """
    from tidemark.operators.sequential import CLIP, FIRST_WEEK, FRESH, LAST_WEEK, THRESHOLD
    from tidemark.operators.sequential import bet as _bet

    def bet(state: list[float], y: float) -> list[float]:
        return [float(x) for x in _bet(state, y)]

    def run(key, frames, state):
        a, b, m, week, status = state.get if state.exists else (FRESH, FRESH, FRESH, 0, "RUNNING")
        a, b, m = list(a), list(b), list(m)
        out = []
        for r in pd.concat(list(frames)).sort_values("week").itertuples():
            if status != "RUNNING":
                break
            y, q = (min(CLIP, max(-CLIP, x)) / CLIP for x in (r.vs_index, r.vs_quant))
            a, b, m, week = bet(a, y), bet(b, q), bet(m, -q), week + 1
            if week >= FIRST_WEEK:
                passed, failed = a[1] >= THRESHOLD and b[1] >= THRESHOLD, m[1] >= THRESHOLD
                status = "INCONCLUSIVE" if passed and failed or (week == LAST_WEEK and not passed and not failed) else "PASS" if passed else "FAIL" if failed else status
            out.append((key[0], week, a[1], b[1], m[1], status))
        state.update((a, b, m, week, status))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in WEALTH.split(", ")])

    return weeks.groupBy("test_id").applyInPandasWithState(run, WEALTH, _STATE, "append", "NoTimeout")
