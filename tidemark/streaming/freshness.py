"""Freshness of feeds as a stream: a state change is a row, and silence alone makes a feed stale.

Each feed has a timer at its last success plus its limit; a success moves it, and when it fires the feed
goes stale though nothing has arrived. State and timers live in the checkpoint, so that a restarted stream goes on with
them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: A store that keeps timers. Needed by every stream with timers.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "feed string, state string, at timestamp, last_success timestamp"
_STATE = "last long, limit long, stale boolean"


class Freshness(StatefulProcessor):
    """Of one feed: the newest success and limit in milliseconds, and whether it has been reported stale."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("feed", _STATE)

    def _rearm(self, due: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(due)

    @staticmethod
    def _row(feed: str, state: str, at: int, last: int) -> pd.DataFrame:
        stamp = lambda ms: pd.Timestamp(ms, unit="ms")
        return pd.DataFrame([(feed, state, stamp(at), stamp(last))], columns=[c.split()[0] for c in CHANGES.split(", ")])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        arrived = pd.concat(list(rows))
        newest = arrived.loc[arrived["success_ms"].idxmax()]
        last, limit, stale = self.state.get() if self.state.exists() else (-1, 0, None)
        if newest["success_ms"] <= last:
            return  # an old success says nothing new
        last, limit = int(newest["success_ms"]), int(newest["limit_ms"])
        late = now >= last + limit
        if late != stale:
            yield self._row(key[0], "stale" if late else "fresh", now, last)
        self.state.update((last, limit, late))
        if not late:
            self._rearm(last + limit)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, limit, stale = self.state.get()
        if not stale:
            self.state.update((last, limit, True))
            yield self._row(key[0], "stale", timerValues.getCurrentProcessingTimeInMs(), last)

    def close(self) -> None:
        pass


def freshness_changes(successes: DataFrame) -> DataFrame:
    """feed, state (fresh or stale), at, last_success: a row for each change.

    successes (feed, success_ms, limit_ms) is a stream of successful ingests and the feeds' limits. A feed is
    stale from its limit after the newest success, by the clock of the stream, whose trigger has to go on where nothing
    arrives. A session needs spark.sql.streaming.stateStore.providerClass = STATE_STORE. One state for each feed.
    """
    return successes.groupBy("feed").transformWithStateInPandas(Freshness(), outputStructType=CHANGES, outputMode="update", timeMode="processingTime")
