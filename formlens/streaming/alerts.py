"""The first overspend of a user's day, by keyed state with timers."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from formlens.operators.metering import metered

ALERT = "user_key string, day date, credit_tokens long"

#: The state store that keyed state with timers needs.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class FirstOverspend(StatefulProcessor):
    """Per user: tokens of each open UTC day and whether its alert is out; a timer drops a day once the watermark is past its midnight."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day date", "tokens long, alerted boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        added: dict = {}
        for r in rows:
            added[r.day] = added.get(r.day, 0) + r.tokens
        for day, tokens in sorted(added.items()):
            known = self.days.containsKey((day,))
            before, alerted = self.days.getValue((day,)) if known else (0, False)
            if not known:
                midnight = datetime(day.year, day.month, day.day, tzinfo=UTC) + timedelta(days=1)
                self.handle.registerTimer(int(midnight.timestamp() * 1000))
            over = before + tokens > self.limit
            self.days.updateValue((day,), (before + tokens, over))
            if over and not alerted:
                yield Row(user_key=key[0], day=day, credit_tokens=self.limit)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        day = datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, UTC).date() - timedelta(days=1)
        self.days.removeKey((day,))
        return iter([])

    def close(self) -> None:
        pass


def overspend_alerts(calls: DataFrame, delay: str = "1 day", credits: int = 20) -> DataFrame:
    """One row for each user and UTC day whose metered tokens pass the day's credit: user_key, day, credit_tokens.

    Which days alert depends on their calls, not on their order. Calls later than ``delay`` are left out, so the
    state holds the open days only. The session needs the settings ``ROCKSDB``.
    """
    rows = metered(calls).filter("ts is not null").withWatermark("ts", delay).select("user_key", "ts", F.to_date("ts").alias("day"), F.col("tokens").cast("long").alias("tokens"))
    return rows.groupBy("user_key").transformWithState(FirstOverspend(credits * 1000), ALERT, "Append", "EventTime")
