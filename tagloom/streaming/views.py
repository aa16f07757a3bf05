"""Views of packages as a stream: a view may arrive at any time and in any order, and still stands in its place."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tagloom.operators.merging import view_lines

SCHEMA = "package_id long, view long, text string, seen_at timestamp"
_OUT = "package_id long, text string, lines long, closed boolean"
#: The keyed state needs this provider: set it as spark.sql.streaming.stateStore.providerClass before the stream starts.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Package(StatefulProcessor):
    """The first line of each kind that a package has shown so far, and a timer that closes the package once no view has come for a while."""

    def __init__(self, quiet_ms: int):
        self.quiet = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getMapState("lines", "k string", "view long, place long, line string")
        self.closes = handle.getValueState("closes", "at long")

    def _text(self, key: tuple, closed: bool) -> pd.DataFrame:
        held = sorted(tuple(v) for _, v in self.lines.iterator())
        return pd.DataFrame({"package_id": [key[0]], "text": ["\n".join(x[2] for x in held)], "lines": [len(held)], "closed": [closed]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  named by the interface
        latest = 0
        for batch in rows:
            latest = max(latest, int(batch["seen_at"].max().timestamp() * 1000))
            first = batch.sort_values(["view", "at"]).drop_duplicates("k")
            for k, view, place, line in first[["k", "view", "at", "line"]].itertuples(index=False):
                known = self.lines.getValue((k,)) if self.lines.containsKey((k,)) else None
                if known is None or (view, place) < (known[0], known[1]):
                    self.lines.updateValue((k,), (int(view), int(place), line))
        before = self.closes.get()[0] if self.closes.exists() else 0
        if latest + self.quiet > before:
            if before:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(latest + self.quiet)
            self.closes.update((latest + self.quiet,))
        yield self._text(key, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._text(key, True)
        self.lines.clear()
        self.closes.clear()

    def close(self) -> None:
        pass


def merged_as_they_come(views: DataFrame, delay: str = "10 minutes", quiet: datetime.timedelta = datetime.timedelta(hours=1)) -> DataFrame:
    """package_id, text, lines and closed of packages whenever views (a stream of SCHEMA) of them have come, in update mode: of a package the last row holds what merge_views gives for all its views.

    Only the first line of each kind is kept as state. Once the watermark (delay behind the latest view) passes the time `quiet` after a package's last view, it is sent as closed and forgotten; a view that
    comes later begins a new package of that id. Views without any line send nothing.
    """
    rows = view_lines(views.withWatermark("seen_at", delay)).where("package_id is not null and view is not null").select("package_id", F.col("view").cast("long").alias("view"), F.col("at").cast("long").alias("at"), "line", "k", "seen_at")
    quiet_ms = int(quiet.total_seconds() * 1000)
    return rows.groupBy("package_id").transformWithStateInPandas(statefulProcessor=_Package(quiet_ms), outputStructType=_OUT, outputMode="Update", timeMode="EventTime")
