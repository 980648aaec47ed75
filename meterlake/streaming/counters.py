"""Counters that run on, told apart on a stream: the state of a session is its last totals, so no batch rereads what came before."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.sequences import COUNTERS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
STATE = "at long, running boolean, " + ", ".join(f"{c} long" for c in COUNTERS)


class Deltas(StatefulProcessor):
    """Rows of one session in their order: counts as they are until totals begin, then what a row has more than the last total."""

    def __init__(self, columns: list[str], order: str, kind: str, idle_ms: int | None):
        self.columns, self.order, self.kind, self.idle_ms = columns, order, kind, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", STATE, ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable", ignore_index=True)
        at, running, *total = self.last.get() if self.last.exists() else (None, False, 0, 0, 0, 0)
        counts = batch[COUNTERS].astype("Int64").fillna(0).astype("int64").to_numpy()
        orders, kinds = batch[self.order].tolist(), batch[self.kind].fillna("").astype(str).tolist()
        keep = []
        for i, row in enumerate(counts):
            if at is not None and orders[i] <= at:
                continue  # came before
            at = orders[i]
            keep.append(i)
            into, out = int(row[0]), int(row[1])
            running = running or ("token" in kinds[i] and max(into, out) > 0)
            if running and not (into < total[0] and out < total[1]):
                more = [max(0, int(c) - t) for c, t in zip(row, total, strict=True)]
                total = [int(c) for c in row]
                counts[i] = more
        self.last.update((at, running, *total))
        told = batch.loc[keep].copy()
        told[COUNTERS] = counts[keep]
        yield told[self.columns]

    def close(self) -> None:
        pass


def stream_deltas(rows: DataFrame, key: str, order: str, kind: str = "kind", idle_hours: int | None = None) -> DataFrame:
    """Like ``operators.sequences.counter_deltas``, for a stream (or a batch): (key, order, kind, counters, other columns).

    A session's rows arrive in order, as a file grows; a row whose order isn't
    after the last one is a repeat and left out. With ``idle_hours``, a session
    without rows for so long is forgotten, and begins anew if it goes on; such a stream
    looks for expired sessions in every trigger, so it is one that runs for good,
    not one over what is available now. A task holds one
    session's rows of one batch. Columns are those of ``rows``; unknown counters are 0.
    """
    rows.sparkSession.conf.set(PROVIDER, ROCKSDB)
    shaped = rows.withColumns({c: F.col(c).cast("long") for c in COUNTERS} | {order: F.col(order).cast("long")})
    processor = Deltas(shaped.columns, order, kind, idle_hours * 3_600_000 if idle_hours else None)
    return shaped.groupBy(key).transformWithStateInPandas(processor, outputStructType=shaped.schema, outputMode="Append", timeMode="ProcessingTime" if idle_hours else "None")
