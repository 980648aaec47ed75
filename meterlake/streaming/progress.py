"""How far streams have come: revisions and rows of each query, kept by a listener."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


@dataclass
class Progress:
    """``revision`` rises by one with each finished batch that had rows; ``batches`` counts all of them."""

    name: str
    revision: int = 0
    batches: int = 0
    rows: int = 0
    running: bool = True
    error: str | None = None
    updated: datetime | None = None
    _seen: set[tuple[str, int]] = field(default_factory=set, repr=False)


class Revisions(StreamingQueryListener):
    """Keeps the progress of all queries of a session by name, and tells ``on_change`` of each change.

    A batch counts once, even if its report comes again; a query that is started
    anew under its name goes on counting.
    """

    def __init__(self, on_change: Callable[[Progress], None] | None = None):
        super().__init__()
        self._all: dict[str, Progress] = {}
        self._names: dict[str, str] = {}
        self._lock = threading.Lock()
        self._on_change = on_change

    def _changed(self, p: Progress) -> None:
        p.updated = datetime.now(timezone.utc)
        if self._on_change:
            self._on_change(p)

    def onQueryStarted(self, event) -> None:
        with self._lock:
            name = event.name or str(event.id)
            self._names[str(event.id)] = name
            p = self._all.setdefault(name, Progress(name))
            p.running, p.error = True, None
            self._changed(p)

    def onQueryProgress(self, event) -> None:
        report = event.progress
        with self._lock:
            name = report.name or self._names.get(str(report.id), str(report.id))
            p = self._all.setdefault(name, Progress(name))
            batch = (str(report.runId), int(report.batchId))
            if batch in p._seen or int(report.numInputRows) == 0 and report.batchDuration is None:
                return
            p._seen = {b for b in p._seen if b[0] == batch[0]} | {batch} if len(p._seen) < 1024 else {batch}
            p.batches += 1
            if int(report.numInputRows):
                p.revision += 1
                p.rows += int(report.numInputRows)
            self._changed(p)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            p = self._all.get(self._names.get(str(event.id), str(event.id)))
            if p:
                p.running, p.error = False, event.exception
                self._changed(p)

    def of(self, name: str) -> Progress | None:
        return self._all.get(name)

    def all(self) -> list[Progress]:
        return sorted(self._all.values(), key=lambda p: p.name)


def watch(spark: SparkSession, on_change: Callable[[Progress], None] | None = None) -> Revisions:
    """A listener on all streams of a session; ``spark.streams.removeListener`` ends it."""
    listener = Revisions(on_change)
    spark.streams.addListener(listener)
    return listener
