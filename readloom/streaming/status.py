"""Status of runs as JSON lines: run_info, phase, progress and final; and a listener for streams."""

from __future__ import annotations

import json
import os
import threading
import time
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def _now() -> int:
    return int(time.time() * 1000)


def measured(reads: DataFrame) -> tuple[DataFrame, Observation]:
    """reads, and what they came to once they have been written: records and bases, without a pass of their own."""
    seen = Observation("reads")
    return reads.observe(seen, F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("bases")), seen


class StatusLines:
    """Appends status lines to a file; progress is written when it changed, once a cadence at most."""

    def __init__(self, path: str, tool: str, cadence: float = 1.0, **info: Any):
        self._file = open(path, "w", encoding="utf-8")  # noqa: SIM115
        self._lock, self._began = threading.Lock(), time.monotonic()
        self._cadence, self._last, self._shown = cadence, -cadence, None
        self._write("run_info", tool=tool, pid=os.getpid(), **info)

    def _write(self, kind: str, **fields: Any) -> None:
        elapsed = round(time.monotonic() - self._began, 3)
        with self._lock:
            self._file.write(json.dumps({"event": kind, "time_ms": _now(), "elapsed_s": elapsed, **fields}) + "\n")
            self._file.flush()

    def phase(self, name: str, **fields: Any) -> None:
        self._write("phase", phase=name, **fields)

    def progress(self, **metrics: Any) -> bool:
        now = time.monotonic()
        if metrics == self._shown or now - self._last < self._cadence:
            return False
        self._last, self._shown = now, metrics
        self._write("progress", metrics=metrics)
        return True

    def final(self, status: str = "ok", **metrics: Any) -> None:
        self._write("final", status=status, metrics=metrics)
        self._file.close()

    def __enter__(self) -> StatusLines:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if not self._file.closed:
            self.final("error" if error else "ok", **({"message": str(error)} if error else {}))


class StreamStatus(StreamingQueryListener):
    """Writes the progress of streaming queries to status lines."""

    def __init__(self, lines: StatusLines):
        self.lines = lines

    def onQueryStarted(self, event) -> None:
        self.lines.phase("started", query=str(event.id))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.lines.progress(query=str(p.id), batch=p.batchId, records=p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.lines.phase("terminated", query=str(event.id), error=event.exception)
