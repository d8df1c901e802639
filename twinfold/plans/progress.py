"""How far a scan is, while it runs.

Tasks add what they have done to accumulators, which the driver sees as each task ends; a thread tells them at intervals.
A task that runs again after a lost executor adds its share again, so that these are for people to watch; the counters that
a scan returns are taken from the rows themselves.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import SparkSession

COUNTED = ("archives_done", "members_done", "bytes_done", "targets_done")


class Progress:
    """``told`` is called with ``state()`` every so many seconds, and once at the end; use it as a context manager."""

    def __init__(self, spark: SparkSession, told: Callable[[dict], None] | None = None, every: float = 1.0):
        self.counts = {name: spark.sparkContext.accumulator(0) for name in COUNTED}
        self.told, self.every, self.phase, self.archives_found = told, every, "listing", None
        self._over, self._thread = threading.Event(), None

    def state(self) -> dict:
        """phase, archives_found (None before they are listed), what is done, and the percentage of archives."""
        done = {name: a.value for name, a in self.counts.items()}
        found = self.archives_found
        return {"phase": self.phase, "archives_found": found, **done, "percent": None if found is None else 100.0 * min(done["archives_done"], found) / found if found else 100.0}

    def begin(self, phase: str, archives_found: int | None = None) -> None:
        self.phase = phase
        self.archives_found = archives_found if archives_found is not None else self.archives_found

    def __enter__(self) -> Progress:
        if self.told:
            self._thread = threading.Thread(target=self._tell, daemon=True)
            self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._over.set()
        if self._thread:
            self._thread.join()
            self.told(self.state())

    def _tell(self) -> None:
        while not self._over.wait(self.every):
            self.told(self.state())
