"""A line that rewrites itself while Spark works, on terminals only."""

from __future__ import annotations

import sys
import threading
import time

from pyspark.sql import SparkSession

INTERVAL = 0.15


class Progress:
    """Within it, a line with the seconds so far and the tasks done of the active stages; callback(seconds, done, tasks)
    is told the same. Nothing is drawn where `out` isn't a terminal. The line is erased at the end."""

    def __init__(self, spark: SparkSession, out=sys.stdout, callback=None, interval: float = INTERVAL):
        self.status, self.out, self.callback, self.interval = spark.sparkContext.statusTracker(), out, callback, interval
        self.drawn = out.isatty()
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)

    def _counts(self) -> tuple[int, int]:
        found = [self.status.getStageInfo(s) for s in self.status.getActiveStageIds()]
        return sum(i.numCompletedTasks for i in found if i), sum(i.numTasks for i in found if i)

    def _run(self) -> None:
        began = time.time()
        while not self._stop.wait(self.interval):
            done, tasks = self._counts()
            seconds = time.time() - began
            if self.callback:
                self.callback(seconds, done, tasks)
            if self.drawn:
                self.out.write(f"\r\x1b[Kindexing: {seconds:.0f} s, {done} of {tasks} tasks")
                self.out.flush()

    def __enter__(self) -> "Progress":
        if self.drawn or self.callback:
            self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._stop.set()
        if self._thread.is_alive():
            self._thread.join()
        if self.drawn:
            self.out.write("\r\x1b[K")
            self.out.flush()
