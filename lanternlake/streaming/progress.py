"""The progress of a build: a share of its work from the ends of its tasks."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Progress:
    """Reports the progress of the Spark jobs that run inside ``with`` on the calling thread.

    A build is a number of ``steps``; each call of ``step`` ends one. Within a step the share of finished tasks of the
    jobs started so far counts, so that a figure never falls and is below the step's end until the step has
    ended; it is 1 at the end of the block, and stays where it was if the block fails. Tasks are counted by stage from
    Spark's status tracker every ``every`` seconds, and ``report`` gets each new figure.
    """

    def __init__(self, spark: SparkSession, report: Callable[[float], None], steps: int = 1, every: float = 0.1):
        self.context, self.report, self.steps, self.every = spark.sparkContext, report, steps, every
        self.group, self.done, self.last = uuid.uuid4().hex, 0, -1.0
        self.seen: dict[int, tuple[int, int]] = {}
        self.lock, self.stop = threading.Lock(), threading.Event()

    def _tell(self, figure: float) -> None:
        with self.lock:
            if figure > self.last:
                self.last = figure
                self.report(figure)

    def _share(self) -> float:
        tracker = self.context.statusTracker()
        for job in tracker.getJobIdsForGroup(self.group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                if found := tracker.getStageInfo(stage):
                    # A stage that has left the tracker keeps its last count; a skipped one has none.
                    self.seen[stage] = (max(found.numCompletedTasks, self.seen.get(stage, (0, 0))[0]), found.numTasks)
        total = sum(n for _, n in self.seen.values())
        return sum(n for n, _ in self.seen.values()) / total if total else 0.0

    def _watch(self) -> None:
        while not self.stop.wait(self.every):
            # What later jobs of the step bring is unknown, so the tasks so far fill it up to 95 %.
            self._tell((self.done + 0.95 * self._share()) / self.steps)

    def step(self) -> None:
        """One step is over; jobs from here on belong to the next."""
        self.done = min(self.done + 1, self.steps)
        self.seen.clear()
        self.group = uuid.uuid4().hex
        self.context.setJobGroup(self.group, "build")
        self._tell(self.done / self.steps)

    def __enter__(self) -> Progress:
        self.context.setJobGroup(self.group, "build")
        self._tell(0.0)
        self.thread = threading.Thread(target=self._watch, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, kind, error, trace) -> None:
        self.stop.set()
        self.thread.join()
        self.context.setLocalProperty("spark.jobGroup.id", None)
        if kind is None:
            self._tell(1.0)
