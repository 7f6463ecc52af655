"""Progress of an analysis: phases with their times and what their tasks have done, a listener that isn't called too often, pausing and cancelling."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import Accumulator
from pyspark.sql import SparkSession

#: Phases and the percentages at which they begin.
PHASES = {"validating-zip": 1, "calculating-fingerprints": 10, "searching-candidates": 61, "creating-groups": 94, "preparing-results": 98, "completed": 100}
#: Seconds between two calls of the listener inside a phase.
EVERY = 0.1


class Cancelled(Exception):
    pass


class Progress:
    """Phases run as one job group, so that ``cancel`` (from another thread) ends what runs.

    While a phase runs, a thread asks Spark for the finished tasks of its jobs and tells the listener how far between this phase's
    percentage and the next one's they are; a phase whose jobs aren't all known yet may stand still, and never goes back. ``pause`` holds
    the analysis before its next phase, where all that was found is in a checkpoint; ``resume`` lets it go on.

    ``timings``: seconds by phase, summed over its runs, pauses left out. ``worker_seconds``: seconds that tasks spent in picture kernels,
    by their name, whatever number of tasks ran at once; repeated tasks count again.
    """

    def __init__(self, spark: SparkSession, listener: Callable[[str, int], None] | None = None):
        self.context, self.listener, self.group = spark.sparkContext, listener, f"analysis-{uuid.uuid4().hex}"
        self.timings: dict[str, float] = {}
        self.clocks: dict[str, Accumulator[float]] = {}
        self.cancelled, self.said, self.percent = False, 0.0, 0
        self.going, self.telling = threading.Event(), threading.RLock()
        self.going.set()

    def clock(self, name: str) -> Accumulator[float]:
        """What tasks add the seconds of a kernel to."""
        if name not in self.clocks:
            self.clocks[name] = self.context.accumulator(0.0)
        return self.clocks[name]

    @property
    def worker_seconds(self) -> dict[str, float]:
        return {name: clock.value for name, clock in self.clocks.items()}

    def tell(self, phase: str, percent: int, always: bool = False) -> None:
        with self.telling:
            now = time.monotonic()
            if self.listener and (always or (percent > self.percent and now - self.said >= EVERY)):
                self.said, self.percent = now, percent
                self.listener(phase, percent)

    def tasks(self, seen: set[int]) -> tuple[int, int]:
        """Finished tasks and all tasks of the group's jobs that aren't ``seen``. Stages that a finished job skipped don't count."""
        tracker, done, known = self.context.statusTracker(), 0, 0
        for job in set(tracker.getJobIdsForGroup(self.group)) - seen:
            info = tracker.getJobInfo(job)
            for stage in (tracker.getStageInfo(s) for s in info.stageIds) if info else ():
                if stage:
                    done += stage.numCompletedTasks
                    known += stage.numTasks if info.status == "RUNNING" else stage.numCompletedTasks
        return done, known

    @contextmanager
    def watched(self, name: str) -> Iterator[None]:
        """Tells the listener what the phase's tasks have done until it ends."""
        if not self.listener:
            yield
            return
        first, last = PHASES[name], min((p for p in PHASES.values() if p > PHASES[name]), default=100)
        seen, over = set(self.context.statusTracker().getJobIdsForGroup(self.group)), threading.Event()

        def watch() -> None:
            while not over.wait(EVERY):
                done, known = self.tasks(seen)
                if known:
                    self.tell(name, min(last - 1, first + (last - first) * done // known))

        watcher = threading.Thread(target=watch, daemon=True)
        watcher.start()
        try:
            yield
        finally:
            over.set()
            watcher.join()

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        self.going.wait()
        if self.cancelled:
            raise Cancelled(name)
        self.tell(name, PHASES[name], always=True)
        self.context.setJobGroup(self.group, name, interruptOnCancel=True)
        start = time.monotonic()
        try:
            with self.watched(name):
                yield
        except Exception as e:
            if self.cancelled:
                raise Cancelled(name) from e
            raise
        finally:
            self.timings[name] = self.timings.get(name, 0.0) + time.monotonic() - start
            self.context.setLocalProperty("spark.jobGroup.id", None)

    def pause(self) -> None:
        """The next phase waits; the running one ends first."""
        self.going.clear()

    def resume(self) -> None:
        self.going.set()

    def cancel(self) -> None:
        self.cancelled = True
        self.going.set()
        self.context.cancelJobGroup(self.group)
