"""Progress of running phases, pausing, cancelling."""

from __future__ import annotations

import threading
import time

import pytest

from pixkin.plans.progress import PHASES, Cancelled, Progress


def slow(spark, tasks, seconds, clock=None):
    """Counts the rows of ``tasks`` tasks that take ``seconds`` each."""

    def run(batches):
        for pdf in batches:
            time.sleep(seconds)
            if clock is not None:
                clock.add(seconds)
            yield pdf

    return spark.range(0, tasks, 1, tasks).mapInPandas(run, "id long").count()


def test_tasks_move_the_percentage(spark):
    told = []
    progress = Progress(spark, lambda phase, percent: told.append((phase, percent)))
    slow(spark, 4, 0)  # another's job doesn't count
    with progress.phase("calculating-fingerprints"):
        assert slow(spark, 48, 0.15, progress.clock("pictures")) == 48
    with progress.phase("searching-candidates"):
        slow(spark, 24, 0.15)
    percents = [p for _, p in told]
    assert percents == sorted(set(percents)) and percents[0] == 10 and 61 in percents
    inside = [p for phase, p in told if phase == "calculating-fingerprints"]
    assert len(inside) > 2 and max(inside) < 61 and all(61 <= p < 94 for phase, p in told if phase == "searching-candidates")
    assert abs(progress.worker_seconds["pictures"] - 48 * 0.15) < 1e-6 and 0 < progress.timings["calculating-fingerprints"]


def phases_of(progress, done):
    try:
        for name in list(PHASES)[:3]:
            with progress.phase(name):
                done.append(name)
    except Cancelled:
        done.append("cancelled")


@pytest.mark.parametrize("ended", ["resume", "cancel"])
def test_pause_holds_before_the_next_phase(spark, ended):
    progress, done = Progress(spark), []
    progress.pause()
    runner = threading.Thread(target=phases_of, args=(progress, done))
    runner.start()
    time.sleep(0.3)
    assert done == [] and runner.is_alive()
    getattr(progress, ended)()
    runner.join(20)
    assert done == (list(PHASES)[:3] if ended == "resume" else ["cancelled"])
    assert sum(progress.timings.values()) < 0.3  # the pause isn't a phase's time


def test_cancel_ends_what_runs(spark):
    progress, caught = Progress(spark, lambda phase, percent: None), []

    def run():
        try:
            with progress.phase("calculating-fingerprints"):
                slow(spark, 16, 30)
        except Cancelled:
            caught.append(True)

    runner = threading.Thread(target=run)
    runner.start()
    time.sleep(2)
    progress.cancel()
    runner.join(25)
    assert caught == [True]
