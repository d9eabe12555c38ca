"""Work that runs: rows that its tasks have written so far, and an end to it on demand."""

from __future__ import annotations

import contextlib
import threading
from collections.abc import Iterator

from pyspark.sql import SparkSession


@contextlib.contextmanager
def tagged(spark: SparkSession, *tags: str) -> Iterator[None]:
    """Jobs that this thread starts in the block carry the tags."""
    for tag in tags:
        spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        for tag in tags:
            spark.sparkContext.removeJobTag(tag)


def rows_in_flight(spark: SparkSession, tag: str) -> int:
    """Rows written by the tasks of running jobs with the tag, as far as executors have told (at each heartbeat and task's end).

    Before a job writes, what its stages have read stands for it, so that a long shuffle shows as well.
    """
    store, total = spark._jsc.sc().statusStore(), 0
    running = spark._jvm.java.util.ArrayList()
    running.add(spark._jvm.org.apache.spark.JobExecutionStatus.RUNNING)
    jobs = store.jobsList(running)
    for i in range(jobs.size()):
        job = jobs.apply(i)
        if not job.jobTags().contains(tag):
            continue
        written = 0
        stages = job.stageIds()
        for j in range(stages.size()):
            with contextlib.suppress(Exception):  # a stage that was skipped or has not begun is not known yet
                written += store.lastStageAttempt(stages.apply(j)).outputRecords()
        total += written
    return total


class Stop:
    """When ``told`` is set, running work gets ``grace`` seconds to end and is then interrupted, as often as more begins."""

    def __init__(self, spark: SparkSession, tag: str, told: threading.Event, grace: float):
        self.spark, self.tag, self.told, self.grace = spark, tag, told, grace
        self.done = threading.Event()
        self.thread = threading.Thread(target=self._watch, daemon=True)

    def _watch(self) -> None:
        while not self.done.is_set():
            if self.told.wait(0.1):
                if self.done.wait(self.grace):
                    return
                while not self.done.wait(0.2):
                    self.spark.sparkContext.cancelJobsWithTag(self.tag)
                return

    def __enter__(self) -> Stop:
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.done.set()
        self.thread.join()
