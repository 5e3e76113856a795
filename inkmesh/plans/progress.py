"""Progress and cancelling of runs: every job of a run carries its tag, and its staged tables go with it when it breaks off."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from inkmesh.plans import staging

#: One row a stage of a job of the run.
PROGRESS = "job int, status string, stage int, name string, tasks int, done int, active int, failed int"


@contextmanager
def tagged(spark: SparkSession, tag: str | None = None, wait: float = 30.0) -> Iterator[str]:
    """A run: jobs begun inside, in this thread, carry the tag (a new one, if none is given).

    If the block raises, cancelled or not, its jobs are stopped, the tables that it staged are deleted once its stages have
    ended (after `wait` seconds at most; see staging.delete for late tasks) and the error goes on. Tables of a run that ends well stay readable until the
    application ends. Runs may stand inside runs.
    """
    tag = tag or f"inkmesh-{uuid.uuid4().hex}"
    context = spark.sparkContext
    context.addJobTag(tag)
    run = staging.open_run(tag)
    try:
        yield tag
    except BaseException:
        context.cancelJobsWithTag(tag)
        until = time.monotonic() + wait
        while _busy(spark, tag) and time.monotonic() < until:
            time.sleep(0.05)
        staging.delete(spark, run.paths)
        raise
    finally:
        staging.close_run(run)
        context.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Stop the run of this tag, from any thread: its jobs at once, and, if it is between two jobs, at its next staged table."""
    staging.forbid(tag)
    spark.sparkContext.cancelJobsWithTag(tag)


def _stages(spark: SparkSession, tag: str) -> list[tuple]:
    tracker, rows = spark.sparkContext.statusTracker(), []
    for job in sorted(spark.sparkContext._jsc.sc().statusTracker().getJobIdsForTag(tag)):
        info = tracker.getJobInfo(job)
        for stage in sorted(info.stageIds) if info else ():
            s = tracker.getStageInfo(stage)
            if s:
                rows.append((job, str(info.status), stage, s.name, s.numTasks, s.numCompletedTasks, s.numActiveTasks, s.numFailedTasks))
    return rows


def _busy(spark: SparkSession, tag: str) -> bool:
    return any(row[1] == "RUNNING" or row[6] for row in _stages(spark, tag))


def progress(spark: SparkSession, tag: str) -> DataFrame:
    """job, status, stage, name, tasks, done, active, failed of the run as it stands now, from any thread.

    Stages that adaptive execution or an earlier job made needless have no tasks done. Spark remembers as many jobs as
    spark.ui.retainedJobs says, so the table stays small.
    """
    return spark.createDataFrame(_stages(spark, tag), PROGRESS)
