"""Staged tables: cut lineage by writing a table where every executor can read it."""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

_DIR = "spark.checkpoint.dir"


class Cancelled(RuntimeError):
    """The run was cancelled between two of its jobs."""


@dataclass
class Run:
    """A tagged run and the folders that it has staged."""

    tag: str
    paths: list[str] = field(default_factory=list)


_runs: ContextVar[tuple[Run, ...]] = ContextVar("runs", default=())
_forbidden: set[str] = set()


def open_run(tag: str) -> Run:
    run = Run(tag)
    _runs.set((*_runs.get(), run))
    return run


def close_run(run: Run) -> None:
    _runs.set(tuple(r for r in _runs.get() if r is not run))
    _forbidden.discard(run.tag)


def forbid(tag: str) -> None:
    """Let no open run of this tag stage another table."""
    _forbidden.add(tag)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; on one machine (a local master) a temporary one where it names none."""
    path = spark.conf.get(_DIR, None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError(f"set {_DIR} to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="inkmesh-")
        spark.conf.set(_DIR, path)
    return path.rstrip("/")


def _forget_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver's file system delete the folder when the application ends: until then plans may still read it."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(place)


def delete(spark: SparkSession, paths: list[str], quiet: float = 1.0, wait: float = 30.0) -> None:
    """Delete staged folders, until none has come back for `quiet` seconds; those that are gone already are passed over.

    A task that was told to stop may go on for a moment and make its folder anew. One that does so after `wait` seconds
    leaves it until the application ends.
    """
    places = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    systems = [p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()) for p in places]
    for fs, place in zip(systems, places):
        fs.mkdirs(place)  # only what exists can be marked
        fs.deleteOnExit(place)
    now = time.monotonic()
    end, calm = now + wait, now + quiet
    while places and now < min(calm, end):
        for fs, place in zip(systems, places):
            if fs.exists(place):
                fs.delete(place, True)
                calm = time.monotonic() + quiet
        time.sleep(0.1)
        now = time.monotonic()


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet below the shared folder and read it back.

    The result no longer depends on earlier shuffle files, so a lost executor costs the tasks it ran and no more.
    Parquet, unlike an RDD checkpoint, stays columnar and compressed and gives the optimizer real sizes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkmesh-{name}-{uuid.uuid4().hex}"
    for run in _runs.get():
        if run.tag in _forbidden:
            raise Cancelled(f"run {run.tag} was cancelled")
        run.paths.append(path)
    df.write.parquet(path)
    _forget_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new, empty folder below the shared one, deleted when the application ends."""
    path = f"{shared_dir(spark)}/inkmesh-{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(place)
    _forget_at_exit(spark, path)
    return path
