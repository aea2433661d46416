"""Where long plans keep what they write between steps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_OWNED: set[str] = set()
# Whether the shuffle files of a query go when it ends, and not when the driver happens to collect its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names; only a local session may fall back to a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is not None:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="vacantia-")
    return _LOCAL[app]


def _application_folder(spark: SparkSession) -> str:
    """The folder of this application's tables; it goes when the session's JVM ends."""
    app = spark.sparkContext.applicationId
    folder = f"{shared_folder(spark)}/vacantia-{app}"
    if app not in _OWNED:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _OWNED.add(app)
    return folder


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for tables of this application; it goes when the application ends."""
    return f"{_application_folder(spark)}/{name}-{uuid.uuid4().hex}"


class Passing:
    """What a step writes for itself: it goes when nothing reads it any more."""

    def __init__(self, spark: SparkSession, around: Passing | None) -> None:
        self.spark, self.around, self.paths = spark, around, []

    def kept(self, df: DataFrame) -> DataFrame:
        """``written``, for the step around this one."""
        token = _STEP.set(self.around)
        try:
            return written(df)
        finally:
            _STEP.reset(token)

    def clear(self) -> None:
        """Delete what the step has written so far; no frame that reads it may be used after this."""
        while self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_STEP: ContextVar[Passing | None] = ContextVar("step", default=None)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Passing]:
    """A step whose tables go at its end, so that disk holds what is still read. What must stay is ``kept``.

    A step that fails leaves its tables to the end of the application.
    """
    step = Passing(spark, _STEP.get())
    token = _STEP.set(step)
    try:
        yield step
    finally:
        _STEP.reset(token)
    step.clear()


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Writes within leave no shuffle files behind: what they wrote is read again, and never the plan that made it."""
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_TIDY)
        else:
            spark.conf.set(_TIDY, before)


def written(df: DataFrame, *by: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, lineage cut, size known.

    ``by`` lays it out in a folder per value of those columns. All of an application's tables are under one folder, which
    is removed when the application ends; those of a ``passing`` step go with the step.
    """
    spark = df.sparkSession
    path = f"{_application_folder(spark)}/{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.partitionBy(*by).parquet(path)
    if (step := _STEP.get()) is not None:
        step.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)
