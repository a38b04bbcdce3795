"""Session helpers: a UTC session and the shared folder for materialised steps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_scope: ContextVar[str | None] = ContextVar("staging scope", default=None)


def local_session(cores: int | str = "*", app: str = "recollect", **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster, pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        # Call sites of column functions are only for error messages and cost a stack walk each.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors can reach, as the cluster names it.

    Only where the session names none (a single-machine test) is a scratch folder set.
    """
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="recollect-"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, inside the open ``staging`` scope if there is one."""
    return f"{_scope.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def staging(spark: SparkSession, name: str = "staged") -> Iterator[str]:
    """A scope whose staged tables lie in one folder, which is deleted at the end, after an error too.

    Results are lazy and read the staged tables, so write them inside the scope, to a path
    outside of the folder that it yields. A scope in a scope ends with its own folder.
    """
    folder = new_path(spark, name)
    token = _scope.set(folder)
    try:
        yield folder
    finally:
        _scope.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back.

    Used after model calls, whose answers must never be computed twice, and to cut long
    lineage. The table lives in the shared folder, so a lost executor costs nothing.
    """
    spark = df.sparkSession
    target = path or new_path(spark, name)
    df.write.mode("errorifexists").parquet(target)
    return spark.read.parquet(target)
