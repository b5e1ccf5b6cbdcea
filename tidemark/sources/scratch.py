"""Results that later steps read several times, kept in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def settled(df: DataFrame) -> DataFrame:
    """df computed once and written to the checkpoint folder, which cuts its lineage.

    The folder is spark.checkpoint.dir; where that is unset, local mode takes a temporary one.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint()


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


#: Makes Spark delete a query's shuffle files as soon as the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writing, _before = threading.Lock(), 0, {}
#: Tables of written() that still lie in the shared folder, by path.
_kept: dict[str, SparkSession] = {}


def written(df: DataFrame, label: str, by: str | None = None, tasks: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts its lineage.

    by: the last column, by which the table is divided into folders.
    tasks: how many tasks write at most, each a file; for tables whose rows are counted before.

    What comes after reads the table, so the shuffle files behind it are not kept.  The
    setting for that is the session's; it is put back when the last of the writes that
    run at the same time has ended.
    """
    global _writing
    spark = df.sparkSession
    if tasks is not None:
        df = df.coalesce(tasks)
    path = f"{scratch_root(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
    with _lock:
        if not _writing:
            _before["value"] = spark.conf.get(CLEANUP, "false")
        _writing += 1
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, partitionBy=by)
    finally:
        with _lock:
            _writing -= 1
            if not _writing:
                spark.conf.set(CLEANUP, _before["value"])
    back = spark.read.schema(df.schema).parquet(path)
    back._tidemark_path = path
    _kept[path] = spark
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for df in tables:
        _delete(df._tidemark_path)


def _delete(name: str) -> None:
    spark = _kept.pop(name, None)
    if spark is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Delete all tables of written().  Results that read them can't be used afterwards."""
    for name in list(_kept):
        _delete(name)


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended before
        if all(s.sparkContext._jsc is not None for s in _kept.values()):
            release()
