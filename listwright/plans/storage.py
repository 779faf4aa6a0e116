"""Tables written between the steps of a plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting for deleting a query's shuffles as it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session, whose executors are the driver itself, may leave it unset; it gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='listwright-')}"
    return _own_dirs[context.applicationId]


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: the lineage ends there, a lost executor costs no
    more than the step at hand, and the planner knows the table's true size, so it broadcasts it only where it is small.
    The shuffles of the step are deleted with its end; else they would stay until the driver collects garbage."""
    path = f"{shared_dir(df.sparkSession)}/listwright-{uuid.uuid4().hex}/{label}"
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, None)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(SHUFFLE_CLEANUP, before) if before is not None else conf.unset(SHUFFLE_CLEANUP)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and nothing reads any more, as their successors are written themselves."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
