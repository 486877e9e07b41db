"""Sessions, and tables kept in reliable storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "tidyframe", **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, adaptive execution, ANSI."""
    builder = SparkSession.builder.appName(app)
    for k, v in ({"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.ansi.enabled": "true"} | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share (``spark.checkpoint.dir``).

    Where that setting is absent a temporary folder is set once on a local master; elsewhere this
    raises, since executors would not see the driver's own disk.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidyframe-"))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``shared_folder`` gave, through the store's own file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows from ``spark.checkpoint.dir``, lineage cut."""
    shared_folder(df.sparkSession, "set")
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of files that a partition made by ``partitions_for`` should hold.
PARTITION_BYTES = 128 << 20


def partitions_for(df: DataFrame) -> int:
    """Partitions for a shuffle of all rows of ``df``: by the bytes of the files that it reads, at least the session's number.

    Adaptive execution does not change a number that is asked for, so that it has to grow with the input.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    files = [f for f in (leaves.apply(i) for i in range(leaves.size())) if f.nodeName() == "LogicalRelation"]
    size = sum(int(str(f.stats().sizeInBytes())) for f in files)
    return max(shuffle_partitions(df.sparkSession), -(-size // PARTITION_BYTES))
