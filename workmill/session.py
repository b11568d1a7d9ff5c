"""Session settings and the one way this package cuts lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Session-level settings every operator relies on. Sizes (shuffle partitions,
# memory, split size) stay with the cluster's own configuration.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even where that costs one more exchange upstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# Where the cluster names no size: a task that joins and groups holds its rows several
# times over and unpacked, 25 times their shuffled bytes, so it is given few of them.
SHARE = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}


def configure(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    for name, value in SHARE.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    return spark


def build(app: str = "workmill", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names.

    A temporary folder is made only in local mode with nothing set; on a
    cluster a machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="workmill-")
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and continue from there (an action).

    Parquet rather than a row checkpoint: it is computed once, read back by
    column, and its size is known, so a later join can judge it. Everything a
    session writes lies under one folder, which can go when the job is over.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps.

    The cleaner follows the driver's garbage collection, which an idle driver
    seldom runs; without this the disk keeps every step's shuffles.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete tables that `cut` wrote, once what was made of them is written too.

    Only folders right below this application's own are deleted.
    """
    for table in tables:
        sc = table.sparkSession.sparkContext
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            if folder.split("/")[-2] == sc.applicationId:
                path = sc._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def broadcastable(df: DataFrame) -> bool:
    """Would Catalyst broadcast `df` in a join, by its own size estimate?"""
    spark = df.sparkSession
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return limit > 0 and int(str(size)) <= limit
