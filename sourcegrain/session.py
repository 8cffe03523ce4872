"""Session defaults and the two places where lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "sourcegrain", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; on a cluster pass no master and let submit decide."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.files.maxPartitionBytes": "128m",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    A session in one process that names none gets a private folder; on a cluster that would be another
    folder on each machine, so there the setting is required.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="sourcegrain-ckpt-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and cuts the lineage of iterative jobs."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession) -> str:
    """A new path below the shared folder that goes when the application ends."""
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def dealt(df: DataFrame, columns: list[str], buckets: int | None = None) -> DataFrame:
    """Rows dealt as ``bucketed`` deals them."""
    return df.repartition(buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def bucketed(df: DataFrame, columns: list[str], order: list[str], buckets: int | None = None, deal: bool = True, **options: str) -> DataFrame:
    """Like ``stored``, as a table bucketed by ``columns`` and sorted within its buckets: joins on all of ``columns`` read
    it without a shuffle. ``buckets`` defaults to the session's number of shuffle partitions. Rows that ``dealt`` has dealt
    and nothing has moved since need no second ``deal``."""
    spark = df.sparkSession
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"sourcegrain_{uuid.uuid4().hex}"
    rows = dealt(df, columns, count) if deal else df
    rows.write.bucketBy(count, *columns).sortBy(*order).format("parquet").options(path=shared_path(spark), **options).saveAsTable(name)
    return spark.table(name)


def chunk_of(spark: SparkSession, key: Column) -> Column:
    """A number for each of the session's shuffle partitions, dealt evenly by ``key``: rows dealt by this number get a
    partition for each of its values, so that what is made distinct per number is as good as made distinct per partition."""
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = spark.range(0, 64 * count, 1, 1).groupBy(F.pmod(F.hash("id"), F.lit(count)).alias("at")).agg(F.min("id").alias("label"))
    labels = {r["at"]: r["label"] for r in near.collect()}  # one for each partition
    return F.element_at(F.array(*[F.lit(labels.get(i, i)).cast("long") for i in range(count)]), F.pmod(F.hash(key), F.lit(count)) + 1)


@contextmanager
def dealt_by_some_keys(spark: SparkSession) -> Iterator[None]:
    """In jobs started inside, rows that lie dealt by some of a join's keys are not dealt anew by all of them."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    For results that several branches of a job use: computed once, safe against lost executors, and
    later reads still prune columns and push filters down. The table goes when the application ends.
    """
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is dealt by key, with the other side, and never broadcast.

    Spark plans with the size of compressed files. Rows of much repeated text, or ones exploded from them, may be far
    larger, and a broadcast of them would pass through the driver.
    """
    return df.hint("merge")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs started inside send Python at most ``rows`` rows at a time.

    Whole texts at Spark's 10,000 rows a batch are tens of MB, several times over, beside the heap and in the worker.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    own = int(before)  # 0 or less: no limit
    spark.conf.set(key, str(rows if own <= 0 else min(own, rows)))
    try:
        yield
    finally:
        spark.conf.set(key, before)
