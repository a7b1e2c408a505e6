"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Removes a query's shuffle files when it ends, not when the driver happens to collect garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and everything runs in one process, as in tests, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="strataline-"))
    return sc.getCheckpointDir()


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a query that runs here is removed when the query ends."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


def bucketed(parts: Iterable[DataFrame], name: str, key: str, buckets: int, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """The parts, written one after the other to one table, whose files each have one bucket of ``key``: groups and joins by it read them without a shuffle."""
    table = f"{name}_{uuid.uuid4().hex}"
    for part in parts:
        spark = part.sparkSession
        with freed_shuffles(spark):
            part.write.partitionBy(*partition_by).bucketBy(buckets, key).option("compression", "zstd").option("path", f"{shared_folder(spark)}/{table}").mode("append").format("parquet").saveAsTable(table)
    return spark.table(table)


def materialized(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df written once as Parquet and read again: cuts lineage, can be read by many consumers, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with freed_shuffles(df.sparkSession):
        df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Removes the files of a table that ``materialized`` gave and nothing reads any more."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(conf).delete(path, True)


def is_there(df: DataFrame) -> bool:
    """Whether the files of a table that was read are still where they were: the shared folder may have been cleared."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()]
    return all(p.getFileSystem(conf).exists(p) for p in paths)
