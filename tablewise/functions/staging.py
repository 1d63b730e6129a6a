"""Intermediate tables that several jobs read.

A result that is expensive to rebuild (a shuffled distinct, a frequency table) and is read by
more than one job is written once as Parquet below the folder named by ``spark.checkpoint.dir``,
which all executors share. The files survive lost executors, cut the lineage, and later jobs read
only the columns they need. Where no folder is named the table is persisted instead: Spark
rebuilds what a lost executor held from the lineage, and nothing is written to a local folder.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_staged: dict[str, list[str | DataFrame]] = {}


def shared_folder(spark: SparkSession) -> str | None:
    """The folder named by ``spark.checkpoint.dir``, or None."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured.rstrip("/") if configured else None


def stage_table(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    kept = _staged.setdefault(spark.sparkContext.applicationId, [])
    folder = shared_folder(spark)
    if folder is None:
        held = df.persist(StorageLevel.MEMORY_AND_DISK)
        kept.append(held)
        return held
    path = f"{folder}/tablewise/{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_so_far(spark: SparkSession) -> int:
    """A mark for ``drop_staged``: how many tables this application holds now."""
    return len(_staged.get(spark.sparkContext.applicationId, []))


def drop_staged(spark: SparkSession, since: int = 0) -> int:
    """Free the tables staged by this application (after the mark ``since``), once results are stored."""
    held = _staged.get(spark.sparkContext.applicationId, [])
    dropped, held[since:] = held[since:], []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for item in dropped:
        if isinstance(item, DataFrame):
            item.unpersist()
        else:
            target = hadoop.Path(item)
            target.getFileSystem(conf).delete(target, True)
    return len(dropped)


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Give iterative estimators the shared folder, so long lineages are cut every few rounds."""
    folder = shared_folder(spark)
    if folder is not None:
        spark.sparkContext.setCheckpointDir(folder + "/checkpoints")
