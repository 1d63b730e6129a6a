"""A training-corpus pipeline: each stage reads what the one before it has kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewise.functions.staging import stage_table
from tablewise.llm import decontaminate, mixing, quality, shards, simhash

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Column in which the mixing stage hands the schedule to the sharding stage: numbers from 0 without gaps.
POSITION = "mix_position"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _free(docs: DataFrame, name: str) -> str:
    """The name, or the name behind so many underscores that no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """Rows told apart by a new column, and its name, as ids may be null or repeat.

    A stored table numbers its rows alike each time it is read.
    """
    row = _free(docs, "_row")
    return docs.withColumn(row, F.monotonically_increasing_id()), row


def _keep(rows: DataFrame, rejected: DataFrame, row: str, docs: DataFrame) -> DataFrame:
    """The rows that are not rejected, with the columns of ``docs``."""
    return rows.join(stage_table(rejected.select(row)), row, "left_anti").select(docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that they reject go; null texts are rejected as empty ones are.

    Here and in the other stages ids may be null or repeat, an empty table stays empty, and other columns, whatever
    their names, stay as they are.
    """
    rows, row = _numbered(docs)
    judged = quality.quality_rules(rows, _table(spark, sf_dir, "labels"), row=row)
    return _keep(rows, judged.where(~F.col("kept")), row, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash: of each group of near-duplicates the row with the smallest id stays, of equal rows one.

    Null ids come last; null and empty texts are alike and one group.
    """
    rows, row = _numbered(docs)
    key = _free(rows, "_key")
    rows = rows.withColumn(key, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row")))
    found = simhash.near_duplicates(rows, key=key)
    return _keep(rows, found.where(F.col(key) != F.col("component_id")).select(F.col(key)["row"].alias(row)), row, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a window of a benchmark item go; null texts hold none."""
    rows, row = _numbered(docs)
    found = decontaminate.decontaminate(rows, _table(spark, sf_dir, "benchmark"), key=row)
    return _keep(rows, found.where("contaminated"), row, docs)


def schedule(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: all documents with their place in the Pfair schedule, as the order of rows is lost when a table is stored.

    The null source is a source; a column ``mix_position`` that the table brings along is an earlier place and is replaced.
    """
    rows, row = _numbered(docs.drop(POSITION))
    place = mixing.mix_sources(rows, key=row).select(row, F.col("position").alias(POSITION))
    return rows.join(place, row).drop(row)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the Pfair schedule, so that any run of the table has the target weights."""
    return schedule(spark, docs, sf_dir).orderBy(POSITION).select([c for c in docs.columns if c != POSITION])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sharding: each document with its shard and its place there. Scheduled documents stand in each shard in the schedule's order.

    Null texts are a group of equal texts; a ``mix_position`` that is no bigint is no schedule and stays as it is; columns ``shard`` and ``slot`` that the table brings along are replaced.
    """
    rows, row = _numbered(docs.drop("shard", "slot"))
    columns = [c for c in rows.columns if c != row]
    placed = shards.shard_documents(rows, key=row).select(row, "shard", "slot")
    if dict(rows.dtypes).get(POSITION) != "bigint":
        return rows.join(placed, row).select(*columns, "shard", "slot")
    scheduled = rows.join(placed.drop("slot"), row)
    return shards.slots_in_order(scheduled, POSITION).select(*columns, "shard", "slot")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", keep_good),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", schedule),
    ("sharding", shard),
]

#: Quality scores and fingerprints rest on a hash that SQL does not offer; a plain version checks the rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each stored and read again by the next one."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir))
    return docs
