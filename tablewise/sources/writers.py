"""Table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str) -> None:
    """Write UTF-8 CSV part files with a header into the folder ``path``."""
    df.write.option("header", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
