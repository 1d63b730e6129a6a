"""Readers and writers."""

from .readers import load_table, read_csv, read_parquet
from .writers import write_csv

__all__ = ["load_table", "read_csv", "read_parquet", "write_csv"]
