"""Blocked gzip through Spark's own text writer, so that tasks write it to any store Spark knows, with its commit protocol.

The writer puts a separator behind every row. Rows are whole blocks of content but for its last byte; the separator is a block that
holds this byte. So every part is a run of blocks, and parts behind each other are one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.sources.bgzf import END_OF_FILE, block


def _write(rows: DataFrame, path: str, separator: bytes) -> None:
    rows.select(F.col("data").cast("string")).write.mode("overwrite").option("lineSep", separator.decode("latin-1")).option("encoding", "ISO-8859-1").option("compression", "none").text(path)


def write_blocks(rows: DataFrame, path: str, last: bytes) -> None:
    """Rows of `data`: blocks of content whose last byte, `last`, is left out."""
    _write(rows, path, block(last))


def write_end(spark: SparkSession, path: str) -> None:
    """The empty block that ends a file."""
    _write(spark.range(1).select(F.lit(b"").alias("data")).coalesce(1), path, END_OF_FILE)
