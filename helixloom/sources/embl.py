"""Annotated element libraries in EMBL text, such as Dfam's, as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_embl(spark: SparkSession, path: str) -> DataFrame:
    """accession, version, name, type, subtype, seq (letters alone, upper case) of each record; what a record doesn't tell is null. Records end at a line of `//`."""
    rec = spark.read.option("lineSep", "\n//").text(path).filter(F.col("value").rlike("(?m)^ID   "))
    one = lambda pattern: F.nullif(F.trim(F.regexp_extract("value", pattern, 1)), F.lit(""))
    note = F.regexp_extract("value", r"(?ms)^CC   RepeatMasker Annotations(.*?)^XX", 1)
    told = lambda text, name: F.nullif(F.trim(F.regexp_extract(text, rf"(?m)^CC        {name}: (.*)$", 1)), F.lit(""))

    def bases(text: Column) -> Column:
        return F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))

    return rec.select(
        one(r"(?m)^ID   ([^;\r\n]*)").alias("accession"), one(r"(?m)^ID   [^;\r\n]*; *S?V? *([^;\r\n]*)").alias("version"), one(r"(?m)^NM   (.*)$").alias("name"),
        told(note, "Type").alias("type"), told(note, "SubType").alias("subtype"), bases(F.regexp_extract("value", r"(?ms)^SQ   [^\n]*\n(.*)", 1)).alias("seq"),
    )
