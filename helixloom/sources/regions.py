"""Region plans: windows over contigs, region texts, BED files, contig classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.functions.sequences import contig_class


def windows(contigs: DataFrame, size: int = 500_000) -> DataFrame:
    """contig, beg, end (1-based, inclusive) of at most `size` bases over contigs (contig, length[, beg, end])."""
    beg = F.col("beg") if "beg" in contigs.columns else F.lit(1).cast("long")
    end = F.least(F.col("end"), F.col("length")) if "end" in contigs.columns else F.col("length")
    rows = contigs.select("contig", beg.alias("_b"), end.alias("_e")).filter("_b <= _e")
    return (
        rows.select("contig", F.explode(F.sequence(F.col("_b"), F.col("_e"), F.lit(size).cast("long"))).alias("beg"), "_e")
        .select("contig", "beg", F.least(F.col("beg") + size - 1, "_e").alias("end"))
    )


def from_texts(spark: SparkSession, regions: list[str], contigs: DataFrame) -> DataFrame:
    """Regions such as chr1, chr1:5, chr1:5-900 or chr1:1,000-2,000; unknown contigs fall out. A contig name may itself hold colons."""
    rows = (
        spark.createDataFrame([(r,) for r in regions], "region string")
        .join(
            contigs.select("contig", "length"),
            F.col("region").eqNullSafe(F.col("contig")) | F.expr("startswith(region, contig || ':') AND substring(region, length(contig) + 2) RLIKE '^[0-9,]+(-[0-9,]+)?$'"),
        )
    )
    span = F.regexp_replace(F.expr("substring(region, length(contig) + 2)"), ",", "")
    part = F.split(span, "-")
    beg = F.when(F.length(span) > 0, part[0].try_cast("long")).otherwise(1)
    end = F.when(F.length(span) > 0, F.coalesce(F.get(part, F.lit(1)).try_cast("long"), F.col("length"))).otherwise(F.col("length"))
    return windows(rows.select("contig", "length", beg.cast("long").alias("beg"), end.cast("long").alias("end")))


def from_bed(spark: SparkSession, path: str, contigs: DataFrame) -> DataFrame:
    """A tab-separated BED file: second and third column may be missing (whole contig, to its end); starts are 0-based; # lines and unknown contigs fall out."""
    lines = spark.read.text(path).filter("length(trim(value)) > 0 AND NOT startswith(value, '#')")
    c = F.split("value", "\t")
    rows = (
        lines.select(
            c[0].alias("contig"), (F.coalesce(F.get(c, F.lit(1)).try_cast("long"), F.lit(0)) + 1).alias("beg"),
            F.get(c, F.lit(2)).try_cast("long").alias("end"),
        )
    )
    return windows(rows.join(contigs.select("contig", "length"), "contig").withColumn("end", F.coalesce("end", "length")))


def select_contigs(contigs: DataFrame, classes: tuple[str, ...] = ("autosome", "sex"), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Contigs of the wanted classes without the excluded names; all contigs where no name is of such a class."""
    rows = contigs.filter(~F.col("contig").isin(*exclude)) if exclude else contigs
    fits = rows.filter(contig_class(F.col("contig")).isin(*classes))
    return rows if fits.isEmpty() else fits


def plan(spark: SparkSession, contigs: DataFrame, regions: list[str] | None = None, bed: str | None = None, classes: tuple[str, ...] = ("autosome", "sex"), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Windows to work on: region texts before a BED file before the genome. Explicit regions switch the contig filters off."""
    if regions:
        return from_texts(spark, regions, contigs)
    if bed:
        return from_bed(spark, bed, contigs)
    return windows(select_contigs(contigs, classes, exclude))
