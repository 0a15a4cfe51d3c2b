"""Orders and choices among reads, and relations of reads with regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixloom.config import Options
from helixloom.operators.intervals import overlap_join


def read_rank(reads: DataFrame, keys: list[str]) -> DataFrame:
    """Adds read_rank: by begin, longest first, edit distance (none is 0), name."""
    return (
        reads.withColumn(
            "read_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("pos", F.desc("end"), F.coalesce("nm", F.lit(0)), "qname")),
        )
    )


#: How a read lies over a region.
LEFT, RIGHT, GAP = 1, 2, 4


def cover_flags(st: Column, en: Column, lo: Column, hi: Column, has_gap: Column | None = None) -> Column:
    """Bits: the read covers the region's left end, its right end, has a gap over an end."""
    return F.when(st <= lo, LEFT).otherwise(0) + F.when(en >= hi, RIGHT).otherwise(0) + (F.when(has_gap, GAP).otherwise(0) if has_gap is not None else 0)


def region_reads(regions: DataFrame, reads: DataFrame, keys: list[str], width: int = 10_000) -> DataFrame:
    """keys, region_id, read_id, cover: reads that overlap each region."""
    j = overlap_join(regions.select(*keys, "region_id", "st", "en"), reads.select(*keys, "read_id", "st", "en"), keys, width)
    return (
        j.select(
            *keys, F.col("a_region_id").alias("region_id"), F.col("b_read_id").alias("read_id"),
            cover_flags(F.col("b_st"), F.col("b_en"), F.col("a_st"), F.col("a_en")).alias("cover"),
        )
    )


def region_order(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Adds region_rank: least noisy first, then shortest."""
    return regions.withColumn("region_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("label", F.col("en") - F.col("st"), "st")))


def workable(regions: DataFrame, depth: DataFrame, keys: list[str], o: Options) -> DataFrame:
    """Regions that aren't too long or too deep, before any group is gathered."""
    n = depth.groupBy(*keys, "region_id").agg(F.countDistinct("read_id").alias("_n"))
    return (
        regions.filter(F.col("en") - F.col("st") <= o.max_noisy_length).join(n, [*keys, "region_id"], "left")
        .filter(F.coalesce("_n", F.lit(0)) <= o.max_noisy_reads).drop("_n")
    )


def phase_set_of_region(reads: DataFrame, keys: list[str], o: Options) -> DataFrame:
    """keys, phase_set: of each region the set with most fully covering reads on its lesser haplotype, then on its greater; enough full and all reads on both.

    reads: keys, read_id, phase_set, hap, full (covers the region).
    """
    n = lambda hap, full: F.count_if((F.col("hap") == hap) & (F.col("full") if full else F.lit(True)))
    g = (
        reads.filter("hap > 0 AND phase_set > 0").groupBy(*keys, "phase_set")
        .agg(n(1, True).alias("f1"), n(2, True).alias("f2"), n(1, False).alias("a1"), n(2, False).alias("a2"))
    )
    fit = g.filter((F.least("f1", "f2") >= o.min_hap_full_reads) & (F.least("a1", "a2") >= o.min_hap_reads))
    return (
        fit.groupBy(*keys)
        .agg(F.max_by("phase_set", F.struct(F.least("f1", "f2"), F.greatest("f1", "f2"), -F.col("phase_set"))).alias("phase_set"))
    )
