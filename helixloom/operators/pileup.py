"""Pileup: counts of observations by site, allele and strand, and the sites' classes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixloom.config import Options
from helixloom.functions import stats
from helixloom.schemas import SNP


def counts(obs: DataFrame, keys: list[str], min_base_quality: float = 10) -> DataFrame:
    """Observations (keys, alt boolean, rev boolean, bq) to one row a site. An alt of low quality counts in low_qual_cov alone.

    Plain counters, so tasks combine before the shuffle and a deep site costs one row a task.
    """
    low = F.col("alt") & (F.col("bq") < min_base_quality)
    cell = lambda alt, rev: F.count_if(~low & (F.col("alt") == alt) & (F.col("rev") == rev))
    out = obs.groupBy(*keys).agg(
        F.count_if(~low).alias("total_cov"), F.count_if(low).alias("low_qual_cov"),
        cell(False, False).alias("ref_fwd"), cell(False, True).alias("ref_rev"), cell(True, False).alias("alt_fwd"), cell(True, True).alias("alt_rev"),
    )
    return out.withColumn("ref_cov", F.col("ref_fwd") + F.col("ref_rev")).withColumn("alt_cov", F.col("alt_fwd") + F.col("alt_rev"))


def category(o: Options, vtype: str = "vtype", repeat: Column | None = None) -> Column:
    """The class of a site from its counters, first match: L low coverage, B strand bias, l low fraction, H homozygous, R indel in a repeat, N clean SNP, I clean indel."""
    fraction = F.col("alt_cov") / F.col("total_cov")
    low = (F.col("total_cov") + F.col("low_qual_cov") < o.min_depth) | (F.col("alt_cov") < o.min_alt_depth)
    out = F.when(low, "L")
    if o.is_ont:
        out = out.when(stats.strand_bias_p(F.col("alt_fwd"), F.col("alt_rev")) < o.strand_bias_p, "B")
    out = out.when(fraction < o.min_alt_fraction, "l").when(fraction > o.max_alt_fraction, "H")
    if repeat is not None:
        out = out.when((F.col(vtype) != SNP) & repeat, "R")
    return out.when(F.col(vtype) == SNP, "N").otherwise("I")


def classify(sites: DataFrame, o: Options, repeat: Column | None = None) -> DataFrame:
    """Adds `category` to counted sites with a vtype."""
    return sites.withColumn("category", category(o, repeat=repeat))


def cover(sites: DataFrame, reads: DataFrame, alleles: DataFrame, keys: list[str], width: int = 10_000) -> DataFrame:
    """Observations of sites by reads: every read that spans a site sees it; an event of the read at the site says what, else it is the reference.

    sites: keys, site_id, pos, end; reads: keys, read_id, st, en, rev; alleles: read_id, site_id, alt, bq.
    """
    spans = reads.select(*keys, "read_id", "rev", "st", "en")
    at = sites.select(*keys, "site_id", F.col("pos").alias("st"), F.col("end").alias("en"))
    from helixloom.operators.intervals import contain_join

    seen = (
        contain_join(at, spans, keys, width)
        .select(*keys, F.col("a_site_id").alias("site_id"), F.col("b_read_id").alias("read_id"), F.col("b_rev").alias("rev"))
    )
    return (
        seen.join(alleles, ["read_id", "site_id"], "left").withColumn("alt", F.coalesce("alt", F.lit(False)))
        .withColumn("bq", F.coalesce("bq", F.lit(255)))
    )


def noisy_read_ratio(regions: DataFrame, reads: DataFrame, events: DataFrame, keys: list[str], width: int) -> DataFrame:
    """For each region (keys, region_id, st, en; ids are distinct within keys): reads that overlap it, those with an event in it, and their ratio."""
    from helixloom.operators.intervals import overlap_distinct

    n = overlap_distinct(regions.select(*keys, "region_id", "st", "en"), "region_id", {"n_reads": reads, "n_noisy": events}, "read_id", keys, width)
    return n.filter("n_reads > 0").withColumn("ratio", F.col("n_noisy") / F.col("n_reads"))


def supported(ratios: DataFrame, o: Options) -> DataFrame:
    """Regions with enough noisy reads, in number and share."""
    return ratios.filter((F.col("n_noisy") >= o.min_alt_depth) & (F.col("ratio") >= o.noisy_read_ratio))


def quality_histogram(reads: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bq, n: base qualities of reads (keys, qual binary), counted batch by batch, so that a base is never a row."""
    kinds = {f.name: f.dataType.simpleString() for f in reads.schema.fields}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            table: dict[tuple, np.ndarray] = {}
            names = zip(*(b.column(k).to_pylist() for k in keys), strict=True)
            for name, qual in zip(names, b.column("qual"), strict=True):
                if qual.is_valid:
                    table[name] = table.get(name, 0) + np.bincount(np.frombuffer(qual.as_buffer(), np.uint8), minlength=256)
            rows = [(*name, q, int(h[q])) for name, h in table.items() for q in np.flatnonzero(h).tolist()]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(len(keys) + 2)]
            types = [*(b.schema.field(k).type for k in keys), pa.int32(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[*keys, "bq", "n"])

    parts = reads.select(*keys, "qual").mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", bq int, n long")
    return parts.groupBy(*keys, "bq").agg(F.sum("n").alias("n"))


def quality_quartiles(qualities: DataFrame, keys: list[str], least_share: float = 0.0001) -> DataFrame:
    """keys, q1, q2, q3: quarters of the list of distinct qualities, after those of too small a share are left out. Not weighted by counts; 0 of none.

    qualities: keys, bq, one row a base, or rows of quality_histogram() with n. The histogram has at most 256 rows a key.
    """
    h = qualities if "n" in qualities.columns else qualities.groupBy(*keys, "bq").agg(F.count("*").alias("n"))
    lists = h.groupBy(*keys).agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("bq", "n"))).alias("all"))
    kept = lists.withColumn("kept", F.transform(F.filter("all", lambda x: x["n"] >= F.col("total") * least_share), lambda x: x["bq"]))
    at = lambda k: F.coalesce(F.get("kept", F.floor(F.size("kept") * k / 4).cast("int")), F.lit(0)).alias(f"q{k}")
    return kept.select(*keys, at(1), at(2), at(3))
