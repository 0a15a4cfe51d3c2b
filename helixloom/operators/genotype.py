"""Genotypes and output records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixloom.config import Options
from helixloom.functions import stats
from helixloom.schemas import DEL, INS, SNP


def three_places(x: Column) -> Column:
    """A number as C prints it with %.3f: from single precision, ties of what is stored to even."""
    return F.format_string("%.3f", F.bround(x.cast("float").cast("double"), 3))


def genotype(variants: DataFrame, o: Options, reference: str | None = None) -> DataFrame:
    """Output records of phased variants (contig, pos, vtype, ref_len, alt_len, alt_seq, ref_cov, alt_cov, hap1, hap2, phase_set, top_allele[, ref_bases: the anchor and the reference bases]).

    Unknown on both haplotypes: homozygous for the deepest allele; unknown on one: reference there. Gaps are anchored a base before.
    """
    known = lambda c: F.when((F.col("hap1") < 0) & (F.col("hap2") < 0), F.col("top_allele")).when(F.col(c) < 0, 0).otherwise(F.col(c))
    rows = variants.withColumn("_1", known("hap1")).withColumn("_2", known("hap2")).filter((F.col("_1") > 0) | (F.col("_2") > 0))
    het = F.col("_1") != F.col("_2")
    is_gap = F.col("vtype") != SNP
    bases = F.col(reference) if reference else F.lit("N")
    ps = F.when(het, F.col("phase_set"))
    phased = F.coalesce(F.col("phase_set"), F.lit(0)) > 0
    gt = F.when(phased, F.concat_ws("|", "_1", "_2")).otherwise(F.concat_ws("/", F.least("_1", "_2"), F.greatest("_1", "_2")))
    length = F.col("alt_len") - F.col("ref_len")
    return rows.select(
        "contig", F.when(is_gap, F.col("pos") - 1).otherwise(F.col("pos")).alias("pos"),
        F.when(is_gap, F.when(F.col("vtype") == DEL, bases).otherwise(F.substring(bases, 1, 1))).otherwise(bases).alias("ref"),
        F.when(F.col("vtype") == INS, F.concat(F.substring(bases, 1, 1), "alt_seq")).when(F.col("vtype") == DEL, F.substring(bases, 1, 1)).otherwise(F.col("alt_seq")).alias("alt"),
        stats.variant_qual(F.col("ref_cov"), F.col("alt_cov"), o.error_rate, o.log10_error, o.max_qual).alias("qual"), gt.alias("gt"),
        (F.col("ref_cov") + F.col("alt_cov")).cast("int").alias("dp"), F.col("ref_cov").cast("int").alias("ref_ad"), F.col("alt_cov").cast("int").alias("alt_ad"),
        stats.genotype_quality(F.col("ref_cov"), F.col("alt_cov"), o.max_gq).alias("gq"), F.when(phased, ps).alias("ps"),
        F.when(F.abs(length) >= o.min_sv_length, F.when(length > 0, "INS").otherwise("DEL")).alias("svtype"), F.when(F.abs(length) >= o.min_sv_length, length).cast("int").alias("svlen"),
        *(["alt_reads"] if "alt_reads" in rows.columns else []),
    )


def with_names(variants: DataFrame, alt_reads: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `alt_reads`, the names of a variant's alt reads (keys, qname), comma-joined; its alt count becomes their number. Variants without any keep their count."""
    names = alt_reads.groupBy(*keys).agg(F.array_sort(F.collect_set("qname")).alias("_names"))  # a variant's depth bounds it
    joined = variants.join(names, keys, "left")
    return (
        joined.withColumn("alt_cov", F.when(F.col("_names").isNull(), F.col("alt_cov")).otherwise(F.size("_names")))
        .withColumn("alt_reads", F.array_join("_names", ",")).drop("_names")
    )


def final_filter(calls: DataFrame, o: Options) -> DataFrame:
    """What is written: deep enough, enough alt reads, and no ambiguous base unless asked for. Mobile elements need less."""
    somatic = F.coalesce(F.col("somatic"), F.lit(False)) if "somatic" in calls.columns else F.lit(False)
    tsd = (F.col("tsdlen") > 0) if "tsdlen" in calls.columns else F.lit(False)
    enough = (
        F.when(somatic, (F.col("alt_ad") >= o.somatic_te_alt) & ((F.col("alt_ad") >= o.somatic_alt) | tsd))
        .otherwise(F.col("alt_ad") >= o.min_alt_depth)
    )
    plain = F.lit(True) if o.amb_bases else ~(F.col("ref").contains("N") | F.col("alt").contains("N"))
    return calls.filter((F.col("dp") >= o.min_depth) & enough & plain)


def body_line(calls: DataFrame) -> DataFrame:
    """contig, pos, line: tab-separated records with INFO and FORMAT in their fixed order."""
    have = set(calls.columns)
    flag = lambda c, name: [F.when(F.coalesce(F.col(c), F.lit(False)), F.lit(name))] if c in have else []
    value = lambda c, name, more=None: [F.when(F.col(c).isNotNull() & (more if more is not None else F.lit(True)), F.concat(F.lit(f"{name}="), F.col(c).cast("string")))] if c in have else []
    end = (F.col("pos") + F.length("ref") - 1).cast("string")
    tsd = (F.col("tsdlen") > 0) if "tsdlen" in have else None
    info = [
        *flag("clean", "CLEAN"), *flag("somatic", "SOMATIC"), *flag("mei", "MEI"), F.concat(F.lit("END="), end), *value("svtype", "SVTYPE"), *value("svlen", "SVLEN"),
        *value("tsd", "TSD", tsd), *value("tsdlen", "TSDLEN", tsd), *value("polyalen", "POLYALEN", tsd), *value("tsdpos1", "TSDPOS1", tsd), *value("tsdpos2", "TSDPOS2", F.col("tsdpos2") > 0 if "tsdpos2" in have else None), *value("repname", "REPNAME"),
    ]
    names = F.col("alt_reads") if "alt_reads" in have else F.lit(None).cast("string")
    has_ps = F.coalesce(F.col("ps") > 0, F.lit(False))
    form = F.concat(F.lit("GT:DP:AD:VAF:GQ"), F.when(has_ps, ":PS").otherwise(""), F.when(names.isNotNull(), ":ALTREADS").otherwise(""))
    vaf = three_places(F.col("alt_ad") / F.col("dp"))
    sample = (
        F.concat_ws(
            ":", "gt", F.col("dp").cast("string"), F.concat_ws(",", F.col("ref_ad").cast("string"), F.col("alt_ad").cast("string")), vaf,
            F.col("gq").cast("string"), F.when(has_ps, F.col("ps").cast("string")), names,
        )
    )
    line = (
        F.concat_ws(
            "\t", "contig", F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.col("qual").cast("string"), F.lit("PASS"),
            F.concat_ws(";", *info), form, sample,
        )
    )
    return calls.select("contig", "pos", line.alias("line"))
