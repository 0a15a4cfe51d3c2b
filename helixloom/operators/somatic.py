"""Somatic (mosaic) variants: candidates, their phase set and haplotype, evidence over alt reads, filters, post-processing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixloom.config import Options
from helixloom.functions.align import cyclic_match
from helixloom.functions.stats import array_lower_median
from helixloom.operators.intervals import contain_join, merge_fixed
from helixloom.operators.sites import dense_variants
from helixloom.plans import functions as kernels
from helixloom.schemas import DEL, INS, SNP


def is_sv(o: Options) -> Column:
    return ((F.col("vtype") == INS) & (F.col("alt_len") >= o.min_sv_length)) | ((F.col("vtype") == DEL) & (F.col("ref_len") >= o.min_sv_length))


def is_candidate(o: Options) -> Column:
    """SNVs and long indels of enough alt reads; a long insertion with a target site duplication needs fewer. No short indels."""
    alt, tsd = F.col("alt_cov"), F.coalesce(F.col("tsd_len"), F.lit(0)) > 0
    te = (F.col("vtype") == INS) & tsd & (alt >= o.somatic_te_alt)
    return F.when(F.col("vtype") == SNP, alt >= o.somatic_alt).when(is_sv(o), (alt >= o.somatic_alt) | te).otherwise(False)


def alike(vtype: int, a: tuple[int, int, str], b: tuple[int, int, str], ratio: float = 0.8) -> bool:
    """Two long gaps (pos, length, bases) of a kind count as one: insertions no farther apart than the shorter is long, deletions that touch; lengths
    within the ratio; and of insertions the bases, up to a rotation."""
    (p, n, x), (q, m, y) = a, b
    near = abs(p - q) <= min(n, m) if vtype == INS else p <= q + m and q <= p + n
    return near and min(n, m) >= ratio * max(n, m) and (vtype != INS or not x or not y or cyclic_match(x, y, ratio))


def merge_alike(svs: DataFrame, keys: list[str], ratio: float = 0.8) -> DataFrame:
    """Long indels of a kind that count as one: the one with most alt reads stays, the earlier of equals.

    svs: keys, var_id, pos, vtype, len, alt_cov[, gap: their bases]. Likeness isn't transitive, so this is a fold in order of position, within
    islands of gaps whose reaches touch; gaps of different islands can't be alike.
    """
    rows = svs if "gap" in svs.columns else svs.withColumn("gap", F.lit(""))
    reach = rows.select(*keys, "vtype", (F.col("pos") - F.col("len")).alias("st"), (F.col("pos") + F.col("len") + 1).alias("en"))
    islands = merge_fixed(reach, [*keys, "vtype"], 0).select(*keys, "vtype", "st", "en")
    points = rows.select(*keys, "vtype", "var_id", "pos", "len", "alt_cov", "gap", F.col("pos").alias("st"), (F.col("pos") + 1).alias("en"))
    at = contain_join(points, islands, [*keys, "vtype"], 10_000)
    kinds = {f.name: f.dataType.simpleString() for f in svs.schema.fields}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple] = []
        for r in sorted(zip(pdf.a_pos, pdf.a_var_id, pdf.a_len, pdf.a_alt_cov, pdf.a_gap, strict=True)):
            like = next((k for k, old in enumerate(kept) if alike(key[-2], (old[0], old[2], old[4]), (r[0], r[2], r[4]), ratio)), None)
            if like is None:
                kept.append(r)
            elif r[3] > kept[like][3]:
                kept[like] = r
        return pd.DataFrame([(*key[: len(keys)], r[1]) for r in kept], columns=[*keys, "var_id"])

    best = at.groupBy(*keys, "vtype", "b_st").applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in [*keys, "var_id"]))
    return svs.join(best, [*keys, "var_id"], "left_semi")


def conflicting_reads(profile: DataFrame, clean: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """keys, read_id: reads that contradict their haplotype at `least` or more clean SNPs. profile: keys, read_id, hap, var_id, allele; clean: keys, var_id, hap1, hap2."""
    own = F.when(F.col("hap") == 1, F.col("hap1")).otherwise(F.col("hap2"))
    j = profile.filter("hap > 0 AND allele >= 0").join(clean, [*keys, "var_id"])
    return (
        j.filter((own >= 0) & (F.col("allele") != own)).groupBy(*keys, "read_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
        .drop("n")
    )


def choose_phase_set(profile: DataFrame, keys: list[str], o: Options) -> DataFrame:
    """keys, var_id, phase_set, alt_hap: of the deepest phase set where alt reads lie on exactly one haplotype, no more than its reference reads, deep enough.

    Variants without any get phase_set 0 and alt_hap 2: they are judged without phase. profile: keys, read_id, var_id, allele, hap, phase_set.
    """
    rows = profile.filter("hap > 0 AND phase_set > 0 AND allele >= 0")
    n = lambda hap, a: F.count_if((F.col("hap") == hap) & (F.col("allele") == a))
    g = (
        rows.groupBy(*keys, "var_id", "phase_set")
        .agg(F.count("*").alias("depth"), n(1, 0).alias("r1"), n(1, 1).alias("a1"), n(2, 0).alias("r2"), n(2, 1).alias("a2"))
    )
    one = (F.col("a1") > 0) != (F.col("a2") > 0)
    hap = F.when(F.col("a1") > 0, 1).otherwise(2)
    alt, ref = F.greatest("a1", "a2"), F.when(F.col("a1") > 0, F.col("r1")).otherwise(F.col("r2"))
    fit = g.filter(one & (alt <= ref) & (F.col("depth") >= o.min_depth)).withColumn("alt_hap", hap)
    best = fit.groupBy(*keys, "var_id").agg(F.max_by(F.struct("phase_set", "alt_hap"), F.struct("depth", -F.col("phase_set"))).alias("b"))
    all_vars = profile.select(*keys, "var_id").distinct()
    return (
        all_vars.join(best, [*keys, "var_id"], "left")
        .select(*keys, "var_id", F.coalesce("b.phase_set", F.lit(0)).alias("phase_set"), F.coalesce("b.alt_hap", F.lit(2)).alias("alt_hap"))
    )


#: What is gathered of each alt read.
EVIDENCE = ("qual", "window_qual", "indel_distance", "dense", "near_clip", "low_complexity_error", "homopolymer_error", "rev")


def evidence(alt_reads: DataFrame, keys: list[str]) -> DataFrame:
    """keys, var_id, n_alt and an array of each of EVIDENCE over the alt reads; a variant's depth bounds it."""
    return alt_reads.groupBy(*keys, "var_id").agg(F.count("*").alias("n_alt"), *(F.collect_list(c).alias(c) for c in EVIDENCE))


def _least(c: str) -> Column:
    return F.coalesce(F.array_min(c), F.lit(0))


def snv_passes(o: Options, phased: bool) -> Column:
    """Filters of a SNV over its evidence and the window's quality quartiles q1, q2, q3; without phase the bar is the third quartile and medians."""
    med = lambda c: array_lower_median(F.col(c))
    both = (F.array_contains("rev", True) & F.array_contains("rev", False)) if o.is_ont else F.lit(True)
    common = (F.col("n_alt") >= o.somatic_alt) & both & (F.coalesce(F.col("var_distance"), F.lit(1 << 30)) >= o.somatic_distance) & (med("indel_distance") >= o.somatic_distance) & (med("dense") == 0) & (med("near_clip") == 0)
    if phased:
        return common & (med("qual") >= F.col("q2")) & (med("window_qual") >= F.col("q1")) & (_least("low_complexity_error") == 0) & (_least("homopolymer_error") == 0)
    return common & (med("qual") >= F.col("q3")) & (med("window_qual") >= F.col("q2")) & (med("low_complexity_error") == 0) & (med("homopolymer_error") == 0)


def is_element() -> Column:
    """At least two of a duplication of 5, a tail of 20, a matching element."""
    yes = lambda c: F.when(c, 1).otherwise(0)
    return yes(F.col("tsd_len") >= 5) + yes(F.abs("polya_len") >= 20) + yes(F.col("te_id").isNotNull()) >= 2


def sv_passes(o: Options) -> Column:
    """Filters of a long indel: enough alt reads, or one and an element; a single read's must not be of low complexity; no germline likeness, dense differences or clips."""
    enough = (F.col("n_alt") >= o.somatic_alt) | ((F.col("n_alt") >= o.somatic_te_alt) & is_element())
    single = (F.col("n_alt") > 1) | ~F.coalesce(F.col("is_low_complexity"), F.lit(False))
    return enough & single & ~F.coalesce(F.col("like_germline"), F.lit(False)) & (array_lower_median(F.col("dense")) == 0) & (array_lower_median(F.col("near_clip")) == 0)


def passes(o: Options) -> Column:
    """The filter of a candidate by its kind and whether a phase set was found."""
    return (
        F.when(F.col("vtype") == SNP, F.when(F.col("phase_set") > 0, snv_passes(o, True)).otherwise(snv_passes(o, False)))
        .otherwise(sv_passes(o))
    )


def without_germline(candidates: DataFrame, germline: DataFrame, keys: list[str], least: int = 500, ratio: float = 0.8, close: int = 50) -> DataFrame:
    """Candidates with no germline variant like them. Both: keys, var_id, pos, vtype, len[, gap: their bases].

    Like is one of their kind within max(least, length) that is alike in length and, where bases are told, in these up to a rotation; or an insertion
    within `close` bases where one has more than the other by a stretch of low complexity. Positions meet in bins of 1000 bases.
    """
    told = "gap" in candidates.columns and "gap" in germline.columns
    extra = [F.col("gap").alias("g_gap")] if told else []
    g = (
        germline.select(
            *(F.col(k).alias(f"_{k}") for k in keys), F.col("pos").alias("g_pos"), F.col("vtype").alias("g_vtype"),
            F.col("len").alias("g_len"), *extra,
        )
    )
    reach = F.greatest(F.lit(least), F.col("len"))
    bins = candidates.withColumn("_bin", F.explode(F.sequence(F.floor((F.col("pos") - reach) / 1000), F.floor((F.col("pos") + reach) / 1000))))
    apart = F.abs(F.col("pos") - F.col("g_pos"))
    on = (F.col("_bin") == F.floor(F.col("g_pos") / 1000)) & (F.col("vtype") == F.col("g_vtype")) & (apart <= reach)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    sized = F.least("len", "g_len") >= ratio * F.greatest("len", "g_len")
    if not told:
        like = bins.join(g, on & sized, "left_semi")
    else:
        both = bins.join(g, on & (sized | ((F.col("vtype") == INS) & (apart <= close))))
        like = both.filter((sized & kernels.cyclic_match("gap", "g_gap")) | ((F.col("vtype") == INS) & (apart <= close) & kernels.low_complexity_difference("gap", "g_gap")))
    return candidates.join(like.select(*keys, "var_id").distinct(), [*keys, "var_id"], "left_anti")


def post_process(variants: DataFrame, alt_reads: DataFrame, keys: list[str], o: Options) -> DataFrame:
    """Drops variants in dense runs, and those at least half of whose alt reads carry one. variants: keys, var_id, beg, end; alt_reads: keys, var_id, read_id."""
    marked = (
        dense_variants(variants.withColumnRenamed("var_id", "id"), keys, o.somatic_window, o.somatic_window_variants)
        .withColumnRenamed("id", "var_id")
    )
    bad_reads = (
        alt_reads.join(marked.filter("dense").select(*keys, "var_id"), [*keys, "var_id"], "left_semi").select(*keys, "read_id").distinct()
        .withColumn("_bad", F.lit(1))
    )
    share = (
        alt_reads.join(bad_reads, [*keys, "read_id"], "left").groupBy(*keys, "var_id")
        .agg(F.count("_bad").alias("n_bad"), F.count("*").alias("n"))
    )
    out = share.filter(2 * F.col("n_bad") >= F.col("n")).select(*keys, "var_id")
    return marked.filter("NOT dense").drop("dense").join(out, [*keys, "var_id"], "left_anti")


def near_long_clip(events: str = "events", pos: str = "pos", long: int = 100, within: int = 100) -> Column:
    """A clip of `long` bases at an end of a read's events within `within` of a position."""
    e = F.col(events)
    one = lambda x, end: x["op"].isin("S", "H") & (x["len"] >= long) & (F.abs(F.col(pos) - end) <= within)
    return one(e[0], e[0]["pos"]) | one(F.element_at(e, -1), F.element_at(e, -1)["pos"])


def indel_distance(events: DataFrame, sites: DataFrame, variants: DataFrame, keys: list[str], cap: int = 10) -> DataFrame:
    """keys, read_id, var_id, indel_distance: from each site to the nearest gap of the read that is no known variant, at most `cap`.

    events: keys, read_id, pos, vtype, len; sites: keys, read_id, var_id, pos; variants: keys, pos, vtype, len.
    """
    own = (
        events.filter(F.col("vtype").isin(INS, DEL)).join(variants, [*keys, "pos", "vtype", "len"], "left_anti")
        .select(*keys, "read_id", F.col("pos").alias("_p"))
    )
    near = (
        sites.withColumn("_b", F.explode(F.array(*(F.floor((F.col("pos") + d) / cap) for d in (-cap, 0, cap)))))
        .join(own.withColumn("_b", F.floor(F.col("_p") / cap)), [*keys, "read_id", "_b"], "left")
    )
    return (
        near.groupBy(*keys, "read_id", "var_id")
        .agg(F.least(F.lit(cap), F.coalesce(F.min(F.abs(F.col("pos") - F.col("_p"))), F.lit(cap))).alias("indel_distance"))
    )
