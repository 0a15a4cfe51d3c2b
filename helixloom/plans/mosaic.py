"""Somatic (mosaic) calls from what the germline plan has found: candidates of low fraction, their evidence read by read, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixloom.config import Options
from helixloom.functions import stats
from helixloom.lineage import cut
from helixloom.operators import evidence, genotype, noisy, pileup, sites, somatic
from helixloom.operators.elements import match
from helixloom.operators.reads import LEFT, RIGHT, region_reads
from helixloom.plans import functions as kernels
from helixloom.plans.germline import Analysis, best_haplotype, covers, matrix, numbered, regions_of
from helixloom.schemas import DEL, INS, SNP
from helixloom.sources import fasta

#: Bases to both sides of a site on which low complexity and homopolymers are judged.
AROUND = 25
#: What the plan keeps of a candidate site.
SITE = ["contig", "site_id", "pos", "vtype", "ref_len", "alt_len", "alt_seq", "ref_cov", "alt_cov", "bases"]


def gap_bases() -> Column:
    """An insertion's own bases, a deletion's from the reference (`bases`: the anchor and on)."""
    return (
        F.when(F.col("vtype") == INS, F.col("alt_seq")).when(F.col("vtype") == DEL, F.substring("bases", F.lit(2), F.col("ref_len")))
        .otherwise("")
    )


def op_of(vtype: str = "vtype") -> Column:
    return F.when(F.col(vtype) == INS, "I").when(F.col(vtype) == DEL, "D").otherwise("X")


def marks(candidates: DataFrame, reference: DataFrame, o: Options, elements: DataFrame | None, te_index: DataFrame | None) -> DataFrame:
    """site_id, tsd, tsd_len, polya_len, te_id, repname of long indels: duplication and tail by the reference behind, and the element that the gap matches."""
    long = candidates.filter(somatic.is_sv(o)).withColumn("_n", F.greatest("ref_len", "alt_len"))
    around = fasta.base_at(reference, long.select("site_id", "contig", "pos", "vtype", "alt_seq", "_n"), 2 * F.col("_n"))
    is_ins = F.col("vtype") == INS
    gap = F.when(is_ins, F.col("alt_seq")).otherwise(F.substring("bases", F.lit(1), F.col("_n")))
    flank = F.when(is_ins, F.substring("bases", F.lit(1), F.col("_n"))).otherwise(F.substring("bases", F.col("_n") + 1, F.col("_n")))
    got = around.select("site_id", gap.alias("seq"), kernels.insertion_marks(gap, flank).alias("m"))
    got = (
        got.select(
            "site_id", "seq", F.substring("seq", F.lit(1), F.col("m.tsd_len")).alias("tsd"), F.col("m.tsd_len").alias("tsd_len"),
            F.col("m.tail_len").alias("polya_len"),
        )
    )
    if te_index is None:
        return (
            got.select(
                "site_id", "tsd", "tsd_len", "polya_len", F.lit(None).cast("long").alias("te_id"),
                F.lit(None).cast("string").alias("repname"),
            )
        )
    hits = (
        match(got.select(F.col("site_id").alias("id"), "seq"), te_index, o.te_kmer)
        .select(F.col("id").alias("site_id"), F.col("te_id").cast("long").alias("te_id"))
    )
    if elements is not None and "name" in elements.columns:
        hits = hits.join(elements.select(F.col("te_id").cast("long").alias("te_id"), F.col("name").alias("repname")), "te_id", "left")
    else:
        hits = hits.withColumn("repname", F.lit(None).cast("string"))
    return got.drop("seq").join(hits, "site_id", "left")


def demoted(a: Analysis) -> DataFrame:
    """contig, site_id of germline variants whose haplotypes both came out as the reference: they may be somatic."""
    zero = a.var_haps.filter(F.greatest("hap1", "hap2") == 0).select("contig", "chunk", "var_id")
    return a.variants.join(zero, ["contig", "chunk", "var_id"]).select("contig", "site_id")


def in_noisy(a: Analysis, reference: DataFrame, o: Options) -> tuple[DataFrame, DataFrame]:
    """Differences of noisy regions that single reads share and no consensus has, as sites (SITE, total_cov); and contig, site_id, read_id, alt, rev, bq of the
    reads that cover their regions."""
    called = regions_of(a, a.regions, a.read_haps, reference, o)
    key = ["contig", "region_id", "pos", "vtype", "ref_len", "alt_len", "alt_seq"]
    found = numbered(noisy.read_candidates(called, ["contig"], o), "_n").withColumn("site_id", -1 - F.col("_n")).drop("_n")
    single = (
        called.filter("kind = 'single'").join(found.select(*key, "site_id"), key).select("contig", "site_id", "read_id").distinct()
        .withColumn("alt", F.lit(True))
    )
    whole = (
        region_reads(a.regions, covers(a.reads), ["contig"]).filter(F.col("cover") == LEFT + RIGHT)
        .join(found.select("contig", "region_id", "site_id"), ["contig", "region_id"])
    )
    strand = a.reads.select("read_id", (F.col("flag").bitwiseAND(16) > 0).alias("rev"))
    seen = whole.select("contig", "site_id", "read_id").join(single, ["contig", "site_id", "read_id"], "full_outer").join(strand, "read_id")
    seen = cut(seen.select("contig", "site_id", "read_id", F.coalesce("alt", F.lit(False)).alias("alt"), "rev", F.lit(255).alias("bq")))
    n = seen.groupBy("contig", "site_id").agg(F.count_if(~F.col("alt")).alias("ref_cov"), F.count("*").alias("total_cov"))
    at = found.join(n, ["contig", "site_id"])
    is_snp = F.col("vtype") == SNP
    placed = at.withColumn("_at", F.col("pos")).withColumn("pos", F.when(is_snp, F.col("pos")).otherwise(F.col("pos") - 1))
    anchored = fasta.base_at(reference, placed, F.col("ref_len") + F.when(is_snp, 0).otherwise(1))
    return anchored.withColumn("pos", F.col("_at")).select(*SITE, "total_cov"), seen


def candidates(a: Analysis, reference: DataFrame, o: Options, elements: DataFrame | None = None, te_index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Sites too rare for germline that may be somatic, with marks and `is_low_complexity`; and contig, site_id, read_id, alt, rev, bq of the reads at them.

    They come from clean sites of low coverage or fraction, from germline variants phased as reference, and from single reads of noisy regions.
    Long ones that count as one are merged, and none is like a germline variant.
    """
    back = cut(demoted(a))
    extra, extra_seen = in_noisy(a, reference, o)
    low = a.counted.filter(F.col("category").isin("L", "l")).unionByName(a.counted.join(back, ["contig", "site_id"], "left_semi"))
    low = cut(low.select(*SITE, "total_cov").unionByName(extra).withColumn("len", F.greatest("ref_len", "alt_len")))
    told = low.join(marks(low, reference, o, elements, te_index), "site_id", "left")
    maybe = cut(told.filter(somatic.is_candidate(o)))
    germline = a.variants.join(back, ["contig", "site_id"], "left_anti")
    named = ["contig", F.col("site_id").alias("var_id"), "pos", "vtype", F.greatest("ref_len", "alt_len").alias("len"), gap_bases().alias("gap")]
    svs = maybe.filter(somatic.is_sv(o)).select(*named, "alt_cov")
    kept = somatic.without_germline(somatic.merge_alike(svs, ["contig"]), germline.select(*named), ["contig"])
    is_snp = F.col("vtype") == SNP
    out = (
        maybe.filter(is_snp)
        .unionByName(maybe.join(kept.select("contig", F.col("var_id").alias("site_id")), ["contig", "site_id"], "left_semi"))
    )
    covered = F.aggregate(kernels.dust_mask("alt_seq"), F.lit(0), lambda s, x: s + x["en"] - x["st"])
    found = cut(out.withColumn("is_low_complexity", (F.col("vtype") == INS) & (covered > 0.8 * F.length("alt_seq"))))
    return found, a.seen.select(*extra_seen.columns).unionByName(extra_seen).join(found.select("contig", "site_id"), ["contig", "site_id"], "left_semi")


def alt_evidence(a: Analysis, found: DataFrame, seen: DataFrame, reference: DataFrame, o: Options) -> tuple[DataFrame, DataFrame]:
    """Evidence columns of each candidate over its alt reads on the chosen phase set and haplotype, with that choice; and those reads."""
    alleles = matrix(seen, found, a.reads, a.events, o, fuzzy=True).join(best_haplotype(a.read_haps), "read_id", "left")
    profile = cut(alleles.select("contig", F.col("site_id").alias("var_id"), "read_id", "allele", F.coalesce("hap", F.lit(0)).alias("hap"), F.coalesce("phase_set", F.lit(-1).cast("long")).alias("phase_set")))
    snps = a.variants.filter("category = 'N'").select("contig", "chunk", "site_id", "var_id")
    on_snps = a.seen.join(snps, ["contig", "site_id"]).join(a.read_haps, ["contig", "chunk", "read_id"])
    on_snps = on_snps.select("contig", "chunk", "read_id", "hap", "var_id", F.col("alt").cast("int").alias("allele"))
    conflict = somatic.conflicting_reads(on_snps, a.var_haps, ["contig", "chunk"]).select("contig", "read_id").distinct()
    fair = profile.join(conflict, ["contig", "read_id"], "left_anti")
    chosen = somatic.choose_phase_set(fair, ["contig"], o)
    own = fair.filter("allele = 1").join(chosen.withColumnRenamed("phase_set", "_ps"), ["contig", "var_id"])
    own = cut(own.filter("_ps = 0 OR (phase_set = _ps AND hap = alt_hap)").select("contig", "var_id", "read_id", "alt_hap", "_ps"))
    first = F.substring("bases", 1, 1).alias("ref")
    at = (
        own.join(
            found.select("contig", F.col("site_id").alias("var_id"), "pos", "vtype", "ref_len", "alt_len", "alt_seq", first),
            ["contig", "var_id"],
        )
    )
    r = a.reads.select("contig", "read_id", "events", "seq", "qual", (F.col("flag").bitwiseAND(16) > 0).alias("rev"))
    with_read = at.join(r, ["contig", "read_id"]).withColumn("op", op_of())
    here = lambda e: (e["pos"] == F.col("pos")) & (e["op"] == F.col("op"))
    # what is known nearby, with the haplotypes that have it
    told = a.variants.join(a.var_haps, ["contig", "chunk", "var_id"], "left").select(
        "contig", F.explode(F.array_distinct(F.array(*(F.floor((F.col("pos") + d) / 1000) for d in (-2 * AROUND, 2 * AROUND))))).alias("_b"),
        F.struct("pos", op_of().alias("op"), F.greatest("ref_len", "alt_len").cast("int").alias("len"), F.col("alt_seq").alias("alt"), "phase_set", "hap1", "hap2").alias("k"),
    )
    known = told.groupBy("contig", "_b").agg(F.collect_list("k").alias("known"))  # variants of a kilobase
    rows = (
        with_read.withColumn("_e", F.try_element_at(F.filter("events", here), F.lit(1))).filter("_e IS NOT NULL")
        .withColumn("_b", F.floor(F.col("pos") / 1000)).join(known, ["contig", "_b"], "left")
    )
    lo = F.greatest(F.col("pos") - AROUND, F.lit(1))
    near = (
        fasta.base_at(reference, found.select("site_id", "contig", lo.alias("pos")), F.lit(2 * AROUND + 1))
        .select(F.col("site_id").alias("var_id"), F.col("bases").alias("hap_seq"), F.col("pos").alias("hap_lo"))
    )
    rows = rows.join(near, "var_id", "left")
    told = evidence.of_reads(rows.select(
        "read_id", "var_id", "rev", "pos", "op", F.col("_e.len").alias("len"), F.col("_e.qi").alias("qi"), F.col("_e.low_qual").alias("low_qual"), "events", "seq", "qual", "known",
        "hap_seq", "hap_lo", F.col("alt_seq").alias("alt"), "ref", F.col("alt_hap").cast("int").alias("hap"), F.col("_ps").alias("phase_set"),
    ))
    return somatic.evidence(told, []).join(chosen, "var_id"), own.select("contig", "var_id", "read_id")


def call(a: Analysis, reference: DataFrame, o: Options, te_index: DataFrame | None = None, elements: DataFrame | None = None) -> DataFrame:
    """Somatic calls in the columns of germline ones, with somatic, mei and the element's marks. elements: te_id, name of the index's elements."""
    found, seen = candidates(a, reference, o, elements, te_index)
    seen = cut(seen)
    told, own = alt_evidence(a, found, seen, reference, o)
    told = cut(told)
    chunk = F.floor((F.col("pos") - 1) / o.window).alias("chunk")
    quartiles = (
        pileup.quality_quartiles(
            pileup.quality_histogram(a.reads.select("contig", chunk, "qual"), ["contig", "chunk"]), ["contig", "chunk"],
        )
    )
    germline = a.variants.join(demoted(a), ["contig", "site_id"], "left_anti")
    near = sites.nearest(found.select("contig", "pos", "site_id"), germline.select("contig", "pos"), ["contig"])
    near = near.select(F.col("site_id").alias("var_id"), F.col("distance").cast("int").alias("var_distance"))
    rows = (
        told.drop("contig").join(found.withColumnRenamed("site_id", "var_id"), "var_id").join(near, "var_id", "left")
        .withColumn("chunk", chunk).join(quartiles, ["contig", "chunk"], "left")
    )
    # candidates() has left out those like germline variants
    rows = (
        rows.withColumn("like_germline", F.lit(False))
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("q1", "q2", "q3", "tsd_len", "polya_len")})
    )
    good = cut(rows.filter(somatic.passes(o)))
    spans = good.select("contig", "var_id", F.col("pos").alias("beg"), (F.col("pos") + F.greatest("ref_len", F.lit(1)) - 1).alias("end"))
    kept = somatic.post_process(spans, own.join(good.select("contig", "var_id"), ["contig", "var_id"], "left_semi"), ["contig"], o)
    final = good.join(kept.select("contig", "var_id"), ["contig", "var_id"], "left_semi")
    if o.read_names:
        names = own.join(a.reads.select("read_id", "qname"), "read_id").select("contig", "var_id", "qname")
        final = genotype.with_names(final, names, ["contig", "var_id"])
    ref, alt, is_gap = F.col("ref_cov"), F.col("alt_cov"), F.col("vtype") != SNP
    first = F.substring("bases", 1, 1)
    length = F.col("alt_len") - F.col("ref_len")
    long = F.abs(length) >= o.min_sv_length
    out = final.select(
        "contig", F.when(is_gap, F.col("pos") - 1).otherwise(F.col("pos")).alias("pos"), F.when(F.col("vtype") == INS, first).otherwise(F.col("bases")).alias("ref"),
        F.when(F.col("vtype") == INS, F.concat(first, "alt_seq")).when(F.col("vtype") == DEL, first).otherwise(F.col("alt_seq")).alias("alt"),
        stats.variant_qual(ref, alt, o.error_rate, o.log10_error, o.max_qual).alias("qual"),
        F.when(F.col("phase_set") == 0, "0/1").when(F.col("alt_hap") == 1, "1|0").otherwise("0|1").alias("gt"),
        (ref + alt).cast("int").alias("dp"), ref.cast("int").alias("ref_ad"), alt.cast("int").alias("alt_ad"), stats.genotype_quality(ref, alt, o.max_gq).alias("gq"),
        F.when(F.col("phase_set") > 0, F.col("phase_set")).alias("ps"), F.when(long, F.when(length > 0, "INS").otherwise("DEL")).alias("svtype"), F.when(long, length).cast("int").alias("svlen"),
        F.lit(True).alias("somatic"), somatic.is_element().alias("mei"), "tsd", F.col("tsd_len").alias("tsdlen"), F.col("polya_len").alias("polyalen"),
        F.when(F.col("tsd_len") > 0, F.col("pos")).alias("tsdpos1"), F.when((F.col("tsd_len") > 0) & (F.col("vtype") == DEL), F.col("pos") + F.col("ref_len")).alias("tsdpos2"), "repname",
        *(["alt_reads"] if o.read_names else []),
    )
    return genotype.final_filter(out, o)
