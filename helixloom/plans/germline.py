"""The whole path from aligned reads to phased calls as one DataFrame plan.

reads: qname, flag, contig, pos, mapq, cigar, seq, qual, tags. contigs: contig, length. reference: bins of sources.fasta.binned().
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixloom.config import HIFI, Options
from helixloom.lineage import cut
from helixloom.functions import sequences as seq
from helixloom.operators import genotype, intervals, noisy, phasing, pileup, sites
from helixloom.operators.decode import decode
from helixloom.operators.reads import region_reads, workable
from helixloom.plans.functions import dust_mask, mean_error
from helixloom.schemas import DEL, INS, SITE_KEY, SNP
from helixloom.sinks.alignments import haplotagged, owned
from helixloom.sources import fasta, sam


def decoded(reads: DataFrame, contigs: DataFrame, reference: DataFrame, o: Options) -> DataFrame:
    """Usable reads with events and noisy intervals. Only reads that carry neither = and X, nor cs or MD, are joined with their reference slice."""
    rows = sam.usable(reads, o.min_mapq).join(contigs.select("contig", F.col("length").alias("contig_length")), "contig")
    plain = F.col("cigar").rlike("[=X]") | F.map_contains_key("tags", "cs") | F.map_contains_key("tags", "MD")
    told = rows.filter(plain).withColumn("ref_beg", F.lit(1).cast("long")).withColumn("ref_seq", F.lit(None).cast("string"))
    untold = numbered(rows.filter(~plain), "_row")
    at = fasta.slices(reference, untold.select("_row", "contig", F.col("pos").alias("beg"), "end"), 0).select("_row", "ref_beg", "ref_seq")
    both = told.unionByName(untold.join(at, "_row", "left").withColumn("ref_beg", F.coalesce("ref_beg", F.lit(1))).drop("_row"))
    return numbered(decode(both, o).filter("kept").drop("ref_seq", "ref_beg"), "read_id")


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """`rows` from a checkpoint, each with a number of its own: its partition and place there, the same whenever it is read. Unlike hashes, numbers never meet."""
    return cut(rows).withColumn(name, F.monotonically_increasing_id())


def site_events(reads: DataFrame, o: Options) -> DataFrame:
    """contig, read_id, rev and the site keys of every difference, with low_qual."""
    e = (
        reads.select("contig", "read_id", (F.col("flag").bitwiseAND(16) > 0).alias("rev"), F.explode("events").alias("e"))
        .filter(F.col("e.op").isin("X", "I", "D"))
    )
    vtype = F.when(F.col("e.op") == "I", INS).when(F.col("e.op") == "D", DEL).otherwise(SNP)
    ref_len = F.when(F.col("e.op") == "I", 0).otherwise(F.col("e.len"))
    alt_len = F.when(F.col("e.op") == "D", 0).otherwise(F.col("e.len"))
    return (
        e.select(
            "contig", "read_id", "rev", F.col("e.pos").alias("pos"), vtype.alias("vtype"), ref_len.alias("ref_len"),
            alt_len.alias("alt_len"), F.coalesce("e.alt", F.lit("")).alias("alt_seq"), F.col("e.low_qual").alias("low_qual"),
        )
    )


def observed(reads: DataFrame, events: DataFrame, found: DataFrame, o: Options) -> DataFrame:
    """contig, site_id, read_id, alt, rev, bq: every spanning read at every site. Long insertions match by likeness of length, other events by key."""
    long = (F.col("vtype") == INS) & (F.col("alt_len") >= o.min_sv_length)
    exact = events.filter(~long).join(found.filter(~long).select(*SITE_KEY, "site_id"), SITE_KEY).select("read_id", "site_id", "low_qual")
    led = found.filter(long).select("contig", "pos", F.col("alt_len").alias("_l"), "site_id")
    like = events.filter(long).join(led, ["contig", "pos"]).filter(F.least("alt_len", "_l") >= 0.8 * F.greatest("alt_len", "_l"))
    like = (
        like.groupBy("read_id", "contig", "pos", "alt_len", "low_qual")
        .agg(F.min_by("site_id", F.struct(F.abs(F.col("_l") - F.col("alt_len")), "site_id")).alias("site_id"))
        .select("read_id", "site_id", "low_qual")
    )
    alleles = (
        exact.unionByName(like).groupBy("read_id", "site_id").agg(F.min("low_qual").alias("low"))
        .select("read_id", "site_id", F.lit(True).alias("alt"), F.when(F.col("low"), 0).otherwise(255).alias("bq"))
    )
    # a site's span begins at the base before a gap, so that only reads beyond it count
    at = (
        found.select(
            "contig", "site_id", F.when(F.col("vtype") == SNP, F.col("pos") - 1).otherwise(F.col("pos") - 2).alias("pos"),
            (F.col("pos") + F.greatest("ref_len", F.lit(1)) - 1 + (F.col("vtype") != SNP).cast("int")).alias("end"),
        )
    )
    return (
        pileup.cover(
            at.withColumn("pos", F.greatest("pos", F.lit(0))),
            reads.select("contig", "read_id", (F.col("flag").bitwiseAND(16) > 0).alias("rev"), (F.col("pos") - 1).alias("st"), F.col("end").alias("en")),
            alleles, ["contig"],
        )
    )


def other_events(found: DataFrame, events: DataFrame, fuzzy: bool = False) -> DataFrame:
    """contig, site_id, read_id where a read shows a difference that overlaps a site and isn't its allele; `fuzzy` counts long gaps that nearly overlap too."""
    reach = F.when(F.lit(fuzzy) & (F.col("vtype") == INS), F.col("alt_len")).otherwise(1)
    key = F.struct(*SITE_KEY)
    a = (
        found.select(
            "contig", "site_id", key.alias("key"), (F.col("pos") - 1 - reach).alias("st"),
            (F.col("pos") + F.col("ref_len") + reach).alias("en"),
        )
    )
    b = (
        events.select(
            "contig", "read_id", key.alias("key"), (F.col("pos") - 1).alias("st"), (F.col("pos") + F.col("ref_len") + 1).alias("en"),
        )
    )
    near = (
        intervals.overlap_join(a, b, ["contig"], 10_000)
        .select(
            "contig", F.col("a_site_id").alias("site_id"), F.col("b_read_id").alias("read_id"), F.col("a_key").alias("a"),
            F.col("b_key").alias("b"),
        )
    )
    meet = sites.overlaps("a", "b") | (sites.nearly_overlaps("a", "b") if fuzzy else F.lit(False))
    return near.filter((F.col("a") != F.col("b")) & meet).select("contig", "site_id", "read_id").distinct()


def matrix(seen: DataFrame, found: DataFrame, reads: DataFrame, events: DataFrame, o: Options, fuzzy: bool = False) -> DataFrame:
    """contig, site_id, read_id, allele of the sites `found`: 1 the allele, 0 the reference, -1 another difference there, -2 the allele in low quality.

    A read that shows nothing at a site within one of its own noisy intervals says nothing about it.
    """
    own = seen.join(found.select("contig", "site_id"), ["contig", "site_id"], "left_semi")
    other = other_events(found, events, fuzzy).withColumn("_other", F.lit(True))
    noise = reads.select("contig", "read_id", F.explode("noisy").alias("n")).select("contig", "read_id", "n.st", "n.en")
    blind = (
        intervals.overlap_join(site_spans(found), noise, ["contig"], 10_000)
        .select("contig", F.col("a_site_id").alias("site_id"), F.col("b_read_id").alias("read_id")).distinct()
        .withColumn("_blind", F.lit(True))
    )
    told = own.join(other, ["contig", "site_id", "read_id"], "left").join(blind, ["contig", "site_id", "read_id"], "left")
    allele = F.when(F.col("alt") & (F.col("bq") < o.min_base_quality), -2).when(F.col("alt"), 1).when(F.col("_other"), -1).otherwise(0)
    return told.withColumn("allele", allele).filter("allele <> 0 OR _blind IS NULL").select("contig", "site_id", "read_id", "allele")


def repeat_context(found: DataFrame, reference: DataFrame) -> DataFrame:
    """site_id, bases (the anchor and on), repeat: a short indel in or of a tandem repeat, by the reference around it."""
    left = (
        fasta.base_at(
            reference, found.select("site_id", "contig", F.greatest(F.col("pos") - 18, F.lit(1)).alias("pos"), F.col("pos").alias("_p")),
            F.col("_p") - F.col("pos"),
        )
        .select("site_id", F.col("bases").alias("left"))
    )
    right = fasta.base_at(reference, found.select("site_id", "contig", "pos", "vtype", "ref_len", "alt_seq"), F.lit(60) + F.col("ref_len"))
    both = right.withColumnRenamed("bases", "right").join(left, "site_id")
    short = F.greatest(F.col("ref_len"), F.length("alt_seq")) <= 5
    unit = F.when(F.col("vtype") == DEL, F.substring("right", F.lit(1), F.col("ref_len"))).otherwise(F.col("alt_seq"))
    hit = seq.tandem_right(F.col("right")) | seq.tandem_left(F.col("left")) | seq.triple_repeat(unit, F.col("right"))
    bases = (
        F.when(F.col("vtype") == SNP, F.substring("right", 1, 1))
        .otherwise(F.concat(F.substring(F.col("left"), F.greatest(F.length("left"), F.lit(1)), F.lit(1)), F.substring("right", F.lit(1), F.col("ref_len"))))
    )
    hp = (F.col("vtype") == DEL) & F.coalesce(seq.homopolymer_at(F.col("right"), F.lit(1)), F.lit(False))
    return (
        both.select(
            "site_id", bases.alias("bases"), ((F.col("vtype") != SNP) & short & F.coalesce(hit, F.lit(False))).alias("repeat"),
            hp.alias("is_hp"),
        )
    )


def low_complexity(reference: DataFrame, places: DataFrame, width: int = fasta.BIN) -> DataFrame:
    """contig, st, en: low-complexity stretches of the contigs that have `places`. A stretch scores within a window, so a bin with the window's bases of the next one sees all that begin in it."""
    ahead = reference.select("contig", (F.col("bin") - 1).alias("bin"), F.substring("seq", 1, HIFI.dust_window).alias("_next"))
    own = reference.join(places.select("contig").distinct(), "contig", "left_semi").join(ahead, ["contig", "bin"], "left")
    found = own.select("contig", (F.col("bin") * width).alias("_at"), F.inline(dust_mask(F.concat("seq", F.coalesce("_next", F.lit(""))))))
    return (
        intervals.merge_fixed(
            found.select("contig", (F.col("_at") + F.col("st")).alias("st"), (F.col("_at") + F.col("en")).alias("en")), ["contig"], 0,
        )
        .select("contig", "st", "en")
    )


def noisy_regions(reads: DataFrame, reference: DataFrame, o: Options) -> DataFrame:
    """contig, st, en, label, region_id: noisy intervals of all reads, extended by low complexity and merged by label, with enough noisy reads among those that cover them."""
    spans = reads.select("contig", "read_id", F.explode("noisy").alias("n")).select("contig", "read_id", "n.st", "n.en", "n.label")
    places = cut(spans.select("contig", "st", "en", "label").distinct())
    wide = intervals.extend_by(places, cut(low_complexity(reference, places)), ["contig"], 10_000)
    merged = numbered(intervals.merge_labelled(wide.select("contig", "st", "en", "label"), ["contig"]), "region_id")
    fit = pileup.supported(pileup.noisy_read_ratio(merged, covers(reads), spans, ["contig"], 10_000), o)
    return merged.join(fit.select("contig", "region_id"), ["contig", "region_id"], "left_semi").filter("en > st")


def covers(reads: DataFrame) -> DataFrame:
    return reads.select("contig", "read_id", (F.col("pos") - 1).alias("st"), F.col("end").alias("en"))


def contained(counted: DataFrame, regions: DataFrame) -> DataFrame:
    """contig, site_id of the sites that lie in a region."""
    return (
        intervals.contain_join(site_spans(counted), regions.select("contig", "st", "en"), ["contig"], 10_000)
        .select("contig", F.col("a_site_id").alias("site_id")).distinct()
    )


def site_spans(counted: DataFrame) -> DataFrame:
    return (
        counted.select(
            "contig", "site_id", (F.col("pos") - 1).alias("st"), (F.col("pos") - 1 + F.greatest("ref_len", F.lit(1))).alias("en"),
        )
    )


def grown_regions(reads: DataFrame, judged: DataFrame, regions: DataFrame, reference: DataFrame, o: Options) -> DataFrame:
    """contig, st, en, region_id: `regions`, and with them indels in repeats and sites that overlap others where enough reads are noisy, each extended by
    low complexity; merged, then grown until noisy_flank bases on both sides hold no candidate."""
    repeats = site_spans(judged.filter("category = 'R'"))
    rest = site_spans(judged.filter(~F.col("category").isin("L", "B", "R")))
    others = site_spans(judged.filter(~F.col("category").isin("L", "B")))
    met = (
        intervals.overlap_join(rest, others, ["contig"], 10_000).filter("a_site_id <> b_site_id")
        .select("contig", F.col("a_site_id").alias("site_id")).distinct()
    )
    crossing = rest.join(met, ["contig", "site_id"], "left_semi")
    hard = cut(repeats.withColumn("sure", F.lit(True)).unionByName(crossing.withColumn("sure", F.lit(False))).withColumnRenamed("site_id", "region_id"))
    wide = cut(intervals.extend_by(hard, cut(low_complexity(reference, hard)), ["contig"], 10_000))
    noise = reads.select("contig", "read_id", F.explode("noisy").alias("n")).select("contig", "read_id", "n.st", "n.en")
    fit = (
        pileup.noisy_read_ratio(wide.filter("NOT sure"), covers(reads), noise, ["contig"], 10_000)
        .filter(F.col("ratio") >= o.min_alt_fraction)
    )
    added = (
        wide.filter("sure")
        .unionByName(wide.filter("NOT sure").join(fit.select("contig", "region_id"), ["contig", "region_id"], "left_semi"))
    )
    merged = (
        intervals.merge_labelled(
            regions.select("contig", "st", "en", "label").unionByName(added.select("contig", "st", "en", F.lit(1).cast(regions.schema["label"].dataType).alias("label"))),
            ["contig"],
        )
    )
    near = site_spans(judged.filter(F.col("category").isin("N", "I", "H", "R")))
    return numbered(intervals.flanked(cut(merged), near, ["contig"], o.noisy_flank), "region_id")


def phase(profile: DataFrame, variants: DataFrame, o: Options) -> tuple[DataFrame, DataFrame]:
    """Reads and variants with stitched haplotypes and phase sets. profile: contig, chunk, read_id, read_rank, var_id, allele; variants with contig and chunk."""

    both = cut(phasing.two_means(profile, variants, ["contig", "chunk"], o))
    reads = both.filter("kind = 'read'").select("contig", "chunk", F.col("id").alias("read_id"), "hap", "phase_set")
    of = both.filter("kind = 'variant'").select("contig", "chunk", F.col("id").alias("var_id"), "phase_set", "hap1", "hap2")
    chains = phasing.stitch_chains(phasing.stitch_votes(reads), variants)
    return cut(phasing.apply_stitch(reads, chains, ["hap"])), cut(phasing.apply_stitch(of, chains, ["hap1", "hap2"]))


@dataclass(frozen=True)
class Analysis:
    """The tables that calls are made from; each is cut from its lineage."""

    reads: DataFrame  # decoded, with read_id, events, noisy
    events: DataFrame  # contig, read_id, rev, site key, low_qual: every difference of every read
    seen: DataFrame  # contig, site_id, read_id, alt, rev, bq: every spanning read at every site
    regions: DataFrame  # noisy regions
    windows: DataFrame  # work_windows()
    counted: DataFrame  # sites outside of them, with counters, bases and category
    variants: DataFrame  # clean germline candidates with chunk and var_id
    profile: DataFrame  # contig, chunk, read_id, read_rank, var_id, allele
    read_haps: DataFrame  # contig, chunk, read_id, hap, phase_set
    var_haps: DataFrame  # contig, chunk, var_id, phase_set, hap1, hap2


def work_windows(clean: DataFrame, contigs: DataFrame, o: Options) -> DataFrame:
    """contig, base, carry, begs: the windows of all contigs. One whose sites (contig, pos, total_cov) have more than max_window_rows alleles of reads is parted:
    `begs` are the positions where its parts begin, and `carry` how many parts more than windows lie before it on the contig."""
    base = F.floor((F.col("pos") - 1) / o.window).cast("long").alias("base")
    before = Window.partitionBy("contig", "base").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    sized = clean.select("contig", base, "pos", "total_cov").withColumn("_part", F.floor(F.coalesce(F.sum("total_cov").over(before), F.lit(0)) / o.max_window_rows))
    begin = sized.groupBy("contig", "base", "_part").agg(F.min("pos").alias("beg"))
    begs = begin.groupBy("contig", "base").agg(F.array_sort(F.collect_set("beg")).alias("begs"))
    every = contigs.select("contig", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / o.window).cast("long"))).alias("base"))
    earlier = Window.partitionBy("contig").orderBy("base").rowsBetween(Window.unboundedPreceding, -1)  # windows of a contig, a few hundred
    more = F.greatest(F.coalesce(F.size("begs"), F.lit(1)) - 1, F.lit(0))
    return every.join(begs, ["contig", "base"], "left").withColumn("carry", F.coalesce(F.sum(more).over(earlier), F.lit(0)))


def in_windows(sites_: DataFrame, windows: DataFrame, o: Options) -> DataFrame:
    """Adds `chunk`: the window, or part of one, that a position lies in. Neighbouring parts have neighbouring numbers, so stitching goes over them as over windows."""
    at = sites_.withColumn("base", F.floor((F.col("pos") - 1) / o.window).cast("long")).join(windows, ["contig", "base"], "left")
    part = F.greatest(F.size(F.filter(F.coalesce("begs", F.array().cast("array<long>")), lambda b: b <= F.col("pos"))) - 1, F.lit(0))
    chunk = (F.col("base") + F.coalesce("carry", F.lit(0)) + part).cast("long").alias("chunk")
    return at.select(*sites_.columns, chunk)


def analyse(reads: DataFrame, contigs: DataFrame, reference: DataFrame, o: Options = HIFI) -> Analysis:
    """Everything up to phased reads and variants. Work on a window of o.window bases is one group; everything else is joins and aggregates."""
    rows = decoded(reads, contigs, reference, o)
    events = cut(site_events(rows, o))
    # a difference that one read alone shows is no candidate of any mode, but a long insertion may be: most differences are errors, and go before any join
    found = (
        numbered(
            sites.distinct_long_insertions(events.filter("NOT low_qual").select(*SITE_KEY), o.min_sv_length, least=min(o.min_alt_depth, o.somatic_alt)),
            "site_id",
        )
    )
    seen = cut(observed(rows, events, found, o))
    noise = cut(noisy_regions(rows, reference, o))
    counted = (
        pileup.counts(seen, ["contig", "site_id"], o.min_base_quality).join(found, ["contig", "site_id"])
        .join(repeat_context(found, reference), "site_id")
    )
    judged = cut(pileup.classify(counted.join(contained(counted, noise), ["contig", "site_id"], "left_anti"), o, F.col("repeat")))
    regions = grown_regions(rows, judged, noise, reference, o)
    counted = cut(judged.join(contained(judged, regions), ["contig", "site_id"], "left_anti"))

    order = Window.partitionBy("contig", "chunk").orderBy(F.struct("pos", "vtype", "ref_len", "alt_len", "alt_seq"))
    clean = counted.filter(F.col("category").isin("N", "I", "H"))
    windows = cut(work_windows(clean, contigs, o))
    clean = in_windows(clean, windows, o)
    variants = cut(clean.withColumn("var_id", F.row_number().over(order).cast("long")))
    alleles = matrix(seen, variants, rows, events, o).join(variants.select("contig", "site_id", "chunk", "var_id"), ["contig", "site_id"])
    profile = (
        alleles.join(rows.select("read_id", F.col("pos").alias("read_rank")), "read_id")
        .select("contig", "chunk", "read_id", "read_rank", "var_id", "allele")
    )
    profile = cut(profile)
    read_haps, var_haps = (
        phase(
            profile,
            variants.select("contig", "chunk", "var_id", "pos", "vtype", "category", F.col("total_cov").cast("int").alias("total_cov"), "is_hp"),
            o,
        )
    )
    return Analysis(rows, events, seen, regions, windows, counted, variants, profile, read_haps, var_haps)


#: What genotype() reads.
GENOTYPED = ["contig", "pos", "vtype", "ref_len", "alt_len", "alt_seq", "ref_cov", "alt_cov", "hap1", "hap2", "phase_set", "top_allele", "bases"]


def calls_of(a: Analysis, reference: DataFrame, o: Options = HIFI) -> tuple[DataFrame, DataFrame]:
    """(germline calls, haplotypes of reads): clean variants and those of noisy regions by consensus, phased together.

    The first sweep calls regions with the haplotypes of clean variants. Then all variants phase the reads again, and regions that had no
    call are tried once more with these, until a sweep calls none.
    """
    clean = (
        a.variants
        .select(
            "contig", "chunk", F.col("site_id").alias("key"), "pos", "vtype", "ref_len", "alt_len", "alt_seq", "ref_cov", "alt_cov",
            "category", "is_hp", "bases", F.lit(True).alias("clean"),
        )
    )
    told = (
        a.profile.join(a.variants.select("contig", "chunk", "var_id", F.col("site_id").alias("key")), ["contig", "chunk", "var_id"])
        .select("contig", "chunk", "key", "read_id", "read_rank", "allele")
    )
    hard, alleles = (cut(x) for x in from_noisy(a, a.regions, a.read_haps, reference, o))
    if hard.isEmpty():
        names, variants, haps, of = told, clean, a.read_haps, a.var_haps.join(a.variants.select("contig", "chunk", "var_id", F.col("site_id").alias("key")), ["contig", "chunk", "var_id"]).drop("var_id")
    else:
        sweep = 0
        while True:  # each sweep but the last calls a region more
            variants, haps, of = together(a, clean, told, hard, alleles, o)
            left = cut(a.regions.join(hard.select("contig", "region_id").distinct(), ["contig", "region_id"], "left_anti"))
            sweep += 1
            late, late_alleles = (cut(x) for x in from_noisy(a, left, haps, reference, o, sweep))
            if late.isEmpty():
                break
            hard, alleles = cut(hard.unionByName(late)), cut(alleles.unionByName(late_alleles))
        names = told.select("contig", "key", "read_id", "allele").unionByName(alleles)
    if o.read_names:
        alt = names.filter("allele = 1").join(a.reads.select("read_id", "qname"), "read_id").select("contig", "key", "qname")
        variants = genotype.with_names(variants, alt, ["contig", "key"])
    known = variants.join(of, ["contig", "chunk", "key"]).withColumn("top_allele", F.when(F.col("alt_cov") > F.col("ref_cov"), 1).otherwise(0))
    cols = [*GENOTYPED, *(["alt_reads"] if o.read_names else [])]
    of_kind = lambda is_clean: genotype.genotype(known.filter(F.col("clean") == is_clean).select(*cols), o, "bases").withColumn("clean", F.lit(is_clean))
    who = a.reads.select("read_id", *(c for c in ("qname", "pos", "flag", "source_idx") if c in a.reads.columns))
    return genotype.final_filter(of_kind(True).unionByName(of_kind(False)), o).dropDuplicates(["contig", "pos", "ref", "alt"]), haps.join(who, "read_id")


def together(a: Analysis, clean: DataFrame, told: DataFrame, hard: DataFrame, alleles: DataFrame, o: Options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clean and noisy variants in one order, and the haplotypes of reads and variants that both give."""
    extra = (
        in_windows(hard, a.windows, o).select(
            "contig", "chunk", "key", "pos", "vtype", "ref_len", "alt_len",
            "alt_seq", "ref_cov", "alt_cov", F.when(F.col("haps") == 3, phasing.NOISY_HOM).otherwise(phasing.NOISY_HET).alias("category"),
            F.lit(False).alias("is_hp"), "bases", F.lit(False).alias("clean"),
        )
    )
    order = Window.partitionBy("contig", "chunk").orderBy(F.struct("pos", "vtype", "ref_len", "alt_len", "alt_seq", "key"))
    variants = cut(clean.unionByName(extra).withColumn("var_id", F.row_number().over(order).cast("long")))
    rank = told.groupBy("read_id").agg(F.min("read_rank").alias("read_rank"))
    more = (
        alleles.join(extra.select("contig", "chunk", "key"), ["contig", "key"]).join(rank, "read_id", "left")
        .select("contig", "chunk", "key", "read_id", F.coalesce("read_rank", F.lit(0)).alias("read_rank"), "allele")
    )
    profile = (
        told.unionByName(more).join(variants.select("contig", "chunk", "key", "var_id"), ["contig", "chunk", "key"])
        .select("contig", "chunk", "read_id", "read_rank", "var_id", "allele")
    )
    haps, of = (
        phase(
            profile,
            variants.select("contig", "chunk", "var_id", "pos", "vtype", "category", (F.col("ref_cov") + F.col("alt_cov")).cast("int").alias("total_cov"), "is_hp"),
            o,
        )
    )
    return variants.drop("var_id"), haps, of.join(variants.select("contig", "chunk", "var_id", "key"), ["contig", "chunk", "var_id"]).drop("var_id")


def call(reads: DataFrame, contigs: DataFrame, reference: DataFrame, o: Options = HIFI) -> tuple[DataFrame, DataFrame]:
    """(calls, haplotypes of reads)."""
    return calls_of(analyse(reads, contigs, reference, o), reference, o)


def tagged(reads: DataFrame, read_haps: DataFrame) -> DataFrame:
    """All `reads` with the HP and PS of their first window; reads that weren't used lose old ones."""
    return haplotagged(reads, owned(read_haps, [c for c in ("qname", "contig", "pos", "flag", "source_idx") if c in read_haps.columns]))


def best_haplotype(read_haps: DataFrame) -> DataFrame:
    """read_id, hap, phase_set: of a read's windows the first that gives it a haplotype."""
    first = F.max_by(F.struct("hap", "phase_set"), F.struct(F.col("hap") > 0, -F.col("chunk"))).alias("h")
    return read_haps.groupBy("read_id").agg(first).select("read_id", "h.hap", "h.phase_set")


def regions_of(a: Analysis, regions: DataFrame, read_haps: DataFrame, reference: DataFrame, o: Options) -> DataFrame:
    """noisy.call() of the regions that are neither too long nor too deep, with the reads that lie over them."""
    cover = cut(region_reads(regions, covers(a.reads), ["contig"]))
    able = workable(regions, cover, ["contig"], o)
    spans = able.select("contig", "region_id", (F.col("st") + 1).alias("beg"), F.col("en").alias("end"))
    sliced = (
        fasta.slices(reference, spans, 0)
        .select("contig", "region_id", (F.col("beg") - 1).alias("st"), (F.col("beg") - 1 + F.length("ref_seq")).alias("en"), "ref_seq")
    )
    own = a.reads.join(best_haplotype(read_haps), "read_id", "left").select(
        "contig", "read_id", "seq", "events", F.coalesce("hap", F.lit(0)).alias("hap"), F.coalesce("phase_set", F.lit(-1).cast("long")).alias("phase_set"), mean_error("qual").alias("error_rate"),
    )
    return cut(noisy.call(sliced, cover, own, ["contig"], o))


def from_noisy(a: Analysis, regions: DataFrame, read_haps: DataFrame, reference: DataFrame, o: Options, sweep: int = 0) -> tuple[DataFrame, DataFrame]:
    """Sites of noisy regions from consensus of their reads (contig, region_id, key, the site's columns, ref_cov, alt_cov, haps, bases), and contig, key, read_id, allele.

    Keys are negative, so they never meet those of clean sites, and differ between sweeps.
    """
    got = regions_of(a, regions, read_haps, reference, o)
    placed = got.filter("kind = 'site'").withColumn("key", -1 - F.monotonically_increasing_id() - F.lit(sweep) * F.lit(1 << 53))
    alleles = (
        got.filter("kind = 'allele'").join(placed.select("contig", "region_id", "site", "key"), ["contig", "region_id", "site"])
        .select("contig", "key", "read_id", "allele")
    )
    n = (
        alleles.groupBy("contig", "key")
        .agg(F.count_if(F.col("allele") == 0).alias("ref_cov"), F.count_if(F.col("allele") == 1).alias("alt_cov"))
    )
    s = placed.select("contig", "region_id", "key", "pos", "vtype", "ref_len", "alt_len", "alt_seq", "haps").join(n, ["contig", "key"])
    snp = F.col("vtype") == SNP
    anchored = (
        fasta.base_at(
            reference, s.withColumn("_at", F.col("pos")).withColumn("pos", F.when(snp, F.col("pos")).otherwise(F.col("pos") - 1)),
            F.col("ref_len") + F.when(snp, 0).otherwise(1),
        )
    )
    return anchored.withColumn("pos", F.col("_at")).drop("_at"), alleles
