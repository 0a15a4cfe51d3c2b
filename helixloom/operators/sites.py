"""Candidate sites: distinct keys, the leader fold of long insertions, order, comparison, nearness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixloom.schemas import DEL, INS, SITE_KEY, SNP


def vcf_pos(pos: Column, vtype: Column) -> Column:
    """A gap's position is the base after its anchor; in output it is the anchor."""
    return F.when(vtype == SNP, pos).otherwise(pos - 1)


def site_order() -> list[Column]:
    return [F.col("contig"), vcf_pos(F.col("pos"), F.col("vtype")), F.col("vtype"), F.col("ref_len"), F.col("alt_len"), F.col("alt_seq")]


def distinct_sites(sites: DataFrame) -> DataFrame:
    return sites.select(*SITE_KEY).distinct()


def leader_fold(lengths: Column, ratio: float = 0.8) -> Column:
    """Kept lengths of an ascending array: a length joins the last kept one if that is at least `ratio` of it, else it is kept itself."""
    zero = F.array().cast("array<int>")
    return (
        F.aggregate(
            lengths, zero,
            lambda kept, x: F.when(F.coalesce(F.element_at(F.when(F.size(kept) > 0, kept), -1) >= ratio * x, F.lit(False)), kept).otherwise(F.array_append(kept, x)),
        )
    )


def distinct_long_insertions(sites: DataFrame, min_sv: int = 30, ratio: float = 0.8, least: int = 1) -> DataFrame:
    """Sites with insertions of at least min_sv folded by leaders within (contig, pos); other sites are distinct by key, those that occur in at least `least` rows.

    Likeness is not transitive, so this is an ordered fold; distinct lengths of a position bound its group.
    """
    is_long = (F.col("vtype") == INS) & (F.col("alt_len") >= min_sv)
    short = distinct_sites(sites.filter(~is_long)) if least < 2 else sites.filter(~is_long).groupBy(*SITE_KEY).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).drop("_n")
    long = sites.filter(is_long).groupBy("contig", "pos", "ref_len", "alt_len").agg(F.min("alt_seq").alias("alt_seq"))
    seqs = long.groupBy("contig", "pos", "ref_len").agg(F.array_sort(F.collect_set(F.struct("alt_len", "alt_seq"))).alias("all"))
    kept = seqs.withColumn("kept", leader_fold(F.transform("all", lambda x: x["alt_len"]), ratio))
    first = kept.select("contig", "pos", "ref_len", F.explode(F.filter("all", lambda x: F.array_contains("kept", x["alt_len"]))).alias("x"))
    return short.unionByName(first.select("contig", "pos", F.lit(INS).alias("vtype"), "ref_len", F.col("x.alt_len").alias("alt_len"), F.col("x.alt_seq").alias("alt_seq")))


def overlaps(a: str, b: str) -> Column:
    """Site overlap of two aliases: insertions of one position; an insertion strictly inside; else half-open overlap."""
    c = lambda x, y: F.col(f"{x}.{y}")
    ins_a, ins_b = c(a, "vtype") == INS, c(b, "vtype") == INS
    end = lambda x: c(x, "pos") + c(x, "ref_len")
    return (
        F.when(ins_a & ins_b, c(a, "pos") == c(b, "pos"))
        .when(ins_a, (c(a, "pos") > c(b, "pos")) & (c(a, "pos") < end(b)))
        .when(ins_b, (c(b, "pos") > c(a, "pos")) & (c(b, "pos") < end(a)))
        .otherwise((c(a, "pos") < end(b)) & (c(b, "pos") < end(a)))
    )


def nearly_overlaps(a: str, b: str) -> Column:
    """Two insertions no farther apart than the shorter is long, or two deletions that touch."""
    c = lambda x, y: F.col(f"{x}.{y}")
    ins = (c(a, "vtype") == INS) & (c(b, "vtype") == INS) & (F.abs(c(a, "pos") - c(b, "pos")) <= F.least(c(a, "alt_len"), c(b, "alt_len")))
    gap = (c(a, "vtype") == DEL) & (c(b, "vtype") == DEL) & (c(a, "pos") <= c(b, "pos") + c(b, "ref_len")) & (c(b, "pos") <= c(a, "pos") + c(a, "ref_len"))
    return ins | gap


def nearest(sites: DataFrame, others: DataFrame, keys: list[str], stretch: int = 4_000_000) -> DataFrame:
    """Adds `distance` to the nearest row of `others` (keys, pos) at or around each site; null without any on the key.

    Rows are ordered within stretches of a key; the last of the others before a stretch and the first behind it come from one row a stretch.
    """
    both = (
        sites.withColumn("_o", F.lit(None).cast("long"))
        .unionByName(others.select(*keys, "pos").distinct().withColumn("_o", F.col("pos").cast("long")), allowMissingColumns=True)
    )
    both = both.withColumn("_bin", F.floor(F.col("pos") / stretch))
    w = Window.partitionBy(*keys, "_bin")
    # at a position the other rows come first going up, and again first going down
    up, down = w.orderBy("pos", F.col("_o").isNull()), w.orderBy(F.desc("pos"), F.col("_o").isNull())
    across = Window.partitionBy(*keys).orderBy("_bin")
    ends = both.groupBy(*keys, "_bin").agg(F.max("_o").alias("_last"), F.min("_o").alias("_first"))
    ends = (
        ends.select(
            *keys, "_bin", F.max("_last").over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_lo"),
            F.min("_first").over(across.rowsBetween(1, Window.unboundedFollowing)).alias("_hi"),
        )
    )
    before, after = F.last("_o", ignorenulls=True).over(up), F.last("_o", ignorenulls=True).over(down)
    placed = both.withColumn("_before", before).withColumn("_after", after).filter("_o is null").join(ends, [*keys, "_bin"])
    lo, hi = F.coalesce("_before", "_lo"), F.coalesce("_after", "_hi")
    return placed.withColumn("distance", F.least(F.col("pos") - lo, hi - F.col("pos"))).drop("_o", "_before", "_after", "_bin", "_lo", "_hi")


def dense_variants(variants: DataFrame, keys: list[str], window: int, m: int) -> DataFrame:
    """Adds `dense` to variants (keys, id, beg, end): part of m+1 neighbours within `window`, from the first's end to the last's begin."""
    order = Window.partitionBy(*keys).orderBy("beg", "id")
    starts = F.coalesce(F.lead("beg", m).over(order) - F.col("end") < window, F.lit(False))
    return variants.withColumn("_s", starts.cast("int")).withColumn("dense", F.max("_s").over(order.rowsBetween(-m, 0)) == 1).drop("_s")


def dense_differences(events: DataFrame, keys: list[str], window: int = 100, n: int = 6) -> DataFrame:
    """keys, dense: any n consecutive events of the keys within `window`."""
    order = Window.partitionBy(*keys).orderBy("pos", "id")
    close = F.coalesce(F.col("pos") - F.lag("pos", n - 1).over(order) <= window, F.lit(False))
    return events.withColumn("_c", close).groupBy(*keys).agg(F.max("_c").alias("dense"))


def merge_sites(old: DataFrame, new: DataFrame, values: list[str]) -> DataFrame:
    """Full-outer merge by site key: values of `old` win; `origin` is old, new or both."""
    a = old.select(*SITE_KEY, F.struct(*values).alias("_a"))
    b = new.select(*SITE_KEY, F.struct(*values).alias("_b"))
    both = a.join(b, SITE_KEY, "full_outer")
    origin = F.when(F.col("_b").isNull(), "old").when(F.col("_a").isNull(), "new").otherwise("both")
    return both.select(*SITE_KEY, *(F.coalesce(f"_a.{v}", f"_b.{v}").alias(v) for v in values), origin.alias("origin"))


def merge_haplotypes(hap1: DataFrame, hap2: DataFrame) -> DataFrame:
    """Sites of two haplotypes: `haps` is 3 where both have one, else 1 or 2."""
    a, b = hap1.select(*SITE_KEY).distinct().withColumn("_a", F.lit(1)), hap2.select(*SITE_KEY).distinct().withColumn("_b", F.lit(2))
    return a.join(b, SITE_KEY, "full_outer").select(*SITE_KEY, (F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0))).alias("haps"))
