"""Registered queries: each operator over the driver's tables, beside the SQL that says the same."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixloom.config import HIFI, ONT
from helixloom.functions import sequences as seq
from helixloom.functions import stats
from helixloom.operators import genotype, intervals, phasing, pileup, sites
from helixloom.plans import bindings as b
from helixloom.plans.registry import ORACLES, QUERIES, query

def longs(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


# Pileup, classes, genotypes ------------------------------------------------------------------------------------------

COUNTS = f"""obs AS ({b.OBS}), counts AS (SELECT pos, count(*) FILTER (NOT (alt AND bq < 10)) AS total_cov, count(*) FILTER (alt AND bq < 10) AS low_qual_cov,
 count(*) FILTER (NOT alt AND NOT rev) AS ref_fwd, count(*) FILTER (NOT alt AND rev) AS ref_rev, count(*) FILTER (alt AND bq >= 10 AND NOT rev) AS alt_fwd, count(*) FILTER (alt AND bq >= 10 AND rev) AS alt_rev,
 count(*) FILTER (NOT alt) AS ref_cov, count(*) FILTER (alt AND bq >= 10) AS alt_cov FROM obs GROUP BY pos)"""
#: Two-sided Fisher of (alt_fwd, alt_rev) against (e, e): the margins are n = alt_fwd + alt_rev, 2e, and alt_fwd + e.
FISHER = """sup AS (SELECT pos, alt_fwd AS a, alt_rev AS b, (alt_fwd + alt_rev) // 2 AS e FROM counts WHERE alt_fwd + alt_rev >= 2),
 mass AS (SELECT pos, a, x, lgamma(a+b+1) + lgamma(2*e+1) + lgamma(a+e+1) + lgamma(b+e+1) - lgamma(a+b+2*e+1) - lgamma(x+1) - lgamma(a+b-x+1) - lgamma(a+e-x+1) - lgamma(e-a+x+1) AS lp
  FROM (SELECT pos, a, b, e, unnest(range(greatest(0, a-e), least(a+b, a+e) + 1)) AS x FROM sup)),
 obsp AS (SELECT pos, lp AS lo FROM mass WHERE x = a),
 fisher AS (SELECT pos, least(1.0, sum(CASE WHEN exp(lp) <= exp(lo) * (1 + 1e-9) THEN exp(lp) ELSE 0 END)) AS p FROM mass JOIN obsp USING (pos) GROUP BY pos)"""
CLASSES = f"""{COUNTS}, {FISHER}, site AS ({b.SITE}), classes AS (SELECT counts.*, vtype, ref_len, alt_len,
 CASE WHEN total_cov + low_qual_cov < 5 OR alt_cov < 2 THEN 'L' WHEN p < 0.01 THEN 'B' WHEN alt_cov / total_cov < 0.2 THEN 'l' WHEN alt_cov / total_cov > 0.8 THEN 'H'
 WHEN vtype <> 8 AND repeat THEN 'R' WHEN vtype = 8 THEN 'N' ELSE 'I' END AS category
 FROM counts JOIN site USING (pos) LEFT JOIN fisher USING (pos))"""


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return pileup.counts(b.observations(spark, d), ["pos"])


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return pileup.classify(_counts(spark, d).join(b.sites(spark, d), "pos"), ONT, F.col("repeat"))


@query(f"WITH {COUNTS} SELECT * FROM counts")
def pileup_counts(spark, d):
    return _counts(spark, d)


@query(f"WITH {CLASSES} SELECT pos, vtype, total_cov, low_qual_cov, alt_cov, category FROM classes")
def pileup_classify(spark, d):
    return _classes(spark, d).select("pos", "vtype", "total_cov", "low_qual_cov", "alt_cov", "category")


@query(f"WITH {CLASSES} SELECT category, count(*) AS n FROM classes GROUP BY category")
def category_histogram(spark, d):
    return _classes(spark, d).groupBy("category").agg(F.count("*").alias("n"))


@query(f"WITH {COUNTS}, {FISHER} SELECT counts.pos, alt_fwd, alt_rev, round(p, 7) AS p FROM counts LEFT JOIN fisher USING (pos)")
def strand_bias_fisher(spark, d):
    return (
        _counts(spark, d)
        .select("pos", "alt_fwd", "alt_rev", F.round(stats.strand_bias_p(F.col("alt_fwd"), F.col("alt_rev")), 7).alias("p"))
    )


ONE_SIDED = """WITH {counts}, t AS (SELECT pos, alt_fwd AS a, alt_rev AS b, ref_fwd AS c, ref_rev AS d FROM counts),
 m AS (SELECT pos, a, x, exp(lgamma(a+b+1)+lgamma(c+d+1)+lgamma(a+c+1)+lgamma(b+d+1)-lgamma(a+b+c+d+1)-lgamma(x+1)-lgamma(a+b-x+1)-lgamma(a+c-x+1)-lgamma(d-a+x+1)) AS p
  FROM (SELECT *, unnest(range(greatest(0, a-d), least(a+b, a+c)+1)) AS x FROM t))
 SELECT pos, round(least(1.0, sum(p) FILTER (x <= a)), 7) AS p_left, round(least(1.0, sum(p) FILTER (x >= a)), 7) AS p_right FROM m GROUP BY pos""".replace("{counts}", COUNTS)


@query(ONE_SIDED)
def fisher_one_sided(spark, d):
    t = [F.col(c) for c in ("alt_fwd", "alt_rev", "ref_fwd", "ref_rev")]
    return (
        _counts(spark, d)
        .select("pos", F.round(stats.fisher_left(*t), 7).alias("p_left"), F.round(stats.fisher_right(*t), 7).alias("p_right"))
    )


@query(f"""WITH {COUNTS} SELECT pos, round(lgamma(total_cov+1) - lgamma(alt_cov+1) - lgamma(total_cov-alt_cov+1) + total_cov * ln(0.5), 6) AS ln_binomial,
 round(lgamma(total_cov+1) - lgamma(alt_cov+1) - lgamma(total_cov-alt_cov+1) + lgamma(alt_cov+2) + lgamma(total_cov-alt_cov+3) - lgamma(total_cov+5) - (lgamma(2) + lgamma(3) - lgamma(5)), 6) AS ln_beta_binomial FROM counts""")
def binomial_masses(spark, d):
    k, n, lit = F.col("alt_cov"), F.col("total_cov"), F.lit
    return (
        _counts(spark, d)
        .select(
            "pos", F.round(stats.ln_binomial(k, n, lit(0.5)), 6).alias("ln_binomial"),
            F.round(stats.ln_beta_binomial(k, n, lit(2), lit(3)), 6).alias("ln_beta_binomial"),
        )
    )


QUALS = """least(60, CAST(trunc(-10 * (ref_cov * log10(0.999) + alt_cov * -3.0)) AS INT)) AS qual,
 CAST(trunc(-10 * (ref_cov * log10(0.999) + alt_cov * -3.0)) AS INT) AS pl0, CAST(trunc(10 * (ref_cov + alt_cov) * 0.301023) AS INT) AS pl1, CAST(trunc(-10 * (ref_cov * -3.0 + alt_cov * log10(0.999))) AS INT) AS pl2"""


@query(f"WITH {COUNTS}, q AS (SELECT pos, ref_cov, alt_cov, {QUALS} FROM counts) SELECT pos, qual, pl0, pl1, pl2, least(60, list_sort([pl0, pl1, pl2])[2] - least(pl0, pl1, pl2)) AS gq FROM q")
def genotype_qual(spark, d):
    ref, alt = F.col("ref_cov"), F.col("alt_cov")
    rows = (
        _counts(spark, d)
        .select(
            "pos", stats.variant_qual(ref, alt).alias("qual"), stats.phred_likelihoods(ref, alt).alias("pl"),
            stats.genotype_quality(ref, alt).alias("gq"),
        )
    )
    return rows.select("pos", "qual", F.col("pl")[0].alias("pl0"), F.col("pl")[1].alias("pl1"), F.col("pl")[2].alias("pl2"), "gq")


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """Classified sites as calls: H is homozygous, N and I are phased by the position's parity in a set named by its hundred."""
    rows = _classes(spark, d).filter(F.col("category").isin("H", "N", "I"))
    odd = F.col("pos") % 2
    hap = lambda first: F.when(F.col("category") == "H", 1).otherwise(odd if first else 1 - odd).cast("int")
    bases = (
        F.when(F.col("vtype") == 1, "A").when(F.col("vtype") == 2, F.concat(F.lit("A"), F.repeat(F.lit("C"), F.col("ref_len"))))
        .otherwise("C")
    )
    alt_seq = F.when(F.col("vtype") == 1, F.repeat(F.lit("G"), F.col("alt_len"))).when(F.col("vtype") == 2, "").otherwise("T")
    rows = (
        rows.select(
            F.lit("chr1").alias("contig"), "pos", "vtype", "ref_len", "alt_len", alt_seq.alias("alt_seq"), "ref_cov", "alt_cov",
            hap(True).alias("hap1"), hap(False).alias("hap2"), (F.floor(F.col("pos") / 100) * 100).alias("phase_set"),
            F.lit(1).alias("top_allele"), bases.alias("bases"),
        )
    )
    return genotype.final_filter(genotype.genotype(rows, ONT, "bases"), ONT)


VCF = f"""WITH {CLASSES}, c AS (SELECT *, CASE WHEN category = 'H' THEN 1 ELSE pos % 2 END AS h1, CASE WHEN category = 'H' THEN 1 ELSE 1 - pos % 2 END AS h2, pos // 100 * 100 AS s, ref_cov + alt_cov AS dp,
  CASE WHEN vtype = 1 THEN 'A' WHEN vtype = 2 THEN 'A' || repeat('C', ref_len) ELSE 'C' END AS r, CASE WHEN vtype = 1 THEN 'A' || repeat('G', alt_len) WHEN vtype = 2 THEN 'A' ELSE 'T' END AS al,
  least(60, CAST(trunc(-10 * (ref_cov * log10(0.999) + alt_cov * -3.0)) AS INT)) AS qual, [CAST(trunc(-10 * (ref_cov * log10(0.999) + alt_cov * -3.0)) AS INT), CAST(trunc(10 * (ref_cov + alt_cov) * 0.301023) AS INT), CAST(trunc(-10 * (ref_cov * -3.0 + alt_cov * log10(0.999))) AS INT)] AS pl
  FROM classes WHERE category IN ('H', 'N', 'I')),
 v AS (SELECT *, CASE WHEN vtype = 8 THEN pos ELSE pos - 1 END AS vp, list_sort(pl)[2] - list_sort(pl)[1] AS g FROM c WHERE dp >= 5 AND alt_cov >= 2)
 SELECT 'chr1' AS contig, vp AS pos, 'chr1' || chr(9) || vp || chr(9) || '.' || chr(9) || r || chr(9) || al || chr(9) || qual || chr(9) || 'PASS' || chr(9) || 'END=' || (vp + length(r) - 1)
  || CASE WHEN abs(length(al) - length(r)) >= 30 THEN ';SVTYPE=' || CASE WHEN length(al) > length(r) THEN 'INS' ELSE 'DEL' END || ';SVLEN=' || (alt_len - ref_len) ELSE '' END
  || chr(9) || 'GT:DP:AD:VAF:GQ' || CASE WHEN h1 <> h2 AND s > 0 THEN ':PS' ELSE '' END || chr(9) || CASE WHEN s > 0 THEN h1 || '|' || h2 ELSE least(h1, h2) || '/' || greatest(h1, h2) END || ':' || dp || ':' || ref_cov || ',' || alt_cov
  || ':' || printf('%.3f', CAST(CAST(alt_cov / dp AS FLOAT) AS DOUBLE)) || ':' || least(60, g) || CASE WHEN h1 <> h2 AND s > 0 THEN ':' || s ELSE '' END AS line FROM v"""


@query(VCF)
def vcf_projection(spark, d):
    return genotype.body_line(_calls(spark, d))


# Intervals -----------------------------------------------------------------------------------------------------------

IV = f"WITH iv AS ({b.IV_SQL}), a AS (SELECT * FROM iv WHERE id % 2 = 0), b AS (SELECT * FROM iv WHERE id % 2 = 1)"
WIDTH = 6 * b.HOUR


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    iv = b.intervals(spark, d)
    return iv.filter("id % 2 = 0"), iv.filter("id % 2 = 1")


@query(f"WITH iv AS ({b.IV_SQL}) SELECT x.grp, x.id AS a_id, y.id AS b_id FROM iv x JOIN iv y ON x.grp = y.grp AND x.st < y.en AND y.st < x.en AND x.id < y.id")
def interval_overlap_join(spark, d):
    iv = b.intervals(spark, d).select("grp", "id", "st", "en")
    return intervals.overlap_join(iv, iv, ["grp"], WIDTH).filter("a_id < b_id").select("grp", "a_id", "b_id")


@query(f"WITH iv AS ({b.IV_SQL}) SELECT x.st // 86400000000 AS day, count(*) AS n FROM iv x JOIN iv y ON x.st < y.en AND y.st < x.en WHERE x.id < y.id GROUP BY 1")
def interval_overlap_days(spark, d):
    """All intervals as one contig: a hot key that its bins spread. Pairs are counted, not made."""
    iv = b.intervals(spark, d).select(F.lit("all").alias("contig"), "id", "st", "en")
    return (
        intervals.overlap_later(iv, ["contig"], WIDTH // 6)
        .groupBy(F.floor(F.col("st") / 86_400_000_000).alias("day")).agg(F.sum("n").alias("n"))
    )


@query(f"{IV} SELECT a.grp, a.id AS a_id, b.id AS b_id FROM a JOIN b ON a.grp = b.grp AND b.st <= a.st AND b.en >= a.en")
def interval_contain_join(spark, d):
    x, y = _halves(spark, d)
    return (
        intervals.contain_join(x.select("grp", "id", "st", "en"), y.select("grp", "id", "st", "en"), ["grp"], WIDTH)
        .select("grp", "a_id", "b_id")
    )


@query(f"{IV} SELECT id, grp, st, en, label FROM a WHERE EXISTS (SELECT 1 FROM b WHERE a.grp = b.grp AND a.st < b.en AND b.st < a.en)")
def interval_semi(spark, d):
    return intervals.overlap_semi(*_halves(spark, d), ["grp"], WIDTH)


@query(f"{IV} SELECT id, grp, st, en, label FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.grp = b.grp AND a.st < b.en AND b.st < a.en)")
def interval_anti(spark, d):
    return intervals.overlap_semi(*_halves(spark, d), ["grp"], WIDTH, "left_anti")


ISLANDS = """i1 AS (SELECT *, max(en) OVER (PARTITION BY grp ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM iv),
 i2 AS (SELECT *, sum(CASE WHEN before IS NULL OR st > before + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY st, en ROWS UNBOUNDED PRECEDING) AS island FROM i1),
 merged AS (SELECT grp, min(st) AS st, max(en) AS en, count(*) AS n, max(label) AS label FROM i2 GROUP BY grp, island)"""


@query(f"WITH iv AS ({b.IV_SQL}), {ISLANDS.format(gap=600_000_000)} SELECT * FROM merged")
def interval_merge_fixed(spark, d):
    return intervals.merge_fixed(b.intervals(spark, d).select("grp", "st", "en", "label"), ["grp"], 600_000_000, 24 * b.HOUR)


#: Round by round, each cluster joins the first one that it may merge with, until none does.
@query(f"""WITH RECURSIVE iv AS ({b.IV_SQL}), c AS (SELECT 0 AS round, grp, st // 60000000 AS st, en // 60000000 AS en, label % 30 AS label FROM iv
 UNION ALL SELECT round, grp, st, en, label FROM (
  SELECT round + 1 AS round, grp, min(st) AS st, max(en) AS en, max(label) AS label, max(count(*)) OVER () AS most FROM (
   SELECT x.round, x.grp, x.st, x.en, x.label, min(y.st) AS root FROM (SELECT DISTINCT * FROM c) x JOIN (SELECT DISTINCT * FROM c) y ON x.grp = y.grp AND y.st <= x.st AND x.st - y.en <= least(x.label, y.label) GROUP BY ALL)
  GROUP BY round, grp, root) WHERE most > 1),
 last AS (SELECT *, max(round) OVER () AS top FROM c) SELECT DISTINCT grp, st, en, label FROM last WHERE round = top""")
def interval_merge_labelled(spark, d):
    """Minutes as positions, so that labels reach over gaps."""
    iv = (
        b.intervals(spark, d)
        .select(
            "grp", F.floor(F.col("st") / 60_000_000).alias("st"), F.floor(F.col("en") / 60_000_000).alias("en"),
            (F.col("label") % 30).alias("label"),
        )
    )
    return intervals.merge_labelled(iv, ["grp"], 1440)


@query(f"{IV} SELECT a.id, a.grp, least(a.st, coalesce(min(b.st), a.st)) AS st, greatest(a.en, coalesce(max(b.en), a.en)) AS en FROM a LEFT JOIN b ON a.grp = b.grp AND a.st < b.en AND b.st < a.en GROUP BY a.id, a.grp, a.st, a.en")
def interval_extend(spark, d):
    x, y = _halves(spark, d)
    return intervals.extend_by(x.drop("label"), y.drop("label"), ["grp"], WIDTH).select("id", "grp", "st", "en")


@query(f"""{IV}, m AS (SELECT grp, st * 1 AS st, en FROM b), s AS (SELECT id, grp, st, st + 1 AS en FROM a)
 SELECT s.id, s.grp, CASE WHEN max(CASE WHEN s.st < m.en AND m.st < s.en THEN 1 ELSE 0 END) = 1 THEN 1 WHEN count(m.st) > 0 THEN 2 ELSE 0 END AS place FROM s
 LEFT JOIN m ON s.grp = m.grp AND s.st < m.en + 5 AND m.st - 5 < s.en GROUP BY s.id, s.grp""")
def low_complexity_place(spark, d):
    x, y = _halves(spark, d)
    points = x.select("grp", "id", "st", (F.col("st") + 1).alias("en"))
    wide = y.select("grp", "st", "en")
    return intervals.low_complexity_class(points, wide, ["grp"], width=WIDTH).select("id", "grp", "place")


@query("SELECT n_name AS contig, CAST(beg AS BIGINT) AS beg, least(beg + 499999, len) AS fin FROM (SELECT n_name, (n_nationkey + 1) * 1234567 AS len, unnest(generate_series(1, (n_nationkey + 1) * 1234567, 500000)) AS beg FROM nation)")
def window_plan(spark, d):
    from helixloom.sources.regions import windows

    contigs = (
        b.table(spark, d, "nation")
        .select(F.col("n_name").alias("contig"), ((F.col("n_nationkey") + 1) * 1234567).cast("long").alias("length"))
    )
    return windows(contigs).select("contig", "beg", F.col("end").alias("fin"))


# Sites ---------------------------------------------------------------------------------------------------------------

RAW_SITES = f"SELECT CAST(l_suppkey % 5 AS VARCHAR) AS contig, l_partkey // 4 AS pos, vtype, ref_len, alt_len, CASE WHEN vtype = 2 THEN '' ELSE repeat('G', alt_len) END AS alt_seq FROM lineitem JOIN ({b.SITE}) s ON l_partkey = s.pos"


def _raw_sites(spark: SparkSession, d: str) -> DataFrame:
    s = b.sites(spark, d).withColumnRenamed("pos", "l_partkey")
    line = b.table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return (
        line.join(s, "l_partkey")
        .select(
            (F.col("l_suppkey") % 5).cast("string").alias("contig"), F.floor(F.col("l_partkey") / 4).alias("pos"), "vtype", "ref_len",
            "alt_len", F.when(F.col("vtype") == 2, "").otherwise(F.repeat(F.lit("G"), F.col("alt_len"))).alias("alt_seq"),
        )
    )


@query(f"SELECT DISTINCT * FROM ({RAW_SITES})")
def site_dedup_exact(spark, d):
    return sites.distinct_sites(_raw_sites(spark, d))


@query(f"""WITH raw AS (SELECT DISTINCT * FROM ({RAW_SITES})), l AS (SELECT contig, pos, ref_len, list_sort(list(DISTINCT alt_len)) AS xs FROM raw WHERE vtype = 1 AND alt_len >= 30 GROUP BY 1, 2, 3),
 k AS (SELECT contig, pos, ref_len, list_reduce(list_transform(xs, lambda x: [x]), lambda kept, x: CASE WHEN kept[-1] >= 0.8 * x[1] THEN kept ELSE list_concat(kept, x) END) AS kept FROM l)
 SELECT contig, pos, 1 AS vtype, ref_len, alt_len, repeat('G', alt_len) AS alt_seq FROM (SELECT contig, pos, ref_len, unnest(kept) AS alt_len FROM k) UNION ALL SELECT * FROM raw WHERE NOT (vtype = 1 AND alt_len >= 30)""")
def site_dedup_leader(spark, d):
    return sites.distinct_long_insertions(_raw_sites(spark, d))


@query(f"""WITH s AS (SELECT DISTINCT * FROM ({RAW_SITES})) SELECT a.contig, a.pos AS a_pos, a.vtype AS a_vtype, b.pos AS b_pos, b.vtype AS b_vtype, count(*) AS n FROM s a JOIN s b ON a.contig = b.contig AND b.pos BETWEEN a.pos - 60 AND a.pos + 60 AND
 CASE WHEN a.vtype = 1 AND b.vtype = 1 THEN a.pos = b.pos WHEN a.vtype = 1 THEN a.pos > b.pos AND a.pos < b.pos + b.ref_len WHEN b.vtype = 1 THEN b.pos > a.pos AND b.pos < a.pos + a.ref_len ELSE a.pos < b.pos + b.ref_len AND b.pos < a.pos + a.ref_len END
 GROUP BY 1, 2, 3, 4, 5""")
def site_overlap(spark, d):
    s = sites.distinct_sites(_raw_sites(spark, d)).withColumn("bin", F.floor(F.col("pos") / 64))
    other = s.withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    pairs = (
        s.alias("a")
        .join(
            other.alias("b"),
            [F.col("a.contig") == F.col("b.contig"), F.col("a.bin") == F.col("b.bin"), sites.overlaps("a", "b"), F.abs(F.col("a.pos") - F.col("b.pos")) <= 60],
        )
    )
    return (
        pairs.groupBy(
            F.col("a.contig").alias("contig"), F.col("a.pos").alias("a_pos"), F.col("a.vtype").alias("a_vtype"),
            F.col("b.pos").alias("b_pos"), F.col("b.vtype").alias("b_vtype"),
        )
        .agg(F.count("*").alias("n"))
    )


HALF_SITES = f"WITH s AS (SELECT DISTINCT * FROM ({RAW_SITES})), o AS (SELECT *, pos % 7 AS v FROM s WHERE pos % 3 <> 0), n AS (SELECT *, pos % 11 AS v FROM s WHERE pos % 3 <> 1)"


@query(f"""{HALF_SITES} SELECT contig, pos, vtype, ref_len, alt_len, alt_seq, coalesce(o.v, n.v) AS v, CASE WHEN n.v IS NULL THEN 'old' WHEN o.v IS NULL THEN 'new' ELSE 'both' END AS origin
 FROM o FULL OUTER JOIN n USING (contig, pos, vtype, ref_len, alt_len, alt_seq)""")
def profile_full_outer(spark, d):
    s = sites.distinct_sites(_raw_sites(spark, d))
    return (
        sites.merge_sites(
            s.filter("pos % 3 <> 0").withColumn("v", F.col("pos") % 7), s.filter("pos % 3 <> 1").withColumn("v", F.col("pos") % 11), ["v"],
        )
    )


@query(f"{HALF_SITES} SELECT contig, pos, vtype, ref_len, alt_len, alt_seq, CASE WHEN n.v IS NULL THEN 1 WHEN o.v IS NULL THEN 2 ELSE 3 END AS haps FROM o FULL OUTER JOIN n USING (contig, pos, vtype, ref_len, alt_len, alt_seq)")
def haplotype_full_outer(spark, d):
    s = sites.distinct_sites(_raw_sites(spark, d))
    return sites.merge_haplotypes(s.filter("pos % 3 <> 0"), s.filter("pos % 3 <> 1"))


@query(f"""WITH {CLASSES}, g AS (SELECT pos FROM classes WHERE category = 'H') SELECT c.pos, least(c.pos - (SELECT max(pos) FROM g WHERE g.pos <= c.pos), (SELECT min(pos) FROM g WHERE g.pos >= c.pos) - c.pos) AS distance FROM classes c""")
def nearest_variant(spark, d):
    c = _classes(spark, d).select(F.lit(1).alias("contig"), "pos", "category")
    return sites.nearest(c.select("contig", "pos"), c.filter("category = 'H'"), ["contig"], 500).select("pos", "distance")


@query("""WITH v AS (SELECT p_brand AS grp, p_partkey AS id, p_partkey AS beg, p_partkey + p_size AS fin FROM part), s AS (SELECT *, coalesce(lead(beg, 5) OVER (PARTITION BY grp ORDER BY beg, id) - fin < 100, false) AS starts FROM v)
 SELECT grp, id, max(CAST(starts AS INT)) OVER (PARTITION BY grp ORDER BY beg, id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) = 1 AS dense FROM s""")
def dense_variant_flag(spark, d):
    v = (
        b.table(spark, d, "part")
        .select(
            F.col("p_brand").alias("grp"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("beg"),
            (F.col("p_partkey") + F.col("p_size")).alias("end"),
        )
    )
    return sites.dense_variants(v, ["grp"], 100, 5).select("grp", "id", "dense")


@query("""WITH e AS (SELECT l_orderkey AS read_id, l_partkey AS pos, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS k FROM lineitem), c AS (SELECT a.read_id, max(CASE WHEN b.pos - a.pos <= 300 THEN 1 ELSE 0 END) AS m FROM e a LEFT JOIN e b ON a.read_id = b.read_id AND b.k = a.k + 2 GROUP BY 1)
 SELECT read_id, m = 1 AS dense FROM c""")
def dense_difference_flag(spark, d):
    e = b.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("read_id"), F.col("l_partkey").alias("pos"), F.lit(0).alias("id"))
    return sites.dense_differences(e, ["read_id"], 300, 3)


# Reads and qualities -------------------------------------------------------------------------------------------------

@query("""WITH t AS (SELECT p_brand AS grp, p_size AS bq FROM part), h AS (SELECT grp, bq, count(*) AS n FROM t GROUP BY 1, 2), l AS (SELECT grp, list_sort(list(bq) FILTER (n >= tot * 0.0001)) AS xs FROM (SELECT *, sum(n) OVER (PARTITION BY grp) AS tot FROM h) GROUP BY grp)
 SELECT grp, coalesce(xs[len(xs) // 4 + 1], 0) AS q1, coalesce(xs[len(xs) * 2 // 4 + 1], 0) AS q2, coalesce(xs[len(xs) * 3 // 4 + 1], 0) AS q3 FROM l""")
def qual_quartiles(spark, d):
    return pileup.quality_quartiles(b.table(spark, d, "part").select(F.col("p_brand").alias("grp"), F.col("p_size").alias("bq")), ["grp"])


@query("SELECT l_orderkey AS read_id, coalesce(quantile_disc(l_quantity, 0.5), 0) AS median, min(l_quantity) AS least FROM lineitem GROUP BY 1")
def lower_median(spark, d):
    return (
        b.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("read_id"))
        .agg(stats.lower_median("l_quantity").alias("median"), F.min("l_quantity").alias("least"))
    )


@query("SELECT l_orderkey AS read_id, round(avg(pow(10, -l_quantity / 10)), 9) AS error_rate FROM lineitem GROUP BY 1")
def read_error_rate(spark, d):
    return (
        b.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("read_id"))
        .agg(F.round(stats.error_rate(F.col("l_quantity")), 9).alias("error_rate"))
    )


EVENTS_IV = "SELECT event_id AS id, user_id % 20 AS grp, user_id AS read_id, epoch_us(ts) AS st, epoch_us(ts) + CAST(trunc(value * 6000000) AS BIGINT) AS en, event_type = 'click' AS noisy FROM events"


@query(f"""WITH e AS ({EVENTS_IV}), r AS (SELECT grp, id AS region_id, st, en FROM e), n AS (SELECT r.grp, r.region_id, count(DISTINCT read_id) AS n_reads, count(DISTINCT read_id) FILTER (noisy) AS n_noisy FROM r JOIN e ON r.grp = e.grp AND r.st < e.en AND e.st < r.en GROUP BY 1, 2)
 SELECT grp, region_id, n_reads, n_noisy, round(n_noisy / n_reads, 9) AS ratio FROM n""")
def noisy_read_ratio(spark, d):
    regions, reads, noisy = _regions(spark, d)
    return pileup.noisy_read_ratio(regions, reads, noisy, ["grp"], b.HOUR).withColumn("ratio", F.round("ratio", 9))


@query(f"""WITH e AS ({EVENTS_IV}), r AS (SELECT grp, id AS region_id, st, en FROM e), n AS (SELECT r.grp, r.region_id, count(DISTINCT read_id) AS n_reads, count(DISTINCT read_id) FILTER (noisy) AS n_noisy FROM r JOIN e ON r.grp = e.grp AND r.st < e.en AND e.st < r.en GROUP BY 1, 2)
 SELECT grp, region_id FROM n WHERE n_noisy >= 2 AND n_noisy / n_reads >= 0.2""")
def noisy_support_filter(spark, d):
    return pileup.supported(pileup.noisy_read_ratio(*_regions(spark, d), ["grp"], b.HOUR), HIFI).select("grp", "region_id")


def _regions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = b.table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    e = (
        e.select(
            "event_id", (F.col("user_id") % 20).alias("grp"), F.col("user_id").alias("read_id"), F.col("us").alias("st"),
            (F.col("us") + (F.col("value") * 6_000_000).cast("long")).alias("en"), "event_type",
        )
    )
    return e.select("grp", F.col("event_id").alias("region_id"), "st", "en"), e, e.filter("event_type = 'click'")


@query("""SELECT o_custkey AS chunk, o_orderkey AS read_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_totalprice DESC, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderkey) AS read_rank FROM orders""")
def read_order(spark, d):
    """Reads by begin, longest first, edit distance, name."""
    from helixloom.operators.reads import read_rank

    o = (
        b.table(spark, d, "orders")
        .select(
            F.col("o_custkey").alias("chunk"), F.col("o_orderkey").alias("read_id"), F.col("o_orderdate").alias("pos"),
            F.col("o_totalprice").alias("end"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("nm"),
            F.col("o_orderkey").alias("qname"),
        )
    )
    return longs(read_rank(o, ["chunk"]), "read_rank").select("chunk", "read_id", "read_rank")


# Phasing -------------------------------------------------------------------------------------------------------------

@query(f"""WITH p AS ({b.PROFILE}), n AS (SELECT grp, var_id, CAST(read_id % 2 + 1 AS INT) AS hap, allele, count(*) AS n FROM p GROUP BY 1, 2, 3, 4), r AS (SELECT *, row_number() OVER (PARTITION BY grp, var_id, hap ORDER BY n DESC, allele) AS k FROM n)
 SELECT grp, var_id, hap, allele, n FROM r WHERE k = 1""")
def hap_majority(spark, d):
    return phasing.hap_majority(b.profile(spark, d).withColumn("hap", (F.col("read_id") % 2 + 1).cast("int")), ["grp", "var_id"])


AGREE = f"""p AS ({b.PROFILE}), v AS (SELECT grp, var_id, CAST(var_id % 2 AS INT) AS hap1, lag(var_id) OVER (PARTITION BY grp ORDER BY var_id) AS prev FROM (SELECT DISTINCT grp, var_id FROM p)),
 s AS (SELECT p.grp, p.read_id, p.var_id, v.prev, p.allele = v.hap1 AS on1 FROM p JOIN v ON p.grp = v.grp AND p.var_id = v.var_id),
 n AS (SELECT x.grp, x.var_id, count(*) FILTER (x.on1 = y.on1) AS n_agree, count(*) FILTER (x.on1 <> y.on1) AS n_conflict FROM s x JOIN s y ON x.grp = y.grp AND x.read_id = y.read_id AND x.prev = y.var_id GROUP BY 1, 2),
 ac AS (SELECT v.grp, v.var_id, coalesce(n_agree, 0) AS n_agree, coalesce(n_conflict, 0) AS n_conflict FROM v LEFT JOIN n ON v.grp = n.grp AND v.var_id = n.var_id)"""


def _agree(spark: SparkSession, d: str) -> DataFrame:
    p = b.profile(spark, d)
    v = p.select("grp", "var_id").distinct().withColumn("hap1", (F.col("var_id") % 2).cast("int"))
    return phasing.agree_conflict(p, v, ["grp"])


@query(f"WITH {AGREE} SELECT * FROM ac")
def agree_conflict(spark, d):
    return _agree(spark, d)


@query("""WITH t AS (SELECT p_brand AS grp, p_partkey AS var_id, p_partkey AS pos, p_size % 2 = 0 AS het, p_size % 4 AS n_agree, p_size // 4 % 4 AS n_conflict FROM part), r AS (SELECT *, row_number() OVER w = 1 AS first, n_agree < 2 AND n_conflict < 2 AS weak FROM t WINDOW w AS (PARTITION BY grp ORDER BY var_id)),
 s AS (SELECT *, CASE WHEN first OR (het AND weak) THEN pos END AS b, CASE WHEN NOT first AND het AND NOT weak AND n_conflict > n_agree THEN 1 ELSE 0 END AS t FROM r)
 SELECT grp, var_id, last_value(b IGNORE NULLS) OVER w AS phase_set, sum(t) OVER w % 2 = 1 AND het AND NOT first AS flip FROM s WINDOW w AS (PARTITION BY grp ORDER BY var_id ROWS UNBOUNDED PRECEDING)""")
def phase_segments(spark, d):
    p, size = b.table(spark, d, "part"), F.col("p_size")
    t = (
        p.select(
            F.col("p_brand").alias("grp"), F.col("p_partkey").alias("var_id"), F.col("p_partkey").alias("pos"),
            (size % 2 == 0).alias("het"), (size % 4).alias("n_agree"), (F.floor(size / 4) % 4).alias("n_conflict"),
        )
    )
    return phasing.phase_segments(t, ["grp"]).select("grp", "var_id", "phase_set", "flip")


HAPS = "SELECT CAST(l_suppkey % 4 AS VARCHAR) AS contig, l_partkey // 40 AS chunk, l_orderkey % 50 AS read_id, CAST(max(l_linenumber % 3) AS INT) AS hap, min(l_partkey // 40 * 40 + l_orderkey % 2) AS phase_set FROM lineitem GROUP BY 1, 2, 3"
VOTES = f"""h AS ({HAPS}), votes AS (SELECT c.contig, c.chunk, CAST(sum(CASE WHEN c.hap <> p.hap THEN 1 ELSE -1 END) AS BIGINT) AS score, max(p.phase_set) AS pre_ps, min(c.phase_set) AS cur_ps FROM h c JOIN h p ON c.contig = p.contig AND c.read_id = p.read_id AND p.chunk = c.chunk - 1 WHERE c.hap > 0 AND p.hap > 0 GROUP BY 1, 2)"""


def _haps(spark: SparkSession, d: str) -> DataFrame:
    line, block = b.table(spark, d, "lineitem"), F.floor(F.col("l_partkey") / 40)
    return (
        line.groupBy(
            (F.col("l_suppkey") % 4).cast("string").alias("contig"), block.alias("chunk"), (F.col("l_orderkey") % 50).alias("read_id"),
        )
        .agg(F.max(F.col("l_linenumber") % 3).cast("int").alias("hap"), F.min(block * 40 + F.col("l_orderkey") % 2).alias("phase_set"))
    )


@query(f"WITH {VOTES} SELECT * FROM votes")
def stitch_votes(spark, d):
    return phasing.stitch_votes(_haps(spark, d))


@query(f"""WITH {VOTES}, r AS (SELECT c.contig, c.chunk, score, pre_ps, cur_ps, coalesce(score <> 0 AND pre_ps <> -1 AND cur_ps <> -1, false) AS linked FROM (SELECT DISTINCT contig, chunk FROM h) c LEFT JOIN votes v ON c.contig = v.contig AND c.chunk = v.chunk),
 f AS (SELECT *, CASE WHEN coalesce(linked AND lag(linked) OVER w AND pre_ps = lag(cur_ps) OVER w, false) THEN 0 ELSE 1 END AS nw FROM r WINDOW w AS (PARTITION BY contig ORDER BY chunk)), g AS (SELECT *, sum(nw) OVER (PARTITION BY contig ORDER BY chunk ROWS UNBOUNDED PRECEDING) AS chain FROM f)
 SELECT contig, chunk, cur_ps, flip, root_ps FROM (SELECT *, sum(CASE WHEN score > 0 THEN 1 ELSE 0 END) OVER w % 2 = 1 AS flip, first_value(pre_ps) OVER w AS root_ps FROM g WINDOW w AS (PARTITION BY contig, chain ORDER BY chunk ROWS UNBOUNDED PRECEDING)) WHERE linked""")
def stitch_parity(spark, d):
    h = _haps(spark, d)
    return phasing.stitch_chains(phasing.stitch_votes(h), h)


@query(f"""WITH {CLASSES}, r AS (SELECT pos // 50 AS grp, pos, category, row_number() OVER (PARTITION BY pos // 50 ORDER BY CASE category WHEN 'N' THEN 0 ELSE 1 END, total_cov DESC, pos) AS k FROM classes WHERE category IN ('N', 'I')) SELECT grp, pos AS var_id FROM r WHERE k = 1""")
def pivot_variant(spark, d):
    c = (
        _classes(spark, d).filter(F.col("category").isin("N", "I"))
        .select(
            F.floor(F.col("pos") / 50).alias("grp"), F.col("pos").alias("var_id"), "category", "vtype", "total_cov",
            F.lit(False).alias("is_hp"),
        )
    )
    return c.groupBy("grp").agg(F.min_by("var_id", phasing.pivot_rank()).alias("var_id"))


@query()
def two_means_phasing(spark, d):
    """Windows of 25 sites; the assignment is sequential, so SQL can't say it. Tested on made haplotypes."""
    window = lambda c: F.floor(F.col(c) / 25)
    c = (
        _classes(spark, d).filter(F.col("category").isin("N", "I", "H"))
        .select(
            window("pos").alias("chunk"), F.col("pos").alias("var_id"), "pos", "vtype", "category",
            F.col("total_cov").cast("int").alias("total_cov"), F.lit(False).alias("is_hp"),
        )
    )
    p = b.profile(spark, d).groupBy("read_id", "var_id").agg(F.min("allele").alias("allele"))
    p = p.select(window("var_id").alias("chunk"), "read_id", F.col("read_id").alias("read_rank"), "var_id", "allele")
    return phasing.two_means(p, c, ["chunk"], replace(ONT, is_ont=False))


# Sequences -----------------------------------------------------------------------------------------------------------

SEQ = f"WITH s AS ({b.SEQ_SQL}), d AS ({b.DOC_SEQ_SQL})"


@query(f"{SEQ}, k AS (SELECT substr(seq, CAST(i AS INT), 6) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - 4)) AS i FROM s)) SELECT kmer, count(*) AS n FROM k WHERE NOT contains(kmer, 'N') GROUP BY 1")
def kmer_count(spark, d):
    k = b.sequences(spark, d).select(F.explode(seq.kmers(F.col("seq"), 6)).alias("kmer"))
    return k.groupBy("kmer").agg(F.count("*").alias("n"))


@query(f"""{SEQ}, t AS (SELECT DISTINCT id AS te_id, strand, substr(q, CAST(i AS INT), 7) AS kmer FROM (SELECT id, strand, q, unnest(range(1, length(q) - 5)) AS i FROM (SELECT id, false AS strand, seq AS q FROM s UNION ALL SELECT id, true, reverse(translate(seq, 'ACGT', 'TGCA')) FROM s))),
 tk AS (SELECT * FROM t WHERE NOT contains(kmer, 'N') AND NOT regexp_full_match(kmer, 'A*.')),
 parts AS (SELECT id, unnest(regexp_split_to_array(seq, 'N+')) AS part FROM d), q AS (SELECT id, substr(part, CAST(i * 7 + 1 AS INT), 7) AS kmer FROM (SELECT id, part, unnest(range(0, length(part) // 7)) AS i FROM parts)),
 n AS (SELECT q.id, te_id, strand, count(*) AS hits FROM q JOIN tk USING (kmer) GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hits DESC, strand DESC, te_id) AS k FROM n WHERE hits >= 3) SELECT id, te_id, strand AS rev, hits FROM r WHERE k = 1""")
def kmer_match_top(spark, d):
    from helixloom.operators.elements import index, match

    return match(b.sequences(spark, d, "documents"), index(b.sequences(spark, d).withColumnRenamed("id", "te_id"), 7), 7, 3)


@query(f"{SEQ} SELECT id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM s")
def revcomp(spark, d):
    return b.sequences(spark, d).select("id", seq.reverse_complement(F.col("seq")).alias("rc"))


@query(f"""{SEQ}, p AS (SELECT id, i, substr(seq, CAST(i AS INT), 18) AS r, substr(seq, CAST(greatest(1, i - 18) AS INT), CAST(i - greatest(1, i - 18) AS INT)) AS l FROM (SELECT id, seq, unnest(range(1, length(seq) + 1)) AS i FROM s))
 SELECT id, CAST(i AS BIGINT) AS i, {' OR '.join(f"(length(r) >= {3 * u} AND substr(r, 1, {u}) = substr(r, {u + 1}, {u}) AND substr(r, 1, {u}) = substr(r, {2 * u + 1}, {u}))" for u in range(1, 7))} AS tandem_right,
 {' OR '.join(f"(length(l) >= {3 * u} AND right(l, {u}) = substr(l, length(l) - {2 * u - 1}, {u}) AND right(l, {u}) = substr(l, length(l) - {3 * u - 1}, {u}))" for u in range(1, 7))} AS tandem_left FROM p""")
def tandem_repeat(spark, d):
    """At every place of every passage: the 18 bases from it on, and the up to 18 before it."""
    padded = F.concat(F.repeat(F.lit("-"), F.lit(18)), F.col("seq"))
    rows = (
        b.sequences(spark, d)
        .select(
            "id",
            F.posexplode(F.arrays_zip(seq.windows(F.col("seq"), 18, least=1).alias("r"), seq.windows(padded, 18, least=18).alias("l"))).alias("k", "x"),
        )
        .filter("x.r IS NOT NULL")
    )
    before = F.regexp_replace("x.l", "-", "")
    return (
        rows.select(
            "id", (F.col("k") + 1).cast("long").alias("i"), seq.tandem_right(F.col("x.r")).alias("tandem_right"),
            seq.tandem_left(before).alias("tandem_left"),
        )
    )


@query(f"{SEQ} SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(seq, 'A{{3,}}', 'A', 'g'), 'C{{3,}}', 'C', 'g'), 'G{{3,}}', 'G', 'g'), 'T{{3,}}', 'T', 'g'), 'N{{3,}}', 'N', 'g') AS hp FROM s")
def hp_compress(spark, d):
    return b.sequences(spark, d).select("id", seq.compress_runs(F.col("seq")).alias("hp"))


@query(f"{SEQ} SELECT id, CAST(i AS BIGINT) AS i, substr(seq, CAST(i AS INT), 5) = repeat(substr(seq, CAST(i AS INT), 1), 5) AS hp FROM (SELECT id, seq, unnest(range(1, length(seq) - 3)) AS i FROM s)")
def homopolymer_run(spark, d):
    rows = b.sequences(spark, d).select("id", F.posexplode(seq.windows(F.col("seq"), 5)).alias("k", "five"))
    return rows.select("id", (F.col("k") + 1).cast("long").alias("i"), seq.homopolymer_at(F.col("five"), F.lit(1)).alias("hp"))


@query(f"{SEQ} SELECT id, list_transform(list_filter(string_split(seq, ''), lambda c: c <> ''), lambda c: CASE c WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 4 END)::VARCHAR AS codes FROM s")
def base_codes(spark, d):
    return b.sequences(spark, d).select("id", seq.base_codes(F.col("seq")).cast("string").alias("codes"))


NAMES = "SELECT DISTINCT CASE p_size % 6 WHEN 0 THEN 'chr' WHEN 1 THEN '' WHEN 2 THEN 'chr' WHEN 3 THEN '' WHEN 4 THEN 'chr' ELSE 'HLA-' END || CASE WHEN p_size % 7 = 0 THEN 'X' WHEN p_size % 7 = 1 THEN 'Y' WHEN p_size % 7 = 2 THEN 'M' WHEN p_size % 7 = 3 THEN 'Un_' || p_size ELSE CAST(p_size - 5 AS STRING) END || CASE WHEN p_size % 5 = 0 THEN ':1-2' ELSE '' END AS name FROM part"


@query(f"""WITH n AS ({NAMES}), c AS (SELECT name, regexp_replace(regexp_replace(name, ':.*$', ''), '^chr', '') AS core FROM n) SELECT name, CASE WHEN core IN ('X', 'Y') THEN 'sex' WHEN regexp_full_match(core, '0*[1-9][0-9]*') THEN 'autosome' ELSE 'other' END AS kind FROM c""")
def contig_class(spark, d):
    return b.view(spark, d, NAMES, "part").select("name", seq.contig_class(F.col("name")).alias("kind"))


CIGARS = "SELECT l_orderkey AS read_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS line, l_partkey AS pos, l_linenumber || 'S' || CAST(l_quantity AS INT) || '=1X' || (l_suppkey % 9 + 1) || 'I' || (l_partkey % 8 + 1) || '=' || (l_suppkey % 5 + 1) || 'D4=' AS cigar FROM lineitem"


@query(f"""WITH c AS ({CIGARS}), o AS (SELECT read_id, line, pos, unnest(regexp_extract_all(cigar, '[0-9]+')) AS len, unnest(regexp_extract_all(cigar, '[SIDX=]')) AS op, unnest(generate_series(1, 7)) AS k FROM c), x AS (SELECT read_id, line, pos, k, op, CAST(len AS INT) AS len FROM o)
 SELECT read_id, line, k, op, len, pos + coalesce(sum(CASE WHEN op IN ('=', 'X', 'D') THEN len END) OVER w, 0)::BIGINT AS ref_pos, coalesce(sum(CASE WHEN op IN ('=', 'X', 'I', 'S') THEN len END) OVER w, 0)::BIGINT AS qi FROM x WINDOW w AS (PARTITION BY read_id, line ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def cigar_decode(spark, d):
    from helixloom.operators.decode import cigar_ops

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    text = (
        F.concat(
            F.col("l_linenumber"), F.lit("S"), F.col("l_quantity").cast("int"), F.lit("=1X"), F.col("l_suppkey") % 9 + 1, F.lit("I"),
            F.col("l_partkey") % 8 + 1, F.lit("="), F.col("l_suppkey") % 5 + 1, F.lit("D4="),
        )
    )
    rows = (
        b.table(spark, d, "lineitem")
        .select(
            F.col("l_orderkey").alias("read_id"), F.row_number().over(w).cast("long").alias("line"), F.col("l_partkey").alias("pos"),
            text.alias("cigar"),
        )
    )
    ops = rows.select("read_id", "line", F.posexplode(cigar_ops(F.col("cigar"), F.col("pos"))).alias("k", "x"))
    return (
        ops.select(
            "read_id", "line", (F.col("k") + 1).cast("long").alias("k"), "x.op", "x.len", F.col("x.ref_pos").alias("ref_pos"),
            F.col("x.qi").cast("long").alias("qi"),
        )
    )


# Kernels over tables: not SQL; unit tests hold them against brute force -------------------------------------------------

DENSE_EVENTS = """e AS (SELECT user_id AS read_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, epoch_us(ts) // 3600000000 AS pos, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS len, event_id % 3 + 1 AS cnt FROM events)"""


@query(f"""WITH {DENSE_EVENTS}, w AS (SELECT a.read_id, a.k, CAST(sum(b.cnt) AS BIGINT) AS total, min(b.pos) AS st, a.pos + a.len AS en FROM e a JOIN e b ON a.read_id = b.read_id AND b.k <= a.k AND (b.k = a.k OR b.pos + b.len - 1 > a.pos - 24) GROUP BY a.read_id, a.k, a.pos, a.len)
 SELECT read_id, k, total, st, en FROM w WHERE total > 5""")
def dense_window(spark, d):
    """Windows of a read's events whose counts exceed a bound. Positions ascend and event ends almost do, so the window is a range of positions and a check of ends."""
    from helixloom.operators.windows import dense_spans

    e = b.table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = (
        e.select(
            F.col("user_id").alias("read_id"), F.row_number().over(w).cast("long").alias("k"),
            F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / b.HOUR).alias("pos"),
            F.when(F.col("event_type") == "click", 0).otherwise(1).alias("len"), (F.col("event_id") % 3 + 1).alias("cnt"),
        )
    )
    return dense_spans(rows, ["read_id"], 24, 5)


#: The matrix row by row, as lists, and the way back from the first least cell of the last row: a pair before a base of the query alone before one of the target.
INFIX = """WITH RECURSIVE s AS ({s}), p AS (SELECT x.id, x.seq AS q, y.seq AS t, string_split(x.seq, '') AS qs, string_split(y.seq, '') AS ts, range(0, length(y.seq) + 1) AS cols FROM s x JOIN s y ON y.id = x.id + 1),
 r(id, i, cells) AS (SELECT id, 0, list_transform(cols, lambda j: 0) FROM p UNION ALL
  SELECT id, i, list_transform(cols, lambda j: CAST(j AS INT) + list_min(list_transform(cand[1:j + 1], lambda c, k: c - CAST(k AS INT) + 1))) FROM (
   SELECT r.id, r.i + 1 AS i, p.cols, list_transform(p.cols, lambda j: CASE WHEN j = 0 THEN r.i + 1 ELSE least(cells[j + 1] + 1, cells[j] + CASE WHEN ts[j] = qs[r.i + 1] THEN 0 ELSE 1 END) END) AS cand FROM r JOIN p ON r.id = p.id WHERE r.i < length(p.q))),
 m AS MATERIALIZED (SELECT * FROM r),
 w(id, i, j, path) AS (SELECT m.id, m.i, list_position(cells, list_min(cells)) - 1, '' FROM m JOIN p ON m.id = p.id AND m.i = length(p.q) UNION ALL
  SELECT id, CASE WHEN op IN ('=', 'X', 'I') THEN i - 1 ELSE i END, CASE WHEN op IN ('=', 'X', 'D') THEN j - 1 ELSE j END, op || path FROM (
   SELECT w.id, w.i, w.j, w.path, CASE WHEN w.j > 0 AND now.cells[w.j + 1] = above.cells[w.j] + CASE WHEN ts[w.j] = qs[w.i] THEN 0 ELSE 1 END THEN CASE WHEN ts[w.j] = qs[w.i] THEN '=' ELSE 'X' END
     WHEN now.cells[w.j + 1] = above.cells[w.j + 1] + 1 THEN 'I' ELSE 'D' END AS op
   FROM w JOIN m now ON now.id = w.id AND now.i = w.i JOIN m above ON above.id = w.id AND above.i = w.i - 1 JOIN p ON p.id = w.id)),
 l AS (SELECT m.id, list_min(cells) AS distance, list_position(cells, list_min(cells)) - 2 AS fin FROM m JOIN p ON m.id = p.id AND m.i = length(p.q))
 SELECT w.id, l.distance, CAST(w.j AS INT) AS start, CAST(l.fin AS INT) AS "end", w.path FROM w JOIN l ON w.id = l.id WHERE w.i = 0""".format(s=b.SEQ_SQL)


@query(INFIX)
def infix_similarity(spark, d):
    """Each benchmark passage against the next one, within it."""
    from helixloom.plans import functions as f

    s = b.sequences(spark, d).select("id", F.col("seq").alias("q"))
    t = b.sequences(spark, d).select((F.col("id") - 1).alias("id"), "seq")
    return s.join(t, "id").select("id", f.infix_edit("q", "seq").alias("a")).select("id", "a.distance", "a.start", "a.end", "a.path")


@query("WITH s AS ({s}) SELECT x.id, CAST(levenshtein(x.seq, y.seq) AS BIGINT) AS distance FROM s x JOIN s y ON y.id = x.id + 1".format(s=b.SEQ_SQL))
def edit_distance(spark, d):
    from helixloom.plans import functions as f

    s = b.sequences(spark, d)
    t = s.select((F.col("id") - 1).alias("id"), F.col("seq").alias("other"))
    return s.join(t, "id").select("id", f.edit_distance("seq", "other").cast("long").alias("distance"))


#: One gap of seven costs less than any mismatch or second gap can save, and goes as far left as it can: to the first place where cutting seven bases gives the query.
@query("""WITH s AS ({s}), p AS (SELECT id, seq, substr(seq, 1, 50) || substr(seq, 58) AS q FROM s),
 g AS (SELECT id, min(i) AS i FROM (SELECT id, seq, q, unnest(range(0, length(seq) - 6)) AS i FROM p) WHERE substr(seq, 1, CAST(i AS INT)) || substr(seq, CAST(i AS INT) + 8) = q GROUP BY id)
 SELECT id, seq AS target, substr(q, 1, CAST(i AS INT)) || '-------' || substr(q, CAST(i AS INT) + 1) AS query FROM p JOIN g USING (id)""".format(s=b.SEQ_SQL))
def affine_alignment(spark, d):
    """Each passage against itself without seven of its bases."""
    from helixloom.plans import functions as f

    s = b.sequences(spark, d).select("id", F.col("seq").alias("t"))
    q = (
        b.sequences(spark, d)
        .select("id", F.concat(F.substring("seq", F.lit(1), F.lit(50)), F.substring("seq", F.lit(58), F.length("seq"))).alias("q"))
    )
    return s.join(q, "id").select("id", f.affine_align("t", "q").alias("a")).select("id", "a.target", "a.query")


@query("WITH s AS ({s}) SELECT id, seq AS s, seq AS consensus FROM s".format(s=b.SEQ_SQL))
def poa_consensus(spark, d):
    """Ten copies of a passage, each with a base left out; the consensus is the passage."""
    from helixloom.plans import functions as f

    s = b.sequences(spark, d).select("id", F.col("seq").alias("s"))
    copies = (
        F.transform(
            F.sequence(F.lit(1), F.lit(10)),
            lambda k: F.concat(F.substring("s", F.lit(1), k * 7), F.substring("s", k * 7 + 2, F.length("s"))),
        )
    )
    return s.select("id", "s", f.poa_consensus(copies).alias("consensus"))


#: The duplication lasts while at most one base differs; the tail, read from the gap's end, has at least four A in five, up to another base beyond twenty.
@query("""WITH s AS ({s}), g AS (SELECT id, substr(seq, 1, 12) || substr(seq, 40) || repeat('A', 14) AS gap, substr(seq, 1, 12) || substr(seq, 90) AS flank FROM s),
 d AS (SELECT id, k, substr(gap, CAST(k AS INT), 1) = substr(flank, CAST(k AS INT), 1) AS m FROM (SELECT *, unnest(range(1, least(length(gap), length(flank)) + 1)) AS k FROM g)),
 w AS (SELECT *, sum(CASE WHEN m THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY k) AS wrong FROM d), dup AS (SELECT id, coalesce(max(k) FILTER (m AND wrong <= 1), 0) AS n FROM w GROUP BY id),
 t AS (SELECT id, k, substr(reverse(gap), CAST(k AS INT), 1) = 'A' AS y FROM (SELECT *, unnest(range(1, length(gap) + 1)) AS k FROM g)),
 c AS (SELECT *, sum(CASE WHEN y THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY k) AS seen, min(CASE WHEN NOT y AND k > 20 THEN k END) OVER (PARTITION BY id) AS stop FROM t),
 a AS (SELECT id, coalesce(max(k) FILTER (y AND k >= 10 AND seen >= CAST(0.8 AS DOUBLE) * k AND k < coalesce(stop, 1000000000)), 0) AS n FROM c GROUP BY id)
 SELECT id, CASE WHEN dup.n BETWEEN 2 AND 100 AND a.n > 0 THEN dup.n ELSE 0 END AS tsd_len, CASE WHEN dup.n BETWEEN 2 AND 100 THEN a.n ELSE 0 END AS tail_len FROM dup JOIN a USING (id)""".format(s=b.SEQ_SQL))
def te_annotate(spark, d):
    """Gaps with a duplication and a tail made from passages."""
    from helixloom.plans import functions as f

    s = b.sequences(spark, d).select("id", "seq")
    gap = F.concat(F.substring("seq", 1, 12), F.substring("seq", F.lit(40), F.length("seq")), F.repeat(F.lit("A"), F.lit(14)))
    flank = F.concat(F.substring("seq", 1, 12), F.substring("seq", F.lit(90), F.length("seq")))
    return s.select("id", f.insertion_marks(gap, flank).alias("m")).select("id", "m.tsd_len", "m.tail_len")


@query("""WITH t AS (SELECT user_id, date_trunc('day', ts) AS st, value FROM events) SELECT user_id, st, count(*) AS n, round(sum(value), 6) AS total FROM t GROUP BY 1, 2""")
def tumbling_counts(spark, d):
    from helixloom.streaming.windows import tumbling_counts as counts

    out = counts(b.table(spark, d, "events"), ["user_id"], "ts", "1 day")
    return out.select("user_id", F.col("st").cast("timestamp_ntz").alias("st"), "n", F.round("total", 6).alias("total"))


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS nw FROM events), g AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
 SELECT user_id, min(ts) AS st, max(ts) + INTERVAL 6 HOUR AS en, count(*) AS n FROM g GROUP BY user_id, k""")
def sessions(spark, d):
    from helixloom.streaming.windows import sessions as merged

    return (
        merged(b.table(spark, d, "events"), "user_id", "ts", "6 hours")
        .select("user_id", F.col("st").cast("timestamp_ntz").alias("st"), F.col("en").cast("timestamp_ntz").alias("en"), "n")
    )


SOMATIC = f"WITH {CLASSES}, k AS (SELECT pos, vtype, ref_len, alt_len, alt_cov, CASE WHEN pos % 5 = 0 THEN 12 ELSE 0 END AS tsd FROM classes)"


@query(f"{SOMATIC} SELECT pos, CASE WHEN vtype = 8 THEN alt_cov >= 2 WHEN vtype = 1 AND alt_len >= 30 THEN alt_cov >= 2 OR (tsd > 0 AND alt_cov >= 1) WHEN vtype = 2 AND ref_len >= 30 THEN alt_cov >= 2 ELSE false END AS candidate FROM k")
def somatic_candidates(spark, d):
    from helixloom.operators.somatic import is_candidate

    c = _classes(spark, d).withColumn("tsd_len", F.when(F.col("pos") % 5 == 0, 12).otherwise(0))
    return c.select("pos", is_candidate(HIFI).alias("candidate"))


@query(f"""WITH p AS ({b.PROFILE}), h AS (SELECT *, read_id % 2 + 1 AS hap, read_id % 3 * 10 + 10 AS phase_set FROM p), g AS (SELECT grp, var_id, phase_set, count(*) AS depth, count(*) FILTER (hap = 1 AND allele = 0) AS r1, count(*) FILTER (hap = 1 AND allele = 1) AS a1, count(*) FILTER (hap = 2 AND allele = 0) AS r2, count(*) FILTER (hap = 2 AND allele = 1) AS a2 FROM h GROUP BY 1, 2, 3),
 f AS (SELECT *, row_number() OVER (PARTITION BY grp, var_id ORDER BY depth DESC, phase_set) AS k FROM g WHERE (a1 > 0) <> (a2 > 0) AND CASE WHEN a1 > 0 THEN a1 <= r1 ELSE a2 <= r2 END AND depth >= 2),
 v AS (SELECT DISTINCT grp, var_id FROM h) SELECT v.grp, v.var_id, coalesce(f.phase_set, 0) AS phase_set, CASE WHEN f.a1 > 0 THEN 1 ELSE 2 END AS alt_hap FROM v LEFT JOIN f ON v.grp = f.grp AND v.var_id = f.var_id AND f.k = 1""")
def somatic_phase_set(spark, d):
    from helixloom.operators.somatic import choose_phase_set

    p = b.profile(spark, d).withColumn("hap", F.col("read_id") % 2 + 1).withColumn("phase_set", F.col("read_id") % 3 * 10 + 10)
    return choose_phase_set(p, ["grp"], replace(HIFI, min_depth=2))


GERMLINE_ANTI = "WITH s AS (SELECT p_brand AS grp, p_partkey AS var_id, p_partkey * 40 AS pos, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END AS vtype, p_size AS len FROM part)"


@query(f"{GERMLINE_ANTI} SELECT grp, var_id FROM s a WHERE var_id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM s b WHERE b.var_id % 3 <> 0 AND a.grp = b.grp AND a.vtype = b.vtype AND abs(a.pos - b.pos) <= greatest(500, a.len) AND least(a.len, b.len) >= 0.8 * greatest(a.len, b.len))")
def somatic_not_germline(spark, d):
    from helixloom.operators.somatic import without_germline

    s = (
        b.table(spark, d, "part")
        .select(
            F.col("p_brand").alias("grp"), F.col("p_partkey").alias("var_id"), (F.col("p_partkey") * 40).alias("pos"),
            F.when(F.col("p_size") % 2 == 0, 1).otherwise(2).alias("vtype"), F.col("p_size").alias("len"),
        )
    )
    return without_germline(s.filter("var_id % 3 = 0"), s.filter("var_id % 3 <> 0"), ["grp"]).select("grp", "var_id")




#: Reads without errors over each passage: 12 a contig, every other one with another base at every 50th place.
@query("WITH s AS ({s}), t AS (SELECT id, replace(seq, 'N', 'A') AS seq FROM s), p AS (SELECT id, pos, substr(seq, CAST(pos AS INT), 1) AS ref FROM (SELECT id, seq, unnest(generate_series(50, length(seq) - 10, 50)) AS pos FROM t)) SELECT 'c' || id AS contig, pos, ref, translate(ref, 'ACGT', 'CGTA') AS alt, true AS het, 1 AS phases, 12 AS dp, 6 AS alt_ad, 60 AS qual, 60 AS gq, CAST(50 AS BIGINT) AS ps FROM p".format(s=b.SEQ_SQL))
def germline_calls(spark, d):
    """The whole path, from reads to phased calls, on passages as contigs. Which haplotype is called the first is free, so that is left out; `phases` counts a contig's orientations."""
    from helixloom.plans import germline
    from helixloom.sources import fasta

    s = b.sequences(spark, d).select(F.concat(F.lit("c"), "id").alias("contig"), F.translate("seq", "N", "A").alias("seq"))
    bases, n = F.split("seq", ""), F.greatest(F.floor((F.length("seq") - 10) / 50).cast("int"), F.lit(0))
    alt = (
        F.array_join(
            F.transform(bases, lambda c, i: F.when((i % 50 == 49) & (i < F.length("seq") - 10), F.translate(c, "ACGT", "CGTA")).otherwise(c)),
            "",
        )
    )
    cigar = F.concat(F.repeat(F.lit("49=1X"), n), F.length("seq") - n * 50, F.lit("="))
    reads = (
        s.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(11))))
        .select(
            F.concat(F.lit("r"), "r").alias("qname"), F.when(F.col("r") % 4 < 2, 0).otherwise(16).alias("flag"), "contig",
            F.lit(1).cast("long").alias("pos"), F.lit(60).alias("mapq"),
            F.when(F.col("r") % 2 == 1, cigar).otherwise(F.concat(F.length("seq"), F.lit("="))).alias("cigar"),
            F.when(F.col("r") % 2 == 1, alt).otherwise(F.col("seq")).alias("seq"), F.lit(None).cast("binary").alias("qual"),
            F.create_map().cast("map<string,string>").alias("tags"),
        )
    )
    calls, _ = germline.call(reads, s.select("contig", F.length("seq").cast("long").alias("length")), fasta.binned(s), HIFI)
    return (
        calls.select(
            "contig", "pos", "ref", "alt", F.col("gt").isin("0|1", "1|0").alias("het"),
            F.size(F.collect_set("gt").over(Window.partitionBy("contig", "ps"))).alias("phases"), "dp", "alt_ad", "qual", "gq", "ps",
        )
    )


from helixloom.plans import read_queries  # noqa: E402, F401

__all__ = ["ORACLES", "QUERIES"]
