"""Operators on hand-made rows, against brute force, and the registered queries against their SQL."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from helixloom.config import HIFI, ONT
from helixloom.functions import sequences, stats
from helixloom.operators import evidence, genotype, intervals, phasing, reads, sites, somatic
from helixloom.operators.decode import Event
from helixloom.plans import functions as sql_functions
from helixloom.plans.queries import ORACLES, QUERIES
from helixloom.sources import fasta, regions
from helixloom.streaming import windows
from tests.compare import differences, duck

SF = "/root/testdata/sf0.001"
RND = random.Random(2)


@pytest.fixture(scope="module")
def db():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, db, name):
    assert differences(QUERIES[name](spark, SF).toPandas(), db.execute(ORACLES[name]).df()) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 200 and set(entry.oracle_sql()) <= set(entry.queries())


def spans(spark, n, keys=3, far=300):
    rows = list({(f"c{RND.randrange(keys)}", st := RND.randrange(far), st + RND.randrange(1, 40), k) for k in range(n)})
    return spark.createDataFrame(rows, "contig string, st long, en long, id int"), rows


def test_joins_equal_theta(spark):
    (a, x), (b, y) = spans(spark, 80), spans(spark, 60)
    meet = lambda p, q: p[0] == q[0] and p[1] < q[2] and q[1] < p[2]
    for width in (7, 50, 1000):
        got = {(r.a_id, r.b_id) for r in intervals.overlap_join(a, b, ["contig"], width).collect()}
        assert got == {(p[3], q[3]) for p in x for q in y if meet(p, q)}
        assert intervals.overlap_join(a, b, ["contig"], width).count() == len(got)
        assert {(r.a_id, r.b_id) for r in intervals.contain_join(a, b, ["contig"], width).collect()} == {(p[3], q[3]) for p in x for q in y if p[0] == q[0] and q[1] <= p[1] and q[2] >= p[2]}
    semi = {r.id for r in intervals.overlap_semi(a, b, ["contig"], 50).collect()}
    assert semi == {p[3] for p in x if any(meet(p, q) for q in y)}
    assert {r.id for r in intervals.overlap_semi(a, b, ["contig"], 50, "left_anti").collect()} == {p[3] for p in x} - semi


def plain_labelled_fold(rows):
    """Merges any two clusters whose gap is at most the lesser label, until nothing changes."""
    rows = sorted(rows)
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i + 1, len(rows)):
                (s, e, lab), (s2, e2, lab2) = rows[i], rows[j]
                if max(s, s2) - min(e, e2) <= min(lab, lab2):
                    rows[i] = (min(s, s2), max(e, e2), max(lab, lab2))
                    del rows[j]
                    changed = True
                    break
            if changed:
                break
    return sorted(rows)


def test_distinct_overlaps_make_no_pairs(spark):
    """Counts as from all pairs, with intervals of no length and behind their own ends, and a plan without a join."""
    from helixloom.operators import pileup

    rnd = np.random.default_rng(3)
    made = lambda n: [(int(g), int(i), int(st), int(st + w)) for g, i, st, w in zip(rnd.integers(0, 2, n), rnd.integers(0, 25, n), rnd.integers(-200, 900, n), rnd.choice([-30, -2, 0, 0, 1, 5, 40, 90, 400], n), strict=True)]
    regions = [(g, k, st, en) for k, (g, _, st, en) in enumerate(made(400))]
    reads, events = made(300), made(60)
    df = lambda rows, name: spark.createDataFrame(rows + [(None, 1, 5, 9)], f"grp int, {name} long, st long, en long")
    got = pileup.noisy_read_ratio(df(regions, "region_id"), df(reads, "read_id"), df(events, "read_id"), ["grp"], 3)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for g, k, st, en in regions:
        n, m = (len({i for h, i, a, b in rows if h == g and st < b and a < en}) for rows in (reads, events))
        if n:
            want[g, k] = (n, m, m / n)
    assert {(r.grp, r.region_id): (r.n_reads, r.n_noisy, r.ratio) for r in got.collect()} == want


def test_profiles_are_dealt_by_size(spark, monkeypatch):
    """Lines are grouped once, behind a shuffle whose parts grow in number with the table, not in size."""
    from helixloom.plans import bindings

    d = "/root/testdata/sf0.001"
    for size in (10_000_000, 10_000):
        monkeypatch.setattr(bindings, "SPREAD", size)
        plan = bindings.profile(spark, d)._jdf.queryExecution().sparkPlan().toString()
        parts = bindings.spread(bindings.table(spark, d, "lineitem"), "l_orderkey").rdd.getNumPartitions()
        assert (parts == 4) == (size > 1_000_000) and "partkey" in plan and "REPARTITION_BY_NUM" in plan


def test_support_filter_makes_no_pairs(spark):
    plan = QUERIES["noisy_support_filter"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "FlatMapGroupsInArrow" in plan


def test_overlap_numbers_make_no_pairs(spark):
    """Of equal begins, intervals of no length and behind their own ends as well; the query's plan has no join."""
    rnd = np.random.default_rng(4)
    rows = [(int(g), int(i), int(st), int(st + w)) for g, i, st, w in zip(rnd.integers(0, 2, 500), rnd.permutation(500), rnd.integers(-60, 300, 500), rnd.choice([-30, -2, 0, 0, 1, 5, 40, 90], 500), strict=True)]
    df = spark.createDataFrame(rows + [(0, 600, None, 9)], "grp int, id long, st long, en long")
    got = intervals.overlap_later(df, ["grp"], 3).groupBy("grp", "id", "st").agg(F.sum("n").alias("n")).collect()
    want = {(g, i, st): n for g, i, st, en in rows if (n := sum(h == g and j > i and st < b and a < en for h, j, a, b in rows))}
    assert {(r.grp, r.id, r.st): r.n for r in got} == want
    assert "Join" not in QUERIES["interval_overlap_days"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_labelled_fold_equals_pair_by_pair_merging():
    rng = random.Random(3)
    for k in range(300):
        rows = [(s, s + rng.randrange(0, 30), rng.choice([0, 1, 3, 10, 40, 200])) for s in (rng.randrange(0, 600) for _ in range(rng.randrange(0, 25)))]
        assert intervals.fold_labelled(rows) == plain_labelled_fold(rows), k


@pytest.mark.parametrize("stretch", [50, 200, 10_000])
def test_labelled_merge_over_stretches(spark, stretch):
    """Growth over ends of stretches, long intervals, huge labels early and late, empty intervals."""
    rng = random.Random(stretch)
    rows = [(f"c{rng.randrange(12)}", s, s + rng.choice([0, 1, 20, 260]), rng.choice([0, 2, 9, 40, 150])) for s in (rng.randrange(0, 2500) for _ in range(700))]
    rows += [("far", 0, 100, 60_000), ("far", 90_000, 90_100, 60_000), *(("far", s, s + 5, 4) for s in range(200, 90_000, 1000)), ("grow", 0, 10, 100), ("grow", 100, 110, 300), ("grow", 60, 61, 1000), ("grow", 900, 905, 900)]
    df = spark.createDataFrame(rows, "contig string, st long, en long, label int").repartition(3)
    got = {}
    for r in intervals.merge_labelled(df, ["contig"], stretch).collect():
        got.setdefault(r.contig, []).append((r.st, r.en, r.label))
    for c in {r[0] for r in rows}:
        assert sorted(got[c]) == plain_labelled_fold([r[1:] for r in rows if r[0] == c]), c


def test_labelled_merge_of_a_contig_is_spread(spark):
    """A huge label at the begin: the rest is still folded stretch by stretch, in many tasks, in time."""
    many = spark.range(400_000).select(F.lit("c").alias("contig"), (F.col("id") * 600).alias("st"), (F.col("id") * 600 + 100).alias("en"), F.when(F.col("id") == 0, 60_000).otherwise(F.col("id") % 500).cast("int").alias("label"))
    got = intervals.merge_labelled(many, ["contig"])
    assert got.count() == 400_000  # labels below 500 don't bridge 500 bases


def test_labelled_merge_equals_the_plain_fold(spark):
    rows = [(f"c{RND.randrange(2)}", st := RND.randrange(600), st + RND.randrange(1, 9), RND.randrange(12)) for _ in range(120)]
    df = spark.createDataFrame(rows, "contig string, st long, en long, label int")
    for stretch in (40, 1000):
        got = {c: sorted((r.st, r.en, r.label) for r in intervals.merge_labelled(df, ["contig"], stretch).filter(F.col("contig") == c).collect()) for c in ("c0", "c1")}
        assert got == {c: intervals.fold_labelled([r[1:] for r in rows if r[0] == c]) for c in ("c0", "c1")}
        plain = {c: intervals.fold_labelled([(*r[1:3], 3) for r in rows if r[0] == c]) for c in ("c0", "c1")}
        fixed = intervals.merge_fixed(df, ["contig"], 3, stretch).collect()
        assert {c: sorted((r.st, r.en, 3) for r in fixed if r.contig == c) for c in ("c0", "c1")} == plain and sum(r.n for r in fixed) == 120
    assert got == {c: intervals.fold_labelled([r[1:] for r in rows if r[0] == c]) for c in ("c0", "c1")}


def test_flanked(spark):
    r = spark.createDataFrame([("c", 100, 110), ("c", 300, 310)], "contig string, st long, en long")
    v = spark.createDataFrame([("c", 115, 118), ("c", 125, 126), ("c", 290, 291), ("c", 200, 201)], "contig string, st long, en long")
    assert sorted((x.st, x.en) for x in intervals.flanked(r, v, ["contig"]).collect()) == [(90, 136), (280, 320)]


def test_statistics(spark):
    df = spark.createDataFrame([(5, 10, 15, 2), (12, 0, 6, 6), (14, 0, 7, 7), (0, 0, 3, 4), (400, 300, 350, 350)], "a long, b long, c long, d long")
    t = [F.col(c) for c in "abcd"]
    p = [r[0] for r in df.select(stats.fisher_two_sided(*t)).collect()]
    assert p[0] == pytest.approx(0.0027631345617513754, rel=1e-9) and p[1] == pytest.approx(0.01373, abs=5e-6) and p[2] < 0.01 and p[3] == 1.0
    one = df.select(stats.fisher_left(*t).alias("l"), stats.fisher_right(*t).alias("r"), F.exp(stats.ln_hypergeometric(*t)).alias("m")).collect()
    assert all(r.l + r.r - r.m == pytest.approx(1, rel=1e-9) for r in one)
    from math import lgamma

    n = [5, 16, 17, 100, 5000]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in n], "n long").select(stats.ln_fact(F.col("n"))).collect()]
    assert got == pytest.approx([lgamma(x + 1) for x in n], rel=1e-12) and got[0] == pytest.approx(4.787491742782046)
    q = spark.createDataFrame([(10, 0), (5, 5), (0, 10)], "r long, a long")
    rows = q.select(stats.variant_qual(F.col("r"), F.col("a")), stats.genotype_quality(F.col("r"), F.col("a")), stats.phred_likelihoods(F.col("r"), F.col("a"))).collect()
    assert [tuple(r) for r in rows] == [(0, 30, [0, 30, 300]), (60, 60, [150, 30, 150]), (60, 30, [300, 30, 0])]
    m = spark.createDataFrame([([4, 1, 3, 2],), ([],)], "x array<int>").select(stats.array_lower_median(F.col("x"))).collect()
    assert [r[0] for r in m] == [2, 0]
    v = spark.createDataFrame([(1, 16), (1, 3)], "a int, d int").select(genotype.three_places(F.col("a") / F.col("d"))).collect()
    assert [r[0] for r in v] == ["0.062", "0.333"]


def test_leaders(spark):
    kept = spark.createDataFrame([([30, 33, 37, 38, 46, 60],)], "x array<int>").select(sites.leader_fold(F.col("x"))).first()[0]
    assert kept == [30, 38, 60]


def test_sequences(spark):
    s = spark.createDataFrame([("AACCGGTTN",), ("ACGNACGTACG",)], "s string")
    assert [r[0] for r in s.select(sequences.reverse_complement(F.col("s"))).collect()] == ["NAACCGGTT", "CGTACGTNCGT"]
    assert s.select(sequences.kmers(F.col("s"), 3)).collect()[1][0] == ["ACG", "ACG", "CGT", "GTA", "TAC", "ACG"]
    assert s.select(sequences.kmers_apart(F.col("s"), 3)).collect()[1][0] == ["ACG", "ACG", "TAC"]
    c = spark.createDataFrame([("AAAACACACAGG",)], "s string").select(sequences.compress_homopolymers(F.col("s"))).first()[0]
    assert c == evidence.compressed("AAAACACACAGG") == "ACAGG"
    k = spark.createDataFrame([("AAAT",), ("AAAA",), ("CCCC",), ("ACGT",)], "k string")
    assert [r[0] for r in k.select(sequences.plain_kmer(F.col("k"))).collect()] == [False, False, True, True]
    assert [r[0] for r in k.select(sequences.kmer_code(F.col("k"), 4)).collect()] == [3, 0, 85, 27]


def test_regions(spark, tmp_path):
    contigs = spark.createDataFrame([("chr1", 1_200_000), ("chr2", 10), ("chrUn_1", 5), ("HLA:1", 900)], "contig string, length long")
    key = lambda df: sorted(tuple(r) for r in df.select("contig", "beg", "end").collect())
    assert key(regions.plan(spark, contigs)) == [("chr1", 1, 500_000), ("chr1", 500_001, 1_000_000), ("chr1", 1_000_001, 1_200_000), ("chr2", 1, 10)]
    assert key(regions.from_texts(spark, ["chr1:5-700,000", "chr2", "chr9:1-2", "HLA:1", "HLA:1:3-9"], contigs)) == [("HLA:1", 1, 900), ("HLA:1", 3, 9), ("chr1", 5, 500_004), ("chr1", 500_005, 700_000), ("chr2", 1, 10)]
    (tmp_path / "x.bed").write_text("# c\nchr1\t0\t100\nchr2\nchr2\t4\nchr9\t1\t2\n")
    assert key(regions.from_bed(spark, str(tmp_path / "x.bed"), contigs)) == [("chr1", 1, 100), ("chr2", 1, 10), ("chr2", 5, 10)]
    assert key(regions.plan(spark, contigs.filter("contig = 'chrUn_1'"))) == [("chrUn_1", 1, 5)]


def test_fasta(spark, tmp_path):
    seq = "".join(RND.choice("ACGT") for _ in range(950))
    (tmp_path / "x.fa").write_text(">c1 first\n" + "\n".join(seq[k : k + 70] for k in range(0, 950, 70)) + "\n>c2\nacgtn\n")
    s = fasta.read_sequences(spark, str(tmp_path / "x.fa"))
    assert {r.contig: r.seq for r in s.collect()} == {"c1": seq, "c2": "ACGTN"}
    bins = fasta.binned(s, 100)
    want = spark.createDataFrame([("c1", 95, 210), ("c1", 901, 950), ("c1", 3, 4)], "contig string, beg long, end long")
    for r in fasta.slices(bins, want, 20, 100).collect():
        lo = max(1, r.beg - 20)
        assert r.ref_beg == lo and r.ref_seq == seq[lo - 1 : r.end + 20]
    at = spark.createDataFrame([("c1", 98), ("c1", 950)], "contig string, pos long")
    assert {r.pos: r.bases for r in fasta.base_at(bins, at, F.lit(6), 100).collect()} == {98: seq[97:103], 950: seq[949:]}
    for step, n in ((50, 30), (50, 120), (100, 100), (1000, 700)):
        fasta.POINT = step
        try:
            got = fasta.base_at(bins, spark.range(1, 951).select(F.lit("c1").alias("contig"), F.col("id").alias("pos")), F.lit(n), 100).collect()
        finally:
            fasta.POINT = 1_000
        assert {r.pos: r.bases for r in got} == {p: seq[p - 1 : p - 1 + n] for p in range(1, 951)}
    (tmp_path / "x.fai").write_text("chr11\t2000000\t7\t70\t71\n")
    assert tuple(fasta.read_index(spark, str(tmp_path / "x.fai")).first()) == ("chr11", 2000000, 7, 70, 71)


def test_phasing_of_made_haplotypes():
    for seed in range(6):
        rnd = random.Random(seed)
        truth = [rnd.randrange(2) for _ in range(30)]
        variants = [phasing._Var(k, 100 * k + 100, "N", 8, 20, False, [], []) for k in range(30)]
        rows, side = [], {}
        for r in range(60):
            a = rnd.randrange(24)
            side[r] = rnd.randrange(2)
            rows.append((r, {k: truth[k] ^ side[r] ^ (rnd.random() < 0.03) for k in range(a, a + 6)}))
        rows.sort(key=lambda x: min(x[1]))
        by_read, by_var = phasing.phase_window(variants, rows, HIFI)
        for ps in {ps for ps, _, _ in by_var.values()}:
            same = {by_var[k][1] ^ truth[k] for k in by_var if by_var[k][0] == ps and by_var[k][1] >= 0}
            assert len(same) == 1  # within a set one haplotype is the truth or its mirror
        assert sum(h > 0 for h, _ in by_read.values()) >= 55


def test_stitching_is_consistent(spark):
    truth = {r: RND.randrange(1, 3) for r in range(40)}
    rows = []
    for chunk in range(8):
        turned = RND.randrange(2)
        for r in range(chunk * 4, chunk * 4 + 12):
            if r < 40:
                rows.append(("c", chunk, r, 3 - truth[r] if turned else truth[r], chunk * 1000 + 5))
    haps = spark.createDataFrame(rows, "contig string, chunk long, read_id long, hap int, phase_set long")
    chains = phasing.stitch_chains(phasing.stitch_votes(haps), haps)
    out = phasing.apply_stitch(haps, chains, ["hap"]).collect()
    assert {r.phase_set for r in out} == {5} and len({r.hap ^ truth[r.read_id] for r in out}) == 1


def test_somatic_filters(spark):
    cols = "var_id int, vtype int, n_alt int, phase_set long, qual array<int>, window_qual array<int>, indel_distance array<int>, dense array<int>, near_clip array<int>, low_complexity_error array<int>, homopolymer_error array<int>, rev array<boolean>, var_distance int, q1 int, q2 int, q3 int, tsd_len int, polya_len int, te_id int, is_low_complexity boolean, like_germline boolean"
    good = [1, 8, 3, 7, [30, 40, 35], [30, 30, 30], [10, 10, 10], [0, 0, 0], [0, 0, 0], [0, 0, 0], [0, 0, 0], [True, False, True], 50, 20, 30, 35, 0, 0, None, False, False]
    change = {2: (2, 1), 3: (4, [10, 20, 10]), 4: (6, [1, 2, 10]), 5: (12, 3), 6: (3, 0), 7: (8, [1, 1, 0]), 8: (9, [1, 0, 1])}
    rows = [tuple(good)]
    for i, (k, v) in change.items():
        row = list(good)
        row[0], row[k] = i, v
        rows.append(tuple(row))
    rows.append((20, 1, 1, 7, *good[4:16], 12, 25, None, True, False))  # a single read with duplication and tail, but of low complexity
    rows.append((21, 1, 1, 7, *good[4:16], 12, 25, None, False, False))
    got = {r.var_id: r.p for r in spark.createDataFrame(rows, cols).select("var_id", somatic.passes(HIFI).alias("p")).collect()}
    assert sorted(k for k, v in got.items() if v) == [1, 6, 8, 21]
    assert not any(spark.createDataFrame(rows[:1], cols).withColumn("rev", F.lit([True, True, True])).select(somatic.passes(ONT)).first())


def test_evidence():
    events = [Event(100, "S", 120, 0, "", False), Event(100, "=", 50, 120, "", False), Event(150, "X", 1, 170, "T", False), Event(151, "I", 2, 171, "GG", False), Event(151, "=", 60, 173, "", False), Event(211, "D", 3, 233, "", False), Event(214, "=", 20, 233, "", False)]
    qual = bytes([30] * 253)
    assert evidence.event_quality("X", 170, 1, qual, False) == 30 and evidence.event_quality("X", 170, 1, qual, True) == 0 and evidence.event_quality("D", 233, 3, qual, False) == 30
    assert evidence.gap_distance(150, events, set()) == 1 and evidence.gap_distance(150, events, {(151, "I", 2)}) == 10
    assert evidence.near_clip(150, events) and not evidence.near_clip(230, events)
    assert evidence.error_within(205, 220, events, set()) and not evidence.error_within(160, 200, events, set())
    assert not evidence.dense(150, events) and evidence.dense(150, events, 3, 100)
    assert evidence.homopolymer_error("ACGTTTTTGCA", "ACGTTTTGCA", "T", "G", 7) and not evidence.homopolymer_error("ACGATCGA", "ACGGTCGA", "A", "G", 3)


def test_region_reads(spark):
    r = spark.createDataFrame([("c", 1, 100, 200)], "contig string, region_id long, st long, en long")
    q = spark.createDataFrame([("c", 1, 50, 250), ("c", 2, 150, 250), ("c", 3, 10, 120), ("c", 4, 201, 300)], "contig string, read_id long, st long, en long")
    assert {x.read_id: x.cover for x in reads.region_reads(r, q, ["contig"]).collect()} == {1: 3, 2: 2, 3: 1}


def test_sql_functions(spark):
    sql_functions.register(spark)
    r = spark.sql("SELECT infix_edit('ACGT', 'TTACGTTT').distance AS d, edit_distance('AC', 'AG') AS e, size(dust_mask(repeat('A', 50))) AS n, affine_align('GAAAAT', 'GAAAT').query AS q, cyclic_match('ACGT', 'GTAC') AS c").first()
    assert tuple(r) == (0, 1, 1, "G-AAAT", True)


def test_streaming_sessions(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = windows.sessions(stream, "user_id", "ts", "6 hours", "60 days").writeStream.outputMode("append").format("memory").queryName("sess").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got, want = spark.table("sess"), windows.sessions(table, "user_id", "ts", "6 hours")
    assert got.exceptAll(want).count() == 0  # what the watermark has closed is final and right


def test_empty_tables(spark):
    none = spark.createDataFrame([], "contig string, st long, en long, label int")
    assert intervals.merge_fixed(none, ["contig"], 0).count() == 0 == intervals.merge_labelled(none, ["contig"]).count()
    assert intervals.overlap_join(none, none, ["contig"], 10).count() == 0


def test_kernel_queries_take_whole_texts(spark, tmp_path):
    """Passages that differ beyond their begins, in a table of three."""
    import random

    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcd") for _ in range(n)) for n in (150, 300, 131)]
    texts[1] = texts[1][:40] + texts[0] + texts[1][190:]  # the first lies within the second
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seqs = [t.translate(str.maketrans("abcd", "ACGT")) for t in texts]
    infix = {r.id: r for r in QUERIES["infix_similarity"](spark, str(tmp_path)).collect()}
    assert infix[0].distance == 0 and seqs[1][infix[0].start :].startswith(seqs[0]) and infix[0].path.count("=") in (1, len(seqs[0]))
    assert set(infix) == {0, 1} and infix[1].distance >= len(seqs[1]) - len(seqs[2])
    for r in QUERIES["affine_alignment"](spark, str(tmp_path)).collect():
        t = seqs[r.id]
        assert r.target.replace("-", "") == t and r.query.replace("-", "") == t[:50] + t[57:]
    assert {r.id: (r.s, r.consensus) for r in QUERIES["poa_consensus"](spark, str(tmp_path)).collect()} == {k: (t, t) for k, t in enumerate(seqs)}


def test_sequence_likeness_of_somatic_gaps(spark):
    from helixloom.schemas import INS

    unit, other = "ACGTTGCA", "TTGACCAGGATTACAGCATTCAGGA"
    rows = [
        ("c", 1, 1000, INS, 40, 3, unit * 5), ("c", 2, 1010, INS, 40, 5, (unit * 5)[3:] + unit[:3]), ("c", 3, 1020, INS, 40, 9, (other * 2)[:40]),
        ("c", 4, 5_000_000, INS, 40, 2, unit * 5), ("d", 5, 1000, INS, 40, 2, unit * 5),
    ]
    svs = spark.createDataFrame(rows, "contig string, var_id long, pos long, vtype int, len int, alt_cov long, gap string")
    merged = somatic.merge_alike(svs, ["contig"])
    assert {r.var_id for r in merged.collect()} == {2, 3, 4, 5}
    known = spark.createDataFrame([("c", 90, 1300, INS, 40, unit * 5), ("c", 91, 5_000_040, INS, 75, unit * 5 + "A" * 35)], "contig string, var_id long, pos long, vtype int, len int, gap string")
    left = somatic.without_germline(merged, known, ["contig"])
    # 2 is a rotation of a germline insertion 290 bases on; 4 differs from one close by by a run of A; 3 and 5 are like none
    assert {r.var_id for r in left.collect()} == {3, 5}


def test_element_library(spark, tmp_path):
    from helixloom.sources.embl import read_embl

    (tmp_path / "x.embl").write_text(
        "ID   DF0000001; SV 4; linear; DNA; STD; UNC; 12 BP.\nNM   AluX\nXX\nCC   RepeatMasker Annotations\nCC        Type: SINE\nCC        SubType: Alu\nXX\nSQ   Sequence 12 BP; 3 A;\n     acgt nacg      8\n     tttt          12\n//\n"
        "ID   DF0000002; SV 1; linear;\nNM   L1Y\nSQ   Sequence 3 BP;\n     ggg 3\n//\n"
    )
    got = [tuple(r) for r in read_embl(spark, str(tmp_path / "x.embl")).orderBy("accession").collect()]
    assert got == [("DF0000001", "4", "AluX", "SINE", "Alu", "ACGTNACGTTTT"), ("DF0000002", "1", "L1Y", None, None, "GGG")]


def test_quality_histogram(spark):
    from helixloom.operators import pileup

    rows = [("a", bytearray([10, 10, 20])), ("a", bytearray([20])), ("b", bytearray()), ("b", None), (None, bytearray([255]))]
    got = pileup.quality_histogram(spark.createDataFrame(rows, "k string, qual binary").repartition(2), ["k"])
    assert {tuple(r) for r in got.collect()} == {("a", 10, 2), ("a", 20, 2), (None, 255, 1)}
