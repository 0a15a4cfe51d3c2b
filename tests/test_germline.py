"""The whole path on simulated haplotypes."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from helixloom.config import HIFI
from helixloom.operators.genotype import body_line
from helixloom.plans import germline
from helixloom.sinks import alignments, vcf
from helixloom.sources import fasta, sam


def simulate(seed=1, n=24_000, depth=24):
    rnd = random.Random(seed)
    ref = "".join(rnd.choice("ACGT") for _ in range(n))
    truth, haps = {}, ["", ""]
    k = 0
    while k < n:
        kind = None
        if 500 < k < n - 500 and k % 400 == 0:
            kind = ("snp", "snp", "ins", "snp", "del", "hom")[k // 400 % 6]
        if kind is None:
            haps[0] += ref[k]
            haps[1] += ref[k]
            k += 1
        elif kind in ("snp", "hom"):
            alt = "ACGT"["ACGT".index(ref[k]) - 1]
            truth[k + 1] = (ref[k], alt, kind == "hom")
            haps[0] += alt if kind == "hom" else ref[k]
            haps[1] += alt
            k += 1
        elif kind == "ins":
            ins = "".join(rnd.choice("ACGT") for _ in range(7))
            if ins[-1] == ref[k - 1]:
                ins = ins[:-1] + "ACGT"["ACGT".index(ref[k - 1]) - 1]
            truth[k] = (ref[k - 1], ref[k - 1] + ins, False)
            haps[0] += ref[k]
            haps[1] += ins + ref[k]
            k += 1
        else:
            truth[k] = (ref[k - 1 : k + 4], ref[k - 1], False)
            haps[0] += ref[k : k + 4]
            k += 4
    return rnd, ref, truth, haps


def reads_of(rnd, ref, truth, depth=24, length=6000):
    """Reads that follow the truth along the reference, told with = and X."""
    rows = []
    for r in range(depth * len(ref) // length):
        st = rnd.randrange(0, len(ref) - length)
        hap = r % 2
        seq, ops, k = [], [], st
        while k < st + length:
            p = k + 1
            if p in truth and len(truth[p][0]) == 1 == len(truth[p][1]) and (hap or truth[p][2]):
                seq.append(truth[p][1])
                ops.append("X")
                k += 1
            elif k in truth and hap and k > st and len(truth[k][1]) > 1:
                seq.append(truth[k][1][1:] + ref[k])
                ops.append("I" * (len(truth[k][1]) - 1) + "=")
                k += 1
            elif k in truth and hap and k > st and len(truth[k][0]) > 1:
                ops.append("D" * (len(truth[k][0]) - 1))
                k += len(truth[k][0]) - 1
            else:
                seq.append(ref[k])
                ops.append("=")
                k += 1
        text, cigar, n = "".join(ops), "", 1
        for a, b in zip(text, text[1:] + "."):
            n, cigar = (n + 1, cigar) if a == b else (1, cigar + f"{n}{a}")
        bases = "".join(seq)
        rows.append((f"r{r}", 16 * (r % 3 == 0), "chr1", st + 1, 60, cigar, bases, bytearray([40] * len(bases)), {}))
    return rows


@pytest.fixture(scope="module")
def made(spark):
    rnd, ref, truth, _ = simulate()
    rows = reads_of(rnd, ref, truth)
    reads = spark.createDataFrame(rows, "qname string, flag int, contig string, pos long, mapq int, cigar string, seq string, qual binary, tags map<string,string>")
    bins = fasta.binned(spark.createDataFrame([("chr1", ref)], "contig string, seq string"))
    contigs = spark.createDataFrame([("chr1", len(ref))], "contig string, length long")
    return reads, contigs, bins, ref, truth


def shifted(ref, pos, r, a):
    """A variant moved as far left as it goes, so that equal ones compare equal."""
    while len(r) != len(a) and (r[-1] == a[-1]):
        pos -= 1
        r, a = ref[pos - 1] + r[:-1], ref[pos - 1] + a[:-1]
    return pos, r, a


def test_calls(spark, made):
    reads, contigs, bins, ref, truth = made
    from dataclasses import replace

    calls, haps = germline.call(reads, contigs, bins, replace(HIFI, window=10_000))
    got = {shifted(ref, r.pos, r.ref, r.alt): r for r in calls.collect()}
    want = {shifted(ref, p, r, a): hom for p, (r, a, hom) in truth.items()}
    inner = {k: v for k, v in want.items() if 2000 < k[0] < 22_000}
    assert not set(got) - set(want)
    assert len(set(inner) & set(got)) >= 0.95 * len(inner)
    for k, hom in inner.items():
        if k in got:
            assert (got[k].gt in ("1|1", "1/1")) == hom
    phased = {(r.ps, r.gt) for k, r in got.items() if k in inner and not inner[k] and r.ps}
    by_set = {}
    for ps, gt in phased:
        by_set.setdefault(ps, set()).add(gt)
    assert by_set and all(len(g) == 1 for g in by_set.values())  # all alts lie on one haplotype, so a set has one phase
    assert len(by_set) <= 2  # windows are stitched
    assert {r.hap for r in haps.collect()} <= {0, 1, 2}
    marked = germline.tagged(reads, haps)
    assert marked.count() == reads.count() and marked.filter("map_contains_key(tags, 'HP')").count() == haps.filter("hap > 0").select("read_id").distinct().count()
    lines = [r.line for r in body_line(calls).collect()]
    assert all(x.count("\t") == 9 for x in lines)


def test_deep_windows_are_parted(spark, made):
    """With few alleles to a group, the only window becomes many parts, and calls and phase stay."""
    from dataclasses import replace

    reads, contigs, bins, ref, truth = made
    a = germline.analyse(reads, contigs, bins, replace(HIFI, max_window_rows=200))
    parts = [r.chunk for r in a.variants.select("chunk").distinct().orderBy("chunk").collect()]
    assert len(parts) > 4 and parts == list(range(len(parts)))
    got = {(r.pos, r.ref, r.alt): (r.gt, r.ps) for r in germline.calls_of(a, bins, replace(HIFI, max_window_rows=200))[0].collect()}
    whole = {(r.pos, r.ref, r.alt): (r.gt, r.ps) for r in germline.call(reads, contigs, bins, HIFI)[0].collect()}
    assert set(got) == set(whole)
    het = {k for k, (gt, _) in whole.items() if gt in ("0|1", "1|0")}
    assert len({got[k][1] for k in het}) <= 2 and len({got[k][0] == whole[k][0] for k in het if 2000 < k[0] < 22_000}) == 1


def test_indel_in_a_repeat_is_called(spark):
    """A heterozygous deletion of one unit of a tandem repeat, away from dense stretches."""
    rnd, ref, _, _ = simulate(seed=7, n=12_000)
    ref = ref[:5_999] + "G" + "AC" * 12 + "T" + ref[6_025:]
    truth = {k + 1: (ref[k], "ACGT"["ACGT".index(ref[k]) - 1], False) for k in range(800, 11_600, 400) if abs(k - 6_000) > 100}
    truth[6_000] = (ref[5_999:6_002], ref[5_999], False)
    reads = spark.createDataFrame(reads_of(rnd, ref, truth), "qname string, flag int, contig string, pos long, mapq int, cigar string, seq string, qual binary, tags map<string,string>")
    bins = fasta.binned(spark.createDataFrame([("chr1", ref)], "contig string, seq string"))
    a = germline.analyse(reads, spark.createDataFrame([("chr1", len(ref))], "contig string, length long"), bins, HIFI)
    assert [r.st < 5_999 and r.en >= 6_024 + 10 for r in a.regions.collect()] == [True]
    got = {shifted(ref, r.pos, r.ref, r.alt): r.gt for r in germline.calls_of(a, bins, HIFI)[0].collect()}
    assert got[6_000, "GAC", "G"] in ("0|1", "1|0") and set(got) <= set((p, r, x) for p, (r, x, _) in truth.items())


def test_sam_and_tags(spark, made, tmp_path):
    reads, contigs, _, ref, _ = made
    head = alignments.header_text([("chr1", len(ref))], "s1")
    (tmp_path / "x.sam").write_text(head + "\n".join(r.value for r in alignments.sam_line(reads).collect()) + "\n")
    back = sam.read_sam(spark, str(tmp_path / "x.sam")).drop("source_idx")
    key = lambda df: sorted((r.qname, r.flag, r.contig, r.pos, r.mapq, r.cigar, r.seq, bytes(r.qual)) for r in df.collect())
    assert key(back) == key(reads)
    assert sam.header(spark, str(tmp_path / "x.sam")) == {"contigs": [("chr1", len(ref))], "samples": ["s1"]}
    haps = reads.limit(3).selectExpr("qname", "contig", "pos", "1 AS hap", "77L AS phase_set")
    tagged = alignments.haplotagged(reads, haps)
    assert tagged.filter("tags['HP'] = '1' AND tags['PS'] = '77'").count() == 3 and tagged.count() == reads.count()


def test_refined_tags(spark, made):
    from helixloom.operators.decode import decode

    reads, contigs, _, ref, _ = made
    rows = decode(sam.usable(reads), HIFI).limit(4).collect()
    for r in rows:
        ops = [(e.op, e.len) for e in r.events]
        assert sum(n for op, n in ops if op in "=XD") == r.end - r.pos + 1
    one = spark.createDataFrame([([("=", 3, 1, None, None), ("X", 1, 4, "A", "T"), ("I", 2, 5, "GG", None), ("=", 2, 5, None, None), ("D", 2, 7, None, "CC")],)], "e array<struct<op:string,len:int,pos:long,alt:string,ref:string>>")
    from pyspark.sql import functions as F

    r = one.select(alignments.cigar_of(F.col("e")).alias("c"), alignments.edit_distance(F.col("e")).alias("nm"), alignments.cs_of(F.col("e")).alias("cs"), alignments.md_of(F.col("e")).alias("md")).first()
    assert tuple(r) == ("3=1X2I2=2D", 5, ":3*ta+gg:2-cc", "3T2^CC0")


def test_vcf_file(spark, tmp_path):
    calls = spark.createDataFrame([("chr2", 5, "A", "T", 60, "0|1", 16, 15, 1, 30, 5), ("chr1", 9, "AC", "A", 60, "1/1", 3, 0, 3, 9, None)], "contig string, pos long, ref string, alt string, qual int, gt string, dp int, ref_ad int, alt_ad int, gq int, ps long")
    contigs = [("chr1", 100), ("chr2", 100)]
    vcf.write(calls, str(tmp_path / "v"), contigs, "s1")
    vcf.merge_parts(str(tmp_path / "v"), str(tmp_path / "v.vcf"))
    text = (tmp_path / "v.vcf").read_text().splitlines()
    body = [x.split("\t") for x in text if not x.startswith("#")]
    assert [b[0] for b in body] == ["chr1", "chr2"] and body[1][9] == "0|1:16:15,1:0.062:30:5" and body[0][7] == "END=10"
    assert body[0][8] == "GT:DP:AD:VAF:GQ" and text[0].startswith("##fileformat")


def test_reads_are_refined(spark):
    """Reads that show a deletion in a repeat at odd places are rewritten to one; their tags say what their CIGAR says."""
    from helixloom.plans import refine

    rnd, ref, _, _ = simulate(seed=7, n=12_000)
    ref = ref[:5_999] + "G" + "AC" * 12 + "T" + ref[6_025:]
    truth = {k + 1: (ref[k], "ACGT"["ACGT".index(ref[k]) - 1], False) for k in range(800, 11_600, 400) if abs(k - 6_000) > 100}
    truth[6_000] = (ref[5_999:6_002], ref[5_999], False)
    rows = reads_of(rnd, ref, truth)
    for k, r in enumerate(rows):  # the gap of every fourth read lies ten bases farther on, which is as good
        if k % 4 == 1:
            ops = "".join(o * int(n) for n, o in re.findall(r"(\d+)([=XID])", r[5]))
            at = 5_999 + 1 - (r[3] - 1) if "D" in ops else None
            if at and 0 < at < len(ops) - 40 and ops[at : at + 2] == "DD":
                ops = ops[:at] + "=" * 10 + "DD" + ops[at + 12 :]
                text, n = "", 1
                for a, b in zip(ops, ops[1:] + "."):
                    n, text = (n + 1, text) if a == b else (1, text + f"{n}{a}")
                rows[k] = (*r[:5], text, *r[6:])
    reads = spark.createDataFrame(rows, "qname string, flag int, contig string, pos long, mapq int, cigar string, seq string, qual binary, tags map<string,string>")
    bins = fasta.binned(spark.createDataFrame([("chr1", ref)], "contig string, seq string"))
    a = germline.analyse(reads, spark.createDataFrame([("chr1", len(ref))], "contig string, length long"), bins, HIFI)
    out = {r.qname: r for r in refine.refined(a, reads, bins, HIFI).collect()}
    assert set(out) == {r[0] for r in rows}
    changed = [r for r in rows if out[r[0]].cigar != r[5]]
    assert changed
    for old in rows:
        r = out[old[0]]
        ops = [(int(n), o) for n, o in re.findall(r"(\d+)([=XIDS])", r.cigar)]
        at, q, gaps, nm = r.pos - 1, 0, [], 0
        for n, o in ops:
            if o in "=X":
                assert all((ref[at + k] == r.seq[q + k]) == (o == "=") for k in range(n))
            if o == "D":
                gaps.append(at + 1)
            nm += n if o in "XID" else 0
            at, q = at + n * (o in "=XD"), q + n * (o in "=XI")
        assert q == len(r.seq)
        if r.pos < 5_900 and at > 6_100:
            assert gaps in ([], [6_001])  # all at the same place now
        if old in changed:
            assert r.tags["NM"] == str(nm) and set(r.tags) >= {"MD", "cs"}
            assert sum(int(x) if x.isdigit() else len(x.strip("^")) for x in re.findall(r"\d+|\^[A-Z]+|[A-Z]", r.tags["MD"])) == at - r.pos + 1


def keyed(df):
    return sorted(repr((r.qname, r.flag, r.contig, r.pos, r.mapq, r.cigar, r.seq, bytes(r.qual or b""), sorted((k, v) for k, v in r.tags.items() if k != "PG"))) for r in df.collect())


def test_bam_source(spark, made, tmp_path):
    from helixloom.sources.bam import Bam, write_bam

    reads, contigs, _, ref, _ = made
    write_bam(str(tmp_path / "x.bam"), iter([r.asDict() for r in reads.orderBy("pos").collect()]), [("chr1", len(ref))])
    spark.dataSource.register(Bam)
    back = spark.read.format("bam").load(str(tmp_path / "x.bam"))
    assert keyed(back) == keyed(reads)


def test_bam_sink(spark, made, tmp_path):
    """Written by the tasks in parts; the parts behind each other are a file that reads back whole, in order, unplaced reads last."""
    from helixloom.sources import bam
    from helixloom.sources.bam import Bam

    reads, contigs, _, ref, _ = made
    odd = spark.createDataFrame([("u1", 4, None, 0, 0, "*", "ACG", bytearray(b"\x01\x02\x03"), {}), ("u2", 4, None, 0, 0, "*", "*", bytearray(), {"XX": "a"})], reads.schema)
    every = reads.withColumn("tags", F.create_map(F.lit("HP"), F.lit("1"))).unionByName(odd)
    text = alignments.header_text([("chr1", len(ref))], "s1", version="1", command="call")
    alignments.write_bam(every.repartition(5), str(tmp_path / "b"), [("chr1", len(ref))], text)
    vcf.merge_parts(str(tmp_path / "b"), str(tmp_path / "y.bam"))
    spark.dataSource.register(Bam)
    back = spark.read.format("bam").load(str(tmp_path / "y.bam"))
    assert keyed(back) == keyed(every)
    rows = back.collect()
    assert [r.pos for r in rows if r.contig] == sorted(r.pos for r in rows if r.contig) and [r.contig for r in rows[-2:]] == [None, None]
    some = spark.read.format("bam").option("exclude_flags", 4).option("min_mapq", 60).option("source_idx", "true").load(str(tmp_path / "y.bam"))
    pushed = bam.read(spark, [str(tmp_path / "y.bam")] * 2, source_idx="true").filter("mapq > 59 AND contig = 'chr1'")
    assert pushed.groupBy("source_idx").count().orderBy("source_idx").collect() == [(0, reads.count()), (1, reads.count())]
    assert some.count() == reads.count() and some.columns[-1] == "source_idx" and some.filter("source_idx <> 0").isEmpty()


def test_an_index_changes_no_row(spark, made, tmp_path):
    import struct

    from helixloom.sources import bam
    from helixloom.sources.bgzf import Reader

    reads, contigs, _, ref, _ = made
    odd = [{"qname": f"u{k}", "flag": 4, "contig": None, "pos": 0, "mapq": 0, "cigar": "*", "seq": "ACG", "qual": b"", "tags": {}} for k in range(3)]
    path = str(tmp_path / "z.bam")
    names = [("chr0", 1000), ("chr1", len(ref)), ("chr2", 500)]
    bam.write_bam(path, iter([*[r.asDict() for r in reads.orderBy("pos").collect()], *odd]), names)
    spark.dataSource.register(bam.Bam)
    plain = keyed(spark.read.format("bam").load(path))
    with open(path, "rb") as f:  # a linear index as the format's own tools write it
        r = Reader(f)
        bam.read_header(r)
        offsets: dict[int, int] = {}
        while True:
            at = r.tell()
            if len(head := r.read(4)) < 4:
                break
            raw = r.read(struct.unpack("<i", head)[0])
            ref_id, pos = struct.unpack_from("<ii", raw)
            if ref_id == 1:
                for w in range(pos >> 14, (pos + 5999) >> 14):
                    offsets.setdefault(w, at)
                offsets.setdefault((pos + 5999) >> 14, at)
    n = max(offsets) + 1
    empty = struct.pack("<ii", 0, 0)
    (tmp_path / "z.bam.bai").write_bytes(b"BAI\1" + struct.pack("<i", 3) + empty + struct.pack("<ii", 0, n) + struct.pack(f"<{n}Q", *(offsets.get(w, 0) for w in range(n))) + empty)
    many = spark.read.format("bam").option("window", 5000).load(path)
    assert many.rdd.getNumPartitions() > 3 and keyed(many) == plain


def test_vcf_in_blocks(spark, tmp_path):
    import gzip

    calls = spark.createDataFrame([(f"chr{k % 2 + 1}", 5 + k, "A", "T", 60, "0|1", 16, 15, 1, 30, 5) for k in range(500)], "contig string, pos long, ref string, alt string, qual int, gt string, dp int, ref_ad int, alt_ad int, gq int, ps long")
    contigs = [("chr1", 1000), ("chr2", 1000)]
    for kind in ("none", "bgzf"):
        vcf.write(calls, str(tmp_path / kind), contigs, "s1", kind, ("##source=x",))
        vcf.merge_parts(str(tmp_path / kind), str(tmp_path / f"{kind}.vcf"))
    plain = (tmp_path / "none.vcf").read_bytes()
    assert gzip.decompress((tmp_path / "bgzf.vcf").read_bytes()) == plain and plain.count(b"\tPASS\t") == 500 and b"##source=x" in plain


def test_mosaic(spark):
    """A SNV on some reads of one haplotype, and a long insertion of an element; a germline-like error on no haplotype isn't called."""
    from dataclasses import replace

    from helixloom.plans import mosaic

    rnd, ref, truth, _ = simulate(seed=4, n=16_000)
    rows = [list(r) for r in reads_of(rnd, ref, truth, depth=40)]
    spot, changed = 8_130, 0
    for r in rows:
        hap2, st, cigar = int(r[0][1:]) % 2, r[3], r[5]
        if hap2 == 0 and changed < 4 and st < spot - 700 and st + 5999 > spot + 700:
            # haplotype 1 follows the reference up to homozygous SNPs, so that places in the read are places in the reference
            k = spot - st
            r[6] = r[6][:k] + "ACGT"["ACGT".index(ref[spot - 1]) - 2] + r[6][k + 1 :]
            out, at = "", 0
            for n, op in re.findall(r"(\d+)([=XID])", cigar):
                n = int(n)
                if op == "=" and at <= k < at + n:
                    out += (f"{k - at}=" if k > at else "") + "1X" + (f"{at + n - k - 1}=" if at + n - k - 1 else "")
                else:
                    out += f"{n}{op}"
                at += n if op in "=XI" else 0
            r[5] = out
            changed += 1
    assert changed == 4
    reads = spark.createDataFrame([tuple(r) for r in rows], "qname string, flag int, contig string, pos long, mapq int, cigar string, seq string, qual binary, tags map<string,string>")
    bins = fasta.binned(spark.createDataFrame([("chr1", ref)], "contig string, seq string"))
    a = germline.analyse(reads, spark.createDataFrame([("chr1", len(ref))], "contig string, length long"), bins, HIFI)
    got = [(r.pos, r.ref, r.alt, r.somatic) for r in mosaic.call(a, bins, replace(HIFI, somatic=True)).collect()]
    assert got == [(spot, ref[spot - 1], "ACGT"["ACGT".index(ref[spot - 1]) - 2], True)]


def test_mosaic_in_a_noisy_region(spark):
    """A SNV on three reads of one haplotype beside a repeat whose deletion makes the region noisy: no consensus has it, single reads share it."""
    from dataclasses import replace

    from helixloom.plans import mosaic

    rnd, ref, _, _ = simulate(seed=7, n=12_000)
    ref = ref[:5_999] + "G" + "AC" * 12 + "T" + ref[6_025:]
    truth = {k + 1: (ref[k], "ACGT"["ACGT".index(ref[k]) - 1], False) for k in range(800, 11_600, 400) if abs(k - 6_000) > 100}
    truth[6_000] = (ref[5_999:6_002], ref[5_999], False)
    rows, spot, changed = [list(r) for r in reads_of(rnd, ref, truth, depth=40)], 6_029, 0
    alt = "ACGT"["ACGT".index(ref[spot - 1]) - 2]
    for r in rows:
        st = r[3]
        if int(r[0][1:]) % 2 == 0 and changed < 3 and st < spot - 900 and st + 5_999 > spot + 900:
            k = spot - st
            r[6] = r[6][:k] + alt + r[6][k + 1 :]
            out, at = "", 0
            for n, op in re.findall(r"(\d+)([=XID])", r[5]):
                n = int(n)
                if op == "=" and at <= k < at + n:
                    out += (f"{k - at}=" if k > at else "") + "1X" + (f"{at + n - k - 1}=" if at + n - k - 1 else "")
                else:
                    out += f"{n}{op}"
                at += n if op in "=XI" else 0
            r[5] = out
            changed += 1
    assert changed == 3
    reads = spark.createDataFrame([tuple(r) for r in rows], "qname string, flag int, contig string, pos long, mapq int, cigar string, seq string, qual binary, tags map<string,string>")
    bins = fasta.binned(spark.createDataFrame([("chr1", ref)], "contig string, seq string"))
    a = germline.analyse(reads, spark.createDataFrame([("chr1", len(ref))], "contig string, length long"), bins, HIFI)
    found, seen = mosaic.candidates(a, bins, replace(HIFI, somatic=True))
    got = {(r.pos, r.alt_seq): r for r in found.collect()}
    assert (spot, alt) in got and got[spot, alt].alt_cov == 3
    at = seen.filter(F.col("site_id") == got[spot, alt].site_id)
    assert at.filter("alt").count() == 3 and at.count() > 20
    calls = mosaic.call(a, bins, replace(HIFI, somatic=True, read_names=True)).collect()
    assert [(r.pos, r.alt, len(r.alt_reads.split(","))) for r in calls] == [(spot, alt, 3)]


def test_names_of_alt_reads(spark, made):
    from dataclasses import replace

    reads, contigs, bins, ref, truth = made
    calls, _ = germline.call(reads, contigs, bins, replace(HIFI, window=10_000, read_names=True))
    rows = calls.collect()
    assert rows and all(len(r.alt_reads.split(",")) == r.alt_ad for r in rows)
    assert body_line(calls).filter("line LIKE '%ALTREADS%'").count() == len(rows)
