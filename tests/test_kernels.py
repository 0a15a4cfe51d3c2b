"""Sequential kernels against brute force and hand-made vectors."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest

from helixloom.config import HIFI
from helixloom.functions import align, dust, elements, poa
from helixloom.operators.decode import BadAlignment, Event, chained, dense_windows, events_of, keeps, noisy_of, palindrome
from helixloom.operators.intervals import flank_reach, fold_labelled
from helixloom.operators.noisy import call_region, slice_of, splice
from helixloom.sources import bam, bgzf

RND = random.Random(3)


def dna(n, letters="ACGT"):
    return "".join(RND.choice(letters) for _ in range(n))


def edits(a, b, mode):
    free = mode == "HW"
    prev = [0 if free else j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1] if mode == "NW" else min(prev)


@pytest.mark.parametrize("mode", ["NW", "HW", "SHW"])
def test_edit(mode):
    for _ in range(60):
        a, b = dna(RND.randrange(0, 12), "ACG"), dna(RND.randrange(0, 15), "ACG")
        hit = align.edit(a, b, mode)
        assert hit.distance == edits(a, b, mode)
        used = b[hit.start : hit.end + 1]
        assert sum(c in "=XD" for c in hit.path) == len(used) and sum(c in "=XI" for c in hit.path) == len(a)
        assert sum(c != "=" for c in hit.path) == hit.distance


def affine_cost(a, b, x=6, o=(6, 24), e=(2, 1)):
    """Cost of the best alignment by three states of each piece, plainly."""
    big = 10**9
    h = {(0, 0): 0}
    f = {}
    for i in range(len(b) + 1):
        for j in range(len(a) + 1):
            best = 0 if i == j == 0 else big
            for p in (0, 1):
                if j:
                    f["g", p, i, j] = min(h[i, j - 1] + o[p] + e[p], f.get(("g", p, i, j - 1), big) + e[p])
                if i:
                    f["i", p, i, j] = min(h[i - 1, j] + o[p] + e[p], f.get(("i", p, i - 1, j), big) + e[p])
                best = min(best, f.get(("g", p, i, j), big), f.get(("i", p, i, j), big))
            if i and j:
                best = min(best, h[i - 1, j - 1] + (a[j - 1] != b[i - 1]) * x)
            h[i, j] = best
    return h[len(b), len(a)]


def cost_of(t, q, x=6, o=(6, 24), e=(2, 1)):
    total, k = 0, 0
    while k < len(t):
        if "-" in (t[k], q[k]):
            side = t if t[k] == "-" else q
            n = k
            while n < len(t) and side[n] == "-":
                n += 1
            total += min(o[p] + e[p] * (n - k) for p in (0, 1))
            k = n
        else:
            total += x * (t[k] != q[k])
            k += 1
    return total


@pytest.mark.parametrize("left", [True, False])
def test_affine(left):
    for _ in range(80):
        a, b = dna(RND.randrange(0, 14), "AC"), dna(RND.randrange(0, 14), "AC")
        t, q = align.affine(a, b, left=left)
        assert (t.replace("-", ""), q.replace("-", "")) == (a, b) and len(t) == len(q)
        assert cost_of(t, q) == affine_cost(a, b)


def test_gaps_go_left_or_right():
    assert align.affine("GAAAAT", "GAAAT") == ("GAAAAT", "G-AAAT")
    assert align.affine("GAAAAT", "GAAAT", left=False) == ("GAAAAT", "GAAA-T")
    assert align.affine("GCACAT", "GCACACAT")[0].startswith("G--")
    assert align.largest_insertion("ACGTACGT", "ACGTTTTTTTTACGT") in ("TTTTTTT", "TTTTTTTT")


def test_gapped_variants_and_alleles():
    assert align.gapped_variants("AC-GT", "ATTG-", 10) == [(12, 1, 0, 1, "T"), (13, 2, 1, 0, "")]
    assert align.gapped_variants("ACGT", "ATGT", 10) == [(11, 8, 1, 1, "T")]
    site = (11, 8, 1, 1, "T")
    assert [align.allele_in("ACGT", q, 10, site) for q in ("ATGT", "ACGT", "AGGT")] == [1, 0, -1]


def test_cyclic_match():
    assert align.cyclic_match("ACGTACGTAC", "GTACGTACAC"[:8] + "GT")
    assert not align.cyclic_match("AAAAAAAAAA", "CCCCCCCCCC")


def test_dust():
    assert dust.mask("ACGTTGCAAGTCCATG", 20, 64) == []
    poly = "ACGTCGATTG" + "A" * 30 + "CGTAGCTAGG"
    (st, en), = dust.mask(poly, 20, 64)
    assert st <= 11 and en >= 39 and dust.covered("A" * 40) == 1.0
    assert dust.mask("N" * 10 + "AC" * 20 + "N" * 5, 20, 64) == [(10, 50)]


def test_elements():
    tsd, body = "GATTACAGATTACA", dna(40, "CG")
    assert elements.insertion_marks(tsd + body + "A" * 15, tsd + "CCC" + dna(60), HIFI) == (14, 15)
    assert elements.insertion_marks(tsd + "T" * 12 + body, tsd + "CCC" + dna(60), HIFI)[1] == -12
    assert elements.insertion_marks(tsd + body, tsd + "CCC" + dna(60), HIFI) == (0, 0)


def noisy(s, rate):
    return "".join(RND.choice("ACGT") if RND.random() < rate else c for c in s if RND.random() > rate / 2)


def test_consensus():
    for _ in range(5):
        truth = dna(60)
        assert align.edit(poa.consensus([noisy(truth, 0.05) for _ in range(15)]), truth).distance <= 1
    a = dna(50)
    b = a[:20] + "TTTTTTTT" + a[20:]
    got = poa.split([a] * 6 + [b] * 5, 0.2)
    assert {c for c, _ in got} == {a, b} and sorted(len(m) for _, m in got) == [5, 6]
    assert len(poa.split([a] * 9 + [b], 0.2)) == 1


def test_merge_fold():
    assert fold_labelled([(0, 10, 5), (13, 20, 4), (30, 40, 100), (100, 110, 60)]) == [(0, 20, 5), (30, 110, 100)]
    for _ in range(30):
        rows = [(s := RND.randrange(200), s + RND.randrange(1, 10), RND.randrange(8)) for _ in range(20)]
        once = fold_labelled(rows)
        assert fold_labelled(once) == once


def test_flank():
    assert flank_reach(100, 110, [(115, 118), (140, 141)]) == (90, 128)
    assert flank_reach(100, 110, [(92, 95), (84, 86), (50, 60)]) == (74, 120)
    assert flank_reach(100, 110, []) == (90, 120)


def test_dense_windows():
    assert dense_windows([(101 + k, 1, 1) for k in range(6)], 100, 5) == [(100, 107, 7)]
    assert dense_windows([(200, 0, 6)], 100, 5) == [(199, 200, 6)]
    assert dense_windows([(300, 6, 6)], 100, 5) == [(299, 306, 7)]
    assert dense_windows([(k * 100, 1, 1) for k in range(20)], 100, 5) == []


REF = "ACGTACGTTTGACCA"


def test_decoders_agree():
    """One alignment told in four ways."""
    seq = "ACGAACGGTTTACCA"[:4] + "CG" + "GG" + "TTT" + "ACCA"
    # reference ACGTACGTTTGACCA: 3 equal, T>A, skip A (deletion), CG, insert GG, TTT, delete G, ACCA
    assert seq == "ACGACGGGTTTACCA"
    told = [
        events_of(1, "3=1X1D2=2I3=1D4=", seq, b"", {}, None, 1, HIFI),
        events_of(1, "4M1D2M2I3M1D4M", seq, b"", {"cs": ":3*ta-a:2+gg:3-g:4"}, None, 1, HIFI),
        events_of(1, "4M1D2M2I3M1D4M", seq, b"", {"MD": "3T0^A5^G4"}, None, 1, HIFI),
        events_of(1, "4M1D2M2I3M1D4M", seq, b"", {}, REF, 1, HIFI),
    ]
    assert all(t == told[0] for t in told[1:]) and chained(told[0])
    assert told[0][1] == Event(4, "X", 1, 3, "A", False) and told[0][4] == Event(8, "I", 2, 6, "GG", False)


def test_decode_faults_and_quality():
    with pytest.raises(BadAlignment):
        events_of(1, "5M", "ACGTA", b"", {"MD": "9"}, None, 1, HIFI) and events_of(1, "6M", "ACGTA", b"", {"MD": "6"}, None, 1, HIFI)
    with pytest.raises(BadAlignment):
        events_of(1, "5M", "ACGTA", b"", {"cs": ":5?"}, None, 1, HIFI)
    e = events_of(1, "1=1X2I1=", "ACGTA", bytes([40, 5, 5, 40, 40]), {}, None, 1, HIFI)
    assert [x.low_qual for x in e] == [False, True, False, False]


def test_clips_and_skips():
    e = events_of(1000, "60S500=70H", "A" * 560, b"", {}, None, 1, HIFI)
    spans, n = noisy_of(e, 1000, 1499, 10_000, HIFI)
    assert spans == [(999, 1099, 0), (1399, 1499, 0)] and n == 2 and keeps(spans, n, 1000, 1499, HIFI)
    assert not keeps([(1000, 1300, 5)], 2, 1000, 1499, HIFI) and not keeps([], 26, 1000, 1499, HIFI)
    assert palindrome(1000, 1999, "chr1,1050,-,100S950M,60,0;", "chr1") and not palindrome(1000, 1999, "chr1,1500,-,950M,60,0;", "chr1")


def test_region_call_and_splice():
    ref = dna(80)
    hap2 = ref[:30] + "GATTACAGATTACA" + ref[30:60] + ref[66:]
    rows = []
    for k in range(12):
        seq = hap2 if k % 2 else ref
        t, q = align.affine(ref, seq)
        cigar = "".join(f"1{'I' if a == '-' else 'D' if b == '-' else '=' if a == b else 'X'}" for a, b in zip(t, q, strict=True))
        rows.append((k, slice_of(events_of(101, cigar, seq, b"", {}, None, 1, HIFI), seq, 101, 180), k % 2 + 1 if k < 8 else 0, 5 if k < 8 else -1, 0.0))
    sites, alleles, single, pairs = call_region(101, ref, rows, replace(HIFI, somatic=True, refine=True))
    assert not single
    assert all(t.replace("-", "") == ref and q.replace("-", "") == (hap2 if r % 2 else ref) for r, t, q in pairs) and len(pairs) == 12
    assert {(s[1], s[2], s[3], s[5]) for s in sites} == {(1, 0, 14, 2), (2, 6, 0, 2)}
    assert all(a == r % 2 for r, _, a in alleles) and len(alleles) == 24
    e = events_of(101, "80=", ref, b"", {}, None, 1, HIFI)
    out = splice(e, (ref[20:30], ref[20:30]), 121, 130, ref)
    assert out == e


def test_bgzf_and_bam(tmp_path):
    data = RND.randbytes(200_000)
    p = tmp_path / "x.gz"
    p.write_bytes(bgzf.compress(data))
    with open(p, "rb") as f:
        assert bgzf.Reader(f).read(10**6) == data
    import gzip

    assert gzip.decompress(p.read_bytes()) == data
    rows = [{"qname": f"r{k}", "flag": 16 * (k % 2), "contig": "chr1", "pos": 100 + k, "mapq": 60, "cigar": "5S10=1X", "seq": dna(16), "qual": bytes([30] * 16), "tags": {"NM": "1", "cs": ":10*ac", "HP": "2"}} for k in range(50)]
    bam.write_bam(str(tmp_path / "x.bam"), iter(rows), [("chr1", 5000)])
    with open(tmp_path / "x.bam", "rb") as f:
        r = bgzf.Reader(f)
        text, contigs = bam.read_header(r)
        import struct

        got = []
        while len(head := r.read(4)) == 4:
            got.append(bam.decode(r.read(struct.unpack("<i", head)[0]), contigs))
    assert contigs == [("chr1", 5000)] and [dict(zip(rows[0], g, strict=True)) for g in got] == rows



def mutated(rng, s, rate):
    out = []
    for c in s:
        x = rng.random()
        if x < rate / 3:
            continue
        if x < rate:
            out.append(rng.choice("ACGT"))
        if x >= 2 * rate / 3:
            out.append(c)
    return "".join(out)


def test_composed_pairs():
    rng = random.Random(6)
    for _ in range(60):
        a = "".join(rng.choice("ACGT") for _ in range(60))
        b = mutated(rng, a, 0.2)
        c = mutated(rng, b, 0.2)
        first, second = align.affine(a, b), align.affine(b, c)
        x, y = align.composed(first, second)
        assert x.replace("-", "") == a and y.replace("-", "") == c and len(x) == len(y) and ("-", "-") not in set(zip(x, y))
        # bases of a and c stand together just where the same base of b holds them together
        place = lambda top, low: {i: j for i, j in _columns(top, low)}
        ab, bc = place(*first), place(*second)
        assert place(x, y) == {i: bc[j] for i, j in ab.items() if j in bc}
    same = ("ACGT", "ACGT")
    assert align.composed(same, same) == same


def _columns(top, low):
    """Places of bases that share a column."""
    i = j = 0
    for a, b in zip(top, low, strict=True):
        if a != "-" and b != "-":
            yield i, j
        i, j = i + (a != "-"), j + (b != "-")


def test_bands_give_what_whole_matrices_give(monkeypatch):
    """From a band of one column on, doubled as needed, results equal those of a band wider than the matrix."""
    rng = random.Random(9)
    pairs = []
    for k in range(150):
        t = "".join(rng.choice("ACGT"[: rng.choice([1, 2, 4])]) for _ in range(rng.randrange(0, 80)))
        q = mutated(rng, t, rng.choice([0, 0.1, 0.5]))
        pairs.append((t, q[:10] + q[30:] if k % 4 == 0 else q))
    results = []
    for band in (1, 1000):
        monkeypatch.setattr(align, "BAND", band)
        results.append([(align.edit(q, t), align.affine(t, q), align.affine(t, q, left=False)) for t, q in pairs])
    assert results[0] == results[1]


def test_long_alignments_in_bounded_memory():
    import tracemalloc

    rng = random.Random(2)
    t = "".join(rng.choice("ACGT") for _ in range(10_000))
    q = mutated(rng, t, 0.05)
    q = q[:4000] + "".join(rng.choice("ACGT") for _ in range(300)) + q[4000:]
    tracemalloc.start()
    a, b = align.affine(t, q)
    assert a.replace("-", "") == t and b.replace("-", "") == q
    got = align.edit(q, t)
    assert sum(c in "=XD" for c in got.path) == len(t) and sum(c != "=" for c in got.path) == got.distance
    assert align.edit(q[2000:4000], t, "HW").distance < 300
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20


def test_consensus_within_a_band(monkeypatch):
    rng = random.Random(4)
    t = "".join(rng.choice("ACGT") for _ in range(1500))
    seqs = [mutated(rng, t, 0.03) for _ in range(9)]
    whole = poa.consensus(seqs)
    monkeypatch.setattr(poa, "CELLS", 1_000_000)
    assert poa.consensus(seqs) == whole == t


def test_homopolymer_regions():
    from helixloom.operators.noisy import in_homopolymer

    flank = "ACGTACGTAC"
    assert in_homopolymer(flank + "GAAAAAAG" + flank, 10) and not in_homopolymer(flank + "GAAAAG" + flank, 10)
    assert not in_homopolymer(flank + "GAAAAAAG" + "CT" * 40 + flank, 10) and not in_homopolymer("AAAAAAA", 10)


def test_haplotype_sequence():
    from helixloom.operators.evidence import haplotype

    ref, lo = "ACGTACGTAC", 101
    known = [
        {"pos": 102, "op": "X", "len": 1, "alt": "T", "phase_set": 5, "hap1": 1, "hap2": 0}, {"pos": 104, "op": "I", "len": 2, "alt": "GG", "phase_set": 5, "hap1": 0, "hap2": 1},
        {"pos": 105, "op": "D", "len": 2, "alt": "", "phase_set": 9, "hap1": 1, "hap2": 1}, {"pos": 108, "op": "X", "len": 1, "alt": "A", "phase_set": 5, "hap1": 1, "hap2": 0},
    ]
    assert haplotype(ref, lo, 108, known, 1, 5) == ("ATGTGTAC", 5)  # the deletion is on both; what changes the site itself is left out
    assert haplotype(ref, lo, 110, known, 2, 5) == ("ACGGGTGTAC", 9)
    assert haplotype(ref, lo, 110, known, 1, 7) == ("ACGTGTAC", 7)  # of another phase set only what is homozygous


def test_alike_gaps():
    from helixloom.operators.somatic import alike
    from helixloom.schemas import DEL, INS

    unit = "ACGTTGCA"
    assert alike(INS, (100, 40, unit * 5), (120, 40, (unit * 5)[3:] + unit[:3])) and not alike(INS, (100, 40, unit * 5), (120, 40, "G" * 40))
    assert not alike(INS, (100, 40, unit * 5), (141, 40, unit * 5)) and not alike(INS, (100, 40, unit * 5), (100, 60, unit * 7 + "ACGT"))
    assert alike(DEL, (100, 50, ""), (150, 45, "")) and not alike(DEL, (100, 50, ""), (151, 45, ""))


def test_batch_decoder_equals_read_by_read():
    import random

    import pyarrow as pa

    from helixloom.config import ONT
    from helixloom.operators import decode_batch

    rnd, reads, clip = random.Random(5), [], lambda: rnd.choice(["", "", "4S", "60S", "70H", "20H40S"])
    for k in range(3000):
        ref = "".join(rnd.choice("ACGT") for _ in range(rnd.randint(10, 150)))
        head, tail, at, ops, seq, cs, md, run = clip(), clip(), 0, [], "", "", "", 0
        while at < len(ref):
            kind, n = rnd.choice("=====XXIIDDN" if k % 3 else "==XIDP"), rnd.randint(1, 12)
            n = min(n, len(ref) - at)
            if kind == "=":
                seq, cs, run = seq + ref[at : at + n], cs + f":{n}", run + n
            elif kind == "X":
                other = ref[at : at + n].translate(str.maketrans("ACGT", "CGTA"))
                seq, cs = seq + other, cs + "".join(f"*{a}{b}" for a, b in zip(ref[at : at + n].lower(), other.lower(), strict=True))
                md, run = md + "".join(f"{run if i == 0 else 0}{c}" for i, c in enumerate(ref[at : at + n])), 0
            elif kind == "I":
                seq, cs = seq + "T" * n, cs + "+" + "t" * n
            elif kind == "D":
                cs, md, run = cs + "-" + ref[at : at + n].lower(), md + f"{run}^{ref[at : at + n]}", 0
            elif kind == "N":
                cs += f"~gt{n}ag"
            ops.append(f"{n}{kind}")
            at += n if kind in "=XDN" else 0
        md += str(run)
        seq = "G" * (int(head[-3:-1]) if head[-1:] == "S" and len(head) > 2 else 4 if head else 0) * (head[-1:] == "S") + seq
        seq += "G" * sum(int(n) for n, op in __import__("re").findall(r"(\d+)([SH])", tail) if op == "S")
        way, cigar, tags = k % 7, head + "".join(ops) + tail, {"SA": f"c,{90 + k % 20},+,{len(ref)}M,60,0;"} if k % 5 == 0 else {}
        if way > 1:
            cigar = cigar.replace("=", "M").replace("X", "M")
        if way in (2, 6):
            tags["cs"] = cs if k % 11 else cs[:-1] + rnd.choice(["", "?", ":0", "=AC"])
        if way in (3, 6):
            tags["MD"] = md if k % 11 else rnd.choice(["", "5", md + "9", md[:-1] + "^", md.replace("0", "")])
        if k % 13 == 0:
            cigar = rnd.choice(["*", "", cigar + "3", cigar + "0M", "M" + cigar, cigar + "1I", cigar.replace("D", "Q")])
        qual = bytes(rnd.choice((5, 40)) for _ in seq)[: rnd.choice((None, None, len(seq) // 2, 0))]
        lone = len(cigar) < 2 or way in (4, 5)
        reads.append({
            "contig": "c", "pos": rnd.choice((5, 100)), "flag": rnd.choice((0, 16)), "cigar": cigar, "seq": rnd.choice((seq, seq, seq, seq, "*")) if not lone else seq, "qual": qual, "tags": list(tags.items()),
            "ref_seq": ref[: rnd.choice((None, 9))] if way in (4, 6) else None, "ref_beg": 100, "contig_length": rnd.choice((300, 1 << 40)),
        })
        reads[-1]["end"] = reads[-1]["pos"] + len(ref) - 1
    kinds = {"contig": pa.string(), "pos": pa.int64(), "end": pa.int64(), "flag": pa.int32(), "cigar": pa.string(), "seq": pa.string(), "qual": pa.binary(), "tags": pa.map_(pa.string(), pa.string()), "ref_seq": pa.string(), "ref_beg": pa.int64(), "contig_length": pa.int64()}
    whole, missed = pa.RecordBatch.from_arrays([pa.array([r[c] for r in reads], t) for c, t in kinds.items()], names=list(kinds)), 0
    for o in (HIFI, ONT):
        got = []
        for b in (whole.slice(0, 1), whole.slice(1, 0), *decode_batch.parts(whole.slice(1), ["cigar", "seq"])):
            got += zip(*(x.to_pylist() for x in decode_batch.decoded(b, o)), strict=True) if b.num_rows else []
        for r, (events, noisy, n, kept) in zip(reads, got, strict=True):
            tags = dict(r["tags"])
            try:
                e = events_of(r["pos"], r["cigar"], "" if r["seq"] == "*" else r["seq"], r["qual"], tags, r["ref_seq"], r["ref_beg"], o)
            except BadAlignment:
                e, missed = [], missed + 1
            clips = (True, True)
            if o.is_ont and palindrome(r["pos"], r["end"], tags.get("SA", ""), "c"):
                clips = (False, True) if r["flag"] & 16 else (True, False)
            spans, m = noisy_of(e, r["pos"], r["end"], r["contig_length"], o, clips) if e else ([], 0)
            assert events == [x._asdict() for x in e], r
            assert [tuple(x.values()) for x in noisy] == spans, r
            assert (n, kept) == (m, bool(e) and keeps(spans, m, r["pos"], r["end"], o)), r
    assert 200 < missed < 4000


def test_batch_evidence_equals_read_by_read():
    import random

    import pyarrow as pa

    from helixloom.operators import decode_batch, evidence

    rnd, rows = random.Random(7), []
    for _ in range(2000):
        at, events = 1000, []
        for op, n in [(rnd.choice("SH="), rnd.choice((5, 150)))] + [(rnd.choice("=XID"), rnd.randint(1, rnd.choice((4, 40)))) for _ in range(rnd.randint(0, 14))] + [(rnd.choice("SH="), rnd.choice((5, 150)))]:
            events.append(Event(at, op, n, rnd.randint(0, 90), "", rnd.random() < 0.2))
            at += n if op in "=XD" else 0
        e = rnd.choice(events)
        known = rnd.choice([None, [], [(x.pos, x.op, x.len) for x in events if rnd.random() < 0.5], [(e.pos, "I", e.len + 1)]])
        rows.append((e, rnd.choice([e.pos, rnd.randint(950, at + 150)]), events, known, rnd.choice([None, b"", bytes(rnd.randrange(41) for _ in range(rnd.randint(1, 100)))])))
    event = decode_batch.EVENTS
    mark = pa.list_(pa.struct([("pos", pa.int64()), ("op", pa.string()), ("len", pa.int32())]))
    b = pa.record_batch({
        "pos": pa.array([p for _, p, *_ in rows]), "op": pa.array([r[0].op for r in rows]), "len": pa.array([r[0].len for r in rows], pa.int32()), "qi": pa.array([r[0].qi for r in rows], pa.int32()), "low_qual": pa.array([r[0].low_qual for r in rows]),
        "events": pa.array([[x._asdict() for x in r[2]] for r in rows], event), "known": pa.array([None if r[3] is None else [dict(zip(("pos", "op", "len"), k, strict=True)) for k in r[3]] for r in rows], mark), "qual": pa.array([r[4] for r in rows], pa.binary()),
    })
    got = list(zip(*(x.tolist() for x in evidence.plain(b.slice(3))), strict=True))
    for (e, pos, events, known, qual), found in zip(rows[3:], got, strict=True):
        own, known, qual = (e.op, e.qi, e.len), set(known or []), qual or b""
        assert found == (evidence.event_quality(*own, qual, e.low_qual), evidence.window_quality(e.qi, qual), evidence.gap_distance(pos, events, known), evidence.dense(pos, events), evidence.near_clip(pos, events))
    assert all(len({x[k] for x in got}) > 1 for k in range(5))
