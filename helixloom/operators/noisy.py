"""Noisy regions: slices of reads, consensus by haplotype or by clusters, sites and alleles from re-alignment. One group a region.

Regions too long or too deep are left out before (reads.workable), so a group's size is bounded.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixloom.config import Options
from helixloom.functions import align, poa
from helixloom.operators.decode import Event
from helixloom.schemas import SNP


class Slice(NamedTuple):
    seq: str
    left: bool
    right: bool


def slice_of(events: list[Event], seq: str, lo: int, hi: int) -> Slice:
    """A read's bases over reference bases lo..hi (1-based, inclusive), insertions at both ends included, and which ends it covers."""
    first = last = None
    ref_lo = ref_hi = None
    for e in events:
        if e.op in "SHN":
            continue
        span = e.len if e.op in "=XD" else 0
        st, en = e.pos, e.pos + span - 1
        if e.op == "I":
            if lo <= e.pos <= hi + 1:
                first = e.qi if first is None else first
                last = e.qi + e.len
            continue
        if en < lo or st > hi:
            continue
        a, b = max(st, lo), min(en, hi)
        ref_lo, ref_hi = a if ref_lo is None else ref_lo, b
        if e.op == "D":
            first = e.qi if first is None else first
            last = e.qi if last is None else last
        else:
            first = e.qi + a - st if first is None else first
            last = e.qi + b - st + 1
    if ref_lo is None:
        return Slice("", False, False)
    return Slice(seq[first:last], ref_lo <= lo, ref_hi >= hi)


def read_order(rows: list[tuple[int, Slice, int, int, float]], length: int, o: Options) -> list[tuple[int, Slice, int, int, float]]:
    """Full cover first; in long regions the fewest expected errors; then the longest."""
    return sorted(rows, key=lambda r: (not (r[1].left and r[1].right), r[4] if length >= o.sample_reads_from else 0, -len(r[1].seq), r[0]))


def choose_phase_set(rows: list[tuple[int, Slice, int, int, float]], o: Options) -> int | None:
    """The phase set with most full reads on its lesser haplotype, enough of all reads on both."""
    full, every = Counter(), Counter()
    for _, s, hap, ps, _ in rows:
        if hap and ps > 0:
            every[ps, hap] += 1
            full[ps, hap] += s.left and s.right
    fit = [(min(full[ps, 1], full[ps, 2]), max(full[ps, 1], full[ps, 2]), -ps) for ps in {p for p, _ in every} if min(full[ps, 1], full[ps, 2]) >= o.min_hap_full_reads and min(every[ps, 1], every[ps, 2]) >= o.min_hap_reads]
    return -max(fit)[2] if fit else None


def consensus_of(rows: list[tuple[int, Slice, int, int, float]], length: int, o: Options) -> list[tuple[str, list[int]]]:
    """(consensus, read ids): one for each haplotype where a phase set has both, else up to two clusters of at least 5 full reads, else none."""
    rows = read_order(rows, length, o)
    full = [r for r in rows if r[1].left and r[1].right and r[1].seq]
    ps = choose_phase_set(rows, o)
    if ps is not None:
        sides = [[r for r in full if r[2] == h and r[3] == ps] for h in (1, 2)]
        if all(sides):
            return [(poa.consensus([r[1].seq for r in side]), [r[0] for r in rows if r[2] == h and r[3] == ps]) for h, side in zip((1, 2), sides, strict=True)]
    if len(full) < 5:
        return []
    return [(c, [full[k][0] for k in members]) for c, members in poa.split([r[1].seq for r in full], o.min_alt_fraction)]


def in_homopolymer(ref: str, flank: int, longest: int = 50, run: int = 6) -> bool:
    """A region whose bases between its flanks are few and hold a run of one base: a read that covers one end alone says nothing there."""
    inner = len(ref) - 2 * flank
    return 0 <= inner <= longest and re.search(r"([ACGT])\1{%d,}" % (run - 1), ref[max(0, flank - 2) : len(ref) - flank + 1]) is not None


def call_region(lo: int, ref: str, rows: list[tuple[int, Slice, int, int, float]], o: Options) -> tuple[list[tuple], list[tuple[int, int, int]], list[tuple], list[tuple[int, str, str]]]:
    """Sites (pos, vtype, ref_len, alt_len, alt_seq, haps) of a region whose first reference base is at lo; (read, site index, allele); in
    somatic mode, differences of single reads that no consensus has (read, pos ... alt_seq): SNVs and long indels; and, where reads are to be
    refined, (read, gapped reference, gapped read) of those that cover the region.

    haps: 3 on both consensus sequences (homozygous), else the one that has it. A read of a consensus is aligned to it, and through it to the reference.
    """
    found = consensus_of(rows, len(ref), o)
    if not found:
        return [], [], [], []
    scores = (o.mismatch, o.gap_open, o.gap_extend)
    to_ref = [align.affine(ref, c, *scores) for c, _ in found]
    of = {read: k for k, (_, members) in enumerate(found) for read in members}
    per = [set(align.gapped_variants(*pair, lo)) for pair in to_ref]
    haps = {v: 3 if len(per) == 1 else 1 for v in per[0]}
    for v in per[1] if len(per) > 1 else ():
        haps[v] = 3 if v in haps else 2
    sites = sorted(haps, key=lambda v: (v[0] - (v[1] != 8), *v[1:]))
    alleles, single, pairs = [], [], []
    full_only = in_homopolymer(ref, o.noisy_flank)
    for read, s, *_ in rows:
        if full_only and not (s.left and s.right):
            continue
        if s.left and s.right:
            k = of.get(read)
            pair = align.affine(ref, s.seq, *scores) if k is None else align.composed(to_ref[k], align.affine(found[k][0], s.seq, *scores))
            beg, end = lo, lo + len(ref) - 1
            if o.refine and s.seq:
                pairs.append((read, *pair))
        elif s.left or s.right:
            got = align.partial(ref, s.seq, s.left, o.partial_ratio)
            if got is None:
                continue
            pair, beg = got[:2], lo if s.left else lo + len(ref) - got[2]
            end = beg + got[2] - 1
        else:
            continue
        for k, v in enumerate(sites):
            if beg <= v[0] and v[0] + max(0, v[2] - 1) <= end:
                alleles.append((read, k, align.allele_in(*pair, beg, v)))
        if o.somatic:
            single += [(read, *v) for v in align.gapped_variants(*pair, beg) if v not in haps and (v[1] == SNP or max(v[2], v[3]) >= o.min_sv_length)]
    return [(*v, haps[v]) for v in sites], alleles, single, pairs


def sliced_events(events: Column, lo: Column, hi: Column) -> Column:
    """A read's events that touch reference bases lo..hi, with aligned ones cut to them; insertions at both ends stay."""
    touch = lambda e: F.when(e["op"].isin("=", "X", "D"), (e["pos"] <= hi) & (e["pos"] + e["len"] > lo)).otherwise((e["op"] == "I") & (e["pos"] >= lo) & (e["pos"] <= hi + 1))

    def cut_to(e: Column) -> Column:
        st = F.when(e["op"] == "I", e["pos"]).otherwise(F.greatest(e["pos"], lo))
        n = F.when(e["op"] == "I", e["len"]).otherwise((F.least(e["pos"] + e["len"] - 1, hi) - st + 1).cast("int"))
        qi = (e["qi"] + F.when(e["op"].isin("=", "X"), st - e["pos"]).otherwise(0)).cast("int")
        return (
            F.struct(
                st.alias("pos"), e["op"].alias("op"), n.alias("len"), qi.alias("qi"), e["alt"].alias("alt"),
                e["low_qual"].alias("low_qual"),
            )
        )

    return F.transform(F.filter(events, touch), cut_to)


def slices(cover: DataFrame, regions: DataFrame, reads: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces of reads over regions: keys, region_id, region columns, read_id, `events` within the region, the bases `seq` that these span and their place `first` in the read.

    Only ids meet first; a read is joined by its id, and what goes on is as long as the region.
    """
    of = regions.select(*keys, "region_id", F.col("st").alias("a_st"), F.col("en").alias("a_en"), F.col("ref_seq").alias("a_ref_seq"))
    both = cover.select(*keys, "region_id", "read_id").join(of, [*keys, "region_id"]).join(reads.drop(*keys), "read_id")
    cut = both.withColumn("events", sliced_events(F.col("events"), F.col("a_st") + 1, F.col("a_en").cast("long")))
    ends = F.transform("events", lambda e: e["qi"] + F.when(e["op"] == "D", 0).otherwise(e["len"]))
    cut = cut.withColumn("first", F.coalesce(F.array_min(F.transform("events", lambda e: e["qi"])), F.lit(0)))
    return cut.withColumn("seq", F.substring("seq", F.col("first") + 1, F.coalesce(F.array_max(ends), F.lit(0)) - F.col("first")))


def call(regions: DataFrame, cover: DataFrame, reads: DataFrame, keys: list[str], o: Options) -> DataFrame:
    """Rows of each region (keys, region_id, st, en: half-open; ref_seq of just its bases): kind site (pos ... haps) or allele (read_id, allele), by site index; in somatic mode also single (pos ... alt_seq, read_id); where reads are to be refined also pair (alt_seq: the gapped reference, query: the gapped read).

    cover: keys, region_id, read_id; reads: keys, read_id, seq, events, hap, phase_set, error_rate.
    """
    spans = slices(cover, regions, reads, keys)
    kinds = {f.name: f.dataType.simpleString() for f in regions.schema.fields}
    cols = [*keys, "region_id", "kind", "site", "pos", "vtype", "ref_len", "alt_len", "alt_seq", "haps", "read_id", "allele", "query"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi, ref = int(pdf.a_st.iloc[0]) + 1, int(pdf.a_en.iloc[0]), pdf.a_ref_seq.iloc[0]
        rows = []
        for r in pdf.sort_values("read_id").itertuples():
            events = [Event(int(e["pos"]), e["op"], int(e["len"]), int(e["qi"]) - int(r.first), e["alt"], bool(e["low_qual"])) for e in r.events]
            rows.append((int(r.read_id), slice_of(events, r.seq, lo, hi), int(r.hap or 0), int(r.phase_set or -1), float(r.error_rate or 0)))
        sites, alleles, single, pairs = call_region(lo, ref, rows, o)
        out = [(*key, "site", k, *s, None, None, None) for k, s in enumerate(sites)]
        out += [(*key, "allele", k, None, None, None, None, None, None, r, a, None) for r, k, a in alleles]
        out += [(*key, "single", -1, *v, None, r, None, None) for r, *v in single]
        out += [(*key, "pair", -1, lo, None, len(ref), None, t, None, r, None, q) for r, t, q in pairs]
        kind = {"pos": "Int64", "vtype": "Int32", "ref_len": "Int32", "alt_len": "Int32", "haps": "Int32", "read_id": "Int64", "allele": "Int32"}
        return pd.DataFrame(out, columns=cols, dtype=object).astype(kind)  # through floats, 64-bit ids would lose their last bits

    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, "region_id"]) + ", kind string, site int, pos long, vtype int, ref_len int, alt_len int, alt_seq string, haps int, read_id long, allele int, query string"
    return spans.groupBy(*keys, "region_id").applyInPandas(run, schema)


def read_candidates(called: DataFrame, keys: list[str], o: Options) -> DataFrame:
    """Somatic candidates of noisy regions: differences that enough single reads share, with their number."""
    site = ["pos", "vtype", "ref_len", "alt_len", "alt_seq"]
    return (
        called.filter("kind = 'single'").groupBy(*keys, "region_id", *site).agg(F.countDistinct("read_id").alias("alt_cov"))
        .filter(F.col("alt_cov") >= o.somatic_alt)
    )


def splice(events: list[Event], pair: tuple[str, str], lo: int, hi: int, seq: str) -> list[Event] | None:
    """A read's events with those over lo..hi replaced by a gapped reference/read pair; None if the result's offsets don't chain."""
    from helixloom.operators.decode import chained

    left, right = [], []
    for e in events:
        span = e.len if e.op in "=XD" else 0
        if e.op in "SH":
            (left if not right and e.pos <= lo and e.qi == 0 else right).append(e)
        elif e.op == "I":
            if e.pos < lo:
                left.append(e)
            elif e.pos > hi + 1:
                right.append(e)
        else:
            if e.pos < lo:
                n = min(span, lo - e.pos)
                left.append(e._replace(len=n))
            if e.pos + span - 1 > hi:
                skip = max(0, hi + 1 - e.pos)
                right.append(e._replace(pos=e.pos + skip, len=span - skip, qi=e.qi + (skip if e.op in "=X" else 0)))
    body = [e for e in left if e.op not in "SH"]
    qi = body[-1].qi + (body[-1].len if body[-1].op in "=XI" else 0) if body else (left[-1].len if left and left[-1].op == "S" else 0)
    mid: list[Event] = []
    pos = lo
    for t, q in zip(*pair, strict=True):
        op = "I" if t == "-" else "D" if q == "-" else "=" if t == q else "X"
        if mid and mid[-1].op == op and op != "X":
            mid[-1] = mid[-1]._replace(len=mid[-1].len + 1, alt=mid[-1].alt + (q if op == "I" else ""))
        else:
            mid.append(Event(pos, op, 1, qi, q if op in "XI" else "", False))
        pos += op != "I"
        qi += op != "D"
    out = left + mid + right
    merged: list[Event] = []
    for e in out:
        if merged and e.op == merged[-1].op and e.op in "=D" and e.pos == merged[-1].pos + merged[-1].len:
            merged[-1] = merged[-1]._replace(len=merged[-1].len + e.len)
        else:
            merged.append(e)
    used = sum(e.len for e in merged if e.op in "=XIS")
    return merged if chained(merged) and used == len(seq) else None
