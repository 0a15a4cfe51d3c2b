"""Phasing: relational steps as DataFrame operations, the sequential two-cluster assignment as one group a window."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixloom.config import Options

#: Classes that take part, by what a match is worth.
CLEAN_SNP, CLEAN_INDEL, CLEAN_HOM, NOISY_HET, NOISY_HOM = "N", "I", "H", "e", "h"
WORTH = {CLEAN_SNP: 2, CLEAN_INDEL: 2}


def hap_majority(profile: DataFrame, keys: list[str]) -> DataFrame:
    """Profile rows (keys, hap, allele >= 0) to keys, hap, allele, n: the majority allele; ties prefer the lower, the reference."""
    n = profile.filter("allele >= 0").groupBy(*keys, "hap", "allele").agg(F.count("*").alias("n"))
    return n.groupBy(*keys, "hap").agg(F.max_by("allele", F.struct("n", -F.col("allele"))).alias("allele"), F.max("n").alias("n"))


def neighbours(variants: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `previous`: the var_id before in each key's order."""
    return variants.withColumn("previous", F.lag("var_id").over(Window.partitionBy(*keys).orderBy("var_id")))


def agree_conflict(profile: DataFrame, variants: DataFrame, keys: list[str]) -> DataFrame:
    """For consecutive heterozygous variants (keys, var_id, hap1: the allele of haplotype 1), reads that have both on one haplotype, or on two.

    profile: keys, read_id, var_id, allele (0 or 1 counts). Every variant gets a row; the first one of a key has zeros.
    """
    het = neighbours(variants, keys)
    side = (
        profile.filter("allele >= 0").join(het.select(*keys, "var_id", "hap1", "previous"), [*keys, "var_id"])
        .withColumn("on1", F.col("allele") == F.col("hap1"))
    )
    left = side.select(*keys, "read_id", F.col("var_id").alias("previous"), F.col("on1").alias("before1"))
    pairs = side.filter("previous is not null").join(left, [*keys, "read_id", "previous"])
    n = (
        pairs.groupBy(*keys, "var_id")
        .agg(
            F.count_if(F.col("on1") == F.col("before1")).alias("n_agree"), F.count_if(F.col("on1") != F.col("before1")).alias("n_conflict"),
        )
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return het.select(*keys, "var_id").join(n, [*keys, "var_id"], "left").select(*keys, "var_id", zero("n_agree"), zero("n_conflict"))


def phase_segments(variants: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """Adds phase_set and flip to variants (keys, var_id, pos: in output, het, n_agree, n_conflict).

    A heterozygous variant with too few reads both ways begins a set; more conflict than agreement toggles the flip from there on. The first
    variant of a key begins a set, and the flip isn't reset by new sets.
    """
    order = Window.partitionBy(*keys).orderBy("var_id")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(order) == 1
    weak = (F.col("n_agree") < least) & (F.col("n_conflict") < least)
    begins = first | (F.col("het") & weak)
    toggles = ~first & F.col("het") & ~weak & (F.col("n_conflict") > F.col("n_agree"))
    out = variants.withColumn("_b", F.when(begins, F.col("pos"))).withColumn("_t", toggles.cast("int"))
    out = out.withColumn("phase_set", F.last("_b", ignorenulls=True).over(run)).withColumn("_f", F.sum("_t").over(run) % 2 == 1)
    return out.withColumn("flip", F.col("_f") & F.col("het") & ~first).drop("_b", "_t", "_f")


def pivot_rank() -> Column:
    """Which variant phasing starts at: clean het SNPs, clean het indels, noisy het SNPs, other noisy ones; the deepest, the first of equals."""
    kind = (
        F.when(F.col("category") == CLEAN_SNP, 0).when(F.col("category") == CLEAN_INDEL, 1)
        .when((F.col("category") == NOISY_HET) & (F.col("vtype") == 8), 2).when((F.col("category") == NOISY_HET) & ~F.col("is_hp"), 3)
        .otherwise(9)
    )
    return F.struct(kind, -F.col("total_cov"), F.col("var_id"))


@dataclass
class _Var:
    id: int
    pos: int
    category: str
    vtype: int
    depth: int
    is_hp: bool
    cons: list[int]
    counts: list[list[int]]

    def vote(self, hap: int, is_ont: bool) -> None:
        n0, n1 = self.counts[hap]
        best = -1 if not n0 + n1 else int(n1 > n0)
        if is_ont and self.is_hp and max(n0, n1) < (n0 + n1) * 0.67:
            best = -1
        self.cons[hap] = best

    @property
    def is_het(self) -> bool:
        return -1 not in self.cons[1:] and self.cons[1] != self.cons[2] and not self.is_hp


def _hap_of(alleles: dict[int, int], variants: dict[int, _Var]) -> int:
    """1 or 2; 0 tied, -1 nothing to go by. Scoring fills the unknown side of a variant that is known on one side."""
    score, used = [0, 0, 0], False
    for v, allele in alleles.items():
        var = variants.get(v)
        if var is None or allele < 0 or var.is_hp or var.category in (NOISY_HOM, CLEAN_HOM):
            continue
        one, two = var.cons[1:]
        if one < 0 and two < 0:
            continue
        var.cons[1], var.cons[2] = (1 - two if one < 0 else one), (1 - one if two < 0 else two)
        used = True
        for hap in (1, 2):
            score[hap] += WORTH.get(var.category, 1) * (1 if var.cons[hap] == allele else -1)
    if not used:
        return -1
    top = max(score[1:])
    if top > 0:
        return 1 if score[1] == top else 2
    low = min(score[1:])
    return 0 if low == 0 else 3 - (1 if score[1] == low else 2)


def phase_window(variants: list[_Var], reads: list[tuple[int, dict[int, int]]], o: Options, rounds: int = 10) -> tuple[dict[int, tuple[int, int]], dict[int, tuple[int, int, int]]]:
    """Two-cluster phasing of a window: read -> (haplotype, phase set) and variant -> (phase set, allele of haplotype 1, of 2).

    Reads come in their order. Starting from the pivot, then leftwards, then rightwards, each read not yet placed joins the haplotype
    that its alleles fit, and the consensus follows at once. Then rounds of phase-set and haplotype updates until nothing changes.
    """
    by_id = {v.id: v for v in variants}
    for v in variants:
        v.cons = [-1, 1, 1] if v.category in (CLEAN_HOM, NOISY_HOM) else [-1, -1, -1]
        v.counts = [[0, 0], [0, 0], [0, 0]]
    haps = dict.fromkeys((r for r, _ in reads), 0)
    covering: dict[int, list[tuple[int, dict[int, int]]]] = {v.id: [] for v in variants}
    for read in reads:
        for v in read[1]:
            if v in covering:
                covering[v].append(read)

    def count(alleles: dict[int, int], hap: int, at_once: bool) -> None:
        for v, allele in alleles.items():
            if allele >= 0 and v in by_id:
                for h in (hap,) if hap else (1, 2):
                    by_id[v].counts[h][allele] += 1
                    if at_once:
                        by_id[v].vote(h, o.is_ont)

    kind = {CLEAN_SNP: 0, CLEAN_INDEL: 1}
    rank = {v.id: (kind.get(v.category, 2 if v.vtype == 8 else 3), -v.depth, v.id) for v in variants if v.category not in (CLEAN_HOM, NOISY_HOM) and not (v.category == NOISY_HET and v.vtype != 8 and v.is_hp)}
    if rank:
        start = next(k for k, v in enumerate(variants) if v.id == min(rank, key=rank.__getitem__))
        for k in [start, *range(start - 1, -1, -1), *range(start + 1, len(variants))]:
            if variants[k].category in (CLEAN_HOM, NOISY_HOM):
                continue
            for r, alleles in covering[variants[k].id]:
                if haps[r] == 0:
                    hap = _hap_of(alleles, by_id)
                    haps[r] = 1 if hap == -1 else hap
                    count(alleles, haps[r], True)
    sets: dict[int, int] = {}
    for _ in range(rounds):
        changed, flip, now, last = False, False, -1, None
        agree: dict[int, list[int]] = {}
        hets = [v for v in variants if v.is_het]
        for a, b in zip(hets, hets[1:], strict=False):
            tally = [0, 0]
            for _, alleles in covering[b.id]:
                x, y = alleles.get(a.id, -1), alleles[b.id]
                if x >= 0 and y >= 0:
                    tally[(x == a.cons[1]) != (y == b.cons[1])] += 1
            agree[b.id] = tally
        before = {v.id: v.cons[1:] for v in variants}
        for v in variants:
            place = v.pos if v.vtype == 8 else v.pos - 1
            if last is None:
                now = place
            elif v.id in before and v in hets:
                yes, no = agree.get(v.id, [0, 0])
                if yes < 2 and no < 2:
                    now = place
                elif no > yes:
                    flip = not flip
                if flip:
                    v.cons[1], v.cons[2] = v.cons[2], v.cons[1]
                    changed = True
            sets[v.id], last = now, v
        before = {v.id: v.cons[1:] for v in variants}
        for v in variants:
            v.counts = [[0, 0], [0, 0], [0, 0]]
        for r, alleles in reads:
            haps[r] = max(0, _hap_of(alleles, by_id))
            count(alleles, haps[r], False)
        for v in variants:
            for hap in (1, 2):
                v.vote(hap, o.is_ont)
        if not changed and all(v.cons[1:] == before[v.id] for v in variants):
            break
    out = {}
    for r, alleles in reads:
        own = [v for v in sorted(alleles) if v in by_id and by_id[v].is_het and alleles[v] >= 0]
        out[r] = haps[r], sets[own[0]] if own else -1
    return out, {v.id: (sets.get(v.id, -1), v.cons[1], v.cons[2]) for v in variants}


def two_means(profile: DataFrame, variants: DataFrame, keys: list[str], o: Options) -> DataFrame:
    """Phases each group of `keys` (a window of bounded length). Rows: keys, kind (read or variant), id, phase_set, hap, hap1, hap2.

    profile: keys, read_id, read_rank, var_id, allele; variants: keys, var_id, pos, vtype, category, total_cov, is_hp.
    """
    kinds = {f.name: f.dataType.simpleString() for f in variants.schema.fields}

    def run(key: tuple, p: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values("var_id")
        many = [_Var(int(i), int(pos), str(c), int(t), int(d), bool(h), [], []) for i, pos, c, t, d, h in zip(v.var_id, v.pos, v.category, v.vtype, v.total_cov, v.is_hp, strict=True)]
        p = p.sort_values(["read_rank", "read_id", "var_id"])
        reads: dict[int, dict[int, int]] = {}
        for r, i, a in zip(p.read_id.tolist(), p.var_id.tolist(), p.allele.tolist(), strict=True):
            reads.setdefault(r, {})[i] = a
        by_read, by_var = phase_window(many, list(reads.items()), o)
        rows = [(*key, "read", r, ps, hap, None, None) for r, (hap, ps) in by_read.items()] + [(*key, "variant", i, ps, None, a, b) for i, (ps, a, b) in by_var.items()]
        return (
            pd.DataFrame(rows, columns=[*keys, "kind", "id", "phase_set", "hap", "hap1", "hap2"])
            .astype({"hap": "Int32", "hap1": "Int32", "hap2": "Int32"})
        )

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", kind string, id long, phase_set long, hap int, hap1 int, hap2 int"
    # new names for the same columns: profile often comes from these very variants
    p, v = (df.select(*(F.col(c).alias(c) for c in df.columns)) for df in (profile, variants))
    return p.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInPandas(run, schema)


def stitch_votes(haps: DataFrame) -> DataFrame:
    """Votes of reads shared by neighbouring windows: contig, chunk, score (different less same), pre_ps (largest), cur_ps (least).

    haps: contig, chunk, read_id, hap (0 takes no part), phase_set.
    """
    cur = haps.filter("hap > 0").select("contig", "read_id", "chunk", F.col("hap").alias("h"), F.col("phase_set").alias("ps"))
    pre = cur.select("contig", "read_id", (F.col("chunk") + 1).alias("chunk"), F.col("h").alias("pre_h"), F.col("ps").alias("pre_ps"))
    both = cur.join(pre, ["contig", "read_id", "chunk"])
    return (
        both.groupBy("contig", "chunk")
        .agg(
            F.sum(F.when(F.col("h") != F.col("pre_h"), 1).otherwise(-1)).alias("score"), F.max("pre_ps").alias("pre_ps"),
            F.min("ps").alias("cur_ps"),
        )
    )


def stitch_chains(votes: DataFrame, chunks: DataFrame) -> DataFrame:
    """What each window's linked phase set becomes: contig, chunk, cur_ps, flip (parity along the chain), root_ps. Always propagated.

    A chain goes on where a window's incoming set is also the set it passes on. One row a window, so a contig's fold is small.
    """
    order = Window.partitionBy("contig").orderBy("chunk")
    rows = chunks.select("contig", "chunk").distinct().join(votes, ["contig", "chunk"], "left")
    linked = F.coalesce((F.col("score") != 0) & (F.col("pre_ps") != -1) & (F.col("cur_ps") != -1), F.lit(False))
    rows = rows.withColumn("linked", linked)
    follows = F.col("linked") & F.lag("linked").over(order) & (F.col("pre_ps") == F.lag("cur_ps").over(order))
    rows = rows.withColumn("_new", (~F.coalesce(follows, F.lit(False))).cast("int"))
    rows = rows.withColumn("_chain", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    chain = Window.partitionBy("contig", "_chain").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    flip = F.sum((F.col("score") > 0).cast("int")).over(chain) % 2 == 1
    return (
        rows.withColumn("flip", flip).withColumn("root_ps", F.first("pre_ps").over(chain)).filter("linked")
        .select("contig", "chunk", "cur_ps", "flip", "root_ps")
    )


def apply_stitch(rows: DataFrame, chains: DataFrame, haps: list[str]) -> DataFrame:
    """Renames linked phase sets of rows (contig, chunk, phase_set) to their chain's root and swaps the two `haps` columns, or flips the one, where the chain says so."""
    c = chains.withColumnRenamed("cur_ps", "phase_set")
    out = rows.join(c, ["contig", "chunk", "phase_set"], "left").withColumn("_f", F.coalesce("flip", F.lit(False)))
    if len(haps) == 1:
        new = {haps[0]: F.when(F.col("_f") & (F.col(haps[0]) > 0), 3 - F.col(haps[0])).otherwise(F.col(haps[0]))}
    else:
        new = {haps[0]: F.when(F.col("_f"), F.col(haps[1])).otherwise(F.col(haps[0])), haps[1]: F.when(F.col("_f"), F.col(haps[0])).otherwise(F.col(haps[1]))}
    new["phase_set"] = F.coalesce("root_ps", "phase_set")
    return out.select(*(new.get(x, F.col(x)).alias(x) for x in rows.columns))
