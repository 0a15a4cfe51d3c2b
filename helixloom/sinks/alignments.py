"""Phased and refined alignments: tags, refined records, SAM lines."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixloom.sinks.blocks import write_blocks, write_end
from helixloom.sources import bam, bgzf


def haplotagged(reads: DataFrame, haps: DataFrame) -> DataFrame:
    """HP and PS of `haps` (qname, contig, pos, flag and, where both have one, source_idx; hap, phase_set; one row a read) on reads; old ones go, also
    from reads without a haplotype. The flag keeps a read's supplementary record at the same place apart."""
    base = F.map_filter("tags", lambda k, v: ~k.isin("HP", "PS"))
    named = [c for c in ("qname", "contig", "pos", "flag", "source_idx") if c in haps.columns and c in reads.columns]
    joined = reads.join(haps.select(*named, "hap", "phase_set"), named, "left")
    hp = (
        F.when(F.col("hap") > 0, F.create_map(F.lit("HP"), F.col("hap").cast("string")))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    ps = (
        F.when((F.col("hap") > 0) & (F.col("phase_set") > 0), F.create_map(F.lit("PS"), F.col("phase_set").cast("string")))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    return joined.withColumn("tags", F.map_concat(base, hp, ps)).select(*reads.columns)


def owned(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of a read's rows in several windows, that of the first."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*(c for c in rows.columns if c not in keys)), "chunk").alias("r")).select(*keys, "r.*")


def cigar_of(events: Column, hard_to_soft: bool = True) -> Column:
    """Run-length text of an array of (op, len); hard clips of primary records become soft."""
    zero = F.array().cast("array<struct<op:string,len:int>>")
    ops = (
        F.transform(
            events,
            lambda e: F.struct(F.when(F.lit(hard_to_soft) & (e["op"] == "H"), "S").otherwise(e["op"]).alias("op"), e["len"].cast("int").alias("len")),
        )
    )

    def join(runs: Column, e: Column) -> Column:
        same = (F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["op"] == e["op"])
        grown = (
            F.concat(
                F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))),
                F.array(F.struct(e["op"].alias("op"), (F.try_element_at(runs, F.lit(-1))["len"] + e["len"]).alias("len"))),
            )
        )
        return F.when(same, grown).otherwise(F.array_append(runs, F.struct(e["op"].alias("op"), e["len"].alias("len"))))

    runs = F.aggregate(F.filter(ops, lambda e: e["len"] > 0), zero, join)
    return F.array_join(F.transform(runs, lambda r: F.concat(r["len"].cast("string"), r["op"])), "")


def edit_distance(events: Column) -> Column:
    """NM: bases of mismatches, insertions and deletions."""
    return F.aggregate(F.filter(events, lambda e: e["op"].isin("X", "I", "D")), F.lit(0), lambda s, e: s + e["len"].cast("int"))


def cs_of(events: Column) -> Column:
    """Short cs text: :n, *rq, +seq, -seq in lower case. Events carry `alt`; mismatches and deletions their reference bases in `ref`."""
    kind = lambda e: F.when(e["op"] == "=", F.concat(F.lit(":"), e["len"].cast("string"))).when(e["op"] == "X", F.concat(F.lit("*"), F.lower(e["ref"]), F.lower(e["alt"]))).when(e["op"] == "I", F.concat(F.lit("+"), F.lower(e["alt"]))).when(e["op"] == "D", F.concat(F.lit("-"), F.lower(e["ref"]))).otherwise("")
    return F.array_join(F.transform(events, kind), "")


def md_of(events: Column) -> Column:
    """MD text: counts of matches between mismatches and ^deletions; insertions don't show."""
    zero = F.struct(F.lit(0).alias("run"), F.lit("").alias("out"))

    def step(s: Column, e: Column) -> Column:
        mark = F.when(e["op"] == "X", e["ref"]).otherwise(F.concat(F.lit("^"), e["ref"]))
        return (
            F.when(e["op"] == "=", F.struct((s["run"] + e["len"].cast("int")).alias("run"), s["out"].alias("out")))
            .when(e["op"].isin("X", "D"), F.struct(F.lit(0).alias("run"), F.concat(s["out"], s["run"].cast("string"), mark).alias("out")))
            .otherwise(s)
        )

    return F.aggregate(events, zero, step, lambda s: F.concat(s["out"], s["run"].cast("string")))


def refined(reads: DataFrame, events: str = "events") -> DataFrame:
    """Records with cigar, pos and the NM, MD and cs tags of their events; records whose cigar doesn't change stay as they are."""
    e = F.col(events)
    pos = F.element_at(F.filter(e, lambda x: x["op"].isin("=", "X", "D")), 1)["pos"]
    new = F.create_map(F.lit("NM"), edit_distance(e).cast("string"), F.lit("MD"), md_of(e), F.lit("cs"), cs_of(e))
    same = cigar_of(e) == F.col("cigar")
    rest = F.map_filter("tags", lambda k, v: ~k.isin("NM", "MD", "cs"))
    return (
        reads.withColumn("_new", F.map_concat(rest, new)).withColumn("tags", F.when(same, F.col("tags")).otherwise(F.col("_new")))
        .withColumn("pos", F.when(same, F.col("pos")).otherwise(pos))
        .withColumn("cigar", F.when(same, F.col("cigar")).otherwise(cigar_of(e))).drop("_new", events)
    )


def sam_line(reads: DataFrame) -> DataFrame:
    """value: SAM text lines. Whole numbers are written as i tags, others as Z."""
    tag = (
        F.array_join(
            F.transform(F.array_sort(F.map_entries("tags")), lambda t: F.concat(t["key"], F.when(t["value"].rlike(r"^-?\d+$"), ":i:").otherwise(":Z:"), t["value"])),
            "\t",
        )
    )
    qual = (
        F.when(F.length("qual") == 0, "*")
        .otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length("qual")), lambda i: F.char(F.conv(F.hex(F.substring("qual", i, F.lit(1))), 16, 10).cast("int") + 33)), ""))
    )
    cols = ["qname", F.col("flag").cast("string"), "contig", F.col("pos").cast("string"), F.col("mapq").cast("string"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), "seq", qual]
    return reads.select(F.concat_ws("\t", *cols, F.when(F.length(tag) > 0, tag)).alias("value"))


def header_text(contigs: list[tuple[str, int]], sample: str, program: str = "helixloom", version: str = "", command: str = "") -> str:
    more = "".join(f"\t{k}:{v}" for k, v in (("VN", version), ("CL", command)) if v)
    return "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in contigs) + f"@RG\tID:{sample}\tSM:{sample}\n@PG\tID:{program}\tPN:{program}{more}\n"


def write_bam(reads: DataFrame, path: str, contigs: list[tuple[str, int]], text: str, program: str = "helixloom") -> None:
    """A folder of parts in coordinate order, written by the tasks: a-header, body, z-end. Put behind each other (sinks.vcf.merge_parts) they are one BAM file.

    Every record ends with the tag PG:Z of the program, and so with the byte 0 that write_blocks() asks for. Reads without a contig come last.
    """
    ids = {n: k for k, (n, _) in enumerate(contigs)}
    cols = ["qname", "flag", "contig", "pos", "mapq", "cigar", "seq", "qual", "tags"]
    place = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(n) for n, _ in contigs)), F.col("contig")), F.lit(0)), F.lit(1 << 40))
    tags = F.map_concat(F.map_filter("tags", lambda k, v: k != "PG"), F.create_map(F.lit("PG"), F.lit(program)))
    rows = reads.select(*cols).withColumn("tags", tags).withColumn("_o", place).orderBy("_o", "pos", "qname", "flag").drop("_o")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[bytes] = []
            out, size = [], 0
            for r in b.to_pylist():
                r["tags"] = dict(r["tags"] or [])
                r["tags"]["PG"] = r["tags"].pop("PG")  # the last one
                held.append(bam.encode(r, ids))
                size += len(held[-1])
                if size > 1 << 20:
                    out.append(bgzf.packed(b"".join(held)[:-1]))
                    held, size = [], 0
            if held:
                out.append(bgzf.packed(b"".join(held)[:-1]))
            yield pa.record_batch([pa.array(out, pa.binary())], names=["data"])

    head = bam.header_bytes(contigs, text)
    spark = reads.sparkSession
    write_blocks(spark.createDataFrame([(bytearray(bgzf.packed(head[:-1])),)], "data binary").coalesce(1), f"{path}/a-header", head[-1:])
    write_blocks(rows.mapInArrow(run, "data binary"), f"{path}/body", b"\0")
    write_end(spark, f"{path}/z-end")
