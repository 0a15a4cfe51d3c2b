"""Reads rewritten by the alignments of noisy regions: refined CIGAR, NM, MD and cs, ready for the alignment sink."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from helixloom.config import HIFI, Options
from helixloom.lineage import cut
from helixloom.operators import noisy
from helixloom.operators.decode import Event
from helixloom.plans.germline import Analysis, regions_of
from helixloom.sinks.alignments import refined as rewritten
from helixloom.sources import fasta

#: Events with the reference bases that tags name.
EVENTS = "array<struct<pos:long,op:string,len:int,qi:int,alt:string,low_qual:boolean,ref:string>>"


def spliced(rows: DataFrame) -> DataFrame:
    """Rows with `events`, `seq`, `pairs` (array of (lo, n, target, query), by lo), `ref_beg` and `ref_seq` over the read: events with the pairs put in, and reference
    bases. A pair whose result doesn't chain is left out."""
    kind = StructType.fromDDL(f"events {EVENTS}")["events"].dataType
    cols = [c for c in rows.columns if c not in ("events", "pairs", "ref_beg", "ref_seq")]
    schema = StructType([*(f for f in rows.schema.fields if f.name in cols), StructField("events", kind)])
    arrow = pa.list_(pa.struct([("pos", pa.int64()), ("op", pa.string()), ("len", pa.int32()), ("qi", pa.int32()), ("alt", pa.string()), ("low_qual", pa.bool_()), ("ref", pa.string())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for own, seq, pairs, beg, ref in zip(*(b.column(c).to_pylist() for c in ("events", "seq", "pairs", "ref_beg", "ref_seq")), strict=True):
                events = [Event(e["pos"], e["op"], e["len"], e["qi"], e["alt"], e["low_qual"]) for e in own]
                for p in pairs:
                    events = noisy.splice(events, (p["target"], p["query"]), p["lo"], p["lo"] + p["n"] - 1, seq) or events
                out.append([{**e._asdict(), "ref": ref[e.pos - beg : e.pos - beg + e.len] if e.op in "XD" else ""} for e in events])
            yield pa.record_batch([*(b.column(c) for c in cols), pa.array(out, arrow)], names=[*cols, "events"])

    return rows.mapInArrow(run, schema)


def refined(a: Analysis, reads: DataFrame, reference: DataFrame, o: Options = HIFI) -> DataFrame:
    """All `reads`, in their columns; those that cover noisy regions which were called have the region's alignment in their CIGAR, and new tags if it changed."""
    called = regions_of(a, a.regions, a.read_haps, reference, replace(o, refine=True))
    pair = F.struct(F.col("pos").alias("lo"), F.col("ref_len").alias("n"), F.col("alt_seq").alias("target"), "query")
    pairs = called.filter("kind = 'pair'").groupBy("read_id").agg(F.sort_array(F.collect_list(pair)).alias("pairs"))  # a read's own regions bound it
    named = [c for c in ("qname", "contig", "pos", "flag", "source_idx") if c in a.reads.columns and c in reads.columns]
    rows = cut(a.reads.join(pairs, "read_id"))
    at = (
        fasta.slices(reference, rows.select("read_id", "contig", F.col("pos").alias("beg"), "end"), 0)
        .select("read_id", "ref_beg", "ref_seq")
    )
    changed = spliced(rows.select(*named, "read_id", "cigar", "seq", "tags", "events", "pairs").join(at, "read_id"))
    key = F.struct(*named).alias("_key")
    new = rewritten(changed.select(key, "pos", "cigar", "tags", "events")).select("_key", F.struct("pos", "cigar", "tags").alias("_new"))
    both = reads.withColumn("_key", F.struct(*named)).join(new, "_key", "left")
    of = {c: F.when(F.col("_new").isNull(), F.col(c)).otherwise(F.col(f"_new.{c}")) for c in ("pos", "cigar", "tags")}
    return both.select(*(of.get(c, F.col(c)).alias(c) for c in reads.columns))
