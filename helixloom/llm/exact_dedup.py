"""Exact dedup by content-defined chunk recipes (operator 8).

A text, its white-space runs made single spaces, is cut into chunks where a rolling hash of the last
WINDOW bytes has high bits zero. Distinct chunks get verified identifiers: a 128-bit hash,
plus the rank among contents of equal hash where contents differ. A document then is the ordered list of its
chunks' identifiers, and only these lists are grouped; long texts move once, chunk by chunk,
after equal chunks of a task are merged.

Defined cases: null text counts as empty, and all empty texts are equal; a null doc_id comes before any number; of
repeated rows (same doc_id, equal text) exactly one can be `kept`; other columns are passed by; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixloom.llm.common import byte_column, cut, only, text_key, text_slices

#: Bytes that the rolling hash sees; a chunk's least, usual and most bytes.
WINDOW, LEAST, USUAL, MOST = 32, 256, 2048, 8192
#: The rolling hash's fixed random table.
GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 32, 256, dtype=np.uint32)


def normalised(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of UTF-8 bytes with every run of space, tab, LF, VT, FF and CR as one space."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    again = np.zeros(len(raw), bool)
    again[1:] = space[1:] & space[:-1]
    again[at[:-1][at[:-1] < len(raw)]] = False
    keep = ~again
    return np.where(space, np.uint8(32), raw)[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def cuts(raw: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash asks for a cut. It is a sum of shifted table values of the last WINDOW bytes, made by doubling."""
    h, s = GEAR[raw], 1
    while s < WINDOW:
        before = h[:-s].copy()
        h[s:] += before << np.uint32(s)
        s *= 2
    return np.flatnonzero(h < np.uint32((1 << 32) // USUAL)) + 1


def chunk_rows(raw: np.ndarray, at: np.ndarray) -> list[list[tuple[int, int]]]:
    """The chunks (begin, end) of each row. Cuts depend on the row's bytes alone: a chunk holds at least LEAST bytes, more than WINDOW."""
    places = cuts(raw)
    which = np.searchsorted(places, at).tolist()
    places_list, bounds, out = places.tolist(), at.tolist(), []
    for lo, hi, a, b in zip(bounds, bounds[1:], which, which[1:], strict=False):
        row, k = [], a
        while hi - lo > LEAST:
            while k < b and places_list[k] < lo + LEAST:
                k += 1
            to = min(places_list[k] if k < b else hi, lo + MOST, hi)
            row.append((lo, to))
            lo = to
        if hi > lo or not row:
            row.append((lo, hi))
        out.append(row)
    return out


def _chunked(docs: DataFrame, contents: bool, hash_bits: int) -> DataFrame:
    """Recipes (doc_id, key, text_sha256, ids) of all rows; or with `contents` all chunks (doc_id, key, ord, id, chunk), each content at most once a slice."""

    def digest(x: bytes) -> bytes:
        h = xxhash.xxh3_128_digest(x)
        return h if hash_bits == 128 else bytes([h[-1] & ((1 << hash_bits) - 1)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            raw, at = normalised(*byte_column(part))
            data, rows = raw.tobytes(), chunk_rows(raw, at)
            if contents:
                seen = {c: None for row in rows for a, b in row for c in (data[a:b],)}
                yield pa.record_batch([pa.array([digest(c) for c in seen], pa.binary()), pa.array(list(seen), pa.binary())], names=["id", "chunk"])
            else:
                sha = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
                ids = [b"".join(digest(data[a:b]) for a, b in row) for row in rows]
                yield pa.record_batch([part.column("doc_id"), part.column("key"), pa.array(sha, pa.string()), pa.array(ids, pa.binary())], names=["doc_id", "key", "text_sha256", "ids"])

    source = docs.select("doc_id", text_key().alias("key"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, "id binary, chunk binary" if contents else f"doc_id {kind}, key long, text_sha256 string, ids binary")


def _occurrences(docs: DataFrame, hash_bits: int) -> DataFrame:
    """All chunks of all rows with their contents, for the rare case that contents collide."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            raw, at = normalised(*byte_column(part))
            data, rows = raw.tobytes(), chunk_rows(raw, at)
            flat = [(k, n, data[a:b]) for k, row in enumerate(rows) for n, (a, b) in enumerate(row)]
            of = pa.array([k for k, _, _ in flat], pa.int64())
            yield pa.record_batch([part.column("doc_id").take(of), part.column("key").take(of), pa.array([n for _, n, _ in flat], pa.int32()), pa.array([c for _, _, c in flat], pa.binary())], names=["doc_id", "key", "ord", "chunk"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        docs.select("doc_id", text_key().alias("key"), "text").dropDuplicates(["doc_id", "key"])
        .mapInArrow(run, f"doc_id {kind}, key long, ord int, chunk binary")
    )


def recipes(docs: DataFrame, hash_bits: int = 128) -> DataFrame:
    """doc_id, key, text_sha256, ids (binary: the verified identifiers of the row's chunks in order) for each row."""
    plain = _chunked(docs, False, hash_bits)
    distinct = _chunked(docs, True, hash_bits).groupBy("id", "chunk").agg(F.lit(1).alias("_one"))
    clash = cut(distinct.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"))
    if clash.isEmpty():  # every identifier stands for one content
        return plain
    ranked = (
        distinct.join(clash, "id", "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("chunk")))
        .select("id", "chunk", "rank")
    )
    ranks = (
        _occurrences(docs, hash_bits).join(ranked, "chunk").groupBy("doc_id", "key")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "rank"))).cast("string").alias("ranks"))
    )
    b = ranks.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "ranks")
    joined = plain.join(b, plain["doc_id"].eqNullSafe(b["_d"]) & (plain["key"] == b["_k"]), "left")
    return joined.select("doc_id", "key", "text_sha256", F.concat("ids", F.coalesce(F.col("ranks"), F.lit("")).cast("binary")).alias("ids"))


def exact_dedup(docs: DataFrame, hash_bits: int = 128) -> DataFrame:
    """doc_id, key (common.text_key), keep_id, group_size, kept, text_sha256 for each row of `docs`."""
    rows = recipes(docs, hash_bits).groupBy("ids", "doc_id", "key", "text_sha256").agg(F.count("*").alias("n"))
    rows = cut(rows)  # recipes, not texts
    # the smallest doc_id of a group, null first; of its rows the one with the smallest key
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("there"), "doc_id", "key")).alias("first")
    # cut, so that both sides of the join come straight from a shuffle and Spark can split a group that holds a large share of the rows
    groups = cut(rows.groupBy("ids").agg(first, F.sum("n").alias("group_size")))
    out = rows.join(groups, "ids").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key")) & (F.col("copy") == 1)
    return out.select("doc_id", "key", F.col("first.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that exact_dedup() keeps, with all their columns; of rows with equal doc_id and text, any one."""
    decided = cut(exact_dedup(docs).select("doc_id", "key", "kept"))
    again = decided.groupBy("doc_id", "key").agg(F.count("*").alias("n")).filter("n > 1")
    return only(docs, decided.filter("kept"), again)
