"""SimHash near-dedup by covering locality-sensitive hashing (operator 10).

A fingerprint has a bit for the majority of the shingles' hashes. For radius r, 2^(r+1)-1 bit masks are laid out so that any r
bits are left out together by at least one of them: bit i has a nonzero vector m(i) of r+1 bits, mask v holds the bits whose
m(i) has an odd product with v, and r vectors of r+1 bits always have a common v of even product. So every
pair within the radius meets in some table, with equal masked fingerprints.

Equal fingerprints are one node. In a table, distinct fingerprints of equal masked bits are compared within their bucket
and give a spanning forest of its links, never all pairs. A bucket beyond `bucket_size` nodes is linked exactly in
another way: every node offers itself and all ways to flip up to half the radius of the bits that the mask leaves out; two
nodes within the radius share such an offer, so each offer's sharers get a link. Then components.

Defined cases: null text counts as empty; a text without words has fingerprint 0; of a component the smallest doc_id names it,
nulls aside; repeated rows share a node; other columns are passed by; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixloom.llm.common import cut, only, raw_texts, text_key, text_slices
from helixloom.llm.components import components

#: A-Z in lower case, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Distinct fingerprints of a bucket that are compared in one task; shingles whose bits are summed at a time.
BUCKET, AT_ONCE = 512, 1 << 16


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text."""
    found = text.translate(LOWER).split()  # of bytes: splits at space, tab, LF, VT, FF and CR
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    end = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    start, stop = [0, *end[: len(found) - words].tolist()], (end[words - 1 :] - 1).tolist()
    digest, n = xxhash.xxh64_digest, len(stop)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, AT_ONCE):
        raw = b"".join([digest(joined[a:b], seed) for a, b in zip(start[lo : lo + AT_ONCE], stop[lo : lo + AT_ONCE], strict=True)])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, key, fp long (the fingerprint as a signed number) for each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            fp = np.array([fingerprint(x, words) for x in raw_texts(part)], np.uint64).view(np.int64)
            yield pa.record_batch([part.column("doc_id"), part.column("key"), pa.array(fp)], names=["doc_id", "key", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key().alias("key"), "text").mapInArrow(run, f"doc_id {kind}, key long, fp long")


def masks(radius: int, bits: int = 64) -> list[int]:
    """The covering masks: for any `radius` bits one of them leaves all of these out."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if ((i % n + 1) & v).bit_count() & 1) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (node, root) of the components of a few distinct fingerprints."""
    bits = fp.view(np.uint64)  # of signed numbers numpy counts the bits of the absolute value
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
    root = np.arange(len(fp))
    while True:
        least = np.where(near, root[None, :], len(fp)).min(1)
        if (least == root).all():
            break
        root = least
    return [(int(fp[i]), int(fp[r])) for i, r in enumerate(root.tolist()) if r != i]


def links(nodes: DataFrame, radius: int = 2, bucket_size: int = BUCKET) -> DataFrame:
    """u, v: links that join all of `nodes` (distinct `fp` long) which a chain of steps within the radius joins."""
    cover = [_signed(m) for m in masks(radius)]
    parts = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for t, m in enumerate(cover)))
    offered = nodes.select("fp", F.explode(parts).alias("p")).select("p.t", "p.part", "fp")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large, over = np.zeros((0, 3), np.int64), None, None

        def out(link: list[tuple[int, int]], rest: np.ndarray) -> pa.RecordBatch:
            u = np.array([a for a, _ in link], np.int64)
            v = np.array([b for _, b in link], np.int64)
            t = np.concatenate([np.full(len(u), -1), rest[:, 0]]).astype(np.int32)
            return (
                pa.record_batch(
                    [pa.array(t), pa.array(np.concatenate([np.zeros(len(u), np.int64), rest[:, 1]])), pa.array(np.concatenate([u, rest[:, 2]])), pa.array(np.concatenate([v, rest[:, 2]]))],
                    names=["t", "part", "u", "v"],
                )
            )

        def settle(rows: np.ndarray, last: bool) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
            """Links of whole buckets, rows of large ones, and what may go on in the next batch."""
            nonlocal large
            link, rest, keep = [], [], rows[:0]
            begin = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)]))
            size = np.diff(np.append(begin, len(rows)))
            for k in np.flatnonzero((size > 1) | (begin == begin[-1]) | (begin == 0)).tolist():
                bucket = rows[begin[k] : begin[k] + size[k]]
                name = tuple(bucket[0, :2].tolist())
                if name == large or size[k] > bucket_size:
                    large = name
                    rest.append(bucket)
                elif k == len(begin) - 1 and not last:
                    keep = bucket
                elif size[k] > 1:
                    link += _forest(np.ascontiguousarray(bucket[:, 2]), radius)
            return link, np.concatenate(rest) if rest else rows[:0], keep

        for b in batches:
            rows = np.stack([b.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in ("t", "part", "fp")], 1)
            if len(rows := np.concatenate([held, rows])):
                link, over, held = settle(rows, False)
                yield out(link, over)
        if len(held):
            yield out(*settle(held, True)[:2])

    dealt = offered.repartition("t", "part").sortWithinPartitions("t", "part", "fp")
    found = cut(dealt.mapInArrow(run, "t int, part long, u long, v long"))
    small = found.filter("t < 0").select("u", "v")
    if found.filter("t >= 0").isEmpty():
        return small
    return small.unionByName(_large_links(found.filter("t >= 0").select("t", "part", F.col("u").alias("fp")), cover, radius))


def _large_links(rows: DataFrame, cover: list[int], radius: int) -> DataFrame:
    """Links within large buckets, at any radius. Nodes of a bucket differ only in bits that its mask leaves out, and two nodes within the radius have a
    point between them that is at most half of it, rounded up, from one and half of it, rounded down, from the other. So every node offers the points
    within the former; of a point's sharers, one within the latter is linked to all.
    """
    far, close = -(-radius // 2), radius // 2
    flips = [[(n, sum(1 << i for i in bits)) for n in range(far + 1) for bits in combinations([i for i in range(64) if not m >> i & 1], n)] for m in masks(radius)]
    of = (
        F.element_at(
            F.array(*(F.array(*(F.struct(F.lit(n <= close).alias("close"), F.lit(_signed(x)).alias("bits")) for n, x in some)) for some in flips)),
            F.col("t") + 1,
        )
    )
    offers = (
        rows.select("t", "fp", F.explode(of).alias("flip"))
        .select("t", "fp", "flip.close", F.col("fp").bitwiseXOR(F.col("flip.bits")).alias("offer"))
    )
    # at most as many sharers as a node has offers
    shared = (
        offers.groupBy("t", "offer").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("v"), F.collect_set("fp").alias("fps"))
        .filter(F.col("v").isNotNull() & (F.size("fps") > 1))
    )
    return shared.select("v", F.explode("fps").alias("u")).filter("u <> v").select("u", "v").distinct()


def grouped(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, key, fp, root (names the component), component_id for each row of `docs`."""
    rows = cut(fingerprints(docs, words))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(nodes.select("fp"), radius))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return (
        rows.join(placed.join(least, "root").select("fp", "root", "component_id"), "fp")
        .select("doc_id", "key", "fp", "root", "component_id")
    )


def near_dedup(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, key, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach) for each row of `docs`."""
    return grouped(docs, words, radius).select("doc_id", "key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """One row of each component of `docs`, all columns kept: that of the smallest doc_id (nulls last), of its rows that of the smallest key."""
    rows = cut(grouped(docs, words, radius).select("doc_id", "key", "root"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "key")).alias("first")
    winners = rows.groupBy("root").agg(first).select("first.doc_id", "first.key")
    again = rows.groupBy("doc_id", "key").agg(F.count("*").alias("n")).filter("n > 1")
    return only(docs, winners, again)
