"""Line dedup by overlapping three-line windows and by long passages (operator 9).

Every run of `size` consecutive lines of a document is hashed (128 bits), and, if `words` is given, every shorter run of more than so many
words, single lines too. A window found before, by (doc_id, place), is a later occurrence; the lines that later occurrences cover, overlapping ones merged, are removed. Only windows that
repeat go into the second pass.

Defined cases: null text counts as empty; a text of fewer lines than a window has only the shorter runs; words are what ASCII blanks part; windows without any
visible character are left out; lines of a window's first occurrence stay even where it overlaps its own
repeat; rows repeated with doc_id and text count as one document, and so don't remove each other; other columns are passed by;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixloom.llm.common import cut, text_key, text_slices, texts

#: A run of fewer lines than a window is a passage if it has more words than this.
PASSAGE = 50


def windows(docs: DataFrame, size: int = 3, words: int | None = None) -> DataFrame:
    """doc_id, key, pos (from 0), n (lines), hash: all windows of all rows, and all passages. Runs of unlike numbers of lines differ in their line ends, so they share no hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            rows, pos, length, hashes = [], [], [], []
            for k, text in enumerate(texts(part)):
                lines = text.encode().split(b"\n")
                seen = [bool(x.strip()) for x in lines]
                places = [(p, size) for p in range(len(lines) - size + 1) if any(seen[p : p + size])]
                if words is not None:
                    many = [len(x.split()) for x in lines]
                    places += [(p, n) for n in range(1, size) for p in range(len(lines) - n + 1) if sum(many[p : p + n]) > words]
                for p, n in places:
                    rows.append(k)
                    pos.append(p)
                    length.append(n)
                    hashes.append(xxhash.xxh3_128_digest(b"\n".join(lines[p : p + n])))
            of = pa.array(rows, pa.int64())
            yield pa.record_batch([part.column("doc_id").take(of), part.column("key").take(of), pa.array(pos, pa.int32()), pa.array(length, pa.int32()), pa.array(hashes, pa.binary())], names=["doc_id", "key", "pos", "n", "hash"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key().alias("key"), "text").mapInArrow(run, f"doc_id {kind}, key long, pos int, n int, hash binary")


def later_windows(docs: DataFrame, size: int = 3, words: int | None = None) -> DataFrame:
    """doc_id, key, spans (array of [first line, line after the last]) of the rows that hold later occurrences; each row named once."""
    every = windows(docs, size, words)
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("there"), "doc_id", "key", "pos")).alias("first")
    # cut, so that the join can split a window that very many documents share
    again = cut(every.groupBy("hash").agg(first, F.count("*").alias("found")).filter("found > 1").select("hash", "first"))
    hits = every.join(again, "hash")
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    begin = F.when(own, F.greatest(F.col("pos"), F.col("first.pos") + F.col("n"))).otherwise(F.col("pos"))
    later = (
        hits.filter(~own | (F.col("pos") != F.col("first.pos")))
        .select("doc_id", "key", F.struct(begin.alias("lo"), (F.col("pos") + F.col("n")).alias("hi")).alias("span"))
    )
    return later.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("span")).alias("spans"))  # a document's own lines bound it


def line_dedup(docs: DataFrame, size: int = 3, words: int | None = None) -> DataFrame:
    """doc_id, text without the lines of later occurrences, n_lines long, n_removed long for each row of `docs`."""
    spans = later_windows(docs, size, words).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "spans")
    own = docs.select("doc_id", "text", text_key().alias("key"))
    rows = own.join(spans, own["doc_id"].eqNullSafe(spans["_d"]) & (own["key"] == spans["_k"]), "left").select("doc_id", "text", "spans")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            out, n_lines, n_removed = [], [], []
            for text, found in zip(texts(part), part.column("spans").to_pylist(), strict=True):
                lines = text.split("\n")
                n_lines.append(len(lines))
                if found:
                    at, left = 0, []
                    for s in found:  # by first line
                        left += lines[at : s["lo"]]
                        at = max(at, s["hi"])
                    lines = left + lines[at:]
                    text = "\n".join(lines)
                out.append(text)
                n_removed.append(n_lines[-1] - len(lines))
            yield pa.record_batch([part.column("doc_id"), pa.array(out, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], names=["doc_id", "text", "n_lines", "n_removed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text string, n_lines long, n_removed long")
