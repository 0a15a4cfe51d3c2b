"""Byte-level BPE encoding and decoding (operator 3).

Each whole text is split by a pattern; every match is encoded by itself: bytes, then merges
of least rank. Distinct matches of a slice go through padded matrices (merges.Merges) once;
a bounded cache keeps them for later slices of the same worker.

Defined cases: null text counts as empty; an empty text has no ids and decodes to no bytes;
repeated rows give repeated results; other columns are passed by. A match of more than
merges.WIDEST bytes is merged by a heap, with equal ids. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from helixloom.llm.common import BoundedCache, text_slices, texts
from helixloom.llm.merges import Merges, gather


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class ByteBPE:
    """A rank file's tokenizer."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.split = regex.compile(pattern).findall
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], k) for t, k in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, merged = np.array(pairs, np.int64).T
        self.merges = Merges(left, right, merged, merged)  # a pair's rank is the id of what it becomes
        by_id: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for t, k in ranks.items():
            by_id[k] = t
        self.token = self._strings(by_id)
        self.decimal = self._strings([b"%d," % k for k in range(len(by_id))])
        self.cache = BoundedCache()

    @staticmethod
    def _strings(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64), np.frombuffer(b"".join(rows), np.uint8)

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        ids, size = self.merges.words(self.byte_id[np.frombuffer(b"".join(raw), np.uint8)], np.array([len(x) for x in raw], np.int64))
        data, end = ids.astype("<u4").tobytes(), (np.cumsum(size) * 4).tolist()
        self.cache.learn(words, [data[a:b] for a, b in zip([0, *end], end, strict=False)])

    def encode(self, many: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        split = [self.split(x) for x in many]
        if new := self.cache.new_of(split):
            self._learn(new)
        get = self.cache.__getitem__
        return [b"".join(map(get, x)) for x in split]

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(*self.token, ids)[0].tobytes()

    def as_decimals(self, ids: np.ndarray) -> bytes:
        return gather(*self.decimal, ids)[0].tobytes()[:-1]


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


#: Columns that transcode() can add.
KINDS = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "ids_sha256": pa.string(), "decoded": pa.binary(), "decoded_sha256": pa.string()}
DDL = {"n_tokens": "n_tokens long", "ids": "ids array<int>", "ids_sha256": "ids_sha256 string", "decoded": "decoded binary", "decoded_sha256": "decoded_sha256 string"}


def transcode(docs: DataFrame, path: str, pattern: str, want: tuple[str, ...] = ("n_tokens", "ids")) -> DataFrame:
    """doc_id and the wanted columns of KINDS for each row of `docs`: encodes the whole text; what is `decoded` comes from the ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for part in text_slices(batches):
            ids = [np.frombuffer(x, "<u4").astype(np.int64) for x in bpe.encode(texts(part))]
            cols: dict[str, list] = {k: [] for k in want}
            for x in ids:
                back = bpe.decode(x) if any("decoded" in k for k in want) else b""
                made = {"n_tokens": lambda x=x: len(x), "ids": lambda x=x: x.astype(np.int32), "ids_sha256": lambda x=x: hashlib.sha256(bpe.as_decimals(x)).hexdigest(), "decoded": lambda b=back: b, "decoded_sha256": lambda b=back: hashlib.sha256(b).hexdigest()}
                for k in want:
                    cols[k].append(made[k]())
            yield pa.record_batch([part.column("doc_id"), *(pa.array(cols[k], KINDS[k]) for k in want)], names=["doc_id", *want])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(DDL[k] for k in want))


def decode_ids(rows: DataFrame, path: str, pattern: str, column: str = "ids") -> DataFrame:
    """Adds `decoded` (binary) to rows with an array of ids; a null array decodes to null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for b in batches:
            out = [None if x is None else bpe.decode(np.asarray(x, np.int64)) for x in b.column(column).to_pylist()]
            yield pa.record_batch([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "decoded"])

    from pyspark.sql.types import BinaryType, StructField, StructType

    kept = [f for f in rows.schema.fields if f.name != "decoded"]
    return rows.select(*(f.name for f in kept)).mapInArrow(run, StructType([*kept, StructField("decoded", BinaryType())]))
