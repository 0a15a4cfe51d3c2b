"""Best-fit packing (operator 2).

1. Every document becomes ids plus an end id, cut into pieces of at most `capacity`.
2. The lengths' histogram (at most `capacity` rows) goes to the driver, which plans best-fit
   decreasing over counts: a run of equal sequences takes a run of equal pieces at once.
3. Each piece takes the planned slot of its rank within its length. Ranks are dealt by a salt, a row's number modulo
   as many salts as its length needs: row numbers within (length, salt) plus the counts of the salts before, so that a
   length that holds a third of all pieces is never in one task, copies of one row included.

Defined cases: null text counts as empty, an empty text is one piece holding the end id; repeated rows are packed
each for itself; an empty table gives no rows; a null doc_id is carried through; other columns are passed by.
The plan is bounded: it has at most (3 x capacity) runs, each halved at most capacity / length times, whatever the corpus.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixloom.llm.common import BoundedCache, cut, fresh, text_slices, texts
from helixloom.llm.merges import Merges

#: Pieces that one salt of a length holds on average.
PER_SALT = 500
#: Characters that the tokenizers library takes at a time; it holds 50 to 280 bytes for each until its call is over.
LIBRARY_CHARS = 1 << 17


def byte_chars() -> list[str]:
    """The public byte-to-character rule of byte-level BPE: printable bytes stand for themselves, the others for 256 and up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBPE:
    """A tokenizers file of the kind: lower case, white space dropped, byte-level BPE with a suffix at a word's end.

    Texts of Latin-1 characters, for which composing is the identity and lower case goes character by character, are split here and
    encoded through padded matrices, once for each distinct word. All other texts, and those that hold a special token's own text, go through the library itself.
    """

    #: The file's own pattern over lower-case Latin-1.
    LETTER, NUMBER = re.compile("[a-zªµºß-öø-ÿ]"), re.compile("[0-9²³¹¼-¾]")
    PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
    BEYOND = re.compile("[^\x00-\x1b\x20-\xff]")
    SPACE = re.compile("[\t-\r ]")

    def __init__(self, path: str):
        with open(path) as f:
            spec = json.load(f)
        self.path, self.library = path, None
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right, merged = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64).T
        self.merges = Merges(left, right, np.arange(len(left)), merged)
        self.inner = np.array([vocab[c] for c in byte_chars()], np.int32)
        self.last = np.array([vocab[c + suffix] for c in byte_chars()], np.int32)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.kinds, self.cache = self._kinds(), BoundedCache()

    @classmethod
    def _kinds(cls) -> np.ndarray:
        """1 for letters, 2 for numbers, 3 for others of Latin-1, 0 for the newline between words; what PIECE says in a table."""
        return (
            np.array(
                [0 if c == 10 else 1 if cls.LETTER.match(chr(c)) else 2 if cls.NUMBER.match(chr(c)) else 3 for c in range(256)], np.uint8,
            )
        )

    def _cut(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of words that hold no apostrophe: all bytes, each piece's size, and each word's number of pieces."""
        raw = np.frombuffer("\n".join(words).encode(), np.uint8)
        more = (raw & 0xC0) == 0x80  # a character's second byte
        char = raw.copy()
        second = np.flatnonzero(more)
        char[second] = char[second - 1] = ((raw[second - 1] & 3) << 6) | (raw[second] & 63)
        kind = self.kinds[char]
        begin = np.concatenate([[True], kind[1:] != kind[:-1]]) | ((kind == 2) & ~more)
        at = np.flatnonzero(begin)
        size, real = np.diff(np.append(at, len(raw))), kind[at] > 0
        return raw[kind > 0], size[real], np.bincount(np.cumsum(kind == 0)[at[real]], minlength=len(words))

    def _learn(self, words: list[str]) -> None:
        """`words` hold no white space but may be several pieces, such as a word and its comma."""
        plain, short = [w for w in words if "'" not in w], [w for w in words if "'" in w]
        parts = [(plain, *self._cut(plain))] if plain else []
        if short:
            pieces = [self.PIECE.findall(w) for w in short]
            raw = [p.encode() for x in pieces for p in x]
            parts.append((short, np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64), np.array([len(x) for x in pieces])))
        for many, flat, size, n_pieces in parts:
            end = np.cumsum(size)
            ids = self.inner[flat]
            ids[end - 1] = self.last[flat[end - 1]]
            ids, size = self.merges.words(ids, size)
            data = ids.astype("<u4").tobytes()
            to = (np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n_pieces)])] * 4).tolist()
            self.cache.learn(many, [data[a:b] for a, b in zip(to, to[1:], strict=False)])

    @classmethod
    def _parts(cls, text: str) -> Iterator[str]:
        """The text cut before white space, over which no token, no special token and no composed character reaches, so the parts' ids are the text's.

        A part ends at the first white space from LIBRARY_CHARS on; what holds none stays whole.
        """
        at = 0
        while space := cls.SPACE.search(text, at + LIBRARY_CHARS):
            yield text[at : space.start()]
            at = space.start()
        yield text[at:]

    def _by_library(self, many: list[str]) -> list[bytes]:
        if self.library is None:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        out: list[list[bytes]] = [[] for _ in many]
        rows: list[int] = []
        parts: list[str] = []

        def run() -> None:
            for k, e in zip(rows, self.library.encode_batch(parts, add_special_tokens=False), strict=True):
                out[k].append(np.asarray(e.ids, "<u4").tobytes())
            rows.clear()
            parts.clear()

        size = 0
        for k, text in enumerate(many):
            for part in self._parts(text):
                if parts and size + len(part) > LIBRARY_CHARS:
                    run()
                    size = 0
                rows.append(k)
                parts.append(part)
                size += len(part)
        if parts:
            run()
        return [b"".join(x) for x in out]

    def encode(self, many: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        odd = [k for k, x in enumerate(many) if (not x.isascii() and self.BEYOND.search(x)) or (x.isascii() and any(c in x for c in "\x1c\x1d\x1e\x1f")) or any(c in x for c in self.special)]
        beyond = set(odd)
        split = [[] if k in beyond else x.lower().split() for k, x in enumerate(many)]
        if new := self.cache.new_of(split):
            self._learn(new)
        get = self.cache.__getitem__
        out = [b"".join(map(get, x)) for x in split]
        for k, got in zip(odd, self._by_library([many[k] for k in odd]) if odd else [], strict=True):
            out[k] = got
        return out


@lru_cache(maxsize=1)
def tokenizer(path: str) -> WordBPE:
    return WordBPE(path)


def pieces_of(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each row's ids and the end id, cut after every `capacity`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end, step = tokenizer(path), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for part in text_slices(batches):
            rows, piece, start, length, crc = [], [], [], [], []
            for k, ids in enumerate(bpe.encode(texts(part))):
                ids += end
                for n, at in enumerate(range(0, len(ids), step)):
                    chunk = ids[at : at + step]
                    rows.append(k)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(chunk) // 4)
                    crc.append(zlib.crc32(chunk))
            yield pa.record_batch(
                [part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over counts. Rows (length, first rank, count, first sequence, offset), by length and rank:
    the pieces of ranks first rank + k have their place at `offset` of sequence first sequence + k."""
    rows: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> runs of sequences (first, count)
    free: list[int] = []  # keys of room, ascending
    opened = 0

    def give(left: int, first: int, count: int) -> None:
        if left and count:
            if left not in room:
                bisect.insort(free, left)
                room[left] = []
            room[left].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, n = 0, histogram[length]
        while rank < n:
            k = bisect.bisect_left(free, length)
            if k < len(free):
                left = free[k]
                first, count = room[left].pop()
                if not room[left]:
                    del room[left], free[k]
                take = min(count, n - rank)
                rows.append((length, rank, take, first, capacity - left))
                give(left, first + take, count - take)
                give(left - length, first, take)
                rank += take
            else:
                each = capacity // length
                full, over = divmod(n - rank, each)
                for count, used in ((full, each), (1, over)):
                    if count and used:
                        for slot in range(used):
                            rows.append((length, rank, count, opened, slot * length))
                            rank += count
                        give(capacity - used * length, opened, count)
                        opened += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces with a `length` of 1 to `capacity`; all further columns are kept."""
    pieces = cut(pieces.drop("sequence_id", "offset"))
    cols = pieces.columns
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    slots = plan(histogram, capacity)
    # a row's number in its partition of the checkpoint is the same whenever it is read, and deals repeated rows out like any others
    salts = F.element_at(F.array(*(F.lit(-(-histogram.get(k, 1) // PER_SALT)) for k in range(1, capacity + 1))), F.col("length").cast("int"))
    salt, n, begin, k, place = (fresh(pieces, x) for x in ("_salt", "_n", "_before", "_k", "_rank"))
    dealt = pieces.withColumn(salt, F.pmod(F.monotonically_increasing_id(), salts).cast("int"))
    counts = dealt.groupBy("length", salt).agg(F.count("*").alias(n))
    before = counts.select("length", salt, (F.sum(n).over(Window.partitionBy("length").orderBy(salt)) - F.col(n)).alias(begin))
    ranked = dealt.withColumn(k, F.row_number().over(Window.partitionBy("length", salt).orderBy(*cols)))
    ranked = ranked.join(before, ["length", salt]).select(*cols, (F.col(begin) + F.col(k) - 1).alias(place))

    def take(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = slots[:, 0] * (1 << 48) + slots[:, 1]
        for b in batches:
            rank = b.column(place).to_numpy(zero_copy_only=False)
            at = np.searchsorted(first, b.column("length").to_numpy(zero_copy_only=False) * (1 << 48) + rank, "right") - 1
            slot = slots[at]
            yield pa.record_batch([*(b.column(c) for c in cols), pa.array(slot[:, 3] + rank - slot[:, 1]), pa.array(slot[:, 4])], names=[*cols, "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructField, StructType

    added = [StructField("sequence_id", LongType()), StructField("offset", LongType())]
    return ranked.mapInArrow(take, StructType([*pieces.schema.fields, *added]))


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    return pack(pieces_of(docs, path, capacity, end_id), capacity)
