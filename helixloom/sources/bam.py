"""BAM as a Spark data source: `spark.read.format("bam")`, in Arrow batches. With an index (path + ".bai") regions become partitions that
seek to their place; without one a file is one partition; the rows are the same. CRAM and .csi indexes aren't supported."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition
from pyspark.sql.types import StructType

from helixloom.schemas import READS
from helixloom.sources.bgzf import Reader, compress, packed

#: Fixed values of the format: packed bases, operation codes, widths of tag values.
BASES = "=ACMGRSVTWYHKDBN"
OPS = "MIDNSHP=X"
WIDTH = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def read_header(r: Reader) -> tuple[str, list[tuple[str, int]]]:
    if r.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    text = r.read(struct.unpack("<i", r.read(4))[0]).rstrip(b"\0").decode()
    contigs = []
    for _ in range(struct.unpack("<i", r.read(4))[0]):
        name = r.read(struct.unpack("<i", r.read(4))[0])[:-1].decode()
        contigs.append((name, struct.unpack("<i", r.read(4))[0]))
    return text, contigs


def _tags(raw: bytes) -> dict[str, str]:
    out, k = {}, 0
    while k < len(raw):
        name, kind = raw[k : k + 2].decode(), chr(raw[k + 2])
        k += 3
        if kind in WIDTH:
            value = struct.unpack_from("<" + WIDTH[kind], raw, k)[0]
            k += struct.calcsize(WIDTH[kind])
        elif kind == "A":
            value, k = chr(raw[k]), k + 1
        elif kind in "ZH":
            end = raw.index(0, k)
            value, k = raw[k:end].decode(), end + 1
        else:  # B: an array
            sub, n = chr(raw[k]), struct.unpack_from("<i", raw, k + 1)[0]
            value = ",".join([sub, *map(str, struct.unpack_from(f"<{n}{WIDTH[sub]}", raw, k + 5))])
            k += 5 + n * struct.calcsize(WIDTH[sub])
        out[name] = str(value)
    return out


#: Two bases of each packed byte.
PAIRS = [BASES[b >> 4] + BASES[b & 15] for b in range(256)]


def decode(raw: bytes, contigs: Sequence[tuple[str, int]]) -> tuple:
    """A record's bytes to a row of schemas.READS."""
    ref, pos, n_name, mapq, _, n_ops, flag, n_seq = struct.unpack_from("<iiBBHHHi", raw)
    k = 32 + n_name
    name = raw[32 : k - 1].decode()
    ops = struct.unpack_from(f"<{n_ops}I", raw, k)
    k += 4 * n_ops
    packed = raw[k : k + (n_seq + 1) // 2]
    seq = "".join(map(PAIRS.__getitem__, packed))[:n_seq]
    k += len(packed)
    qual = raw[k : k + n_seq]
    tags = _tags(raw[k + n_seq :])
    cigar = "".join(f"{x >> 4}{OPS[x & 15]}" for x in ops) or "*"
    return name, flag, contigs[ref][0] if ref >= 0 else None, pos + 1, mapq, cigar, seq or "*", b"" if qual[:1] == b"\xff" else qual, tags


def encode(row: Any, ids: dict[str, int]) -> bytes:
    """A row of schemas.READS to a record with its length."""
    import re

    ops = [(int(n), OPS.index(o)) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", row["cigar"] or "")]
    seq = "" if row["seq"] in (None, "*") else row["seq"]
    codes = [BASES.find(c) if c in BASES else 15 for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    qual = bytes(row["qual"]) if row["qual"] else b"\xff" * len(seq)
    name = row["qname"].encode() + b"\0"
    tags = b""
    for t, v in (row["tags"] or {}).items():
        whole = re.fullmatch(r"-?\d+", v or "") and -(2**31) <= int(v) < 2**31
        tags += t.encode() + (b"i" + struct.pack("<i", int(v)) if whole else b"Z" + (v or "").encode() + b"\0")
    beg, end = row["pos"] - 1, row["pos"] - 1 + max(1, sum(n for n, o in ops if OPS[o] in "MDN=X"))
    body = (
        struct.pack(
            "<iiBBHHHiiii", ids.get(row["contig"], -1), beg, len(name), row["mapq"], bin_of(beg, end), len(ops), row["flag"], len(seq), -1,
            -1, 0,
        )
    )
    body += name + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + packed + qual + tags
    return struct.pack("<i", len(body)) + body


def bin_of(beg: int, end: int) -> int:
    """The format's bin number of a half-open span: the smallest of its five nested grids' cells that holds it."""
    end -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if beg >> shift == end >> shift:
            return first + (beg >> shift)
    return 0


def linear_index(path: str) -> list[list[int]]:
    """For each contig of a .bai file, the least virtual offset of each 16 kb stretch."""
    with open(path, "rb") as f:
        raw = f.read()
    k, out = 8, []
    for _ in range(struct.unpack_from("<i", raw, 4)[0]):
        n_bin = struct.unpack_from("<i", raw, k)[0]
        k += 4
        for _ in range(n_bin):
            k += 8 + 16 * struct.unpack_from("<i", raw, k + 4)[0]
        n = struct.unpack_from("<i", raw, k)[0]
        out.append(list(struct.unpack_from(f"<{n}Q", raw, k + 4)))
        k += 4 + 8 * n
    return out


@dataclass
class Span(InputPartition):
    path: str
    source: int = 0
    contig: str | None = None
    beg: int = 1
    end: int = 1 << 60
    offset: int = 0
    unplaced: bool = False  # only reads without a contig, from offset on


#: Arrow types of schemas.READS, and rows of a batch.
TYPES = pa.schema([
    ("qname", pa.string()), ("flag", pa.int32()), ("contig", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("seq", pa.string()), ("qual", pa.binary()),
    ("tags", pa.map_(pa.string(), pa.string())),
])
ROWS = 1024


class BamReader(DataSourceReader):
    """Options: window (bases of a partition where there is an index), exclude_flags and min_mapq (reads left out before they are decoded), source_idx (true adds the file's place)."""

    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options["path"].split(",") if p]
        self.window = int(options.get("window", 20_000_000))
        self.exclude, self.min_mapq = int(options.get("exclude_flags", 0)), int(options.get("min_mapq", 0))
        self.with_source = options.get("source_idx", "false").lower() == "true"
        self.contig: str | None = None

    def partitions(self) -> list[Span]:
        out = []
        for source, path in enumerate(self.paths):
            if not os.path.exists(f"{path}.bai"):
                out.append(Span(path, source))
                continue
            with open(path, "rb") as f:
                contigs = read_header(Reader(f))[1]
            index = linear_index(f"{path}.bai")
            for (name, length), offsets in zip(contigs, index, strict=True):
                if any(offsets) and self.contig in (None, name):
                    for beg in range(1, length + 1, self.window):
                        at = next((o for o in offsets[(beg - 1) >> 14 :] if o), 0)
                        if at:
                            out.append(Span(path, source, name, beg, min(length, beg + self.window - 1), at))
            # reads without a contig come last; an index must not change what is read
            if self.contig is None:
                out.append(Span(path, source, offset=max((o for offsets in index for o in offsets), default=0), unplaced=True))
        return out

    def read(self, part: Span) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in self._rows(part):
            rows.append(row)
            if len(rows) == ROWS:
                yield self._batch(rows, part)
                rows = []
        if rows:
            yield self._batch(rows, part)

    def _batch(self, rows: list[tuple], part: Span) -> pa.RecordBatch:
        cols = [pa.array([list(x.items()) for x in c] if f.name == "tags" else c, f.type) for c, f in zip(zip(*rows, strict=True), TYPES, strict=True)]
        names = TYPES.names
        if self.with_source:
            cols, names = [*cols, pa.array([part.source] * len(rows), pa.int32())], [*names, "source_idx"]
        return pa.record_batch(cols, names=names)

    def _rows(self, part: Span) -> Iterator[tuple]:
        with open(part.path, "rb") as f:
            r = Reader(f)
            contigs = read_header(r)[1]
            names = [n for n, _ in contigs]
            if part.offset:
                r = Reader(f, part.offset)
            while len(head := r.read(4)) == 4:
                raw = r.read(struct.unpack("<i", head)[0])
                ref, pos, _, mapq, _, _, flag = struct.unpack_from("<iiBBHHH", raw)
                contig = names[ref] if ref >= 0 else None
                if part.unplaced and ref >= 0:
                    continue
                if part.contig:  # a read belongs to the span that it begins in
                    if contig != part.contig or pos + 1 > part.end:
                        break
                    if pos + 1 < part.beg:
                        continue
                if flag & self.exclude or mapq < self.min_mapq or self.contig not in (None, contig):
                    continue
                yield decode(raw, contigs)


class PushingReader(BamReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes a least mapping quality and a contig; Spark applies what is left, and these again."""
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("mapq",) and isinstance(f.value, int):
                self.min_mapq = max(self.min_mapq, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, EqualTo) and f.attribute == ("contig",) and isinstance(f.value, str):
                self.contig = f.value
            yield f


class Bam(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return READS + (", source_idx int" if self.options.get("source_idx", "false").lower() == "true" else "")

    def reader(self, schema: StructType) -> BamReader:
        # Spark refuses a reader that takes filters where the session doesn't allow it, so one is asked for: read() does
        return (PushingReader if self.options.get("push", "false").lower() == "true" else BamReader)(self.options)


def read(spark: SparkSession, paths: str | list[str], **options: str) -> DataFrame:
    """Reads of one or more files, with filters on mapping quality and contig taken by the source."""
    spark.dataSource.register(Bam)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("bam").options(push="true", **options).load(paths if isinstance(paths, str) else ",".join(paths))


def header_bytes(contigs: list[tuple[str, int]], text: str = "") -> bytes:
    text = text or "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in contigs)
    head = b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(contigs))
    for n, k in contigs:
        head += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k)
    return head


def write_bam(path: str, rows: Iterator[Any], contigs: list[tuple[str, int]], text: str = "") -> None:
    """One BAM file from sorted rows, block by block; sinks.alignments.write_bam() writes tables of any size."""
    ids = {n: k for k, (n, _) in enumerate(contigs)}
    with open(path, "wb") as f:
        held = header_bytes(contigs, text)
        for r in rows:
            held += encode(r, ids)
            if len(held) >= 1 << 20:
                f.write(packed(held))
                held = b""
        f.write(compress(held))
