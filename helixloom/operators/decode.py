"""Reads to event arrays. Plain operation offsets are column expressions; whole decoding, which needs bases and
qualities along a read, is an Arrow-batched function.

Events: (pos 1-based, op of =XIDSH, len, qi 0-based in the read, alt, low_qual). An insertion's pos is the base after it.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixloom.config import Options


def cigar_ops(cigar: Column, pos: Column) -> Column:
    """Array of (op, len, ref_pos, qi) of a CIGAR text, offsets by one fold."""
    n = F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDNSHP=X])"), F.lit(1))
    o = F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDNSHP=X])"), F.lit(2))
    ops = F.zip_with(o, n, lambda op, k: F.struct(op.alias("op"), k.cast("int").alias("len")))
    zero = (
        F.struct(
            pos.cast("long").alias("ref"), F.lit(0).alias("qi"),
            F.array().cast("array<struct<op:string,len:int,ref_pos:bigint,qi:int>>").alias("out"),
        )
    )

    def step(s: Column, x: Column) -> Column:
        here = F.struct(x["op"].alias("op"), x["len"].alias("len"), s["ref"].alias("ref_pos"), s["qi"].alias("qi"))
        ref = s["ref"] + F.when(x["op"].isin("M", "=", "X", "D", "N"), x["len"]).otherwise(0)
        qi = s["qi"] + F.when(x["op"].isin("M", "=", "X", "I", "S"), x["len"]).otherwise(0)
        return F.struct(ref.alias("ref"), qi.alias("qi"), F.array_append(s["out"], here).alias("out"))

    return F.aggregate(ops, zero, step, lambda s: s["out"])


class Event(NamedTuple):
    pos: int
    op: str
    len: int
    qi: int
    alt: str
    low_qual: bool


class BadAlignment(ValueError):
    """Operations that don't fit the read or each other: the read is skipped."""


CIGAR = re.compile(r"(\d+)([MIDNSHP=X])")
CS = re.compile(r":(\d+)|=([A-Za-z]+)|\*([a-z])([a-z])|\+([A-Za-z]+)|-([A-Za-z]+)|~[a-z]{2}(\d+)[a-z]{2}")
MD = re.compile(r"(\d+)|\^([A-Z]+)|([A-Z])")


def _by_md(ops: list[tuple[str, int]], md: str) -> list[tuple[str, int]]:
    """M operations split by a MD text's matches and mismatches."""
    marks: deque[list] = deque()
    for n, gap, base in MD.findall(md):
        if n and int(n):
            marks.append(["=", int(n)])
        elif gap:
            marks.append(["D", len(gap)])
        elif base:
            marks.append(["X", 1])
    out = []
    for op, n in ops:
        if op == "D":
            if not marks or marks[0] != ["D", n]:
                raise BadAlignment("MD and CIGAR differ")
            marks.popleft()
        if op not in "M=X":
            out.append((op, n))
            continue
        while n:
            if not marks or marks[0][0] == "D":
                raise BadAlignment("MD and CIGAR differ")
            take = min(n, marks[0][1])
            out.append((marks[0][0], take))
            marks[0][1] -= take
            n -= take
            if not marks[0][1]:
                marks.popleft()
    return out


def _by_cs(ops: list[tuple[str, int]], cs: str) -> list[tuple[str, int]]:
    """Operations of a cs text between the CIGAR's clips."""
    head = [x for x in ops[:2] if x[0] in "SH"]
    tail = [x for x in ops[-2:] if x[0] in "SH"] if len(ops) > len(head) else []
    out, at = [], 0
    for m in CS.finditer(cs):
        if m.start() != at:
            raise BadAlignment("unknown cs text")
        at = m.end()
        same, seq, a, _, ins, gap, skip = m.groups()
        out.append(("=", int(same)) if same else ("=", len(seq)) if seq else ("X", 1) if a else ("I", len(ins)) if ins else ("D", len(gap)) if gap else ("N", int(skip)))
    if at != len(cs):
        raise BadAlignment("unknown cs text")
    return [*head, *out, *tail]


def _by_reference(ops: list[tuple[str, int]], seq: str, pos: int, ref: str, ref_beg: int) -> list[tuple[str, int]]:
    """M operations compared with the reference; bases beyond the slice count as equal to nothing and are skipped as matches."""
    out, at, qi = [], pos - ref_beg, 0
    for op, n in ops:
        if op == "M":
            for k in range(n):
                known = 0 <= at + k < len(ref)
                out.append(("X" if known and ref[at + k] != seq[qi + k] else "=", 1))
        else:
            out.append((op, n))
        at += n if op in "M=XDN" else 0
        qi += n if op in "M=XIS" else 0
    return out


def events_of(pos: int, cigar: str, seq: str, qual: bytes, tags: dict[str, str], ref: str | None, ref_beg: int, o: Options) -> list[Event]:
    """A read's events: from = and X operations, else the cs tag, else MD, else the reference."""
    ops = [(b, int(a)) for a, b in CIGAR.findall(cigar)]
    if any(op in "=X" for op, _ in ops):
        pass
    elif "cs" in tags:
        ops = _by_cs(ops, tags["cs"])
    elif "MD" in tags:
        ops = _by_md(ops, tags["MD"])
    elif ref is not None:
        ops = _by_reference(ops, seq, pos, ref, ref_beg)
    low = lambda k: bool(qual) and k < len(qual) and qual[k] < o.min_base_quality
    out: list[Event] = []
    at, qi = pos, 0

    def push(op: str, n: int, alt: str, is_low: bool) -> None:
        if out and op in "=ID" and out[-1].op == op and out[-1].low_qual == is_low:
            e = out[-1]
            out[-1] = e._replace(len=e.len + n, alt=e.alt + alt)
        else:
            out.append(Event(at, op, n, qi, alt, is_low))

    for op, n in ops:
        if op in "=M":
            push("=", n, "", False)
            at, qi = at + n, qi + n
        elif op == "X":
            for _ in range(n):
                push("X", 1, seq[qi : qi + 1], low(qi))
                at, qi = at + 1, qi + 1
        elif op == "I":
            push("I", n, seq[qi : qi + n], all(low(k) for k in range(qi, qi + n)))
            qi += n
        elif op == "D":
            push("D", n, "", low(qi - 1) or low(qi))
            at += n
        elif op in "SH":
            push(op, n, "", False)
            qi += n if op == "S" else 0
        elif op == "N":
            at += n
    if seq and qi != len(seq):
        raise BadAlignment("operations don't fit the read")
    return out


def chained(events: list[Event]) -> bool:
    """Each event begins in the read where the one before ended."""
    return all(a.qi + (a.len if a.op in "=XIS" else 0) == b.qi for a, b in zip(events, events[1:], strict=False))


def dense_windows(events: list[tuple[int, int, int]], window: int, most: int) -> list[tuple[int, int, int]]:
    """Noisy stretches (st, en, label), half-open, of difference events (pos, length on the reference, count) in order.

    Over each event lies a window of those whose last base is within `window`; where its counts exceed `most`, the span from its first
    event to the last is noisy. Spans that touch become one; the label is the larger of their counts' sum and their length.
    """
    front, total, out = 0, 0, []
    spans: list[list[int]] = []  # begin, end, first event, last event
    for k, (pos, length, count) in enumerate(events):
        total += count
        while front < k and events[front][0] + events[front][1] - 1 <= pos - window:
            total -= events[front][2]
            front += 1
        if count and total > most:
            begin, end = events[front][0], pos + length
            if spans and begin <= spans[-1][1]:
                spans[-1][1], spans[-1][3] = end, k
            else:
                spans.append([begin, end, front, k])
    for begin, end, a, b in spans:
        out.append((begin - 1, end, max(sum(c for _, _, c in events[a : b + 1]), end - begin + 1)))
    return out


def palindrome(pos: int, end: int, sa: str, contig: str) -> bool:
    """Some supplementary alignment covers at least 90 % of the read's own span."""
    for x in filter(None, sa.split(";")):
        c, p, _, cigar = x.split(",")[:4]
        if c == contig:
            st = int(p)
            en = st + sum(int(n) for n, op in CIGAR.findall(cigar) if op in "MDN=X") - 1
            if min(end, en) - max(pos, st) + 1 >= 0.9 * (end - pos + 1):
                return True
    return False


def noisy_of(events: list[Event], pos: int, end: int, contig_length: int, o: Options, clip_ends: tuple[bool, bool] = (True, True)) -> tuple[list[tuple[int, int, int]], int]:
    """Noisy intervals of a read and its number of difference events: dense stretches, and the ends of long clips (label 0)."""
    diffs, n, spans = [], 0, []
    for e in events:
        if e.op in "XID" and not e.low_qual:
            diffs.append((e.pos, 0 if e.op == "I" else e.len, e.len if e.op in "ID" else 1))
            n += 1
    for first, wanted in ((True, clip_ends[0]), (False, clip_ends[1])):
        e = events[0] if first else events[-1]
        if wanted and e.op in "SH" and e.len > o.end_clip:
            n += 1
            if first and pos > 10:
                spans.append((pos - 1, min(end, pos - 1 + o.end_clip_flank), 0))
            elif not first and end < contig_length - 10:
                spans.append((max(pos - 1, end - o.end_clip_flank), end, 0))
    return dense_windows(diffs, o.dense_window, o.dense_count) + spans, n


def keeps(noisy: list[tuple[int, int, int]], n_events: int, pos: int, end: int, o: Options) -> bool:
    """A read stays unless half of it is noisy or more than a twentieth of its bases are events. An interval's length counts one base more."""
    span = end - pos + 1
    return sum(b - a + 1 for a, b, _ in noisy) <= o.max_noisy_fraction * span and n_events <= o.max_event_ratio * span


EVENT_TYPE = "array<struct<pos:long,op:string,len:int,qi:int,alt:string,low_qual:boolean>>"
NOISY_TYPE = "array<struct<st:long,en:long,label:int>>"


def decode(reads: DataFrame, o: Options) -> DataFrame:
    """Reads (schemas.READS columns, end[, ref_seq, ref_beg, contig_length]) with events, noisy intervals, n_events, and `kept`: not skipped.

    A read of wrong operations has no events and isn't kept.
    """
    have = set(reads.columns)
    rows = reads if "ref_seq" in have else reads.withColumn("ref_seq", F.lit(None).cast("string")).withColumn("ref_beg", F.lit(1).cast("long"))
    rows = rows if "contig_length" in have else rows.withColumn("contig_length", F.lit(1 << 40).cast("long"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from helixloom.operators import decode_batch

        for whole in batches:
            for b in decode_batch.parts(whole, ["cigar", "seq", "qual", "ref_seq"]):
                yield pa.record_batch([*b.columns, *decode_batch.decoded(b, o)], names=[*b.schema.names, "events", "noisy", "n_events", "kept"])

    from pyspark.sql.types import StructType

    extra = StructType.fromDDL(f"events {EVENT_TYPE}, noisy {NOISY_TYPE}, n_events int, kept boolean")
    return rows.mapInArrow(run, StructType([*rows.schema.fields, *extra.fields]))
