"""Evidence of an alt read for a somatic variant: qualities, nearness to errors, dense differences, clips, homopolymers."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from helixloom.config import HIFI
from helixloom.functions import align, dust
from helixloom.operators.decode import Event
from helixloom.operators.decode_batch import before, text_of
from helixloom.operators.noisy import slice_of

#: Half a quality window, the cap of an indel's distance, a clip's least length and reach, the reach for dense differences.
AROUND, CAP, CLIP, REACH, FAR = 3, 10, 100, 100, 600
#: So many differences within so many bases are dense.
DENSE = (6, 100)


def event_quality(op: str, qi: int, n: int, qual: bytes, low: bool) -> int:
    """Mean quality of an event's bases, whole; a deletion has those of its two neighbours; 0 if it counts as low."""
    if low or not qual:
        return 0
    own = qual[max(0, qi - 1) : qi + 1] if op == "D" else qual[qi : qi + n]
    return sum(own) // len(own) if own else 0


def window_quality(qi: int, qual: bytes) -> int:
    """Least quality within AROUND bases."""
    return min(qual[max(0, qi - AROUND) : qi + AROUND + 1], default=0)


def is_variant(e: Event, known: set[tuple[int, str, int]]) -> bool:
    return (e.pos, e.op, e.len) in known


def gap_distance(pos: int, events: list[Event], known: set[tuple[int, str, int]]) -> int:
    """To the nearest gap of the read that is no known variant, CAP at most."""
    return min([CAP, *(min(abs(e.pos - pos), abs(e.pos + (e.len if e.op == "D" else 0) - pos)) for e in events if e.op in "ID" and not is_variant(e, known))])


def dense(pos: int, events: list[Event], n: int = DENSE[0], window: int = DENSE[1]) -> bool:
    """Any n consecutive differences of good quality within `window`, among those within FAR of a position."""
    at = [e.pos for e in events if e.op in "XID" and not e.low_qual and abs(e.pos - pos) <= FAR]
    return any(b - a <= window for a, b in zip(at, at[n - 1 :], strict=False))


def near_clip(pos: int, events: list[Event]) -> bool:
    return any(e.op in "SH" and e.len >= CLIP and abs(e.pos - pos) <= REACH for e in (events[0], events[-1]))


def error_within(lo: int, hi: int, events: list[Event], known: set[tuple[int, str, int]]) -> bool:
    """The read differs, other than by known variants, within a low-complexity span."""
    return any(e.op in "XID" and not is_variant(e, known) and e.pos < hi and lo < e.pos + max(1, e.len if e.op == "D" else 1) for e in events)


def compressed(s: str) -> str:
    """Runs of 3 or more of a base as one; then of 3 or more of a pair as one pair."""
    once = "".join(c if len(run) >= 3 else run for c, g in groupby(s) for run in ("".join(g),))
    return re.sub(r"(..)\1{2,}", r"\1", once)


def homopolymer_error(read: str, reference: str, alt: str, ref: str, at: int) -> bool:
    """A SNV that may be a homopolymer error: the read around it equals the haplotype without it once both are compressed, or the aligned column doesn't show it.

    `at`: place of the SNV in `reference`, which is the haplotype's sequence over the same stretch.
    """
    with_it = reference[:at] + alt + reference[at + 1 :]
    if compressed(read) == compressed(reference) and compressed(with_it) != compressed(reference):
        return True
    if compressed(read) == compressed(with_it):
        return False
    t, q = align.affine(reference, read)
    k = -1
    for c, d in zip(t, q, strict=True):
        k += c != "-"
        if k == at and c != "-":
            return d != alt
    return True


def haplotype(reference: str, lo: int, pos: int, known: list[dict], hap: int, phase_set: int) -> tuple[str, int]:
    """The sequence of a haplotype over a stretch of reference from lo on, and the place of a site in it: the known variants that lie on it, homozygous
    ones included, are put in. Variants that would change the site itself are left out."""
    out, at = reference, pos - lo
    own = [k for k in known if (k["hap1"] if hap == 1 else k["hap2"]) == 1 and (k["hap1"] == k["hap2"] or (phase_set > 0 and k["phase_set"] == phase_set))]
    for k in sorted(own, key=lambda k: -k["pos"]):
        st = k["pos"] - lo
        gone = k["len"] if k["op"] == "D" else 0 if k["op"] == "I" else 1
        if st < 0 or st + gone > len(reference) or st <= pos - lo < st + max(1, gone):
            continue
        out = out[:st] + (k["alt"] or "") + out[st + gone :]
        if st <= pos - lo:
            at += len(k["alt"] or "") - gone
    return out, at


def of_reads(rows: DataFrame) -> DataFrame:
    """Rows (read_id, var_id, pos, op, len, qi, low_qual, events, seq, qual, rev, known: array of (pos, op, len, alt, phase_set, hap1, hap2), hap_seq, hap_lo, alt, ref, hap, phase_set)
    to read_id, var_id, rev and somatic.EVIDENCE columns.

    hap_seq: the reference around the site from hap_lo on. Low complexity is judged on it, homopolymers on what the read's haplotype makes of it.
    """
    names = ["qual", "window_qual", "indel_distance", "dense", "near_clip", "low_complexity_error", "homopolymer_error"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = plain(b) if b.num_rows else [np.zeros(0, np.int64)] * 5
            errors = np.zeros((2, b.num_rows), np.int64)
            around = np.flatnonzero(pc.fill_null(pc.binary_length(b.column("hap_seq")), 0).to_numpy(zero_copy_only=False))
            for k in around.tolist():
                errors[:, k] = sequence_errors(b.slice(k, 1).to_pylist()[0])
            yield pa.record_batch([b.column("read_id"), b.column("var_id"), b.column("rev"), *(pa.array(x.astype(np.int32)) for x in (*made, *errors))], names=["read_id", "var_id", "rev", *names])

    return rows.mapInArrow(run, "read_id long, var_id long, rev boolean, " + ", ".join(f"{n} int" for n in names))


def sequence_errors(r: dict) -> tuple[int, int]:
    """Whether a row of of_reads() with sequence around it has an error of low complexity, and one of homopolymers."""
    events = [Event(e["pos"], e["op"], e["len"], e["qi"], e["alt"], e["low_qual"]) for e in r["events"]]
    known = {(k["pos"], k["op"], k["len"]) for k in r["known"] or []}
    around, at = r["hap_seq"], r["pos"] - (r["hap_lo"] or 0)
    masked = [(a, b) for a, b in dust.mask(around, HIFI.dust_threshold, HIFI.dust_window) if a <= at < b]
    own = slice_of(events, r["seq"], r["hap_lo"], r["hap_lo"] + len(around) - 1) if r["op"] == "X" else None
    whole = own is not None and own.left and own.right
    hap_seq, place = haplotype(around, r["hap_lo"], r["pos"], r["known"] or [], r["hap"], r["phase_set"]) if own is not None else ("", 0)
    return (
        int(any(error_within(r["hap_lo"] + a, r["hap_lo"] + b, events, known | {(r["pos"], r["op"], r["len"])}) for a, b in masked)),
        int(own is not None and (not whole or homopolymer_error(own.seq, hap_seq, r["alt"], r["ref"], place))),
    )


OPS = pa.array(list("=XIDSHMNP"))
X, I, D, S, H = 1, 2, 3, 4, 5  # noqa: E741


def _ints(a: pa.Array) -> np.ndarray:
    return pc.fill_null(a, False if pa.types.is_boolean(a.type) else 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _ops(a: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(a, value_set=OPS), 15).to_numpy(zero_copy_only=False).astype(np.int64)


def _flat(a: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """The row of each element of a list column, and the elements."""
    return np.repeat(np.arange(len(a)), _ints(pc.list_value_length(a))), a.flatten()


def plain(b: pa.RecordBatch) -> list[np.ndarray]:
    """event_quality(), window_quality(), gap_distance(), dense() and near_clip() of a batch's rows."""
    pos, qi, n, op, low = _ints(b.column("pos")), _ints(b.column("qi")), _ints(b.column("len")), _ops(b.column("op")), _ints(b.column("low_qual")) > 0
    qual = text_of(b.column("qual"))
    size, total, st = np.diff(qual.at), before(qual.data), qual.at[:-1]
    begin = np.minimum(np.where(op == D, np.maximum(0, qi - 1), qi), size)
    end = np.maximum(begin, np.minimum(np.where(op == D, qi + 1, qi + n), size))
    own = np.where(low, 0, (total[st + end] - total[st + begin]) // np.maximum(end - begin, 1))
    window = np.full(len(pos), 256, np.int64)
    for k in range(-AROUND, AROUND + 1):
        use = np.flatnonzero((qi + k >= 0) & (qi + k < size))
        window[use] = np.minimum(window[use], qual.data[st[use] + qi[use] + k])
    window[window == 256] = 0

    row, e = _flat(b.column("events"))
    e_pos, e_op, e_len, e_low = _ints(e.field("pos")), _ops(e.field("op")), _ints(e.field("len")), _ints(e.field("low_qual")) > 0
    off = np.abs(e_pos - pos[row])
    distance = np.full(len(pos), CAP, np.int64)
    gap = np.flatnonzero((e_op == I) | (e_op == D))
    k_row, known = _flat(b.column("known"))
    if len(known):
        at = np.concatenate([(row[gap] << 40) + e_pos[gap], (k_row << 40) + _ints(known.field("pos"))])
        what = np.concatenate([(e_len[gap] << 4) + e_op[gap], (_ints(known.field("len")) << 4) + _ops(known.field("op"))])
        all_of = (np.unique(at, return_inverse=True)[1] << 36) + what
        gap = gap[~np.isin(all_of[: len(gap)], all_of[len(gap) :])]
    np.minimum.at(distance, row[gap], np.minimum(off[gap], np.abs(e_pos[gap] + np.where(e_op[gap] == D, e_len[gap], 0) - pos[row[gap]])))

    near = np.flatnonzero(((e_op == X) | (e_op == I) | (e_op == D)) & ~e_low & (off <= FAR))
    a, z = near[: -DENSE[0] + 1], near[DENSE[0] - 1 :]
    crowded = np.zeros(len(pos), np.int64)
    crowded[row[a[(row[a] == row[z]) & (e_pos[z] - e_pos[a] <= DENSE[1])]]] = 1
    clip = np.flatnonzero(((e_op == S) | (e_op == H)) & (e_len >= CLIP) & (off <= REACH))
    outer = np.ones(len(row), bool)
    outer[1:-1] = (row[1:-1] != row[:-2]) | (row[1:-1] != row[2:])
    clipped = np.zeros(len(pos), np.int64)
    clipped[row[clip[outer[clip]]]] = 1
    return [own, window, distance, crowded, clipped]
