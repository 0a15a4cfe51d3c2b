"""decode.events_of(), noisy_of() and keeps() over a batch of reads at once: operations are flat arrays, and no read costs a call.

What isn't plain in a text (unknown letters, operations of no length, skips in a cs tag, a MD text that doesn't fit) is left to events_of().
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from helixloom.config import Options

LETTERS = b"=XIDSHMNP"
SAME, DIFF, INS, DEL, SOFT, HARD, MATCH, SKIP, PAD = range(9)
NONE = 255
CODE = np.full(256, NONE, np.uint8)
CODE[list(LETTERS)] = range(9)
#: Whether an operation moves on the reference, and in the read.
ON_REF, ON_READ = np.array([1, 1, 0, 1, 0, 0, 1, 1, 0], bool), np.array([1, 1, 1, 0, 1, 0, 1, 0, 0], bool)
#: What a mark of a cs text stands for.
MARK = np.full(256, NONE, np.uint8)
MARK[list(b":=*+-~")] = [SAME, SAME, DIFF, INS, DEL, SKIP]
#: Bytes of texts that are worked on at once; a longer read is worked on alone.
PART = 4_000_000

EVENTS = pa.list_(pa.struct([("pos", pa.int64()), ("op", pa.string()), ("len", pa.int32()), ("qi", pa.int32()), ("alt", pa.string()), ("low_qual", pa.bool_())]))
NOISY = pa.list_(pa.struct([("st", pa.int64()), ("en", pa.int64()), ("label", pa.int32())]))


class Text(NamedTuple):
    """Texts of all rows behind each other, and where each begins."""

    data: np.ndarray
    at: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


class Ops(NamedTuple):
    row: np.ndarray
    op: np.ndarray
    n: np.ndarray

    def of(self, which: np.ndarray) -> Ops:
        return Ops(*(x[which] for x in self))


def joined(*parts: Ops) -> Ops:
    return Ops(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def text_of(a: pa.Array) -> Text:
    """Bytes of a text or binary column; null is empty."""
    binary = pa.types.is_binary(a.type) or pa.types.is_large_binary(a.type)
    a = pc.fill_null(a.cast(pa.large_binary() if binary else pa.large_string()), b"" if binary else "")
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1]
    return Text(np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0])


def numbers(data: np.ndarray, end: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Values of the digits before each end."""
    out = np.zeros(len(end), np.int64)
    for k in range(int(width.max(initial=0))):
        more = width > k
        out[more] += (data[end[more] - 1 - k].astype(np.int64) - 48) * 10**k
    return out


def before(x: np.ndarray) -> np.ndarray:
    """Running sums, with what lies before each place."""
    return np.concatenate([[0], np.cumsum(x, dtype=np.int64)])


def spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each, n of them."""
    return np.repeat(begin - before(n)[:-1], n) + np.arange(int(n.sum()))


def by_cigar(t: Text, odd: np.ndarray) -> Ops:
    row, digit = t.rows(), (t.data >= 48) & (t.data <= 57)
    p = np.flatnonzero(~digit)
    r = row[p]
    width = p - np.maximum(np.concatenate([[-1], p[:-1]])[: len(p)] + 1, t.at[r])
    n = numbers(t.data, p, np.minimum(width, 9))
    odd[r[(CODE[t.data[p]] == NONE) | (width > 9) | (n == 0)]] = True
    some = np.flatnonzero(np.diff(t.at))
    odd[some[digit[t.at[some + 1] - 1]]] = True
    return Ops(r, CODE[t.data[p]], n)


def by_cs(ops: Ops, t: Text, odd: np.ndarray) -> Ops:
    """Operations of the cs texts between the clips of their rows' operations."""
    p = np.flatnonzero(MARK[t.data] != NONE)
    r = t.rows()[p]
    end = np.minimum(np.concatenate([p[1:], [len(t.data)]])[: len(p)], t.at[r + 1])
    width, op = end - p - 1, MARK[t.data[p]]
    of = lambda kind: (lambda c: c[end] - c[p + 1])(before(kind))
    lower = (t.data >= 97) & (t.data <= 122)
    letters, digits = of(lower | ((t.data >= 65) & (t.data <= 90))), of((t.data >= 48) & (t.data <= 57))
    count = t.data[p] == ord(":")
    fits = np.where(count, (digits == width) & (width < 10), np.where(op == DIFF, (of(lower) == width) & (width == 2), letters == width))
    n = np.where(op == DIFF, 1, width)
    n[count] = numbers(t.data, end[count], np.where(fits, width, 0)[count])
    odd[r[~fits | (n == 0) | (op == SKIP)]] = True
    some = np.flatnonzero(np.diff(t.at))
    odd[some[MARK[t.data[t.at[some]]] == NONE]] = True
    size = np.bincount(ops.row, minlength=len(odd))[ops.row]
    k = np.arange(len(ops.row)) - np.searchsorted(ops.row, ops.row)
    clip = (ops.op == SOFT) | (ops.op == HARD)
    odd[ops.row[clip & (size < 4)]] = True  # the first two operations and the last two are partly the same
    out = joined(ops.of(clip & (k < 2)), Ops(r, op, n), ops.of(clip & (k >= 2) & (k >= size - 2)))
    return out.of(np.argsort(out.row, kind="stable"))


def md_marks(t: Text, odd: np.ndarray) -> Ops:
    """Matches, mismatches and deletions of MD texts."""
    row, d = t.rows(), t.data
    kind = np.where((d >= 48) & (d <= 57), 0, np.where((d >= 65) & (d <= 90), 1, np.where(d == ord("^"), 2, 3)))
    odd[row[kind == 3]] = True
    new = np.ones(len(d), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (row[1:] != row[:-1]) | (kind[1:] == 2)
    st = np.flatnonzero(new)
    n, r, kind = np.diff(np.concatenate([st, [len(d)]])), row[st], kind[st]
    gap = np.zeros(len(st), bool)  # letters behind a ^
    gap[1:] = (kind[:-1] == 2) & (kind[1:] == 1) & (r[1:] == r[:-1])
    lone = (kind == 2) & ~np.concatenate([gap[1:], [False]])[: len(st)]
    number = kind == 0
    odd[r[lone | (number & (n > 9))]] = True
    n[number] = numbers(d, st[number] + n[number], np.minimum(n[number], 9))
    each = np.where((kind == 1) & ~gap, n, 1)
    out = Ops(np.repeat(r, each), np.repeat(np.where(number, SAME, np.where(gap, DEL, DIFF)).astype(np.uint8), each), np.repeat(np.where((kind == 1) & ~gap, 1, n), each))
    return out.of(np.repeat(kind != 2, each) & (out.n > 0))


def by_md(ops: Ops, t: Text, odd: np.ndarray) -> Ops:
    """M operations split by the MD texts' marks: both part the same bases of the reference, and every begin of either parts them."""
    marks = md_marks(t, odd)
    moves = (ops.op == MATCH) | (ops.op == DEL)
    m = ops.of(moves)
    size = np.zeros(len(odd), np.int64)
    np.add.at(size, m.row, m.n)
    base, told = before(size), np.zeros(len(odd), np.int64)
    np.add.at(told, marks.row, marks.n)
    odd[told < size] = True
    st = before(marks.n)[:-1] - before(told)[:-1][marks.row]
    inside = (st < size[marks.row]) & ~odd[marks.row]
    marks, st = marks.of(inside), st[inside]
    m_kept = ~odd[m.row]
    m, which = m.of(m_kept), np.flatnonzero(moves)[m_kept]
    size = np.where(odd, 0, size)
    base = before(size)
    at, end = base[marks.row] + st, base[marks.row + 1]
    m_at = before(m.n)[:-1]
    cuts = np.union1d(at, m_at)
    k, j = np.searchsorted(m_at, cuts, side="right") - 1, np.searchsorted(at, cuts, side="right") - 1
    n = np.diff(np.concatenate([cuts, [size.sum()]]))
    gone = m.op[k] == DEL
    wrong = gone != (marks.op[j] == DEL)
    wrong |= gone & ((m_at[k] != at[j]) | (m.n[k] != marks.n[j]) | (at[j] + marks.n[j] > end[j]))
    odd[m.row[k[wrong]]] = True
    out = joined(Ops(m.row[k], marks.op[j], n), ops.of(~moves))
    return out.of(np.argsort(np.concatenate([which[k], np.flatnonzero(~moves)]), kind="stable"))


def by_reference(ops: Ops, pos: np.ndarray, seq: Text, ref: Text, ref_beg: np.ndarray, odd: np.ndarray) -> Ops:
    """M operations compared with the reference, base by base."""
    at, qi = places(ops, pos - ref_beg)
    m = ops.op == MATCH
    odd[ops.row[m & (qi + ops.n > np.diff(seq.at)[ops.row])]] = True
    use = np.flatnonzero(m & ~odd[ops.row])
    r, n = ops.row[use], ops.n[use]
    k, size = spread(at[use], n), np.repeat(np.diff(ref.at)[r], n)
    known = (k >= 0) & (k < size)
    diff = np.zeros(len(k), bool)
    diff[known] = ref.data[(k + np.repeat(ref.at[r], n))[known]] != seq.data[spread(qi[use] + seq.at[r], n)[known]]
    new = np.zeros(len(k), bool)
    new[before(n)[:-1]] = True
    new |= diff
    new[1:] |= diff[:-1]
    st = np.flatnonzero(new)
    which = np.repeat(use, n)[st]
    out = joined(Ops(ops.row[which], np.where(diff[st], DIFF, SAME).astype(np.uint8), np.diff(np.concatenate([st, [len(k)]]))), ops.of(~m))
    return out.of(np.argsort(np.concatenate([which, np.flatnonzero(~m)]), kind="stable"))


def places(ops: Ops, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each operation begins on the reference and in the read."""
    first = np.searchsorted(ops.row, ops.row)
    ref, read = before(ops.n * ON_REF[ops.op]), before(ops.n * ON_READ[ops.op])
    return begin[ops.row] + ref[:-1] - ref[first], read[:-1] - read[first]


class Events(NamedTuple):
    row: np.ndarray
    pos: np.ndarray
    op: np.ndarray
    n: np.ndarray
    qi: np.ndarray
    low: np.ndarray
    alt: pa.Array


def events(ops: Ops, pos: np.ndarray, seq: Text, qual: Text, o: Options, odd: np.ndarray) -> Events:
    """Events of operations, mismatches one by one; equal neighbours of one quality are one. Rows that don't fit their reads become odd."""
    ops = Ops(ops.row, np.where(ops.op == MATCH, SAME, ops.op), ops.n)
    each = np.where(ops.op == DIFF, ops.n, 1)
    ops = Ops(np.repeat(ops.row, each), np.repeat(ops.op, each), np.repeat(np.where(ops.op == DIFF, 1, ops.n), each))
    at, qi = places(ops, pos)
    read, size = np.zeros(len(odd), np.int64), np.diff(seq.at)
    np.add.at(read, ops.row, ops.n * ON_READ[ops.op])
    odd |= (size > 0) & (read != size)
    use = ~odd[ops.row] & (ops.op != SKIP) & (ops.op != PAD)
    ops, at, qi = ops.of(use), at[use], qi[use]
    n_qual, poor = np.diff(qual.at), before(qual.data < o.min_base_quality)

    def poor_in(which: np.ndarray, st: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Bases of low quality among n from st on; those beyond the qualities aren't low."""
        r = ops.row[which]
        end = np.minimum(st + n, n_qual[r])
        return poor[qual.at[r] + end] - poor[qual.at[r] + np.minimum(st, end)]

    low = np.zeros(len(at), bool)
    x, i, d = (np.flatnonzero(ops.op == k) for k in (DIFF, INS, DEL))
    low[x] = poor_in(x, qi[x], 1) > 0
    low[i] = poor_in(i, qi[i], ops.n[i]) == ops.n[i]
    left = np.where(qi[d] > 0, qi[d] - 1, np.maximum(n_qual[ops.row[d]] - 1, 0))  # as qual[-1] has it
    low[d] = (poor_in(d, left, 1) > 0) | (poor_in(d, qi[d], 1) > 0)
    new = np.ones(len(at), bool)
    new[1:] = (ops.row[1:] != ops.row[:-1]) | (ops.op[1:] != ops.op[:-1]) | (low[1:] != low[:-1]) | ~np.isin(ops.op[1:], (SAME, INS, DEL))
    st = np.flatnonzero(new)
    n = np.add.reduceat(ops.n, st) if len(st) else ops.n
    row, op, qi = ops.row[st], ops.op[st], qi[st]
    shown = np.where(((op == DIFF) | (op == INS)) & (size[row] > 0), n, 0)
    letters = seq.data[spread(seq.at[row] + qi, shown)]
    alt = pa.LargeStringArray.from_buffers(len(st), pa.py_buffer(before(shown)), pa.py_buffer(letters))
    return Events(row, at[st], op, n, qi, low[st], alt.cast(pa.string()))


def noisy(e: Events, rows: int, pos: np.ndarray, end: np.ndarray, length: np.ndarray, clip_ends: tuple[np.ndarray, np.ndarray], o: Options) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(row, st, en, label) of noisy intervals, n_events and kept. Events end in order, so a window's first event is a search."""
    k = np.flatnonzero(((e.op == DIFF) | (e.op == INS) | (e.op == DEL)) & ~e.low)
    row, at, gap = e.row[k], e.pos[k], e.op[k] != DIFF
    size, count = np.where(e.op[k] == INS, 0, e.n[k]), np.where(gap, e.n[k], 1)
    far = row << 40
    own = at - pos[row] + o.dense_window + 2
    front = np.minimum(np.searchsorted(far + own + size - 1, far + own - o.dense_window, side="right"), np.arange(len(k)))
    total = before(count)
    hit = np.flatnonzero(total[1:] - total[front] > o.dense_count)
    r, st, en = row[hit], at[front[hit]], at[hit] + size[hit]
    new = np.ones(len(hit), bool)
    new[1:] = (r[1:] != r[:-1]) | (st[1:] > en[:-1])
    a = np.flatnonzero(new)
    b = np.concatenate([a[1:], [len(hit)]])[: len(a)] - 1
    label = np.maximum(total[hit[b] + 1] - total[front[hit[a]]], en[b] - st[a] + 1)
    spans = [[r[a], st[a] - 1, en[b], label]]
    n = np.bincount(row, minlength=rows)
    some = np.unique(e.row)
    for side, wanted in (("left", clip_ends[0]), ("right", clip_ends[1])):
        j = np.searchsorted(e.row, some, side=side) - (side == "right")
        r = some[wanted[some] & ((e.op[j] == SOFT) | (e.op[j] == HARD)) & (e.n[j] > o.end_clip)]
        n[r] += 1
        r = r[pos[r] > 10] if side == "left" else r[end[r] < length[r] - 10]
        flank = (pos[r] - 1, np.minimum(end[r], pos[r] - 1 + o.end_clip_flank)) if side == "left" else (np.maximum(pos[r] - 1, end[r] - o.end_clip_flank), end[r])
        spans.append([r, *flank, np.zeros(len(r), np.int64)])
    out = [np.concatenate(x) for x in zip(*spans, strict=True)]
    order = np.argsort(out[0], kind="stable")
    out = [x[order] for x in out]
    covered, bases = np.zeros(rows, np.int64), end - pos + 1
    np.add.at(covered, out[0], out[2] - out[1] + 1)
    has = np.zeros(rows, bool)
    has[some] = True
    return out, n, has & (covered <= o.max_noisy_fraction * bases) & (n <= o.max_event_ratio * bases)


def tag(tags: pa.MapArray, name: str) -> pa.Array:
    """Values of a tag, null where there is none."""
    at = np.frombuffer(tags.buffers()[1], np.int32)[tags.offset : tags.offset + len(tags) + 1]
    hit = np.flatnonzero(pc.equal(tags.keys, name).to_numpy(zero_copy_only=False).astype(bool))
    hit = hit[(hit >= at[0]) & (hit < at[-1])]
    row = np.searchsorted(at, hit, side="right") - 1
    where = np.full(len(tags), -1, np.int64)
    where[row] = hit
    return tags.items.take(pa.array(where, mask=where < 0))


def lists(rows: int, row: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), values)


def parts(b: pa.RecordBatch, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of rows with at most PART bytes of these texts, or one row."""
    size = sum(pc.fill_null(pc.binary_length(b.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    total, st = before(size), 0
    while st < b.num_rows:
        en = max(st + 1, int(np.searchsorted(total, total[st] + PART, side="right")) - 1)
        yield b.slice(st, en - st)
        st = en


def decoded(b: pa.RecordBatch, o: Options) -> list[pa.Array]:
    """Columns events, noisy, n_events and kept of a batch of reads."""
    from helixloom.operators.decode import BadAlignment, events_of, palindrome

    rows, cs, md = b.num_rows, tag(b.column("tags"), "cs"), tag(b.column("tags"), "MD")
    pos, end, length, ref_beg = (pc.fill_null(b.column(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pos", "end", "contig_length", "ref_beg"))
    seq_column = pc.if_else(pc.equal(b.column("seq"), "*"), "", b.column("seq"))
    cigar, seq, ref, cs_text, md_text, qual = (text_of(a) for a in (b.column("cigar"), seq_column, b.column("ref_seq"), cs, md, b.column("qual")))
    odd = np.zeros(rows, bool)
    for t in (cigar, seq, ref, cs_text, md_text):
        odd[t.rows()[t.data > 127]] = True
    ops = by_cigar(cigar, odd)
    ops = ops.of(~odd[ops.row])
    told = np.zeros(rows, bool)
    told[ops.row[(ops.op == SAME) | (ops.op == DIFF)]] = True
    flat = [ops.of(told[ops.row])]
    for a, by in ((cs, lambda x, w: by_cs(x, Text(*only(cs_text, w)), odd)), (md, lambda x, w: by_md(x, Text(*only(md_text, w)), odd)), (b.column("ref_seq"), lambda x, w: by_reference(x, pos, seq, ref, ref_beg, odd))):
        which = ~told & a.is_valid().to_numpy(zero_copy_only=False) & ~odd
        if which.any():
            flat.append(by(ops.of(which[ops.row]), which))
        told |= which
    flat.append(ops.of(~told[ops.row]))
    ops = joined(*flat)
    ops = ops.of(np.argsort(ops.row, kind="stable"))
    ops = ops.of(~odd[ops.row])
    e = events(ops, pos, seq, qual, o, odd)
    rest = np.flatnonzero(odd).tolist()
    if rest:
        found = []
        for r in b.take(pa.array(rest)).select(["pos", "cigar", "seq", "qual", "tags", "ref_seq", "ref_beg"]).to_pylist():
            try:
                found.append(events_of(r["pos"], r["cigar"], "" if r["seq"] == "*" else r["seq"] or "", r["qual"] or b"", dict(r["tags"] or []), r["ref_seq"], r["ref_beg"], o))
            except BadAlignment:
                found.append([])
        more = [(k, x.pos, LETTERS.index(x.op.encode()), x.len, x.qi, x.low_qual, x.alt) for k, xs in zip(rest, found, strict=True) for x in xs]
        cols = list(zip(*more, strict=True)) if more else [[]] * 7
        kinds = (np.int64, np.int64, np.uint8, np.int64, np.int64, bool)
        both = [np.concatenate([x, np.array(y, t)]) for x, y, t in zip(e[:6], cols[:6], kinds, strict=True)]
        order = np.argsort(both[0], kind="stable")
        e = Events(*(x[order] for x in both), pa.concat_arrays([e.alt, pa.array(cols[6], pa.string())]).take(pa.array(order)))
    first, last = np.ones(rows, bool), np.ones(rows, bool)
    if o.is_ont:
        sa = tag(b.column("tags"), "SA")
        for k in np.flatnonzero(sa.is_valid().to_numpy(zero_copy_only=False)).tolist():
            if palindrome(int(pos[k]), int(end[k]), sa[k].as_py(), b.column("contig")[k].as_py()):
                (last if b.column("flag")[k].as_py() & 16 == 0 else first)[k] = False  # the clip at the read's 3' end is left aside
    spans, n, kept = noisy(e, rows, pos, end, length, (first, last), o)
    op = pa.array([chr(c) for c in LETTERS]).take(pa.array(e.op))
    of = lambda values, kind: pa.StructArray.from_arrays(values, fields=list(kind.value_type))
    i32 = lambda x: pa.array(x.astype(np.int32))
    return [
        lists(rows, e.row, of([pa.array(e.pos), op, i32(e.n), i32(e.qi), e.alt, pa.array(e.low)], EVENTS)),
        lists(rows, spans[0], of([pa.array(spans[1]), pa.array(spans[2]), i32(spans[3])], NOISY)), i32(n), pa.array(kept),
    ]


def only(t: Text, which: np.ndarray) -> Text:
    """Texts of some rows; all others are empty."""
    n = np.diff(t.at)
    return Text(t.data[np.repeat(which, n)], before(np.where(which, n, 0)))
