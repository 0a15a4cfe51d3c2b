"""Corpus operators against brute force, library results and exact round trips, with odd rows of every kind."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from helixloom.llm import byte_bpe, chat, components, exact_dedup, line_dedup, merges, neighbours, packing, queries, secrets, simhash, token_counts, toxicity
from helixloom.llm.common import text_key

RND = random.Random(11)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, length int, kept string, key string"
WORDS = [f"w{k}" for k in range(400)]
INSULTS = ["zorgface", "blimhead", "krundle"]


def prose(n):
    return " ".join(RND.choice(WORDS) for _ in range(n))


LONG = prose(30_000) + "\n" + "x" * 5000
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One\ttwo"), (6, "one  two"), (7, LONG), (8, LONG + " "), (8, LONG + " "), (9, "naïve café — ½ ²³ 日本語 🙂 é \x1c\x85\xa0 don't <|endoftext|>"),
    (10, "a b c d e"), (11, "A b c d e"), (None, "no id"), (12, "same"), (12, "same"), (12, "other same id"), (13, "\x00\x0b\x0c nul"), (14, prose(50)), (15, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empties, very long texts, ties, repeated rows, and columns named as results are."""
    rows = [(i, t, None if k % 3 else "en", "s", len(t) if t else None, k, "clash", "clash") for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_token_counts(docs, empty):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks, find = byte_bpe.read_ranks(path), __import__("regex").compile(P.PATTERN).findall

    def greedy(w):
        n = 0
        while w:
            k = min(len(w), 128)
            while w[:k] not in ranks:
                k -= 1
            w, n = w[k:], n + 1
        return n

    want = [(i, len(find(t or "")), sum(greedy(w.encode()) for w in find(t or ""))) for i, t in ODD]
    assert rows_of(token_counts.token_counts(docs, path, P.PATTERN)) == sorted(want, key=repr)
    assert token_counts.token_counts(empty, path, P.PATTERN).count() == 0


def test_byte_bpe_equals_the_library(docs, empty):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    got = rows_of(byte_bpe.transcode(docs, path, P.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256")))
    want = []
    for i, t in ODD:
        ids = lib.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    back = byte_bpe.decode_ids(byte_bpe.transcode(docs, path, P.PATTERN, ("ids",)), path, P.PATTERN)
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted((t or "").encode() for _, t in ODD)
    assert byte_bpe.transcode(empty, path, P.PATTERN).count() == 0


def test_long_matches_go_through_the_heap():
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    bpe = byte_bpe.ByteBPE(path, P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    for t in ["ab" * 400, "".join(RND.choice("etaoin") for _ in range(900)), "=" * 1000, "é" * 500, "".join(RND.choice("abc") for _ in range(merges.WIDEST))]:
        assert np.frombuffer(bpe.encode([t])[0], "<u4").tolist() == lib.encode_ordinary(t)


def test_word_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    own = packing.WordBPE(path)
    many = [t or "" for _, t in ODD] + ["".join(chr(RND.randrange(1, 256)) for _ in range(200)) for _ in range(40)] + ["".join(chr(RND.randrange(1, 0x3000)) for _ in range(100)) for _ in range(10)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(many)] == [lib.encode(t, add_special_tokens=False).ids for t in many]


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(docs, empty, capacity):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    want = []
    for i, t in ODD:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, k, a, len(ids[a : a + capacity]), zlib.crc32(np.array(ids[a : a + capacity], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
    out = packing.pack_documents(docs, path, capacity)
    got = out.collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert packing.pack_documents(empty, path, capacity).count() == 0


SPECIAL = ["a <|endoftext|> b", "<|startoftext|>", "x<|endoftext|><|startoftext|>\u00e9 \u00bd", "\u65e5\u672c <|endoftext|> \u8a9e", "<|EndOfText|> <|endoftext", "don't<|startoftext|>don't"]


def test_special_strings_go_as_the_library_takes_them():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.WordBPE(path).encode(SPECIAL)]
    assert got == [lib.encode(t, add_special_tokens=False).ids for t in SPECIAL] and 49407 in got[0]


def test_the_library_takes_a_bounded_part_at_a_time(monkeypatch):
    """Many texts that only the library encodes, and a long one, go to it in parts; the ids are those of the whole texts."""
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    taken = []

    class Seen:
        def encode_batch(self, many, **kw):
            taken.append([len(x) for x in many])
            return lib.encode_batch(many, **kw)

    words = ["don't", "a\u0301", "\u0301b", "\u03a3\u03a3", "\u65e5\u672c\u3002", "<|endoftext|>", "x<|startoftext|>y", "12\u0663", "\u2014", "\U0001f600!", "It's", "\u1100\u1161", "\u0130"]
    spaces = [" ", "  ", "\n", "\r\n", "\t", "\u00a0", "\u3000", "\x0b", "\x1d", " \u2028"]
    many = ["".join(RND.choice(words) + RND.choice(spaces) for _ in range(n)) + "\u2014" for n in [*[30] * 60, 900]] + [*SPECIAL, "\u2014", " \u2014", "\u65e5" * 500]
    monkeypatch.setattr(packing, "LIBRARY_CHARS", 200, raising=False)
    own = packing.WordBPE(path)
    own.library = Seen()
    got = [np.frombuffer(x, "<u4").tolist() for x in own.encode(many)]
    assert got == [lib.encode(t, add_special_tokens=False).ids for t in many]
    assert all(sum(x) <= 200 or len(x) == 1 for x in taken) and max(map(max, taken)) == 500  # one holds no white space to be cut before
    assert sorted(max(x) for x in taken)[-2] <= 300  # a part ends at the first such white space from 200 on


def test_copies_of_a_piece_are_dealt_over_salts(spark, monkeypatch):
    """A length that one repeated row fills is ranked in many groups, and each copy gets a place of its own."""
    monkeypatch.setattr(packing, "PER_SALT", 50)
    rows = spark.range(0, 3000, 1, 4).select(F.lit(7).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(20).cast("long").alias("length"), F.lit(1).cast("long").alias("ids_crc32"))
    clash = {c: F.lit(c) for c in ("_salt", "_n", "_before", "_k", "_rank", "offset")}
    got = packing.pack(rows.withColumns(clash), 64).collect()
    assert all((r._salt, r._n, r._before, r._k, r._rank) == ("_salt", "_n", "_before", "_k", "_rank") for r in got)
    assert len({(r.sequence_id, r.offset) for r in got}) == 3000 and {r.offset for r in got} == {0, 20, 40} and len({r.sequence_id for r in got}) == 1000


def test_caches_are_bounded_by_bytes():
    from helixloom.llm.common import BoundedCache

    cache = BoundedCache(limit=100, most_bytes=1000)
    for k in range(50):
        words = cache.new_of([[f"{k}-{j}" * 40 for j in range(5)]])
        cache.learn(words, [b"x" * 8] * len(words))
        assert 0 < len(cache) <= 100 and cache.bytes <= 1000 + 5 * 220 and cache.new_of([[]]) == []


def test_plan_is_best_fit():
    for _ in range(20):
        n = {RND.randrange(1, 65): RND.randrange(1, 50) for _ in range(20)}
        slots = packing.plan(n, 64)
        free, used = [], 0
        for size in sorted((k for k, v in n.items() for _ in range(v)), reverse=True):  # plain best-fit decreasing, piece by piece
            fit = min((k for k in range(len(free)) if free[k] >= size), key=lambda k: free[k], default=None)
            if fit is None:
                free.append(64 - size)
            else:
                free[fit] -= size
        used = int((slots[:, 3] + slots[:, 2]).max())
        assert used == len(free)
        for size in n:
            rows = slots[slots[:, 0] == size]
            assert rows[0, 1] == 0 and (rows[1:, 1] == rows[:-1, 1] + rows[:-1, 2]).all() and rows[:, 2].sum() == n[size]


BASE = {
    "assign": re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+"),
}


def base_spans(text):
    out = []
    for k, kind in enumerate(("assign", "access", "hex")):
        for m in BASE[kind].finditer(text):
            if {"assign": lambda m=m: len(m[2]) >= 6, "access": lambda m=m: len(m[0]) >= 20, "hex": lambda m=m: len(m[0]) >= 24}[kind]():
                out.append((m.start(), k, m.end()))
    return sorted(out)


KEY, SECRET = "AKIA" + "ABCD1234" * 2, "aB3" + "xYz0" * 9 + "Q"
SECRET_DOCS = [
    "token: abc", "secret: token : abcdefgh", 'Password = "hunter22" api_key:\'abcdef\'', "🙂🙂 apikey=" + "f" * 30, "token=token=abcdef passwd:x PASSWD: ./+=-_9", KEY + "XYZ " + "0123456789abcdef" * 2 + "AKIASHORT",
    f"id {KEY} then {SECRET} at https://s3.example.com:443/x", f"{SECRET} alone https://example.com", f"{KEY}" + "." * 900 + SECRET, f"{KEY} https://example.com only", "é" * 700 + f"{SECRET} {KEY} {SECRET}",
]


def test_secrets(spark, docs, empty):
    rows = [(100 + k, t) for k, t in enumerate(SECRET_DOCS)] + [(i, t) for i, t in ODD]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, base string")
    got = {(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.report(df).collect()}
    want = set()
    for i, t in rows:
        s = base_spans(t or "")
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in s)
        want.add((i, *(sum(k == x for _, x, _ in s) for k in range(3)), hashlib.sha256(text.encode()).hexdigest()))
    assert got == want and secrets.report(df).count() == len(rows)
    spans = {r.doc_id: r.spans for r in secrets.report(df).filter("doc_id >= 100").collect()}
    added = {i - 100: [x.split(":")[0] for x in s.split(",") if x.startswith(("secret", "endpoint"))] for i, s in spans.items()}
    assert added[6] == ["secret", "endpoint"] and added[10] == ["secret", "secret"] and not added[7] and not added[8] and not added[9]
    assert secrets.report(empty).count() == 0


@pytest.mark.parametrize("form", ["={}", ' = {}', '="{}"', "='{}'", ": {}", "=={}"])
def test_assigned_secrets_are_linked(spark, form):
    """The environment form and its kin: the secret and an endpoint near it are found, and neither stays in the text."""
    text = f"AWS_ACCESS_KEY_ID={KEY}\nAWS_SECRET_ACCESS_KEY{form.format(SECRET)}\nAWS_ENDPOINT=https://s3.example.com"
    df = spark.createDataFrame([(1, text), (2, f"{KEY} {form.format(SECRET + chr(61))}"), (3, f"KEY{form.format(SECRET)}")], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in secrets.report(df).collect()}
    at, end = text.index(SECRET), text.index("https")
    assert f"secret:{at}:{at + 40}" in spans[1].split(",") and f"endpoint:{end}:{len(text)}" in spans[1].split(",")
    assert "secret" not in spans[2] + spans[3]  # padding follows; no access identifier
    clean = secrets.redact(df).filter("doc_id = 1").first().text
    assert SECRET not in clean and KEY not in clean and "s3.example.com" not in clean


WEAK = {"secret": re.compile(secrets.SECRET), "endpoint": re.compile(secrets.ENDPOINT)}


def brute_spans(text):
    """Base spans, and weak parts that lie within a scope of an access identifier which also holds a secret."""
    base = base_spans(text)
    weak = [(m.start(), secrets.KINDS.index(k), m.end()) for k, p in WEAK.items() for m in p.finditer(text) if k == "endpoint" or all(re.search(c, m[0]) for c in ("[a-z]", "[A-Z]", "[0-9]"))]
    linked = set()
    for a, kind, b in base:
        if secrets.KINDS[kind] == "access":
            near = [s for s in weak if s[0] >= a - secrets.SCOPE and s[2] <= b + secrets.SCOPE]
            if any(secrets.KINDS[k] == "secret" for _, k, _ in near):
                linked |= set(near)
    return sorted([*base, *linked])


def test_linked_spans_equal_brute_force(spark):
    pieces = [KEY, SECRET, SECRET[:39] + "=", "https://s3.example.com:443/x", "s3.eu.amazonaws.com", "a..amazonaws.com.", "x" * 150, "é" * 90, "\n", "token=abcdefgh", "0123456789abcdef" * 2, "UPPER" * 8, "AWS_SECRET=" + SECRET]
    rows = [(k, " ".join(RND.choice(pieces) for _ in range(RND.randrange(1, 60)))) for k in range(120)]
    got = {r.doc_id: r.spans for r in secrets.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for k, t in rows:
        assert got[k] == ",".join(f"{secrets.KINDS[x]}:{a}:{b}" for a, x, b in brute_spans(t))
    assert sum("secret" in s for s in got.values()) > 20 and sum("endpoint" in s for s in got.values()) > 20


@pytest.mark.parametrize("part", ["a.", ".", "https://", "0", "AKIA", "aB3/", " ", "token", "token=", "-", "a.amazonaws.com.", "\"", "é"])
def test_secrets_of_long_runs(spark, part):
    """A megabyte of each class behind an access identifier: neither stack nor time gives out."""
    text = f"{KEY} password" + part * (1_000_000 // len(part))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = secrets.report(df).first()
    assert row.spans == ",".join(f"{secrets.KINDS[x]}:{a}:{b}" for a, x, b in brute_spans(text))
    secrets.redact(df).first()


def test_secrets_many_matches(spark):
    text = ("ab12" * 6 + " token=abcdef ") * 50_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = secrets.report(df).first()
    assert (row.n_hex, row.n_assign) == (50_000, 50_000) and row.spans == ",".join(f"{secrets.KINDS[x]}:{a}:{b}" for a, x, b in base_spans(text))
    assert secrets.redact(df).first().text == "[SECRET] [SECRET] " * 50_000


def test_secrets_run_without_python(docs):
    import io
    from contextlib import redirect_stdout

    out = io.StringIO()
    with redirect_stdout(out):
        secrets.parts(docs).explain()
    assert not re.search("Python|Pandas|Arrow", out.getvalue())


def test_redaction_in_blocks(spark):
    """Spans at and over the ends of blocks."""
    n = secrets.BLOCK
    texts = ["é" * (n - k) + "a1" * 20 + " é " * n + "token=abcdefgh" for k in (0, 1, 20, 40, 41)] + [("b2" * 15 + " ") * 2000, "c3" * 3 * n, "x" * n, "x" * (2 * n + 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.redact(df).collect():
        assert r.text == re.sub("[0-9a-f]{24,}|token=[a-z]{6,}", "[SECRET]", texts[r.doc_id])


def test_redaction(spark, docs):
    df = spark.createDataFrame([(k, t, len(t), "z") for k, t in enumerate(SECRET_DOCS)], "doc_id long, text string, n_chars long, base string")
    for r in secrets.redact(df).collect():
        t = SECRET_DOCS[r.doc_id]
        spans = [tuple(s)[::2] for s in secrets.find_secrets(df).filter(F.col("doc_id") == r.doc_id).first().spans] if base_spans(t) else []
        want, at = "", 0
        for a, b in sorted(spans):
            if a >= at:
                want += t[at:a] + "[SECRET]"
            at = max(at, b)
        assert r.text == want + t[at:] and r.n_chars == len(r.text) and r.base == "z"
    assert rows_of(secrets.redact(docs)) == rows_of(docs)  # nothing to hide, so nothing changes


def test_chat(spark):
    rows = [
        (1, 0, "user", "hi <|im_end|> <\\|x|> a<|b \\n"), (1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (1, 2, "assistant", "é🙂\n"), (2, 1, "assistant", None), (2, 0, None, "x"), (None, 0, "user", "n"),
        (3, 0, "od\nd\\r<|o|>le", "t"), (3, 0, "od\nd\\r<|o|>le", "t"), (3, None, "assistant", ""), (4, 0, "assistant", "z" * 200_000), (4, 1, "user", "y" * 200_000),
    ]
    turns = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, part string").repartition(2)
    made = chat.format_chat(chat.with_probe(turns), 50_000)
    parts = made.collect()
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(made).collect()}
    assert any(p.part for p in parts)
    groups = collections.defaultdict(list)
    for c, t, role, text in rows + [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]:
        groups[c].append((t is not None, t or 0, role is not None, role or "", text is not None, text or ""))
    assert set(got) == set(groups)
    for c, g in groups.items():
        g.sort()
        said = [(r[3], r[5]) for r in g]
        loss = "".join(t for r, t in said if r == "assistant")
        n, turns_sha, chars, loss_sha, formatted = got[c]
        assert (n, chars) == (len(said), len(loss)) and turns_sha == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest() and loss_sha == hashlib.sha256(loss.encode()).hexdigest()
        whole = "".join(p.formatted for p in sorted((p for p in parts if p.conv_id == c), key=lambda p: p.part))
        assert len(whole) == formatted and whole.count(chat.START) == len(said) == whole.count(chat.END)
    assert chat.read_back(chat.format_chat(turns.limit(0))).count() == 0


def test_a_hot_conversation_is_many_tasks_work(spark):
    """Most rows are one conversation's; its turns are formatted in more than one task and read back in order."""
    rows = [(7, k % 900, "assistant" if k % 2 else "user", f"{k % 5} t{k}") for k in range(2000)] + [(None, None, "user", f"n{k}") for k in range(700)] + [(k, 0, "user", "x") for k in range(50)]
    made = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be one task's
    try:
        parts = made.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({p.part >> 32 for p in parts if p.conv_id == 7}) > 1
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    for c in (7, None, 3):
        own = sorted((t is not None, t or 0, role, text) for i, t, role, text in rows if i == c)
        assert got[c].n_turns == len(own) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in own).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256("".join(t for *_, r, t in own if r == "assistant").encode()).hexdigest()


def brute_neighbours(rows, k=20, every=20):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, float)
    ids = sorted(good)
    out = {}
    for q in ids:
        if q % every == 0:
            s = sorted((-float(good[q] @ good[c]), c) for c in ids if c != q)
            out[q] = s[:k]
    return out


def test_neighbours_exact_when_all_lists_are_probed(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(8).round(2).tolist()) for i in range(300)]
    rows += [(1000 + k, rows[3][1]) for k in range(40)] + [(1020, rows[3][1])]
    rows += [(400, None), (420, [0.0] * 8), (440, [1.0, None] + [0.0] * 6), (460, [float("nan")] + [1.0] * 7), (480, [float("inf")] + [1.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int, cls int")
    p = neighbours.Parameters(miss=0.0, epsilon=1e6, block=100, columns=3, rounds=(1, 3), step=16, queries=7)
    got = collections.defaultdict(list)
    for r in neighbours.search(df, p=p).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = brute_neighbours([(i, np.float32(v).astype(float).tolist() if v is not None and None not in v else v) for i, v in rows])
    assert set(got) == set(want)
    for q, s in want.items():
        assert [r for r, _, _ in got[q]] == list(range(1, 21))
        assert [c for _, c, _ in got[q]] == [c for _, c in s]
        assert np.allclose([x for _, _, x in got[q]], [-x for x, _ in s])
    assert neighbours.search(df.limit(0)).count() == 0
    assert neighbours.search(df.filter("vec_id in (0, 7)")).count() == 1


def recall(spark, path, p=None):
    df = spark.read.parquet(f"{path}/embeddings.parquet")
    got = collections.defaultdict(set)
    for r in neighbours.search(df, p=p).collect():
        got[r.query_id].add(r.vec_id)
    rows = df.filter("embedding IS NOT NULL").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    hits = []
    for k in np.flatnonzero(ids % 20 == 0).tolist():
        score = x @ x[k]
        score[k] = -np.inf
        hits.append(len(got[ids[k]] & set(ids[np.lexsort((ids, -score))[:20]].tolist())))
    assert all(len(got[q]) == 20 for q in ids[ids % 20 == 0].tolist())
    return np.mean(hits) / 20


def test_neighbours_recall(spark):
    assert recall(spark, "/root/testdata/sf0.1") >= 0.9


def test_neighbours_recall_beyond_the_sample(spark):
    """k-means sees a fraction of the rows; lists are of more than one block."""
    assert recall(spark, "/root/testdata/sf0.1", neighbours.Parameters(sample=300, block=50, rounds=(2, 6))) >= 0.9


def test_neighbours_leave_far_lists_alone(spark, tmp_path):
    """Of well parted clusters a query needs few lists: the scan reads few pairs."""
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((40, 16)) * 20
    rows = [(k, (centre[k % 40] + rng.standard_normal(16)).tolist()) for k in range(4000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert recall(spark, str(tmp_path), neighbours.Parameters(rounds=(2, 4))) >= 0.98


def test_expected_rows_of_lists():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((20_000, 64)) / 8
    near = neighbours.nearest(x, x[:20], 1)[:, 0]
    centre = np.stack([x[near == k].mean(0) for k in range(20)])
    off = ((x - centre[near]) ** 2).sum(1)
    stats = [np.array([f(off[near == k]) for k in range(20)]) for f in (len, np.mean, np.var)]
    q = rng.standard_normal((50, 64)) / 8
    square = ((q[:, None] - centre) ** 2).sum(2)
    beat = np.full(50, 1.6)
    want = np.array([[(((x[near == k] - y) ** 2).sum(1) <= 1.6).sum() for k in range(20)] for y in q])
    got = neighbours.Lists(centre, *stats).expected(square, beat)
    assert abs(got.sum() / want.sum() - 1) < 0.25 and np.corrcoef(got.ravel(), want.ravel())[0, 1] > 0.9


def test_toxicity(spark, empty):
    rows, labels = [], []
    for k in range(1200):
        words = prose(60).split()
        toxic = k % 4 == 0
        if toxic:
            for _ in range(3):
                words[RND.randrange(60)] = RND.choice(INSULTS)
        rows.append((k, " ".join(words), 9))
        labels.append((k, 1, int(toxic)))
    misspelt = prose(60).split()
    for j in range(4):
        misspelt[j * 9] = "zorgfacce"
    rows += [(5000, None, 9), (5001, "", 9), (5002, " ".join(misspelt), 9), (5003, LONG, 9), (None, "no id", 9), (1, rows[1][1], 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    lab = spark.createDataFrame(labels + [(7777, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(df, lab).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    held = [k for k in range(1200) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(by[k].held_out == (k in set(held)) for k in range(1200))
    right = np.mean([by[k].predicted == (k % 4 == 0) for k in held])
    assert right >= 0.97 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert by[5002].score > by[5003].score
    changed = lab.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.toxicity(df, changed).collect()}
    assert all(again[k] == by[k].score for k in range(1200))  # held-out labels teach nothing
    assert toxicity.toxicity(empty, lab.limit(0)).count() == 0
    # nothing can be learned without rows of both classes, so nothing is rejected
    for nothing in (lab.limit(0), lab.filter("toxic = 1"), lab.filter("toxic = 0")):
        assert toxicity.keep_clean(df, nothing).count() == len(rows)
    kept = {r.doc_id for r in toxicity.keep_clean(df, lab).collect()}
    assert kept == {r.doc_id for r in got if r.score < 0.3}


def test_folded_scores_equal_unfolded_ones():
    """The scorer against bag, mean and softmax of the trained table, place by place."""
    p = toxicity.Parameters(bits=10, steps=60, epochs=1)
    rows = [(" ".join([prose(20), *RND.sample(INSULTS, 2 * (k % 3 == 0))]), int(k % 3 == 0)) for k in range(90)]
    label = np.array([y for _, y in rows])
    table, soft, bias, learnt = toxicity.learn(rows, label, p)
    scorer = toxicity.fold(table, soft, bias, learnt, p).scorer()
    texts = [prose(30), "zorgfacce blimhead " + prose(5), "", "Word, word WORD unseen!", INSULTS[0], "\u00e9\u00e8 \u65e5\u672c"]
    known = np.where(learnt[:, None], table, 0.0)

    def plain(text):
        words = collections.Counter(text.lower().split())
        bag, weight = np.zeros(p.dims), 0.0
        for w, n in words.items():
            at, _ = toxicity.places([w], p)
            bag += (1 + np.log(n)) * known[at].mean(0)
            weight += 1 + np.log(n)
        z = bag / (weight + p.padding) @ soft + bias
        e = np.exp(z - z.max())
        return e[1] / e.sum()

    assert np.allclose(scorer(texts), [plain(t) for t in texts], atol=1e-5)
    again = toxicity.places(["zorgface"], p)[0]  # a word's places are its own hash and those of its n-grams
    assert len(again) == 1 + sum(max(0, len("<zorgface>") - n + 1) for n in p.grams)


def test_fitting_is_bounded_and_reads_long_texts(spark):
    rows = [(k, (INSULTS[0] + " ") * 9 + prose(30) if k % 2 else prose(30)) for k in range(200)]
    rows += [(k, "long " * 9000 + prose(10)) for k in range(200, 210)] + [(1, "again " + prose(4))] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(k, k % 2) for k in range(210)], "doc_id long, toxic int")
    seen = []
    own = toxicity.train
    try:
        toxicity.train = lambda r, p, prior: seen.append(r) or own(r, p, prior)
        toxicity.fit(df, lab)
        toxicity.fit(df, lab, toxicity.Parameters(per_class=7))
        toxicity.fit(df, lab, toxicity.Parameters(class_bytes=2000))
    finally:
        toxicity.train = own
    assert any(len(t) > 40_000 for t, _ in seen[0]) and {y for _, y in seen[0]} == {0, 1}
    assert collections.Counter(y for _, y in seen[1]) == {0: 7, 1: 7}
    for y in (0, 1):
        some = [t for t, label in seen[2] if label == y]
        assert some and sum(map(len, some[:-1])) < 2000


def squeeze(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


@pytest.mark.parametrize("bits", [128, 3])
def test_exact_dedup(spark, docs, empty, bits):
    base = [prose(40) for _ in range(12)]
    rows = list(ODD) + [(200 + k, base[k % 12] if k % 2 else base[k % 12].replace(" ", " \n")) for k in range(60)] + [(300, LONG), (299, LONG.replace(" ", "\t", 5)), (301, LONG[:-1] + "y")]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, keep_id string").repartition(4)
    got = exact_dedup.exact_dedup(df, bits).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[squeeze(t)].append(i)
    want = collections.Counter()
    for t, ids in groups.items():
        first = None if None in ids else min(ids)
        want.update((i, first, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_dedup(empty).count() == 0
    if bits == 128:
        left = exact_dedup.keep_first(docs).collect()
        assert sorted(squeeze(r.text) for r in left) == sorted({squeeze(t) for _, t in ODD}) and left[0].kept == "clash"


def test_chunks_depend_on_their_text_alone():
    a, b = LONG.encode(), prose(2000).encode()
    raw = np.frombuffer(b + a, np.uint8)
    alone = exact_dedup.chunk_rows(np.frombuffer(a, np.uint8), np.array([0, len(a)]))[0]
    behind = exact_dedup.chunk_rows(raw, np.array([0, len(b), len(b) + len(a)]))[1]
    assert [(x + len(b), y + len(b)) for x, y in alone] == behind and len(alone) > 20


def brute_lines(rows, size=3):
    docs = sorted({(i is not None, i or 0, t or "") for i, t in rows})
    docs.sort(key=lambda d: (d[0], d[1], KEYS[d[2]]))
    first, out = {}, {}
    for d in docs:
        lines = d[2].split("\n")
        gone = set()
        for p in range(len(lines) - size + 1):
            w = tuple(lines[p : p + size])
            if not any(x.strip() for x in w):
                continue
            if w not in first:
                first[w] = (d, p)
            else:
                lo = max(p, first[w][1] + size) if first[w][0] == d else p
                gone |= set(range(lo, p + size))
        out[d] = "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone)
    return out


KEYS: dict[str, int] = {}


def test_line_dedup(spark, docs, empty):
    block = ["alpha beta", "gamma", "delta", "epsilon"]
    rows = list(ODD) + [(50, "\n".join(block)), (51, "\n".join(["x", *block, "y"])), (52, "\n".join(["q"] * 7)), (53, "\n\n\n\n\n"), (54, "\n".join(block[:3] + ["z"] + block[1:])), (55, "\n".join(block)), (55, "\n".join(block)), (40, "a\nb\nc\na\nb\nc\na\nb\nc")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, pos int").repartition(3)
    KEYS.update((r.text or "", r.k) for r in df.select("text", text_key().alias("k")).collect())
    want = brute_lines(rows)
    got = line_dedup.line_dedup(df).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter((i, *want[i is not None, i or 0, t or ""]) for i, t in rows)
    assert line_dedup.line_dedup(empty).count() == 0


def test_passages_of_one_and_two_lines(spark, tmp_path):
    """The query removes later copies of single lines and two-line runs of more than 50 words, between differing neighbours and in short texts, and nothing less."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(n)) for x, n in (("a", 51), ("b", 30), ("c", 30), ("d", 50)))
    texts = {
        1: f"p\n{a}\nq", 2: a, 3: f"r\n{a}\ns\n{a}", 4: f"t\n{b}\n{c}\nu", 5: f"{b}\n{c}", 6: f"{c}\n{b}", 7: d, 8: f"v\n{d}", 9: f"x\ny\nz\n{a}\nw", 10: "x\ny\nz",
        11: f"é\n{b}\n{c}\n{b}\n{c}", 12: f"{a} \n{a}\n{b}\n{c}", 13: None, 14: "",
    }
    want = {1: 0, 2: 1, 3: 2, 4: 0, 5: 2, 6: 0, 7: 0, 8: 0, 9: 1, 10: 3, 11: 4, 12: 3, 13: 0, 14: 0}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op9_line_dedup(spark, str(tmp_path)).collect()}
    assert {i: r.n_removed for i, r in got.items()} == want
    assert got[3].text == "r\ns" and got[9].text == "x\ny\nz\nw" and got[11].text == "é" and got[12].text == f"{a} " and got[2].text == ""


def test_windows_alone_equal_the_sql(spark):
    from tests.compare import differences, duck

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert differences(line_dedup.line_dedup(docs).toPandas(), duck(sf).execute(queries.WINDOWS_SQL).df()) == ""


def brute_fingerprint(text, k=3):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=2):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    many = sorted(fps)
    for n, a in enumerate(many):
        for b in many[n + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_simhash(spark, docs, empty):
    near = prose(4000)
    rows = list(ODD) + [(60 + k, near.replace(WORDS[k], "zz", 1)) for k in range(40)]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, fp string").repartition(3)
    got = simhash.near_dedup(df).collect()
    fps = {t or "": brute_fingerprint(t or "") for _, t in rows}
    comp = brute_components(set(fps.values()))
    least = {}
    for i, t in rows:
        c = comp[fps[t or ""]]
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    want = collections.Counter((i, f"{fps[t or '']:016x}", least[comp[fps[t or ""]]]) for i, t in rows)
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert len({r.component_id for r in got if r.doc_id and r.doc_id >= 60}) < 40
    assert simhash.near_dedup(empty).count() == 0
    left = simhash.keep_first(df).collect()
    assert len(left) == len(set(comp.values())) and all(least[comp[fps[r.text or ""]]] == r.doc_id for r in left)


@pytest.mark.parametrize(("bucket", "radius"), [(512, 2), (2, 2), (2, 1), (512, 3), (2, 3)])
def test_links_lose_none(spark, bucket, radius):
    """Also where every bucket counts as large."""
    seeds = [RND.getrandbits(64) for _ in range(30)]
    fps = set(seeds)
    for s in seeds:
        x = s
        for _ in range(12):  # chains and bushes of one to three flips
            y = x
            for _ in range(RND.randrange(1, 4)):
                y ^= 1 << RND.randrange(64)
            fps.add(y)
            x = RND.choice([x, y])
    nodes = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long").repartition(3)
    roots = {r.node: r.root for r in components.components(simhash.links(nodes, radius, bucket)).collect()}
    want = brute_components(fps, radius)
    sets = collections.defaultdict(set)
    for f in fps:
        sets[roots.get(simhash._signed(f), simhash._signed(f))].add(f)
    brute = collections.defaultdict(set)
    for f, r in want.items():
        brute[r].add(f)
    assert sorted(map(sorted, sets.values())) == sorted(map(sorted, brute.values()))


def test_masks_cover():
    from itertools import combinations

    for r in (1, 2, 3):
        ms = simhash.masks(r, 24)
        assert len(ms) == 2 ** (r + 1) - 1
        assert all(any(not any(m >> b & 1 for b in bits) for m in ms) for bits in combinations(range(24), r))


def test_components(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 50)] + [(7, 7), (5000, 4000), (None, 3), (1001, None), (5000, 4000)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(201)) and all(got[1000 + k] == 1000 for k in range(50)) and got[5000] == 4000
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    from tests.compare import differences, duck

    sf = "/root/testdata/sf0.001"
    assert differences(queries.QUERIES[name](spark, sf).toPandas(), duck(sf).execute(queries.ORACLES[name]).df()) == ""
