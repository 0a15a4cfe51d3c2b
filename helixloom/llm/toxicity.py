"""Toxicity by subword-bag embeddings (operator 7).

A word is the mean of its own vector and those of its character n-grams (hashed into a table); a text is the mean of its words, where a
word's weight grows with the logarithm of its count and every bag is padded with empty words; a linear softmax decides. Table and softmax are trained jointly, in numpy, by Adagrad on a bounded sample of labelled rows; so words never seen, such
as misspellings, share the vectors of their n-grams. For scoring, table and softmax fold into one number for each place of the table.

Defined cases: null text counts as empty; a text without words gets the prior alone; without labelled rows of both classes all scores are the
prior (0.5 without any label), and keep_clean() keeps every row; rows with a null label aren't learned from, and of several labels of a doc_id the largest counts; repeated rows get equal scores; other columns are passed by;
an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixloom.llm.common import BoundedCache, fresh, text_slices, texts


@dataclass(frozen=True)
class Parameters:
    #: Rows of each class that the model is fitted on at most, and their bytes together: texts are whole, of any length, but once
    #: those taken (by their id's hash) hold so many bytes, no more are.
    per_class: int = 3000
    class_bytes: int = 24 << 20
    #: Places of the table as a power of two, dimensions, n-gram lengths.
    bits: int = 17
    dims: int = 4
    grams: tuple[int, ...] = (3, 4, 5)
    #: Passes over the sample, more where it is so small that they make fewer than `steps` batches.
    epochs: int = 5
    steps: int = 400
    batch: int = 64
    rate: float = 1.5
    #: Spread of the table's first values.
    spread: float = 0.01
    #: Empty words that every bag has besides, so that a few words alone don't decide.
    padding: float = 40.0
    seed: int = 5
    threshold: float = 0.3


PRIME, MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
EDGE = ".,;:!?()[]{}\"'|…«»“”‘’*_-"


def word_list(text: str) -> list[str]:
    return text.lower().split()


def places(words: list[str], p: Parameters) -> tuple[np.ndarray, np.ndarray]:
    """Table places of the words and their n-grams, word by word; and how many each word has. Hashes are polynomials over code points, of all words at once."""
    bare = [f"<{w.strip(EDGE)}>" for w in words]
    size = np.fromiter(map(len, bare), np.int64, len(bare))
    code = np.frombuffer("".join(bare).encode("utf-32-le"), np.uint32).astype(np.uint64)
    word, start = np.repeat(np.arange(len(bare)), size), np.cumsum(size) - size
    power = np.cumprod(np.full(int(size.max(initial=0)) + 1, PRIME))
    whole = np.add.reduceat(code * power[np.arange(len(code)) - np.repeat(start, size)], start) if len(code) else np.zeros(0, np.uint64)
    hashes, of = [whole], [np.arange(len(bare))]
    for n in p.grams:
        if (m := len(code) - n + 1) > 0:
            h = np.full(m, n, np.uint64)
            for k in range(n):
                h = h * PRIME + code[k : k + m]
            inside = word[:m] == word[n - 1 :]
            hashes.append(h[inside])
            of.append(word[:m][inside])
    h, of_word = np.concatenate(hashes), np.concatenate(of)
    order = np.argsort(of_word, kind="stable")
    place = ((h ^ (h >> np.uint64(29))) * MIX) >> np.uint64(64 - p.bits)
    return place[order].astype(np.int32), np.bincount(of_word, minlength=len(bare))


@dataclass(frozen=True)
class Model:
    """logit of class 1 = bias + mean over words of the mean of `weight` at the word's places."""

    weight: np.ndarray
    bias: float
    p: Parameters
    #: Whether rows of both classes were there to learn from; if not, the score is the prior alone.
    fitted: bool = True

    def scorer(self) -> Callable[[list[str]], np.ndarray]:
        cache = BoundedCache()

        def score(many: list[str]) -> np.ndarray:
            split = [word_list(x) for x in many]
            if new := cache.new_of(split):
                flat, n = places(new, self.p)
                cache.learn(new, (np.add.reduceat(self.weight[flat], np.cumsum(n) - n) / n).tolist())
            get = cache.__getitem__
            logit = np.empty(len(split))
            for k, x in enumerate(split):
                count = Counter(x)
                n = 1 + np.log(np.fromiter(count.values(), np.float64, len(count)))
                logit[k] = self.bias + n @ np.fromiter(map(get, count), np.float64, len(count)) / (n.sum() + self.p.padding)
            return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))

        return score


def train(rows: list[tuple[str, int]], p: Parameters, prior: float) -> Model:
    """`prior`: the share of class 1 among all labelled rows; the sample's own share is evened out."""
    label = np.array([y for _, y in rows], np.int64)
    size = 1 << p.bits
    if not len(rows) or label.min() == label.max():
        share = min(max(prior, 1e-6), 1 - 1e-6)
        return Model(np.zeros(size, np.float32), float(np.log(share / (1 - share))), p, False)
    table, soft, bias, learnt = learn(rows, label, p)
    mine = label.mean()
    shift = np.log(prior / (1 - prior)) - np.log(mine / (1 - mine))
    return fold(table, soft, bias + np.array([0.0, shift]), learnt, p)


def fold(table: np.ndarray, soft: np.ndarray, bias: np.ndarray, learnt: np.ndarray, p: Parameters) -> Model:
    """One number for each place of the table, as means and the softmax's difference are linear. Places that no word of the sample has say nothing."""
    return Model(np.where(learnt, table @ (soft[:, 1] - soft[:, 0]), 0.0).astype(np.float32), float(bias[1] - bias[0]), p)


def learn(rows: list[tuple[str, int]], label: np.ndarray, p: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Table, softmax, its bias, and which places of the table the sample's words have."""
    size = 1 << p.bits
    rng = np.random.Generator(np.random.PCG64(p.seed))
    number: dict[str, int] = {}
    docs = []
    for text, _ in rows:
        words, count = np.unique(np.array([number.setdefault(w, len(number)) for w in word_list(text)], np.int32), return_counts=True)
        share = 1 + np.log(count)
        docs.append((words, (share / (share.sum() + p.padding)).astype(np.float32)))
    words = list(number)
    parts = [places(words[lo : lo + 20_000], p) for lo in range(0, len(words), 20_000)]
    flat, n_at = (np.concatenate([x[k] for x in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
    del number, words, parts
    start = np.cumsum(n_at, dtype=np.int64) - n_at
    table = rng.uniform(-p.spread, p.spread, (size, p.dims))
    soft, bias = rng.standard_normal((p.dims, 2)), np.zeros(2)
    g_table, g_soft, g_bias = np.full((size, p.dims), 1e-6), np.full((p.dims, 2), 1e-6), np.full(2, 1e-6)
    order = rng.permutation(len(rows))
    batches = [order[lo : lo + p.batch] for lo in range(0, len(order), p.batch)]

    def laid_out(of: np.ndarray) -> tuple:
        """A batch's words and table places, made anew each time, as all of them together would fill the driver's memory."""
        words, inverse = np.unique(np.concatenate([docs[k][0] for k in of]), return_inverse=True)
        doc = np.repeat(np.arange(len(of)), [len(docs[k][0]) for k in of])
        n = n_at[words]
        flat_at = flat[np.repeat(start[words] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        used, place = np.unique(flat_at, return_inverse=True)
        return label[of], doc, inverse, np.concatenate([docs[k][1] for k in of]), np.repeat(np.arange(len(words)), n), 1 / n, used, place, len(words)

    def into(index: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(index, value[:, d], n) for d in range(value.shape[1])], 1)

    for _ in range(max(p.epochs, -(-p.steps // len(batches)))):
        for k in rng.permutation(len(batches)):
            y, doc, inverse, share, word, inv_n, used, place, n_words = laid_out(batches[k])
            own = table[used]
            vec = into(word, own[place], n_words) * inv_n[:, None]
            text = into(doc, vec[inverse] * share[:, None], len(y))
            z = text @ soft + bias
            e = np.exp(z - z.max(1, keepdims=True))
            d = e / e.sum(1, keepdims=True)
            d[np.arange(len(y)), y] -= 1
            d /= len(y)
            d_text, d_soft, d_bias = d @ soft.T, text.T @ d, d.sum(0)
            d_vec = into(inverse, d_text[doc] * share[:, None], n_words) * inv_n[:, None]
            d_own = into(place, d_vec[word], len(used))
            g_table[used] += d_own**2
            table[used] = own - p.rate * d_own / np.sqrt(g_table[used])
            g_soft += d_soft**2
            soft -= p.rate * d_soft / np.sqrt(g_soft)
            g_bias += d_bias**2
            bias -= p.rate * d_bias / np.sqrt(g_bias)
    return table, soft, bias, np.bincount(flat, minlength=size) > 0


def held_out() -> Column:
    """Rows that nothing is learned from: crc32 of the doc_id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, p: Parameters | None = None) -> Model:
    """A model from the labelled rows that aren't held out: of each class the per_class rows of smallest hash, within class_bytes. `docs` is read once."""
    p = p or Parameters()
    usable = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    shares = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    total = sum(shares.values())
    # twice the rows, as some have no text
    ids = [usable.filter(F.col("toxic") == y).select("doc_id", "toxic", F.xxhash64("doc_id").alias("_h")).orderBy("_h").limit(2 * p.per_class) for y in sorted(shares)]
    if not ids:
        return train([], p, 0.5)
    labelled = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(reduce(DataFrame.unionByName, ids)), "doc_id")  # 4 * per_class ids at most
    order = Window.partitionBy("toxic").orderBy("_h", "text")
    # a limit on row_number() is taken in every task before rows move, so that one doc_id with very many rows costs no more than any other
    first = labelled.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= p.per_class)
    held = (
        first.withColumn("_b", F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .filter(F.coalesce("_b", F.lit(0)) < p.class_bytes)
    )
    got = held.select("toxic", "_k", "text").toArrow().sort_by([("toxic", "ascending"), ("_k", "ascending")])
    rows = list(zip(got["text"].to_pylist(), got["toxic"].to_pylist(), strict=True))
    del got
    return train(rows, p, shares.get(1, 0) / total if total else 0.5)


def score_column(model: Model, text: str = "text") -> Column:
    """The score of each whole text as a column."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = model.scorer()
        for col in batches:
            parts = [scorer(texts(b)) for b in text_slices([pa.record_batch([col], names=["text"])])]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return score(F.col(text))


def toxicity(docs: DataFrame, labels: DataFrame, p: Parameters | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `docs`."""
    p = p or Parameters()
    rows = docs.select("doc_id", held_out().alias("held_out"), score_column(fit(docs, labels, p)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= p.threshold).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, p: Parameters | None = None) -> DataFrame:
    """The rows of `docs`, all columns kept, whose text isn't predicted toxic."""
    p = p or Parameters()
    model = fit(docs, labels, p)
    if not model.fitted:  # nothing is known of toxicity, so nothing is rejected
        return docs
    name = fresh(docs, "_score")
    return docs.withColumn(name, score_column(model)).filter(F.col(name) < p.threshold).drop(name)
