"""Approximate nearest neighbours by adaptive dimension scans (operator 6).

Nearness is the largest inner product. Vectors get one more dimension that evens out their norms, so that it becomes the least
Euclidean distance; a fixed random rotation spreads that distance evenly over the dimensions. Lists come from k-means on a
bounded sample; every vector is indexed. A query visits its lists nearest first, in a few rounds, and keeps the k-th distance
found so far. Within each probed list, dimensions are read in column blocks: after each, a candidate whose partial distance,
scaled up to all dimensions, is beyond that k-th distance with high confidence, is given up. Survivors are scored exactly,
in double precision, on the original vectors, and bring the k-th distance down for the list's next vectors and the next round.
Farther lists are probed unless all those left out together are expected, from their sizes and spreads, to hold less than a share `miss`
of the k nearest; how many that leaves depends on the data, not on a fixed number.

Equal vectors are one candidate (a class); a class knows its least ids, as many as a result can hold. So copies cost no
work, and ties go to smaller ids. A list's vectors lie in blocks of at most `block`; a task holds one block and streams the queries by.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids, nor vectors of another than the
most common length; rows repeated with id and vector count once; a query's own id is never its neighbour; fewer candidates give fewer rows;
other columns are passed by; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixloom.llm.common import cut


@dataclass(frozen=True)
class Parameters:
    k: int = 20
    #: Rows that k-means is fitted on at most.
    sample: int = 16_384
    #: Lists: the root of the classes, times this, at most sample / 16.
    lists_per_root: float = 1.0
    #: Nearest lists that the first rounds probe up to; the rest follow in a last round, as far as they are needed.
    rounds: tuple[int, ...] = (4, 32)
    #: Share of the k nearest that lists left out may be expected to hold; an upper bound, as k-th distances still shrink after it is taken.
    miss: float = 0.25
    #: Dimensions read at a time, and the tests' significance (the larger, the fewer false dismissals).
    columns: int = 32
    epsilon: float = 2.1
    #: Vectors of one block, vectors after which the k-th distances are brought up to date, and queries at a time.
    block: int = 16_384
    step: int = 2_048
    queries: int = 1_024
    seed: int = 7


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def kmeans(x: np.ndarray, n: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(seed))
    centre = x[rng.choice(len(x), n, replace=False)]
    for _ in range(rounds):
        near = nearest(x, centre, 1)[:, 0]
        count = np.bincount(near, minlength=n)
        total = np.stack([np.bincount(near, x[:, d], n) for d in range(x.shape[1])], 1)
        centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[rng.choice(len(x), n)])
    return centre


def nearest(x: np.ndarray, centre: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each row, nearest first."""
    out = []
    for lo in range(0, len(x), 4096):
        d = (centre**2).sum(1) - 2 * x[lo : lo + 4096] @ centre.T
        part = np.argpartition(d, n - 1, 1)[:, :n] if n < len(centre) else np.broadcast_to(np.arange(len(centre)), d.shape)
        out.append(np.take_along_axis(part, np.take_along_axis(d, part, 1).argsort(1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, n), np.int64)


def scan(query: np.ndarray, vector: np.ndarray, beat: np.ndarray, columns: int, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) rows that survive the adaptive scan. All are rotated, in single precision; `beat` holds for each query the squared distance to beat.

    A pair is given up once its partial distance, scaled to all dimensions, is beyond the distance to beat by more than the test
    allows. While many pairs are alive a column block is one matrix product; then only the pairs still alive are read.
    """
    dims, alive = vector.shape[1], None
    limit = lambda end: beat * (1 + (epsilon / end**0.5 if end < dims else 1e-4)) ** 2 * (end / dims) + 1e-6
    part = np.zeros((len(query), len(vector)), np.float32)
    for at in range(0, dims, columns):
        end = min(at + columns, dims)
        a, b = query[:, at:end], vector[:, at:end]
        if alive is None:
            part -= a @ (2 * b.T)
            part += (b**2).sum(1)
            part += (a**2).sum(1)[:, None]
            good = part <= limit(end)[:, None]
            if end < dims and np.count_nonzero(good) > good.size // 16:
                part[~good] = np.inf
                continue
            alive = np.nonzero(good)
            part = part[alive]
        else:
            i, j = alive
            part += ((a[i] - b[j]) ** 2).sum(1)
            good = part <= limit(end)[i]
            alive, part = (i[good], j[good]), part[good]
    return alive if alive is not None else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def first_of(i: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each i the `most` rows of greatest score, ties to smaller ids; ordered so."""
    order = np.lexsort((ids, -score, i))
    i, score, ids = i[order], score[order], ids[order]
    begin = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, np.int64)
    place = np.arange(len(i)) - np.repeat(begin, np.diff(np.append(begin, len(i))))
    return i[place < most], score[place < most], ids[place < most]


@dataclass(frozen=True)
class Lists:
    """Centres, and of each list its vectors' number, and mean and variance of their squared distance to the centre."""

    centre: np.ndarray
    count: np.ndarray
    mean: np.ndarray
    variance: np.ndarray

    def expected(self, square: np.ndarray, beat: np.ndarray) -> np.ndarray:
        """How many vectors of each list are expected within each query's distance to beat; `square`: squared distances of queries to centres.

        A vector's squared distance is that of its centre, plus its own from there, less twice a product of the two ways, which for ways
        in any direction has mean 0 and variance 4 |a|^2 |b|^2 / dims.
        """
        spread = np.sqrt(self.variance + 4 * square * self.mean / self.centre.shape[1]) + 1e-9
        z = (beat[:, None] - square - self.mean) / spread
        z = np.clip(z, -8, 8)
        return self.count / (1 + np.exp(-1.5976 * z - 0.07056 * z**3))  # the normal distribution, to 2 in 10,000


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part, each once."""
    x = F.col("embedding")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & x.isNotNull() & whole)
    return rows.dropDuplicates(["vec_id", "embedding"])


def search(vectors: DataFrame, every: int = 20, p: Parameters | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the p.k nearest found of each row whose vec_id is divisible by `every`, against all rows."""
    p = p or Parameters()
    spark, most = vectors.sparkSession, p.k + 1
    rows = cut(valid(vectors))
    id_kind, emb_kind = vectors.schema["vec_id"].dataType.simpleString(), vectors.schema["embedding"].dataType.simpleString()
    size = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return spark.createDataFrame([], f"query_id {id_kind}, rank int, vec_id {id_kind}, score double")
    dims = size["n"]
    rows = rows.filter(F.size("embedding") == dims)
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).filter(F.col("_k") <= most)
    classes = cut(first.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("cls"), "ids", "embedding"))
    asked = cut(rows.filter(F.col("vec_id") % every == 0).join(classes.select("embedding", "cls"), "embedding").select(F.col("vec_id").alias("query_id"), "cls"))

    norm2 = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    total = classes.agg(F.count("*").alias("n"), F.max(norm2).alias("m")).first()
    sample = (
        classes.select("embedding", F.xxhash64("cls").alias("h")).orderBy("h").limit(p.sample).select("embedding").toArrow()["embedding"]
        .combine_chunks()
    )
    fit = _matrix(sample, dims)
    rotation = np.linalg.qr(np.random.Generator(np.random.PCG64(p.seed)).standard_normal((dims + 1, dims + 1)))[0]
    top = total["m"]

    def rotated(x: np.ndarray, is_query: bool) -> np.ndarray:
        rest = np.zeros(len(x)) if is_query else np.sqrt(np.maximum(top - (x**2).sum(1), 0))
        return (np.concatenate([x, rest[:, None]], 1) @ rotation).astype(np.float32)

    n_lists = int(max(1, min(p.lists_per_root * total["n"] ** 0.5, len(fit) / 16)))
    seeds = kmeans(rotated(fit, False).astype(np.float64), n_lists, p.seed)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = rotated(_matrix(b.column("embedding"), dims), False)
            yield pa.record_batch([*b.columns, pa.array(nearest(x, seeds, 1)[:, 0], pa.int32())], names=["cls", "embedding", "list"])

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row of a task for each list it has: its vectors' sum."""
        total, n = np.zeros((n_lists, dims + 1)), np.zeros(n_lists, np.int64)
        for b in batches:
            at = b.column("list").to_numpy()
            np.add.at(total, at, rotated(_matrix(b.column("embedding"), dims), False).astype(np.float64))
            n += np.bincount(at, minlength=n_lists)
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.float64()))], names=["list", "n", "total"])

    def offs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("list").to_numpy()
            d = ((rotated(_matrix(b.column("embedding"), dims), False) - centre[at]) ** 2).sum(1)
            yield pa.record_batch([b.column("list"), pa.array(d, pa.float64())], names=["list", "off"])

    indexed = cut(classes.select("cls", "embedding").mapInArrow(assign, f"cls {id_kind}, embedding {emb_kind}, list int"))
    # centres and spreads are those of all vectors, not the sample's: n_lists * (dims + 1) numbers come to the driver, whatever the rows
    parts = (
        indexed.select("list", "embedding").mapInArrow(sums, "list int, n long, total array<double>")
        .select("list", "n", F.posexplode("total").alias("d", "x"))
    )
    centre = seeds.copy()
    for r in parts.groupBy("list", "d").agg((F.sum("x") / F.sum("n")).alias("x")).collect():
        centre[r["list"], r["d"]] = r["x"]
    of_list = {r["list"]: r for r in indexed.select("list", "embedding").mapInArrow(offs, "list int, off double").groupBy("list").agg(F.count("*").alias("n"), F.avg("off").alias("m"), F.var_pop("off").alias("v")).collect()}
    lists = Lists(centre, *(np.array([of_list[k][c] if k in of_list else 0.0 for k in range(n_lists)]) for c in "nmv"))
    blocks = F.element_at(F.array(*(F.lit(max(1, -(-int(n) // p.block))) for n in lists.count)), F.col("list") + 1)
    stored = (
        indexed.select(
            "list", F.pmod(F.xxhash64("cls"), blocks).cast("int").alias("vb"), F.lit(0).alias("side"), "cls", "embedding",
            F.lit(None).cast("double").alias("kth"),
        )
    )
    wanted = cut(classes.join(asked.select("cls").distinct(), "cls", "left_semi").select("cls", "embedding"))

    def distance_to_beat(kth: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The squared distance of the rotated vectors that a score is; infinite without one."""
        return np.where(np.isnan(kth), np.inf, np.maximum((x.astype(np.float64) ** 2).sum(1) + top - 2 * kth, 0))

    def probe(lo: int, hi: int, last: bool):
        """Which of the lists from the lo-th to the hi-th nearest each query goes on to."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = rotated(_matrix(b.column("embedding"), dims), True)
                order = nearest(x, centre, n_lists)
                take = np.zeros(order.shape, bool)
                take[:, lo:hi] = True
                if last:
                    beat = distance_to_beat(b.column("kth").to_numpy(zero_copy_only=False), x)
                    square = np.maximum((x.astype(np.float64) ** 2).sum(1)[:, None] + (centre**2).sum(1) - 2 * x @ centre.T, 0)
                    hope = np.where(take, np.take_along_axis(lists.expected(square, beat), order, 1), 0.0)
                    least = np.argsort(hope, 1)
                    spared = np.cumsum(np.take_along_axis(hope, least, 1), 1) <= p.miss * p.k
                    np.put_along_axis(take, least, np.take_along_axis(take, least, 1) & ~(spared & np.isfinite(beat)[:, None]), 1)
                chosen = [row[on].tolist() for row, on in zip(order, take, strict=True)]
                yield pa.record_batch([*b.columns, pa.array(chosen, pa.list_(pa.int32()))], names=["cls", "embedding", "kth", "lists"])

        return run

    def visit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by (list, block), vectors before queries: the block's vectors are held, queries stream by."""
        held: list[pa.RecordBatch] = []
        now, block = None, None
        for big in batches:
            name = np.stack([big.column(c).to_numpy() for c in ("list", "vb", "side")], 1)
            begin = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]).any(1)])).tolist()
            for lo, hi in zip(begin, [*begin[1:], len(name)], strict=True):
                key, side, part = tuple(name[lo, :2]), name[lo, 2], big.slice(lo, hi - lo)
                if key != now:
                    now, held, block = key, [], None
                if side == 0:
                    held.append(part)
                    continue
                if block is None and held:
                    vx = np.concatenate([_matrix(h.column("embedding"), dims) for h in held])
                    block = np.concatenate([h.column("cls").to_numpy() for h in held]), vx, rotated(vx, False)
                    held = []
                for at in range(0, part.num_rows if block else 0, p.queries):
                    yield against(part.slice(at, p.queries), *block)

    def against(part: pa.RecordBatch, ids: np.ndarray, vx: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        qx, qid = _matrix(part.column("embedding"), dims), part.column("cls").to_numpy()
        q = rotated(qx, True)
        kth = part.column("kth").to_numpy(zero_copy_only=False).copy()
        i, score, near = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        for lo in range(0, len(v), p.step):
            a, b = scan(q, v[lo : lo + p.step], distance_to_beat(kth, q).astype(np.float32), p.columns, p.epsilon)
            b = b + lo
            got = np.concatenate([np.einsum("nd,nd->n", qx[a[x : x + 65536]], vx[b[x : x + 65536]]) for x in range(0, len(a), 65536)] or [np.zeros(0)])
            i, score, near = first_of(np.concatenate([i, a]), np.concatenate([score, got]), np.concatenate([near, ids[b].astype(np.int64)]), most)
            found = np.bincount(i, minlength=len(q))
            full = np.flatnonzero(found == most)
            worst = score[np.cumsum(found)[full] - 1]
            kth[full] = np.fmax(kth[full], worst)
        return pa.record_batch([pa.array(qid[i].astype(np.int64)), pa.array(near), pa.array(score)], names=["cls", "near", "score"])

    best, edges = None, [0, *(r for r in p.rounds if r < n_lists), n_lists]
    for lo, hi in zip(edges, edges[1:], strict=False):
        known = wanted.withColumn("kth", F.lit(None).cast("double"))
        if best is not None:
            worst = best.groupBy("cls").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= most)
            known = wanted.join(worst.select("cls", "kth"), "cls", "left").select("cls", "embedding", "kth")
        asks = known.mapInArrow(probe(lo, hi, lo > 0 and hi == n_lists), f"cls {id_kind}, embedding {emb_kind}, kth double, lists array<int>")
        asks = asks.select(F.explode("lists").alias("list"), "cls", "embedding", "kth")
        asks = asks.select("list", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("vb"), F.lit(1).alias("side"), "cls", "embedding", "kth")
        dealt = stored.unionByName(asks).repartition("list", "vb").sortWithinPartitions("list", "vb", "side")
        found = dealt.mapInArrow(visit, "cls long, near long, score double")
        both = found if best is None else best.select("cls", "near", "score").unionByName(found)
        ranked = (
            both.withColumn("_k", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("score"), "near")))
            .filter(F.col("_k") <= most)
        )
        best = cut(ranked.select("cls", "near", "score"))
    # of at most `most` classes at most `most` ids each
    rows_of = best.join(classes.select(F.col("cls").alias("near"), "ids"), "near").select("cls", "score", F.explode("ids").alias("vec_id"))
    ranked = (
        rows_of.withColumn("_k", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("score"), "vec_id")))
        .filter(F.col("_k") <= most)
    )
    gathered = ranked.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("_k", "vec_id", "score"))).alias("hits"))
    out = asked.join(gathered, "cls")
    hits = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, p.k)
    out = out.select("query_id", F.posexplode(hits).alias("pos", "hit"))
    return (
        out.select(
            "query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").cast(id_kind).alias("vec_id"),
            F.col("hit.score").alias("score"),
        )
    )
