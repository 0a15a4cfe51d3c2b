"""What the corpus operators share: bounded text slices, row keys, cut lineage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker takes apart at a time; a longer text makes a slice of its own.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about SLICE_BYTES of `column`, so that memory follows neither row counts nor text lengths."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of the texts; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def byte_column(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes in one array, and where each row begins in it (one offset more than rows)."""
    col = pc.fill_null(batch.column(column), "").cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of `df` has."""
    while name.lower() in map(str.lower, df.columns):
        name = f"_{name}"
    return name


def text_key(column: str = "text") -> Column:
    """With doc_id it names a row's text, also where doc_ids repeat; null and empty are one."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def cut(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut at files in the shared checkpoint folder, so that a lost executor costs no second run of what lies before."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Only a local master without one gets a temporary folder, as in tests; any other raises, as executors don't share it."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith(("local[", "local-cluster[")) and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    remove_at_exit(spark, sc.getCheckpointDir())
    return sc.getCheckpointDir()


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """The driver removes `path`, a folder of this application alone, when it ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def only(docs: DataFrame, winners: DataFrame, repeated: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns kept, whose (doc_id, text_key) is in `winners`, each once. `repeated`: the (doc_id, key) of more than one row."""

    def named(df: DataFrame) -> DataFrame:
        return df.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"))

    key = fresh(docs, "_key")
    marked = docs.withColumn(key, text_key())

    def join(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        return left.join(right, left["doc_id"].eqNullSafe(right["_d"]) & (left[key] == right["_k"]), how)

    stay = join(marked, named(winners), "left_semi")
    again = cut(named(repeated))
    if again.isEmpty():
        return stay.drop(key)
    return join(stay, again, "left_anti").unionByName(join(stay, again, "left_semi").dropDuplicates(["doc_id", key])).drop(key)


class BoundedCache(dict):
    """What this worker knows of words already seen. Emptied before a slice of texts when it holds too many words or bytes, so memory stays within the bound and a slice."""

    def __init__(self, limit: int = 300_000, most_bytes: int = 32 << 20):
        super().__init__()
        self.limit, self.most_bytes, self.bytes = limit, most_bytes, 0

    def new_of(self, split: Iterable[list[str]]) -> list[str]:
        """The distinct words of a slice that aren't held, after room for them is made."""
        seen: set[str] = set()
        for x in split:
            seen.update(x)
        if len(self) + len(seen) > self.limit or self.bytes > self.most_bytes:
            self.clear()
            self.bytes = 0
        return [w for w in seen if w not in self]

    def learn(self, words: list[str], values: list) -> None:
        self.update(zip(words, values, strict=True))
        self.bytes += sum(map(len, words)) + (sum(map(len, values)) if values and isinstance(values[0], bytes) else 8 * len(values))
