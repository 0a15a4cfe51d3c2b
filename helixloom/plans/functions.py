"""Kernels as SQL functions: register(spark) makes them callable from spark.sql()."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from helixloom.config import HIFI
from helixloom.functions import align, dust, elements, poa


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


#: Error rate of each quality.
ERROR = 10.0 ** (-np.arange(256) / 10)
#: Types as objects, since texts would need a running session at import.
INT, TEXT = IntegerType(), StringType()


@F.pandas_udf(ArrayType(_struct(st=INT, en=INT)))
def dust_mask(s: pd.Series) -> pd.Series:
    return s.map(lambda x: [{"st": a, "en": b} for a, b in dust.mask(x or "", HIFI.dust_threshold, HIFI.dust_window)])


@F.pandas_udf(_struct(distance=INT, start=INT, end=INT, path=TEXT))
def infix_edit(query: pd.Series, target: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([align.edit(q, t, "HW") for q, t in zip(query, target, strict=True)], columns=["distance", "start", "end", "path"])


@F.pandas_udf(INT)
def edit_distance(query: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([align.edit(q, t).distance for q, t in zip(query, target, strict=True)], dtype="int32")


@F.pandas_udf(BooleanType())
def cyclic_match(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([align.cyclic_match(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


@F.pandas_udf(BooleanType())
def low_complexity_difference(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([align.low_complexity_difference(x, y, HIFI.dust_threshold, HIFI.dust_window) for x, y in zip(a, b, strict=True)], dtype=bool)


@F.pandas_udf(_struct(target=TEXT, query=TEXT))
def affine_align(target: pd.Series, query: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([align.affine(t, q) for t, q in zip(target, query, strict=True)], columns=["target", "query"])


@F.pandas_udf(_struct(tsd_len=INT, tail_len=INT))
def insertion_marks(gap: pd.Series, flank: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([elements.insertion_marks(g, f, HIFI) for g, f in zip(gap, flank, strict=True)], columns=["tsd_len", "tail_len"])


@F.pandas_udf(TEXT)
def poa_consensus(seqs: pd.Series) -> pd.Series:
    return seqs.map(lambda x: poa.consensus([s for s in x if s]))


@F.arrow_udf(DoubleType())
def mean_error(qual: pa.Array) -> pa.Array:
    """Mean error rate of a read's bases by their qualities; 0 without any."""
    at = qual.cast(pa.large_binary()).buffers()
    offsets = np.frombuffer(at[1], np.int64)[qual.offset : qual.offset + len(qual) + 1]
    total = np.concatenate([[0.0], np.cumsum(ERROR[np.frombuffer(at[2] or b"", np.uint8)[offsets[0] : offsets[-1]]])])[offsets - offsets[0]]
    size = np.diff(offsets)
    return pa.array(np.where(size > 0, np.diff(total) / np.maximum(size, 1), 0.0))


FUNCTIONS = {f.__name__: f for f in (mean_error, dust_mask, infix_edit, edit_distance, cyclic_match, low_complexity_difference, affine_align, insertion_marks, poa_consensus)}


def register(spark: SparkSession) -> None:
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)
