"""A corpus pipeline of five stages, each by one corpus operator: documents in, packed sequences out.

Stages filter (toxicity, exact and near copies) or rewrite (secrets become a mark); the last packs what is left. run() writes
each stage's rows to the shared checkpoint folder as Parquet and reads them again, so that an executor's loss never
costs more than a stage. A stage's folder goes once the next one is written, and the last when the driver ends.

Defined cases, for every stage: a null text counts as empty and stays null unless its row goes; a null doc_id is carried through (drop_copies and
drop_near_copies: it comes before any number, or after, as exact_dedup and simhash say); rows repeated with id and text are scored, redacted and packed
each, and one of them is kept among copies; columns beyond doc_id and text, whatever their names, are kept by all stages but the last;
n_chars follows a redacted text; an empty table gives no rows; without labels of both classes drop_toxic keeps every row.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from helixloom.llm import exact_dedup, packing, secrets, simhash, toxicity
from helixloom.llm.common import checkpoint_folder, remove, remove_at_exit, table
from helixloom.llm.queries import WORD_BPE


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path(WORD_BPE))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack),
]

#: SQL can't train a classifier or run the tokenizers; tests/llm hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
