"""Deterministic readings of the driver's tables as observations, sites, intervals and sequences; the same text serves both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.functions.sequences import LETTERS, NUCLEOTIDES

ALT = (
    "CASE WHEN l_partkey % 7 = 0 THEN (l_returnflag <> 'A' OR l_quantity > 12) WHEN l_partkey % 11 = 0 THEN (l_returnflag = 'R' AND l_quantity > 35) "
    "WHEN l_partkey % 13 = 0 THEN l_linestatus = 'F' WHEN l_partkey % 17 = 0 THEN (l_returnflag = 'R' AND l_quantity > 49) ELSE l_returnflag = 'R' END"
)
OBS = f"SELECT l_partkey AS pos, l_orderkey AS read_id, {ALT} AS alt, l_linestatus = 'F' AS rev, l_quantity AS bq FROM lineitem"
#: Sites: the kind and lengths of a part by its size; a part that divides by 3 stands for a repeat.
VTYPE = "CASE WHEN p_size >= 40 THEN 1 WHEN p_size <= 10 THEN 2 ELSE 8 END"
SITE = (
    f"SELECT p_partkey AS pos, {VTYPE} AS vtype, CASE WHEN p_size >= 40 THEN 0 WHEN p_size <= 10 THEN p_size ELSE 1 END AS ref_len, "
    "CASE WHEN p_size >= 40 THEN p_size WHEN p_size <= 10 THEN 0 ELSE 1 END AS alt_len, p_size % 3 = 0 AS repeat FROM part"
)
#: Spark casts towards zero, the oracle rounds: it needs trunc().
IV_SPARK = "SELECT event_id AS id, user_id AS grp, unix_micros(CAST(ts AS TIMESTAMP)) AS st, unix_micros(CAST(ts AS TIMESTAMP)) + CAST(value * 60000000 AS BIGINT) AS en, CAST(value AS INT) AS label FROM events"
IV_SQL = "SELECT event_id AS id, user_id AS grp, epoch_us(ts) AS st, epoch_us(ts) + CAST(trunc(value * 60000000) AS BIGINT) AS en, CAST(trunc(value) AS INT) AS label FROM events"
SEQ_SQL = "SELECT item_id AS id, regexp_replace(translate(lower(text), '{a}', '{b}'), '[^ACGT]', 'N', 'g') AS seq FROM benchmark".format(a=LETTERS, b=NUCLEOTIDES)
DOC_SEQ_SQL = "SELECT doc_id AS id, regexp_replace(translate(lower(text), '{a}', '{b}'), '[^ACGT]', 'N', 'g') AS seq FROM documents".format(a=LETTERS, b=NUCLEOTIDES)
#: Het variants of a read by its lines: the same rule for alleles, one row a read and site.
PROFILE = f"SELECT l_suppkey % 10 AS grp, l_orderkey AS read_id, l_partkey AS var_id, CAST(min(CASE WHEN {ALT} THEN 1 ELSE 0 END) AS INT) AS allele FROM lineitem GROUP BY 1, 2, 3"
HOUR = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """`sql` over tables of the driver, without registering views."""
    for n in names:
        sql = sql.replace(f"FROM {n}", "FROM {" + n + "}")
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, OBS, "lineitem")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SITE, "part")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, IV_SPARK, "events")


#: Bytes of a table's files for each part of spread().
SPREAD = 2_000_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys into as many parts as the files ask for, so that a task's table of groups stays the same size however large the input is."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // SPREAD)), *keys)


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearly every line is a group of its own: combining them before the shuffle would hold all lines of a task and save nothing."""
    return spark.sql(PROFILE.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spread(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey"))


def sequences(spark: SparkSession, sf_dir: str, name: str = "benchmark") -> DataFrame:
    from helixloom.functions.sequences import as_dna

    key = {"benchmark": "item_id", "documents": "doc_id"}[name]
    return table(spark, sf_dir, name).select(F.col(key).alias("id"), as_dna(F.col("text")).alias("seq"))
