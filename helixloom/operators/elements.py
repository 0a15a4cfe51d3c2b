"""Mobile elements: k-mer index and best match; duplications and tails come from functions.elements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixloom.functions import sequences as seq


def index(elements: DataFrame, k: int = 15) -> DataFrame:
    """te_id, rev, kmer: distinct k-mers of element sequences (te_id, seq), forward and reverse-complemented, simple ones left out."""
    both = (
        elements.select(
            "te_id",
            F.explode(F.array(F.struct(F.lit(False).alias("rev"), F.col("seq").alias("s")), F.struct(F.lit(True).alias("rev"), seq.reverse_complement(F.col("seq")).alias("s")))).alias("x"),
        )
    )
    words = both.select("te_id", "x.rev", F.explode(seq.kmers(F.col("x.s"), k)).alias("kmer"))
    return words.filter(seq.plain_kmer(F.col("kmer"))).distinct()


def match(queries: DataFrame, te_index: DataFrame, k: int = 15, least: int = 3) -> DataFrame:
    """id, te_id, rev, hits: for each query (id, seq) the element and strand with most k-mer hits, every k-th k-mer asked; ties prefer reverse, then the first element.

    The index is a library of a few elements; Spark broadcasts it when its size allows, by its own check.
    """
    words = queries.select("id", F.explode(seq.kmers_apart(F.col("seq"), k)).alias("kmer"))
    hits = words.join(te_index, "kmer").groupBy("id", "te_id", "rev").agg(F.count("*").alias("hits")).filter(F.col("hits") >= least)
    best = hits.groupBy("id").agg(F.max_by(F.struct("te_id", "rev", "hits"), F.struct("hits", "rev", -F.col("te_id"))).alias("b"))
    return best.select("id", "b.te_id", "b.rev", "b.hits")
