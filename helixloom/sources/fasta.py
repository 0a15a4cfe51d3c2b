"""FASTA files and indexes as tables; reference slices by bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.functions import sequences as seq

BIN = 100_000
#: Bases of the pieces that point look-ups join.
POINT = 1_000


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """contig, length, offset, line_bases, line_width of a .fai file."""
    c = F.split("value", "\t")
    return (
        spark.read.text(path)
        .select(
            c[0].alias("contig"), *(c[k + 1].cast("long").alias(n) for k, n in enumerate(("length", "offset", "line_bases", "line_width"))),
        )
    )


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """contig, seq: records split at `>`; line ends are dropped, letters go upper."""
    rec = spark.read.text(path, lineSep=">").filter("length(value) > 0")
    head, rest = F.substring_index("value", "\n", 1), F.expr("substring(value, instr(value, '\n') + 1)")
    return rec.select(F.regexp_extract(head, r"^(\S+)", 1).alias("contig"), F.upper(F.regexp_replace(rest, r"\s", "")).alias("seq"))


def binned(sequences: DataFrame, width: int = BIN) -> DataFrame:
    """contig, bin, seq: pieces of `width` bases, so that no join moves a chromosome. A chromosome is halved in steps, as cutting a piece walks what it is cut out of."""
    pieces = seq.windows(F.col("seq"), width, width, least=1, block=14, blocks=14)
    return sequences.select("contig", F.posexplode(pieces).alias("bin", "seq")).select("contig", F.col("bin").cast("long").alias("bin"), "seq")


def slices(bins: DataFrame, regions: DataFrame, flank: int = 50_000, width: int = BIN) -> DataFrame:
    """Adds ref_beg and ref_seq (1-based begin, upper-case bases, clipped at the contig's ends) to regions (contig, beg, end), with `flank` bases on both sides."""
    lo = F.greatest(F.col("beg") - flank, F.lit(1))
    want = regions.withColumn("ref_beg", lo.cast("long")).withColumn("_to", F.col("end") + flank)
    keys = [*regions.columns, "ref_beg", "_to"]
    parts = (
        want.withColumn("bin", F.explode(F.sequence(F.floor((F.col("ref_beg") - 1) / width), F.floor((F.col("_to") - 1) / width))))
        .join(bins, ["contig", "bin"])
    )
    whole = (
        parts.groupBy(*keys)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bin", "seq"))), lambda x: x["seq"]), "").alias("_seq"))
    )
    skip = F.col("ref_beg") - F.floor((F.col("ref_beg") - 1) / width) * width
    return (
        whole.select(
            *regions.columns, "ref_beg",
            F.substring("_seq", skip.cast("int"), (F.col("_to") - F.col("ref_beg") + 1).cast("int")).alias("ref_seq"),
        )
    )


def points(bins: DataFrame, step: int, width: int = BIN) -> DataFrame:
    """contig, piece, seq: two steps of bases from every step on, over the ends of bins, whose width is a multiple of `step`."""
    ahead = bins.select("contig", (F.col("bin") - 1).alias("bin"), F.substring("seq", 1, step).alias("_next"))
    both = bins.join(ahead, ["contig", "bin"], "left").withColumn("_n", F.ceil(F.length("seq") / step).cast("int"))
    pieces = (
        F.slice(
            seq.windows(F.concat("seq", F.coalesce("_next", F.lit(""))), 2 * step, step, least=1, block=16, blocks=16), F.lit(1),
            F.col("_n"),
        )
    )
    return (
        both.select("contig", "bin", F.posexplode(pieces).alias("_k", "seq"))
        .select("contig", (F.col("bin") * (width // step) + F.col("_k")).alias("piece"), "seq")
    )


def base_at(bins: DataFrame, sites: DataFrame, length: Column, width: int = BIN) -> DataFrame:
    """Adds `bases` to sites (contig, pos): `length` reference bases from pos on, as far as the contig goes; null beyond it.

    Lengths up to POINT look up one short piece; longer ones, such as those of long gaps, are cut out of slices.
    """
    step = POINT if width % POINT == 0 else width
    asked = sites.withColumn("_length", length.cast("int"))
    short = asked.filter("_length <= %d" % step).withColumn("piece", F.floor((F.col("pos") - 1) / step))
    near = short.join(points(bins, step, width), ["contig", "piece"], "left")
    near = near.select(*sites.columns, F.substring("seq", (F.col("pos") - F.col("piece") * step).cast("int"), F.col("_length")).alias("bases"))
    long = (
        asked.filter("_length > %d" % step)
        .select(
            F.col("contig"), F.col("pos").cast("long").alias("beg"), (F.col("pos") + F.col("_length") - 1).cast("long").alias("end"),
            F.struct(*sites.columns).alias("_site"),
        )
    )
    far = slices(bins, long, 0, width).select("_site.*", F.col("ref_seq").alias("bases"))
    return near.unionByName(far.select(*near.columns))
