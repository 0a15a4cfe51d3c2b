"""SAM text as the reads table, without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Flags of reads that are never used: unmapped, secondary, supplementary.
UNUSED = 0x904


def parse(lines: DataFrame) -> DataFrame:
    """Alignment lines (value) to the columns of schemas.READS."""
    c = F.split("value", "\t")
    text = F.when(c[10] == "*", "").otherwise(c[10])
    qual = F.unhex(F.concat_ws("", F.transform(F.split(text, ""), lambda x: F.when(x == "", "").otherwise(F.lpad(F.hex(F.ascii(x) - 33), 2, "0")))))
    tags = F.map_from_entries(F.transform(F.slice(c, 12, F.greatest(F.size(c) - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, 6, 1_000_000))))
    return (
        lines.select(
            c[0].alias("qname"), c[1].cast("int").alias("flag"), c[2].alias("contig"), c[3].cast("long").alias("pos"),
            c[4].cast("int").alias("mapq"), c[5].alias("cigar"), c[9].alias("seq"), qual.alias("qual"), tags.alias("tags"),
        )
    )


def read_sam(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Alignment lines of one or more files; source_idx is the file's place in the list."""
    paths = [paths] if isinstance(paths, str) else paths
    out = None
    for k, p in enumerate(paths):
        one = parse(spark.read.text(p).filter("NOT startswith(value, '@')")).withColumn("source_idx", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def read_list(spark: SparkSession, path: str, extra: tuple[str, ...] = ()) -> list[str]:
    """Paths of an input list, one a line, and then the extra ones. A list is driver-side configuration."""
    return [r["value"].strip() for r in spark.read.text(path).filter("length(trim(value)) > 0").collect()] + list(extra)


def header(spark: SparkSession, path: str) -> dict[str, list]:
    """Contigs (name, length) and sample names of a SAM file's header."""
    lines = [r["value"] for r in spark.read.text(path).filter("value RLIKE '^@(SQ|RG)\t'").collect()]
    tag = lambda line, t: next((x[3:] for x in line.split("\t")[1:] if x.startswith(f"{t}:")), None)
    return {"contigs": [(tag(x, "SN"), int(tag(x, "LN"))) for x in lines if x.startswith("@SQ")], "samples": list(dict.fromkeys(s for x in lines if x.startswith("@RG") and (s := tag(x, "SM"))))}


def sample_name(heads: list[dict[str, list]], paths: list[str]) -> str:
    """The first sample of the headers, else the files' names joined."""
    names = [s for h in heads for s in h["samples"]]
    return names[0] if names else ",".join(p.rsplit("/", 1)[-1] for p in paths)


def reference_length(cigar: Column) -> Column:
    return F.aggregate(F.regexp_extract_all(cigar, F.lit("([0-9]+)[MDN=X]"), F.lit(1)), F.lit(0), lambda s, x: s + x.cast("int"))


def usable(reads: DataFrame, min_mapq: int = 30) -> DataFrame:
    """Mapped primary reads of enough mapping quality, with their last base."""
    return (
        reads.filter(((F.col("flag").bitwiseAND(UNUSED)) == 0) & (F.col("mapq") >= min_mapq))
        .withColumn("end", F.col("pos") + reference_length(F.col("cigar")) - 1)
    )


def with_chunks(reads: DataFrame, size: int = 500_000) -> DataFrame:
    """One row for each window that a read touches."""
    return reads.withColumn("chunk", F.explode(F.sequence(F.floor((F.col("pos") - 1) / size), F.floor((F.col("end") - 1) / size))))
