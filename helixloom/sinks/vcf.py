"""VCF output: header, body, plain or blocked gzip."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixloom.operators.genotype import body_line
from helixloom.sinks.blocks import write_blocks, write_end
from helixloom.sources.bgzf import packed

#: The declared fields.
INFO = [
    ("CLEAN", "0", "Flag", "Clean-region variant"), ("SOMATIC", "0", "Flag", "Somatic or mosaic variant"), ("MEI", "0", "Flag", "Mobile element insertion"), ("END", "1", "Integer", "Last position"),
    ("SVTYPE", "1", "String", "Type of structural variant"), ("SVLEN", "A", "Integer", "Length of structural variant"), ("TSD", "1", "String", "Target site duplication"), ("TSDLEN", "1", "Integer", "Length of target site duplication"),
    ("POLYALEN", "1", "Integer", "Length of poly-A or, negative, poly-T"), ("TSDPOS1", "1", "Integer", "Position of first target site duplication"), ("TSDPOS2", "1", "Integer", "Position of second target site duplication"), ("REPNAME", "1", "String", "Name of mobile element"),
]
FORMAT = [
    ("GT", "1", "String", "Genotype"), ("DP", "1", "Integer", "Depth"), ("AD", "R", "Integer", "Depth by allele"), ("VAF", "A", "Float", "Alt fraction"), ("GQ", "1", "Integer", "Genotype quality"),
    ("PS", "1", "Integer", "Phase set"), ("ALTREADS", "1", "String", "Names of alt reads"),
]


#: The declared filters.
FILTER = [("PASS", "All filters passed"), ("LowQual", "Low quality variant"), ("RefCall", "Reference call"), ("NoCall", "Site has depth=0 resulting in no call")]


def header(contigs: list[tuple[str, int]], sample: str, extra: tuple[str, ...] = ()) -> str:
    """extra: lines such as ##fileDate, ##source, ##reference and the command line."""
    lines = ["##fileformat=VCFv4.3", *extra, *(f'##FILTER=<ID={a},Description="{d}">' for a, d in FILTER)]
    lines += [f"##contig=<ID={n},length={k}>" for n, k in contigs]
    for kind, fields in (("INFO", INFO), ("FORMAT", FORMAT)):
        lines += [f'##{kind}=<ID={a},Number={b},Type={c},Description="{d}">' for a, b, c, d in fields]
    return "\n".join([*lines, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample])]) + "\n"


def lines(calls: DataFrame, contigs: list[tuple[str, int]]) -> DataFrame:
    """contig, pos, line in file order; contigs in header order. Range-partitioned, so parts follow each other."""
    order = F.array_position(F.array(*(F.lit(n) for n, _ in contigs)), F.col("contig"))
    return body_line(calls).withColumn("_o", order).orderBy("_o", "pos", "line").drop("_o")


def write(calls: DataFrame, path: str, contigs: list[tuple[str, int]], sample: str, compression: str = "none", extra: tuple[str, ...] = ()) -> None:
    """A folder of sorted parts, written by the tasks wherever Spark writes; the header is a part of its own, which sorts first.
    compression: none, gzip, or bgzf: blocked gzip, whose parts make one file when they are put behind each other."""
    spark = calls.sparkSession
    body = lines(calls, contigs).select("line")
    head = spark.createDataFrame([(header(contigs, sample, extra).rstrip("\n"),)], "line string").coalesce(1)
    if compression == "bgzf":
        write_blocks(_packed_lines(head), f"{path}/a-header", b"\n")
        write_blocks(_packed_lines(body), f"{path}/body", b"\n")
        write_end(spark, f"{path}/z-end")
        return
    body.write.mode("overwrite").option("compression", compression).text(f"{path}/body")
    head.write.mode("overwrite").option("compression", compression).text(f"{path}/a-header")


def _packed_lines(rows: DataFrame) -> DataFrame:
    """data: blocks of some lines each, without the last line's end."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([pa.array([packed("\n".join(b.column(0).to_pylist()).encode())], pa.binary())], names=["data"])

    return rows.mapInArrow(run, "data binary")


def merge_parts(path: str, to: str) -> None:
    """Joins a local folder's parts, of VCF or BAM, to one file, a piece at a time."""
    import shutil
    from glob import glob

    with open(to, "wb") as f:
        for p in (p for d in ("a-header", "body", "z-end") for p in sorted(glob(f"{path}/{d}/part-*"))):
            with open(p, "rb") as part:
                shutil.copyfileobj(part, f, 1 << 20)
