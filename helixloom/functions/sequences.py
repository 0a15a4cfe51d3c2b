"""Nucleotide sequences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS, NUCLEOTIDES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


def nucleotides(s: Column) -> Column:
    """Upper case over ACGT; any other character is N."""
    return F.regexp_replace(F.upper(s), "[^ACGT]", "N")


def as_dna(text: Column) -> Column:
    """A deterministic reading of any text as DNA: letters go round ACGT, all else is N."""
    return F.regexp_replace(F.translate(F.lower(text), LETTERS, NUCLEOTIDES), "[^ACGT]", "N")


def base_codes(s: Column) -> Column:
    """A 0, C 1, G 2, T 3, other 4."""
    return F.transform(F.split(F.translate(nucleotides(s), "ACGTN", "01234"), ""), lambda c: c.cast("int"))


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGT", "TGCA"))


#: Places of a block, and blocks of a stretch. substring() walks a text from its begin, so pieces are cut out of blocks, and these out of stretches.
BLOCK, BLOCKS = 512, 128


def _pieces(s: Column, size: int, step: int, most: int) -> Column:
    """Substrings of up to `size` from every step-th place on, as many as have at least `most` characters."""
    n = F.floor((F.length(s) - most) / step + 1).cast("int")
    one = lambda t: F.substring(t["text"], t["at"] * step + 1, F.lit(size))
    return (
        F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: one({"text": s, "at": i})))
        .otherwise(F.array().cast("array<string>"))
    )


def windows(s: Column, size: int, step: int = 1, least: int | None = None, block: int | None = None, blocks: int | None = None) -> Column:
    """The substrings of `size` characters from every step-th place on, in order; with `least`, also those cut short by the text's end that have so many.

    `block`: places of a block; `blocks`: blocks of a stretch.
    """
    least, block, many = size if least is None else least, block or BLOCK, blocks or BLOCKS
    within = step * block
    whole = within * many
    # stretches and blocks hold size - step characters more than are theirs, for the pieces that begin in them; what begins there is the next one's
    of = lambda t: F.slice(_pieces(t, within + size - step, within, 1), 1, many)
    parts = (
        F.transform(
            _pieces(s, whole + size - step, whole, 1),
            lambda t: F.transform(of(t), lambda b: F.slice(_pieces(b, size, step, least), 1, block)),
        )
    )
    return F.flatten(F.flatten(parts))


def kmers(s: Column, k: int) -> Column:
    """All k-mers without N, in order, repeats included."""
    return F.filter(windows(s, k), lambda x: ~x.contains("N"))


def kmers_apart(s: Column, k: int) -> Column:
    """Every k-th k-mer of each stretch between N's."""
    return F.flatten(F.transform(F.split(s, "N+"), lambda part: windows(part, k, k)))


def kmer_code(kmer: Column, k: int) -> Column:
    """Two bits a base, first base highest."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def plain_kmer(kmer: Column) -> Column:
    """False for the k-mers that count as simple: A in all but the last place."""
    return ~kmer.rlike("^A*.$")


def tandem_right(s: Column) -> Column:
    """A sequence begins with three copies of a unit of 1 to 6 bases."""
    return s.rlike(r"^(.{1,6})\1\1")


def tandem_left(s: Column) -> Column:
    """A sequence ends with three copies of a unit of 1 to 6 bases."""
    return F.reverse(s).rlike(r"^(.{1,6})\1\1")


def triple_repeat(unit: Column, context: Column) -> Column:
    """The context begins with three copies of an indel of up to 5 bases."""
    return (F.length(unit) <= 5) & (F.length(unit) > 0) & context.startswith(F.repeat(unit, F.lit(3)))


def homopolymer_at(s: Column, at: Column, n: int = 5) -> Column:
    """n equal bases from a place (1-based)."""
    return F.substring(s, at, F.lit(n)) == F.repeat(F.substring(s, at, F.lit(1)), n)


def compress_runs(s: Column) -> Column:
    """Runs of 3 or more of a base become one."""
    return F.regexp_replace(s, r"(.)\1{2,}", "$1")


def compress_homopolymers(s: Column) -> Column:
    """compress_runs(); then runs of 3 or more of a pair become one pair."""
    return F.regexp_replace(compress_runs(s), r"(..)\1{2,}", "$1")


def contig_class(name: Column) -> Column:
    """autosome, sex or other; a chr prefix and what follows a colon are left aside. Any whole number from 1 is an autosome."""
    core = F.regexp_replace(F.regexp_replace(name, ":.*$", ""), "^chr", "")
    return F.when(core.isin("X", "Y"), "sex").when(core.rlike("^0*[1-9][0-9]*$"), "autosome").otherwise("other")


def qualities(text: Column) -> Column:
    """Phred+33 text as an array of numbers."""
    return F.transform(F.split(text, ""), lambda c: F.ascii(c) - 33)
