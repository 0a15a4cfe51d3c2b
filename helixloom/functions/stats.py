"""Statistics as column expressions: factorials, Fisher's test, binomial masses, qualities."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ln n! up to here comes from a constant table made by a running sum, beyond from Stirling's series, which is exact to 2e-12 there.
TABLE = 16
_LN_FACT = [0.0]
for _n in range(1, TABLE + 1):
    _LN_FACT.append(_LN_FACT[-1] + math.log(_n))


def ln_fact(n: Column) -> Column:
    x = n.cast("double")
    far = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + (1 / 12 - (1 / 360 - 1 / (1260 * x * x)) / (x * x)) / x
    return F.when(n <= TABLE, F.get(F.lit(_LN_FACT), n.cast("int"))).otherwise(far)


def clamped_log10(x: Column, least: float = 1e-300) -> Column:
    """The decimal logarithm of a probability, which is taken as at least `least`."""
    return F.log10(F.greatest(x, F.lit(least)))


def ln_choose(n: Column, k: Column) -> Column:
    return ln_fact(n) - ln_fact(k) - ln_fact(n - k)


def ln_beta(a: Column, b: Column) -> Column:
    """ln B(a, b) of positive whole numbers."""
    return ln_fact(a - 1) + ln_fact(b - 1) - ln_fact(a + b - 1)


def ln_binomial(k: Column, n: Column, p: Column) -> Column:
    return ln_choose(n, k) + k * F.log(p) + (n - k) * F.log(1 - p)


def ln_beta_binomial(k: Column, n: Column, a: Column, b: Column) -> Column:
    return ln_choose(n, k) + ln_beta(k + a, n - k + b) - ln_beta(a, b)


def ln_hypergeometric(a: Column, b: Column, c: Column, d: Column) -> Column:
    """ln of the mass of a 2x2 table given its margins."""
    return ln_fact(a + b) + ln_fact(c + d) + ln_fact(a + c) + ln_fact(b + d) - ln_fact(a + b + c + d) - ln_fact(a) - ln_fact(b) - ln_fact(c) - ln_fact(d)


def _tables(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """Masses of the tables with these margins relative to the table's own: below it and above it, each (its w now, sum of all, sum of those no likelier).

    Neighbouring masses differ by a simple ratio, so no factorials are needed and nothing cancels.
    """
    a, rows, cols, rest = a.cast("double"), (a + b).cast("double"), (a + c).cast("double"), (d - a).cast("double")
    at, lo, hi = a.cast("long"), F.greatest(F.lit(0.0), -rest).cast("long"), F.least(rows, cols).cast("long")
    none = F.array().cast("array<bigint>")
    zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("all"), F.lit(0.0).alias("less"))

    def sums(x: Column, ratio: Callable[[Column], Column]) -> Column:
        def add(s: Column, k: Column) -> Column:
            return F.transform(F.array(s["w"] * ratio(k.cast("double"))), lambda w: F.struct(w.alias("w"), (s["all"] + w).alias("all"), (s["less"] + F.when(w <= 1 + 1e-9, w).otherwise(0.0)).alias("less")))[0]

        return F.aggregate(x, zero, add)

    up = sums(F.when(hi > at, F.sequence(at + 1, hi)).otherwise(none), lambda x: (rows - x + 1) * (cols - x + 1) / (x * (rest + x)))
    down = sums(F.when(at > lo, F.sequence(at, lo + 1)).otherwise(none), lambda x: x * (rest + x) / ((rows - x + 1) * (cols - x + 1)))
    return down, up


def fisher_two_sided(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Share of all tables with these margins that are no likelier, up to a relative 1e-9, than the table itself."""
    down, up = _tables(a, b, c, d)
    return (1 + down["less"] + up["less"]) / (1 + down["all"] + up["all"])


def fisher_left(a: Column, b: Column, c: Column, d: Column) -> Column:
    """P(first cell <= a)."""
    down, up = _tables(a, b, c, d)
    return (1 + down["all"]) / (1 + down["all"] + up["all"])


def fisher_right(a: Column, b: Column, c: Column, d: Column) -> Column:
    """P(first cell >= a)."""
    down, up = _tables(a, b, c, d)
    return (1 + up["all"]) / (1 + down["all"] + up["all"])


def strand_bias_p(forward: Column, reverse: Column) -> Column:
    """Two-sided p of alt reads by strand against an even split; null without alt reads to split."""
    e = F.floor((forward + reverse) / 2).cast("long")
    return F.when(e > 0, fisher_two_sided(forward.cast("long"), reverse.cast("long"), e, e))


def variant_qual(ref: Column, alt: Column, error: float = 0.001, log10_error: float = -3.0, most: int = 60) -> Column:
    return F.least(F.lit(most), (-10 * (ref * math.log10(1 - error) + alt * log10_error)).cast("int"))


def phred_likelihoods(ref: Column, alt: Column, error: float = 0.001, log10_error: float = -3.0, log10_two: float = 0.301023) -> Column:
    """Truncated phred likelihoods of the genotypes 0/0, 0/1 and 1/1."""
    right = math.log10(1 - error)
    return (
        F.array(
            (-10 * (ref * right + alt * log10_error)).cast("int"), (10 * (ref + alt) * log10_two).cast("int"),
            (-10 * (ref * log10_error + alt * right)).cast("int"),
        )
    )


def genotype_quality(ref: Column, alt: Column, most: int = 60) -> Column:
    """Second least less least of the three likelihoods."""
    pl = F.array_sort(phred_likelihoods(ref, alt))
    return F.least(F.lit(most), pl[1] - pl[0])


def lower_median(x: str) -> Column:
    """Aggregate: the lower median of a column, 0 of nothing."""
    return F.coalesce(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {x})"), F.lit(0.0))


def array_lower_median(values: Column) -> Column:
    s = F.array_sort(values)
    return F.when(F.size(s) > 0, F.get(s, F.floor((F.size(s) - 1) / 2).cast("int"))).otherwise(0)


def error_rate(quality: Column) -> Column:
    """Aggregate: mean error probability of phred qualities."""
    return F.avg(F.pow(F.lit(10.0), -quality / 10))
