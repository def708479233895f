"""Special functions and small linear systems as column expressions."""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps at most of the gamma series and fraction: enough for a double's precision with shapes up to a million.
MOST_STEPS = 10_000


def log_gamma(a: Column) -> Column:
    """ln of the gamma function for a > 0: Stirling's series ten places up, and the product in between taken off."""
    z = a + 10
    product = a
    for i in range(1, 10):
        product = product * (a + i)
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3))) + 1 / (1260 * F.pow(z, F.lit(5))) - 1 / (1680 * F.pow(z, F.lit(7)))
    return (z - 0.5) * F.log(z) - z + 0.5 * log(2 * pi) + series - F.log(product)


def gamma_upper(a: Column, x: Column) -> Column:
    """The regularised upper incomplete gamma function Q(a, x), a > 0; 1 where x <= 0, null for an a that is not above 0 or a null.

    Below a + 1 one minus the power series, above it the continued fraction from its far end: folds over as many steps
    as the shape needs (some tens of them, and nine times its root).
    """
    a, x = a.cast("double"), x.cast("double")
    most = lambda least: F.least(F.lit(MOST_STEPS), F.ceil(least + 9 * F.sqrt(F.greatest(a, F.lit(0.0)))).cast("int"))
    n = F.sequence(F.lit(1), most(30))
    front = F.exp(a * F.log(x) - x - log_gamma(a))
    one = F.struct((1 / a).alias("term"), (1 / a).alias("sum"))
    grow = lambda s, i: F.struct((s["term"] * x / (a + i)).alias("term"), (s["sum"] + s["term"] * x / (a + i)).alias("sum"))
    series = front * F.aggregate(n, one, grow)["sum"]
    down = F.sequence(most(90), F.lit(1), F.lit(-1))
    tail = F.aggregate(down, F.lit(0.0), lambda s, i: -i * (i - a) / (x + 2 * i + 1 - a + s))
    fraction = front / (x + 1 - a + tail)
    q = F.when(x <= 0, 1.0).when(x < a + 1, 1 - series).otherwise(fraction)
    return F.when((a > 0) & x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), q)))


def solve(system: Column, size: int, least: float = 1e-10) -> Column:
    """The solution of a small symmetric positive system, given as ``size`` rows of coefficients and the right side.

    Gauss-Jordan elimination as a fold over the pivots; null if a pivot is below ``least`` of its first value, that is if
    the columns depend on each other.
    """
    diagonal = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: system[i][i])

    def clear(m: Column, k: Column) -> Column:
        pivot = m[k][k]
        row = F.transform(m[k], lambda v: F.when(pivot > least * diagonal[k], v / pivot))
        return F.transform(m, lambda r, i: F.when(i == k, row).otherwise(F.zip_with(r, row, lambda v, p: v - r[k] * p)))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), system, clear)
    out = F.transform(done, lambda r: r[size])
    return F.when(~F.exists(out, lambda v: v.isNull() | F.isnan(v)), out)
