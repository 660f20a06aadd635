"""Closed-form statistics as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-sided 95 % points of the normal and of Student's t for 1..30 degrees of freedom.
NORMAL_975 = 1.959963984540054
T_975 = (
    12.706204736, 4.302652730, 3.182446305, 2.776445105, 2.570581836, 2.446911851, 2.364624252,
    2.306004135, 2.262157163, 2.228138852, 2.200985160, 2.178812830, 2.160368656, 2.144786688,
    2.131449546, 2.119905299, 2.109815578, 2.100922040, 2.093024054, 2.085963447, 2.079613845,
    2.073873068, 2.068657610, 2.063898562, 2.059538553, 2.055529439, 2.051830516, 2.048407142,
    2.045229642, 2.042272456,
)


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a proportion; NULL where there is no trial."""
    n = F.when(n > 0, n.cast("double"))
    p = successes / n
    scale = 1 + F.lit(z * z) / n
    centre = (p + F.lit(z * z) / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n)) / scale
    return centre - half, centre + half


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: mean of ``value`` weighted by ``weight`` over rows where both are known."""
    known = value.isNotNull() & weight.isNotNull()
    return F.try_divide(F.sum(F.when(known, value * weight)), F.sum(F.when(known, weight)))


def pearson(x: Column | str, y: Column | str) -> Column:
    """Aggregate: Pearson correlation of complete pairs, NULL where either side is constant."""
    x, y = (F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def share(condition: Column) -> Column:
    """Aggregate: fraction of rows for which the condition holds (unknown counts as not)."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def clip(column: Column, low: float, high: float) -> Column:
    return F.when(column.isNotNull(), F.least(F.greatest(column, F.lit(low)), F.lit(high)))


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + c
    return total


# Hart's rational approximation of the normal tail (double precision).
HART_NUMERATOR = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
HART_DENOMINATOR = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)


def normal_cdf(z: Column) -> Column:
    """Normal distribution function; absolute error below 1e-14."""
    x = F.abs(z)
    density = F.exp(-x * x / 2)
    near = density * _horner(x, HART_NUMERATOR) / _horner(x, HART_DENOMINATOR)
    fraction = x + 0.65
    for step in (4.0, 3.0, 2.0, 1.0):
        fraction = x + F.lit(step) / fraction
    far = density / fraction / math.sqrt(2 * math.pi)
    tail = F.when(x > 37, F.lit(0.0)).when(x < 7.07106781186547, near).otherwise(far)
    return F.when(z > 0, 1 - tail).otherwise(tail)


def t_two_sided_p(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) for whole degrees of freedom: the finite trigonometric series."""
    theta = F.atan(F.abs(t) / F.sqrt(df))
    sine, cos2 = F.sin(theta), F.pow(F.cos(theta), 2)
    odd = df % 2 == 1
    start = F.when(odd, F.cos(theta)).otherwise(F.lit(1.0))
    terms = F.when(odd, F.floor((df - 1) / 2)).otherwise(F.floor(df / 2)).cast("int")

    def step(state: Column, i: Column) -> Column:
        ratio = F.when(odd, (2.0 * i) / (2.0 * i + 1)).otherwise((2.0 * i - 1) / (2.0 * i))
        term = state["term"] * ratio * cos2
        return F.struct((state["total"] + term).alias("total"), term.alias("term"))

    zero = F.struct(start.alias("total"), start.alias("term"))
    steps = F.when(terms > 1, F.sequence(F.lit(1), terms - 1)).otherwise(F.array().cast("array<int>"))
    series = F.aggregate(steps, zero, step)["total"]
    inside = F.when(df == 1, F.lit(2 / math.pi) * theta) \
        .when(odd, F.lit(2 / math.pi) * (theta + sine * series)) \
        .otherwise(sine * series)
    return 1 - inside


def t_quantile_975(df: Column) -> Column:
    """0.975 point of Student's t: table to 30 degrees of freedom, series expansion beyond."""
    z = NORMAL_975
    g1, g2 = (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    beyond = z + g1 / df + g2 / (df * df) + g3 / (df * df * df)
    return F.when(df <= 30, F.array(*[F.lit(v) for v in T_975])[(df - 1).cast("int")]).otherwise(beyond)
