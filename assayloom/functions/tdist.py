"""Two-sided Student t probability as a column expression.

p = I_x(v/2, 1/2) with x = v / (v + t^2). The regularised incomplete beta is summed by its continued
fraction with a fixed number of levels, evaluated from the inside out, and its prefactor in logs. For
integer degrees of freedom the log gamma ratio is a finite sum, so only built-in functions are needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = 200


def _log_beta_half(dof: Column) -> Column:
    """ln B(v/2, 1/2) for integer v >= 1, by the recurrence B(a+1, 1/2) = B(a, 1/2) * a / (a + 1/2)."""
    odd = dof % 2 == 1
    start = F.when(odd, F.lit(0.5)).otherwise(F.lit(1.0))
    base = F.when(odd, F.log(F.pi())).otherwise(F.log(F.lit(2.0)))
    steps = F.when(odd, (dof - 1) / 2).otherwise((dof - 2) / 2).cast("int")
    terms = F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>"))
    return base + F.aggregate(
        terms, F.lit(0.0), lambda s, i: s + F.log((start + i) / (start + i + F.lit(0.5)))
    )


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta, from level LEVELS down to 1.

    Terms: d_2m = m (b - m) x / ((a + 2m - 1)(a + 2m)), d_2m+1 = -(a + m)(a + b + m) x / ((a + 2m)(a + 2m + 1)).
    """
    levels = F.sequence(F.lit(LEVELS), F.lit(1), F.lit(-1))

    def term(j):
        m = F.floor(j / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(j % 2 == 0, even).otherwise(odd)

    return F.lit(1.0) / F.aggregate(levels, F.lit(1.0), lambda tail, j: F.lit(1.0) + term(j) / tail)


def two_sided_p(t: Column, dof: Column) -> Column:
    """P(|T| >= |t|); 1 for t = 0, null for undefined t."""
    v = dof.cast("double")
    t2 = t * t
    x = v / (v + t2)
    # the complement keeps its digits when x is close to 1
    y = t2 / (v + t2)
    a, b = v / 2, F.lit(0.5)
    front = F.exp(a * F.log(x) + b * F.log(y) - _log_beta_half(dof.cast("int")))
    direct = front * _fraction(a, b, x) / a
    mirrored = F.lit(1.0) - front * _fraction(b, a, y) / b
    return F.when(t2 == 0, F.lit(1.0)).when(x < (a + 1) / (a + b + 2), direct).otherwise(mirrored)
