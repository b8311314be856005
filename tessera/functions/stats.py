"""Statistics as Column expressions over counts and sums, and the two tail probabilities.

Everything but the tails is plain arithmetic, so it stays in generated code and other engines can
state the same formula.  Undefined values are null.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(a, b) -> Column:
    return F.try_divide(a, b)


def pearson(n, sx, sxx, sy, syy, sxy) -> Column:
    """Pearson correlation from sums; null where a side is constant."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((vx > 1e-12) & (vy > 1e-12), (n * sxy - sx * sy) / F.sqrt(vx * vy))


def partial(rxy, rxz, ryz) -> Column:
    """Correlation of x and y without what z explains of both."""
    left = (1 - rxz * rxz) * (1 - ryz * ryz)
    return F.when(left > 1e-12, (rxy - rxz * ryz) / F.sqrt(left))


def sign_moments(n, pos, neg) -> tuple[Column, Column]:
    """(mean, sample variance) of a sign in {-1, 0, 1} from counts."""
    mean = ratio((pos - neg).cast("double"), n)
    return mean, ratio((pos + neg) - n * mean * mean, n - 1)


def welch_signs(n1, p1, q1, n2, p2, q2) -> dict[str, Column]:
    """Contrast of mean signs inside and outside, from counts of + and - on each side."""
    m1, v1 = sign_moments(n1, p1, q1)
    m2, v2 = sign_moments(n2, p2, q2)
    constant = lambda n, p, q: (p == n) | (q == n) | (p + q == 0)
    usable = (n1 >= 2) & (n2 >= 2) & ~(constant(n1, p1, q1) & constant(n2, p2, q2))
    e1, e2 = ratio(v1, n1), ratio(v2, n2)
    t = ratio(m1 - m2, F.sqrt(e1 + e2))
    df = ratio((e1 + e2) * (e1 + e2), ratio(e1 * e1, n1 - 1) + ratio(e2 * e2, n2 - 1))
    d = ratio(m1 - m2, F.sqrt((v1 + v2) / 2))
    return {"delta": m1 - m2, "welch_t": F.when(usable, t), "welch_df": F.when(usable, df), "cohens_d": F.when(usable, d)}


def yates_chi2(a, nx, ny, n, scale=1.0) -> Column:
    """Continuity-corrected chi-square of a 2x2 table given its corner, margins and total."""
    a, nx, ny, n = (x.cast("double") for x in (a, nx, ny, n))
    b, c = nx - a, ny - a
    d = n - a - b - c
    gap = F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0))
    under = (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(under > 0, n * gap * gap / under).otherwise(0.0) * scale


def mcnemar_chi2(b01, b10) -> Column:
    gap = F.greatest(F.abs(b01 - b10) - 1, F.lit(0)).cast("double")
    return F.when(b01 + b10 > 0, gap * gap / (b01 + b10)).otherwise(0.0)


def wilson_lower(k, n, z: float = 1.96) -> Column:
    """Lower bound of the Wilson interval; 0 without trials."""
    n = n.cast("double")
    p = ratio(k.cast("double"), n)
    under = 1 + z * z / n
    bound = (p + z * z / (2 * n)) / under - (z / under) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, bound).otherwise(0.0)


def mutual_information(n11, nx, ny, n) -> Column:
    """Mutual information (nats) of two indicators from counts; 0 log 0 is 0."""
    n11, nx, ny, n = (x.cast("double") for x in (n11, nx, ny, n))

    def term(joint, a, b):
        return F.when(joint > 0, joint / n * F.log(joint * n / (a * b))).otherwise(0.0)

    return term(n11, nx, ny) + term(nx - n11, nx, n - ny) + term(ny - n11, n - nx, ny) + term(n - nx - ny + n11, n - nx, n - ny)


def _beta_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t: the regularised incomplete beta function by Lentz's fraction."""
    if not (math.isfinite(t) and math.isfinite(df)) or df <= 0:
        return math.nan
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x <= 0 or x >= 1:
        return 1.0 if x >= 1 else 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        x, a, b = 1 - x, b, a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    tail = front * total / a
    return 1 - tail if swap else tail


@F.pandas_udf(T.DoubleType())
def t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of Student's t."""
    return pd.Series([_beta_tail(a, b) for a, b in zip(t.fillna(np.nan), df.fillna(np.nan), strict=True)])


@F.pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series) -> pd.Series:
    """Upper tail of chi-square with one degree of freedom."""
    return x.map(lambda v: math.erfc(math.sqrt(v / 2)) if v == v else math.nan)


def correlation_p(r, n) -> Column:
    """Two-sided p-value of a Pearson correlation of n pairs; 0 where the pairs lie on a line, 1 for two pairs."""
    t = F.when(F.abs(r) < 1, r * F.sqrt((n - 2) / (1 - r * r)))
    return F.when(n <= 2, F.when(r.isNotNull(), F.lit(1.0))).when(F.abs(r) >= 1, F.lit(0.0)).otherwise(t_tail(t, (n - 2).cast("double")))


def bonferroni(p, tests) -> Column:
    return F.least(p * tests, F.lit(1.0))
