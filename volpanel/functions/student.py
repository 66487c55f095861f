"""Student-t tail probability; the one statistic that needs a special function Spark lacks.

It only ever sees result rows (one per model pair), never the loss panel.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _two_sided_tail():
    # Built as a closure so that executors need no copy of this package.
    def two_sided_tail(statistic: pd.Series, degrees: pd.Series) -> pd.Series:
        import math

        import numpy as np

        def beta_fraction(a, b, x):
            tiny = 1e-300
            c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
            d = 1.0 / (d if abs(d) > tiny else tiny)
            total = d
            k = 0
            while total == total:
                k += 1
                for term in (
                    k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)),
                    -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1)),
                ):
                    d = 1.0 + term * d
                    d = 1.0 / (d if abs(d) > tiny else tiny)
                    c = 1.0 + term / c
                    c = c if abs(c) > tiny else tiny
                    total *= c * d
                if abs(c * d - 1.0) < 1e-15:
                    break
            return total

        def regularized_beta(a, b, x):
            if x <= 0.0 or x >= 1.0:
                return 0.0 if x <= 0.0 else 1.0
            log_front = (
                math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                + a * math.log(x) + b * math.log1p(-x)
            )
            front = math.exp(log_front)
            if x < (a + 1.0) / (a + b + 2.0):
                return front * beta_fraction(a, b, x) / a
            return 1.0 - front * beta_fraction(b, a, 1.0 - x) / b

        out = [
            np.nan if (t is None or n is None or t != t or n != n) else regularized_beta(n / 2.0, 0.5, n / (n + t * t))
            for t, n in zip(statistic, degrees)
        ]
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(two_sided_tail, "double")


def student_t_two_sided(statistic: Column, degrees: Column) -> Column:
    return _two_sided_tail()(statistic.cast("double"), degrees.cast("double"))
