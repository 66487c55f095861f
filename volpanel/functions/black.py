"""Option value on a forward under the lognormal model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.functions.mathx import normal_cdf

MIN_SIGMA = 1e-6
MIN_TAU = 1e-8


def with_black_price(
    df: DataFrame,
    sigma: str,
    out: str,
    forward: str = "forward_price",
    strike: str = "strike",
    tau: str = "tau",
    discount: str = "discount_factor",
    option_type: str = "option_type",
) -> DataFrame:
    """Add the discounted value of each contract; staged columns keep the expressions small."""
    width = F.greatest(F.col(sigma), F.lit(MIN_SIGMA)) * F.sqrt(F.greatest(F.col(tau), F.lit(MIN_TAU)))
    staged = df.withColumn("_width", width).withColumn(
        "_d1", F.ln(F.col(forward) / F.col(strike)) / F.col("_width") + 0.5 * F.col("_width")
    )
    side = F.when(F.col(option_type) == "C", F.lit(1.0)).otherwise(F.lit(-1.0))
    staged = (
        staged.withColumn("_side", side)
        .withColumn("_n1", normal_cdf(F.col("_side") * F.col("_d1")))
        .withColumn("_n2", normal_cdf(F.col("_side") * (F.col("_d1") - F.col("_width"))))
    )
    price = F.col(discount) * F.col("_side") * (
        F.col(forward) * F.col("_n1") - F.col(strike) * F.col("_n2")
    )
    return staged.withColumn(out, price).drop("_width", "_d1", "_side", "_n1", "_n2")
