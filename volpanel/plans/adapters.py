"""Views of the given tables in the shape of the option panel, for Spark and as oracle SQL text.

``quotes`` and ``chain`` read every row of ``lineitem``; ``daily`` reads ``orders``; ``loss`` and
``headers`` read ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNDERLYING = "^IDX"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- row-level quotes -------------------------------------------------------------------------

QUOTES_SQL = """
quotes AS (
  SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS quote_date,
         '^IDX' AS underlying_symbol, l_returnflag AS root,
         CAST(l_shipdate AS DATE) + CAST(l_linenumber*125-120 AS INT) AS expiration,
         l_quantity AS strike, CASE WHEN l_linestatus='O' THEN 'C' ELSE 'P' END AS option_type,
         l_extendedprice/1000.0e0 AS bid_1545,
         l_extendedprice/1000.0e0 + l_tax - 0.005e0 AS ask_1545,
         l_discount AS implied_volatility_1545, l_quantity/10.0e0 AS vega_1545,
         l_extendedprice/l_quantity AS active_underlying_price_1545,
         CAST(l_quantity AS BIGINT) AS trade_volume, l_partkey AS open_interest,
         nullif(l_discount, 0.0e0) AS underlying_bid_1545, nullif(l_tax, 0.0e0) AS underlying_ask_1545
  FROM lineitem)
"""


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_columns(table(spark, sf_dir, "lineitem"))


def quote_columns(lineitem: DataFrame) -> DataFrame:
    """Quote view of line items, batch or stream."""
    date = F.to_date("l_shipdate")
    bid = F.col("l_extendedprice") / 1000.0
    return lineitem.select(
        "l_orderkey",
        "l_linenumber",
        date.alias("quote_date"),
        F.lit(UNDERLYING).alias("underlying_symbol"),
        F.col("l_returnflag").alias("root"),
        F.date_add(date, F.col("l_linenumber") * 125 - 120).alias("expiration"),
        F.col("l_quantity").alias("strike"),
        F.when(F.col("l_linestatus") == "O", "C").otherwise("P").alias("option_type"),
        bid.alias("bid_1545"),
        (bid + F.col("l_tax") - 0.005).alias("ask_1545"),
        F.col("l_discount").alias("implied_volatility_1545"),
        (F.col("l_quantity") / 10.0).alias("vega_1545"),
        F.try_divide("l_extendedprice", "l_quantity").alias("active_underlying_price_1545"),
        F.col("l_quantity").cast("bigint").alias("trade_volume"),
        F.col("l_partkey").alias("open_interest"),
        F.nullif("l_discount", F.lit(0.0)).alias("underlying_bid_1545"),
        F.nullif("l_tax", F.lit(0.0)).alias("underlying_ask_1545"),
    )


QUALITY_SQL = """option_type IN ('C','P') AND strike > 0 AND quote_date < expiration
  AND expiration - quote_date BETWEEN 10 AND 730 AND bid_1545 > 0 AND ask_1545 > 0 AND ask_1545 >= bid_1545
  AND implied_volatility_1545 > 0 AND vega_1545 > 0 AND active_underlying_price_1545 > 0"""


# --- option chain -----------------------------------------------------------------------------

CHAIN_SQL = """
legs AS (
  SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS quote_date,
         CAST(date_trunc('quarter', l_shipdate) AS DATE) AS quarter_date, l_returnflag AS root, l_linenumber AS expiry_no, CAST(ceil(l_quantity/5.0e0) AS INT)*100.0e0 AS strike,
         CASE WHEN l_linestatus='O' THEN 'C' ELSE 'P' END AS option_type,
         avg(l_tax) AS mean_tax, avg(l_discount) AS mean_discount, sum(l_quantity) AS quantity,
         CAST(count(*) AS BIGINT) AS trade_volume
  FROM lineitem GROUP BY 1,2,3,4,5,6),
priced AS (
  SELECT quote_date, root, root AS option_root,
         CAST(quarter_date + to_months(CAST(3*expiry_no AS INT)) AS DATE) AS expiration, strike, option_type,
         (CASE WHEN option_type='C' THEN greatest(550.0e0-strike,0.0e0) ELSE greatest(strike-550.0e0,0.0e0) END)
           + 40.0e0 + 100.0e0*mean_tax AS mid_1545,
         0.01e0+mean_discount AS spread_1545, 0.1e0+mean_tax*2.0e0 AS implied_volatility_1545,
         1.0e0+quantity/100.0e0 AS vega_1545,
         CASE WHEN option_type='C' THEN 0.5e0 ELSE -0.5e0 END AS delta_1545,
         550.0e0+10.0e0*mean_discount AS active_underlying_price_1545,
         trade_volume, 10*trade_volume AS open_interest
  FROM legs),
chain AS (
  SELECT *, mid_1545 - 0.5e0*spread_1545 AS bid_1545, mid_1545 + 0.5e0*spread_1545 AS ask_1545,
         spread_1545/greatest(mid_1545, 1.0e-6) AS rel_spread_1545,
         CAST(expiration - quote_date AS INT) AS dte_days, (expiration - quote_date)/365.0e0 AS tau
  FROM priced)
"""


def monthly_sql(text: str) -> str:
    """The same oracle text over monthly instead of quarterly quote dates."""
    return text.replace(
        "date_trunc('quarter', l_shipdate) AS DATE) AS quote_date", "date_trunc('month', l_shipdate) AS DATE) AS quote_date"
    )


def chain(spark: SparkSession, sf_dir: str, period: str = "quarter") -> DataFrame:
    """Option chain per quarter, or per month so that contracts live on past the next quote date."""
    legs = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.trunc(F.to_date("l_shipdate"), period).alias("quote_date"),
            F.trunc(F.to_date("l_shipdate"), "quarter").alias("quarter_date"),
            F.col("l_returnflag").alias("root"),
            F.col("l_linenumber").alias("expiry_no"),
            (F.ceil(F.col("l_quantity") / 5.0) * 100.0).alias("strike"),
            F.when(F.col("l_linestatus") == "O", "C").otherwise("P").alias("option_type"),
        )
        .agg(
            F.avg("l_tax").alias("mean_tax"),
            F.avg("l_discount").alias("mean_discount"),
            F.sum("l_quantity").alias("quantity"),
            F.count(F.lit(1)).alias("trade_volume"),
        )
    )
    strike, call = F.col("strike"), F.col("option_type") == "C"
    intrinsic = F.when(call, F.greatest(550.0 - strike, F.lit(0.0))).otherwise(F.greatest(strike - 550.0, F.lit(0.0)))
    priced = legs.select(
        "quote_date",
        "root",
        F.col("root").alias("option_root"),
        F.add_months("quarter_date", F.col("expiry_no") * 3).alias("expiration"),
        "strike",
        "option_type",
        (intrinsic + 40.0 + 100.0 * F.col("mean_tax")).alias("mid_1545"),
        (0.01 + F.col("mean_discount")).alias("spread_1545"),
        (0.1 + F.col("mean_tax") * 2.0).alias("implied_volatility_1545"),
        (1.0 + F.col("quantity") / 100.0).alias("vega_1545"),
        F.when(call, 0.5).otherwise(-0.5).alias("delta_1545"),
        (550.0 + 10.0 * F.col("mean_discount")).alias("active_underlying_price_1545"),
        "trade_volume",
        (F.col("trade_volume") * 10).alias("open_interest"),
    )
    mid, spread = F.col("mid_1545"), F.col("spread_1545")
    dte = F.datediff("expiration", "quote_date")
    return priced.withColumns(
        {
            "bid_1545": mid - 0.5 * spread,
            "ask_1545": mid + 0.5 * spread,
            "rel_spread_1545": spread / F.greatest(mid, F.lit(1e-6)),
            "dte_days": dte,
            "tau": dte / 365.0,
        }
    )


# --- daily state panel ------------------------------------------------------------------------

DAILY_SQL = """
daily AS (
  SELECT CAST(o_orderdate AS DATE) AS quote_date, o_orderstatus AS option_root,
         CAST(count(*) AS BIGINT) AS total_trade_volume,
         CAST(sum(CAST(floor(o_totalprice/1000.0e0) AS BIGINT)) AS BIGINT) AS total_open_interest,
         avg(o_totalprice) AS active_underlying_price_1545,
         CASE WHEN count(*) > 2 THEN CAST(count(*) AS DOUBLE)/100.0e0 END AS surface_fit_rmse_iv,
         CASE WHEN count(*) <> 3 THEN 0.01e0*count(*) END AS median_rel_spread_1545,
         CAST(10*count(*) AS BIGINT) AS surface_node_count, CAST(least(count(*), 5) AS BIGINT) AS valid_expiry_count,
         count(*) >= 2 AS has_state
  FROM orders GROUP BY 1, 2),
state AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY option_root ORDER BY quote_date) - 1 AS BIGINT) AS state_row_index,
         ln(active_underlying_price_1545) AS state_z_000, ln(total_open_interest + 1.0e0) AS state_z_001
  FROM daily WHERE has_state)
"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.to_date("o_orderdate").alias("quote_date"), F.col("o_orderstatus").alias("option_root"))
        .agg(
            n.alias("total_trade_volume"),
            F.sum(F.floor(F.col("o_totalprice") / 1000.0)).alias("total_open_interest"),
            F.avg("o_totalprice").alias("active_underlying_price_1545"),
            F.when(n > 2, n.cast("double") / 100.0).alias("surface_fit_rmse_iv"),
            F.when(n != 3, 0.01 * n).alias("median_rel_spread_1545"),
            (n * 10).alias("surface_node_count"),
            F.least(n, F.lit(5)).cast("bigint").alias("valid_expiry_count"),
            (n >= 2).alias("has_state"),
        )
    )


def daily_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    from volpanel.operators.calendar import with_state_row_index

    states = daily(spark, sf_dir).where("has_state").withColumns(
        {
            "state_z_000": F.ln("active_underlying_price_1545"),
            "state_z_001": F.ln(F.col("total_open_interest") + 1.0),
        }
    )
    return with_state_row_index(states)


# --- model losses -----------------------------------------------------------------------------

LOSS_SQL = """
loss AS (
  SELECT 'value' AS metric, event_type AS model_name, CAST(ts AS DATE) AS target_date, avg(value)/100.0e0 AS loss
  FROM events GROUP BY 2, 3)
"""


def loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("model_name"), F.to_date("ts").alias("target_date"))
        .agg((F.avg("value") / 100.0).alias("loss"))
        .select(F.lit("value").alias("metric"), "model_name", "target_date", "loss")
    )


# --- file headers -----------------------------------------------------------------------------

HEADERS_SQL = """
seen AS (
  SELECT user_id, CAST(ts AS DATE) AS trade_date, event_type, min(ts) AS first_ts FROM events GROUP BY 1, 2, 3),
headers AS (
  SELECT user_id AS file_id, trade_date, list(event_type ORDER BY first_ts, event_type) AS header
  FROM seen GROUP BY 1, 2)
"""
REQUIRED_HEADER = ("click", "purchase", "view")
DOCUMENTED_HEADER = ("click", "purchase", "view", "signup")


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per user and day; its header is the order in which event types first appear."""
    seen = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("file_id"), F.to_date("ts").alias("trade_date"), "event_type")
        .agg(F.min("ts").alias("first_ts"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("first_ts", "event_type")))
    return seen.groupBy("file_id", "trade_date").agg(ordered.getField("event_type").alias("header"))


# --- surface states ---------------------------------------------------------------------------

QUARTER_SQL = """
quarter AS (
  SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS quote_date, l_returnflag AS option_root,
         avg(l_tax) AS t, avg(l_discount) AS d
  FROM lineitem GROUP BY 1, 2)
"""


def quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.trunc(F.to_date("l_shipdate"), "quarter").alias("quote_date"), F.col("l_returnflag").alias("option_root"))
        .agg(F.avg("l_tax").alias("t"), F.avg("l_discount").alias("d"))
    )


def latent_states(spark: SparkSession, sf_dir: str, eta_raw: float = -1.0, crossed: bool = False) -> DataFrame:
    """Latent states per quarter and root; ``crossed`` dents two knots so that the running maximum acts."""
    columns = {}
    for i in range(11):
        dent = 0.006 if crossed and i in (3, 8) else 0.0
        columns[f"state_z_{i:03d}"] = F.ln(F.lit(0.02 + 0.004 * i - dent) + F.col("t") / 100.0)
    columns["state_z_011"] = F.col("d") - 0.35
    columns["state_z_012"] = F.lit(eta_raw) + F.col("d")
    columns["state_z_013"] = F.col("t") + 0.1
    return quarter(spark, sf_dir).withColumns(columns).drop("t", "d")


def latent_sql(eta_raw: float = -1.0, crossed: bool = False) -> str:
    parts = []
    for i in range(11):
        dent = 0.006 if crossed and i in (3, 8) else 0.0
        parts.append(f"ln({0.02 + 0.004 * i - dent!r}e0 + t/100.0e0) AS state_z_{i:03d}")
    return QUARTER_SQL + f""",
latent AS (
  SELECT quote_date, option_root, {', '.join(parts)},
         d - 0.35e0 AS state_z_011, {eta_raw!r}e0 + d AS state_z_012, t + 0.1e0 AS state_z_013
  FROM quarter)
"""


