"""Column contract of the daily quote files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names and types of the quote files.
REQUIRED_COLUMNS = (
    "underlying_symbol", "quote_date", "root", "expiration", "strike", "option_type",
    "bid_1545", "ask_1545", "active_underlying_price_1545", "implied_volatility_1545",
    "delta_1545", "vega_1545", "trade_volume", "open_interest",
)
CALCS_COLUMNS = ("active_underlying_price_1545", "implied_volatility_1545", "delta_1545", "vega_1545")
OPTIONAL_COLUMNS = (
    "gamma_1545", "theta_1545", "rho_1545", "bid_eod", "ask_eod", "vwap", "open", "high", "low", "close",
    "implied_underlying_price_1545", "delivery_code", "bid_size_1545", "ask_size_1545", "bid_size_eod",
    "ask_size_eod", "underlying_bid_1545", "underlying_ask_1545", "underlying_bid_eod", "underlying_ask_eod",
)
DOCUMENTED_COLUMNS = REQUIRED_COLUMNS + OPTIONAL_COLUMNS

STRING_COLUMNS = ("underlying_symbol", "root", "option_type", "delivery_code")
DATE_COLUMNS = ("quote_date", "expiration")
LONG_COLUMNS = (
    "trade_volume", "bid_size_1545", "ask_size_1545", "bid_size_eod", "ask_size_eod", "open_interest",
)


def column_type(name: str) -> T.DataType:
    if name in STRING_COLUMNS:
        return T.StringType()
    if name in DATE_COLUMNS:
        return T.DateType()
    return T.LongType() if name in LONG_COLUMNS else T.DoubleType()


def quote_schema() -> T.StructType:
    return T.StructType([T.StructField(name, column_type(name)) for name in DOCUMENTED_COLUMNS])


def header_report(
    header: Column,
    required: tuple[str, ...] = REQUIRED_COLUMNS,
    documented: tuple[str, ...] = DOCUMENTED_COLUMNS,
    calcs: tuple[str, ...] = CALCS_COLUMNS,
) -> dict[str, Column]:
    """Missing and extra columns of one file header and whether it passes."""
    def literal(names: tuple[str, ...]) -> Column:
        return F.array(*[F.lit(n) for n in names])

    missing = F.array_sort(F.array_except(literal(required), header))
    return {
        "missing_required_columns": missing,
        "missing_calcs_columns": F.array_sort(F.array_except(literal(calcs), header)),
        "extra_columns": F.array_sort(F.array_except(header, literal(documented))),
        "pass_status": F.size(missing) == 0,
    }
