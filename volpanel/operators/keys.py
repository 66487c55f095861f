"""Column names shared by the operators. All of them can be overridden by argument."""

CONTRACT_KEY = ("quote_date", "underlying_symbol", "root", "expiration", "strike", "option_type")
EXPIRY_KEY = ("quote_date", "root", "expiration")
NODE_KEY = (*EXPIRY_KEY, "strike")
PANEL_KEY = ("option_root",)
STATE_KEY = ("option_root", "quote_date")
FORECAST_KEY = ("model_name", "option_root", "forecast_origin", "target_date")
