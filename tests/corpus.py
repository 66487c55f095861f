"""Synthetic daily archives from the published formulas, for the source and end-to-end tests."""

from __future__ import annotations

import csv
import io
import math
import zipfile
from datetime import date, timedelta
from pathlib import Path

from volpanel.sources.schema import DOCUMENTED_COLUMNS

RATIOS = (0.80, 0.85, 0.90, 0.95, 0.975, 1.00, 1.025, 1.05, 1.10, 1.15, 1.20)
EXPIRY_DAYS = (30, 60, 91, 182, 365)
RATE = 0.01


def business_days(count: int, start: date = date(2020, 1, 2)) -> list[date]:
    days, day = [], start
    while len(days) < count:
        if day.weekday() < 5:
            days.append(day)
        day += timedelta(days=1)
    return days


def phi(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def quote(day: date, i: int, root: str, days: int, ratio: float, side: str) -> dict[str, object]:
    spot = 3000.0 + 2.5 * i + 40.0 * math.sin(i / 7.0)
    tau, strike = days / 365.0, round(spot * ratio / 5.0) * 5.0
    forward, discount = spot * math.exp(RATE * tau), math.exp(-RATE * tau)
    sigma = 0.14 + (0.012 if root == "SPXW" else 0.0) + 0.03 * abs(math.log(strike / forward)) + 0.015 * tau + 0.01 * math.sin(i / 5.0)
    width = sigma * math.sqrt(tau)
    d1 = math.log(forward / strike) / width + 0.5 * width
    sign = 1.0 if side == "C" else -1.0
    price = discount * sign * (forward * phi(sign * d1) - strike * phi(sign * (d1 - width)))
    spread = max(0.05, 0.01 * price)
    vega = discount * forward * math.exp(-0.5 * d1 * d1) / math.sqrt(2.0 * math.pi) * math.sqrt(tau)
    return {
        "underlying_symbol": "^SPX",
        "quote_date": day.isoformat(),
        "root": root,
        "expiration": (day + timedelta(days=days)).isoformat(),
        "strike": f"{strike:.3f}",
        "option_type": side,
        "bid_1545": f"{max(0.01, price - spread / 2):.4f}",
        "ask_1545": f"{price + spread / 2:.4f}",
        "active_underlying_price_1545": f"{spot:.4f}",
        "implied_volatility_1545": f"{sigma:.4f}",
        "delta_1545": f"{phi(d1) - (0.0 if side == 'C' else 1.0):.4f}",
        "vega_1545": f"{vega:.4f}",
        "trade_volume": "100",
        "open_interest": "1000",
        "underlying_bid_1545": f"{spot - 0.1:.4f}",
        "underlying_ask_1545": f"{spot + 0.1:.4f}",
    }


def day_quotes(day: date, i: int, roots=("SPX",)) -> list[dict[str, object]]:
    return [
        quote(day, i, root, days, ratio, side)
        for root in roots for days in EXPIRY_DAYS for ratio in RATIOS for side in ("C", "P")
    ]


def write_archive(path: Path, rows: list[dict[str, object]], columns=DOCUMENTED_COLUMNS, members: int = 1) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    text = io.StringIO()
    writer = csv.DictWriter(text, columns, restval="", extrasaction="ignore", lineterminator="\n")
    writer.writeheader()
    writer.writerows(rows)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for n in range(members):
            archive.writestr(f"part{n}.csv", text.getvalue())


def archive_name(day: date) -> str:
    return f"UnderlyingOptionsEODCalcs_{day.isoformat()}.zip"


def write_corpus(root: Path, count: int, roots=("SPX",), nested: bool = False) -> list[date]:
    days = business_days(count)
    for i, day in enumerate(days):
        folder = root / str(day.year) / f"{day.month:02d}" if nested else root
        write_archive(folder / archive_name(day), day_quotes(day, i, roots))
    return days
