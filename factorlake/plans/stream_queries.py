"""Queries of bars from events."""

from __future__ import annotations

from ..sources import adapter
from ..streaming import bars
from .registry import register, rounded, rounded_sql

_C = ("open", "high", "low", "close")
register(
    "stream_daily_bars",
    lambda s, d: bars.daily_bars(adapter.table(s, d, "events")).select("trade_date", "event_type", *[rounded(c, 4).alias(c) for c in _C], "n"),
    f"""SELECT ts::DATE AS trade_date, event_type, {rounded_sql('first(value ORDER BY ts, event_id)', 4)} AS open, {rounded_sql('max(value)', 4)} AS high, {rounded_sql('min(value)', 4)} AS low, {rounded_sql('last(value ORDER BY ts, event_id)', 4)} AS close, count(*) AS n FROM events GROUP BY ALL""",
)
