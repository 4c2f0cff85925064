"""Tables of the market data model: a fixed required core, open to extra columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Table:
    name: str
    types: dict[str, str]
    required: tuple[str, ...]
    keys: tuple[str, ...]
    time: str

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in self.types.items()))


INTERVALS = {"1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "1h": "1 hour", "4h": "4 hours", "1d": "1 day"}
_OHLCV = {c: "double" for c in ("open", "high", "low", "close", "volume")}
TRADES = Table("raw_trades", {"symbol": "string", "price": "double", "quantity": "double", "timestamp": "timestamp_ntz", "trade_id": "bigint", "is_buyer_maker": "boolean"}, ("symbol", "price", "quantity", "timestamp"), ("symbol", "trade_id"), "timestamp")
OHLCV = Table("ohlcv", {"symbol": "string", "interval": "string"} | _OHLCV | {"timestamp": "timestamp_ntz"}, ("symbol", "interval", *_OHLCV, "timestamp"), ("symbol", "interval", "timestamp"), "timestamp")
INDICATOR_COLUMNS = ("rsi_14", "macd", "macd_signal", "bollinger_upper", "bollinger_lower", "sma_20", "ema_12")
INDICATORS = Table("indicators", {"symbol": "string", "timestamp": "timestamp_ntz"} | {c: "double" for c in INDICATOR_COLUMNS}, ("symbol", "timestamp"), ("symbol", "interval", "timestamp"), "timestamp")
#: how long the topics keep their rows
RETENTION = {"raw_trades": "24 hours", "raw_klines": "7 days", "processed_data": "7 days", "anomalies": "30 days"}
