"""One query for each operator, on the event table seen as trades, and the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import anomalies as an
from tidemark.operators import bars as b
from tidemark.operators import drift, forecast, lookups, quality, sketches, walk_forward
from tidemark.operators import indicators as ind
from tidemark.schemas import INDICATORS, INTERVALS, OHLCV, TRADES
from tidemark.sources import readers, writers
from tidemark.streaming import daily, ingest, late
from tidemark.streaming import operators as st

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def trades(spark: SparkSession, d: str) -> DataFrame:
    return readers.events_as_trades(events(spark, d))


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return b.ohlcv(trades(spark, d), "1h")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def ntz(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


def r(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in cols)


T = """trades AS (SELECT event_type AS symbol, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS quantity,
 ts AS "timestamp", event_id AS trade_id, event_id % 2 = 0 AS is_buyer_maker FROM events)"""


def bars_sql(interval: str, name: str = "bars", src: str = "trades") -> str:
    return f"""{name} AS (SELECT symbol, '{interval}' AS "interval", time_bucket(INTERVAL '{INTERVALS[interval]}', "timestamp") AS "timestamp",
 arg_min(price, row("timestamp", trade_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, row("timestamp", trade_id)) AS close,
 sum(quantity) AS volume, count(*) AS trades FROM {src} GROUP BY ALL)"""


CLOSED = """bars AS (SELECT * FROM allbars WHERE "timestamp" + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE)"""
W = 'PARTITION BY symbol ORDER BY "timestamp"'
RECURSION = f"""n AS (SELECT *, row_number() OVER ({W}) AS rn, coalesce(close - lag(close) OVER ({W}), 0) AS mv FROM bars),
e AS (SELECT symbol, rn, close AS e12, close AS e26, 0e0 AS sig, greatest(mv, 0) AS g, greatest(-mv, 0) AS l FROM n WHERE rn = 1
 UNION ALL SELECT n.symbol, n.rn, e12 + 2e0 / 13 * (close - e12), e26 + 2e0 / 27 * (close - e26),
 sig + 0.2e0 * ((e12 + 2e0 / 13 * (close - e12)) - (e26 + 2e0 / 27 * (close - e26)) - sig), g + (greatest(mv, 0) - g) / 14e0, l + (greatest(-mv, 0) - l) / 14e0
 FROM e JOIN n ON n.symbol = e.symbol AND n.rn = e.rn + 1),
ind AS (SELECT n.*, e12 AS ema_12, e12 - e26 AS macd, sig AS macd_signal, CASE WHEN n.rn >= 14 THEN CASE WHEN l = 0 THEN 100e0 ELSE 100 - 100 / (1 + g / l) END END AS rsi_14,
 CASE WHEN n.rn >= 20 THEN avg(close) OVER w20 END AS sma_20, CASE WHEN n.rn >= 20 THEN avg(close) OVER w20 + 2 * stddev_pop(close) OVER w20 END AS bollinger_upper,
 CASE WHEN n.rn >= 20 THEN avg(close) OVER w20 - 2 * stddev_pop(close) OVER w20 END AS bollinger_lower
 FROM n JOIN e USING (symbol, rn) WINDOW w20 AS (PARTITION BY symbol ORDER BY "timestamp" ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""
WITH_H = f"WITH {T}, {bars_sql('1h')}"
REC_H = f"WITH RECURSIVE {T}, {bars_sql('1h')}, {RECURSION}"
REC_CLOSED = f"WITH RECURSIVE {T}, {bars_sql('1h', 'allbars')}, {CLOSED}, {RECURSION}"
BAR = ("open", "high", "low", "close", "volume")


def alerts_sql(kinds: tuple[str, ...]) -> str:
    prev = 'PARTITION BY symbol ORDER BY "timestamp" ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING'
    parts = []
    for kind, col in (("price", "lr"), ("volume", "volume")):
        if kind in kinds:
            parts.append(f"""SELECT symbol, "timestamp" + INTERVAL 1 HOUR AS detected_at, '{kind}' AS kind, {col} AS value, ({col} - m) / s AS score, 3e0 AS threshold
 FROM (SELECT *, avg({col}) OVER p AS m, stddev_pop({col}) OVER p AS s, count({col}) OVER p AS c FROM ret WINDOW p AS ({prev})) WHERE c = 20 AND s > 0 AND abs({col} - m) / s >= 3""")
    lag = f"lag(close) OVER ({W})"
    return f"""ret AS (SELECT *, CASE WHEN close > 0 AND {lag} > 0 THEN ln(close / {lag}) END AS lr FROM bars),
al AS ({' UNION ALL '.join(parts)})"""


ALERT = f"symbol, detected_at, kind, {r('value', 'score')}, threshold"

# ---- sources and sinks


@register(f"WITH {T} SELECT * FROM trades")
def read_trades(spark, d):
    """Trades published as JSON texts and decoded again."""
    return readers.decode(writers.to_messages(trades(spark, d)), TRADES).drop("_corrupt")


def _messages(spark, d) -> DataFrame:
    """Trades as JSON texts, of which each seventh is cut off and so does not parse."""
    whole = writers.to_messages(trades(spark, d).withColumn("cut", F.col("trade_id") % 7 == 0))
    cut = F.get_json_object("value", "$.cut") == "true"
    return whole.select(F.when(cut, F.concat(F.lit("{\"trade_id\":"), F.get_json_object("value", "$.trade_id"))).otherwise(F.col("value")).alias("value"))


@register(f"WITH {T} SELECT * FROM trades WHERE trade_id % 7 <> 0")
def read_parsed(spark, d):
    """The trades among messages of which some are malformed."""
    return readers.read_messages(_messages(spark, d), TRADES)[0]


@register(f"""WITH {T} SELECT '{{"trade_id":' || trade_id AS _corrupt FROM trades WHERE trade_id % 7 = 0""")
def read_malformed(spark, d):
    """The malformed messages, set aside whole."""
    return readers.read_messages(_messages(spark, d), TRADES)[1]


@register(f"{WITH_H} SELECT symbol, \"interval\", \"timestamp\", {r(*BAR)} FROM bars")
def read_klines(spark, d):
    """Bars published as JSON in two versions and read back, the last version staying."""
    bars = hourly(spark, d).drop("trades")
    both = bars.withColumns({"close": F.col("close") + 1, "version": F.lit(1)}).union(bars.withColumn("version", F.lit(2)))
    text = writers.to_messages(both)
    schema = ", ".join(f"`{c}` {t}" for c, t in OHLCV.types.items()) + ", version int"
    return rounded(b.normalize_klines(text.select(F.from_json("value", schema).alias("v")).select("v.*"), "version"))


@register(f"{REC_H} SELECT symbol, \"interval\", \"timestamp\", {r('ema_12', 'sma_20')}, 'indicators' AS kind FROM ind")
def publish_processed(spark, d):
    sent = writers.to_processed(ind.indicators(hourly(spark, d)), "indicators")
    back = sent.select(F.from_json("value", "symbol string, interval string, timestamp timestamp_ntz, ema_12 double, sma_20 double, kind string").alias("v")).select("v.*")
    return rounded(back)


@register(f"{WITH_H}, {alerts_sql(('price', 'volume'))} SELECT {ALERT} FROM al")
def publish_alerts(spark, d):
    sent = writers.to_alerts(an.anomalies(hourly(spark, d)))
    return rounded(sent.select(F.from_json("value", "symbol string, detected_at timestamp_ntz, kind string, value double, score double, threshold double").alias("v")).select("v.*"))


@register(f"{WITH_H} SELECT symbol, \"interval\", \"timestamp\", {r(*BAR)}, CAST(\"timestamp\" AS DATE) AS date FROM bars")
def upsert_replay(spark, d):
    """The same bars merged twice."""
    path, bars = st.scratch(spark), hourly(spark, d).drop("trades")
    for _ in range(2):
        writers.upsert(bars, path, ["symbol", "interval", "timestamp"])
    return rounded(spark.read.parquet(path).select(*b.BAR, "date"))


@register(f"WITH {T} SELECT symbol, \"interval\", \"timestamp\", {r(*BAR)} FROM (SELECT * FROM (WITH {bars_sql('1h')} SELECT * FROM bars)) WHERE \"timestamp\" > (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def retain_7d(spark, d):
    last = events(spark, d).agg(F.max("ts")).first()[0]
    return rounded(writers.retain(hourly(spark, d), "timestamp", "7 days", F.lit(last).cast("timestamp_ntz")).select(b.BAR))


# ---- validation and deduplication

BROKEN = """broken AS (SELECT CASE WHEN trade_id % 11 = 0 THEN NULL ELSE symbol END AS symbol, CASE WHEN trade_id % 7 = 0 THEN NULL WHEN trade_id % 13 = 0 THEN 'n/a' ELSE 'ok' END AS p, price, quantity, "timestamp", trade_id, is_buyer_maker FROM trades)"""


def broken(spark, d) -> DataFrame:
    """Trades with every 11th symbol and every 7th price missing, every 13th price no number."""
    t, i = trades(spark, d), F.col("trade_id")
    price = F.when(i % 7 == 0, None).when(i % 13 == 0, F.lit("n/a")).otherwise(F.col("price").cast("string"))
    return t.withColumns({"symbol": F.when(i % 11 != 0, F.col("symbol")), "price": price})


@register(f"WITH {T}, {BROKEN} SELECT symbol, price, quantity, \"timestamp\", trade_id, is_buyer_maker FROM broken WHERE symbol IS NOT NULL AND p = 'ok'")
def valid_trades(spark, d):
    return quality.validate(broken(spark, d), TRADES)[0]


@register(f"WITH {T}, {BROKEN} SELECT 'raw_trades' AS \"table\", reason, count(*) AS n FROM (SELECT 'symbol: missing' AS reason FROM broken WHERE symbol IS NULL UNION ALL SELECT 'price: missing' FROM broken WHERE p IS NULL UNION ALL SELECT 'price: type' FROM broken WHERE p = 'n/a') GROUP BY ALL")
def reject_counts(spark, d):
    return quality.reject_counts(quality.validate(broken(spark, d), TRADES)[1], TRADES)


@register(f"{WITH_H} SELECT symbol, \"interval\", \"timestamp\", {r(*BAR)} FROM bars WHERE hour(\"timestamp\") % 5 <> 0")
def valid_ohlcv(spark, d):
    """Bars of which every fifth hour's lack a volume."""
    bars = hourly(spark, d).withColumn("volume", F.when(F.hour("timestamp") % 5 != 0, F.col("volume")))
    return rounded(quality.validate(bars, OHLCV)[0].select(b.BAR))


@register(f"{REC_H} SELECT symbol, \"timestamp\", {r('rsi_14', 'macd')} FROM ind WHERE hour(\"timestamp\") % 6 <> 0")
def valid_indicators(spark, d):
    rows = ind.indicators(hourly(spark, d)).withColumn("symbol", F.when(F.hour("timestamp") % 6 != 0, F.col("symbol")))
    return rounded(quality.validate(rows, INDICATORS)[0].select("symbol", "timestamp", "rsi_14", "macd"))


def repeated(t: DataFrame) -> DataFrame:
    """Every 10th trade twice, the copy a second later; every 17th without its id."""
    copy = t.filter("trade_id % 10 = 0").withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 SECOND"))
    return t.unionByName(copy).withColumn("trade_id", F.when(F.col("trade_id") % 17 != 0, F.col("trade_id")))


DEDUPED = f"""WITH {T} SELECT symbol, price, quantity, "timestamp", CASE WHEN trade_id % 17 <> 0 THEN trade_id END AS trade_id, is_buyer_maker FROM trades
UNION ALL SELECT symbol, price, quantity, "timestamp" + INTERVAL 1 SECOND, NULL, is_buyer_maker FROM trades WHERE trade_id % 170 = 0"""


@register(DEDUPED)
def dedupe_trades(spark, d):
    return quality.dedupe_trades(repeated(trades(spark, d)))


# ---- bars and metrics


def _bars(interval: str):
    @register(f"WITH {T}, {bars_sql(interval)} SELECT symbol, \"interval\", \"timestamp\", {r(*BAR)}, trades FROM bars", f"ohlcv_{interval}")
    def query(spark, d):
        return rounded(b.ohlcv(trades(spark, d), interval))


for _i in INTERVALS:
    _bars(_i)


@register(f"{WITH_H} SELECT symbol, \"interval\", \"timestamp\", {r(*BAR)} FROM bars")
def rollup_1h(spark, d):
    return rounded(b.rollup_bars(b.ohlcv(trades(spark, d), "1m"), "1h"))


DAILY = f"""{WITH_H}, days AS (SELECT symbol, CAST("timestamp" AS DATE) AS date, arg_min(price, row("timestamp", trade_id)) AS open, max(price) AS high, min(price) AS low,
 arg_max(price, row("timestamp", trade_id)) AS close, sum(quantity) AS volume, count(*) AS trades, sum(price * quantity) / nullif(sum(quantity), 0) AS vwap,
 coalesce(sum(quantity) FILTER (NOT is_buyer_maker), 0) / nullif(sum(quantity), 0) AS taker_buy_share FROM trades GROUP BY ALL),
ret AS (SELECT symbol, "timestamp", CASE WHEN close > 0 AND lag(close) OVER ({W}) > 0 THEN ln(close / lag(close) OVER ({W})) END AS lr FROM bars),
vol AS (SELECT symbol, CAST("timestamp" AS DATE) AS date, stddev_pop(lr) AS volatility FROM ret GROUP BY ALL),
daily AS (SELECT days.*, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS "return", volatility FROM days LEFT JOIN vol USING (symbol, date))
SELECT symbol, date, {r(*BAR)}, trades, {r('vwap', 'taker_buy_share', 'volatility')}, round("return", 6) + 0.0 AS "return" FROM daily"""


@register(DAILY)
def daily_metrics(spark, d):
    return rounded(b.daily_metrics(trades(spark, d)))


@register(f"SELECT * FROM ({DAILY}) ORDER BY date DESC, symbol LIMIT 50")
def daily_recent(spark, d):
    return lookups.recent(rounded(b.daily_metrics(trades(spark, d))), "date", 50, None, "symbol")


# ---- indicators


def _indicator(name: str, cols: tuple[str, ...], make):
    @register(f"{REC_H} SELECT symbol, \"timestamp\", {r(*cols)} FROM ind", name)
    def query(spark, d):
        return rounded(make(hourly(spark, d)).select("symbol", "timestamp", *cols))


_indicator("sma_1h", ("sma_20",), ind.bollinger)
_indicator("bollinger_1h", ("bollinger_upper", "bollinger_lower"), ind.bollinger)
_indicator("ema_1h", ("ema_12",), ind.ema)
_indicator("macd_1h", ("macd", "macd_signal"), ind.macd)
_indicator("rsi_1h", ("rsi_14",), ind.rsi)
IND = r("rsi_14", "macd", "macd_signal", "bollinger_upper", "bollinger_lower", "sma_20", "ema_12")


@register(f"{REC_H} SELECT symbol, \"interval\", \"timestamp\", {IND} FROM ind")
def indicators_1h(spark, d):
    return rounded(ind.indicators(hourly(spark, d)))


# ---- alerts


@register(f"{WITH_H}, {alerts_sql(('price',))} SELECT {ALERT} FROM al")
def price_alerts(spark, d):
    return rounded(an.price_alerts(hourly(spark, d)))


@register(f"{WITH_H}, {alerts_sql(('volume',))} SELECT {ALERT} FROM al")
def volume_spikes(spark, d):
    return rounded(an.volume_spikes(hourly(spark, d)))


@register(f"{WITH_H}, {alerts_sql(('price', 'volume'))} SELECT {ALERT} FROM al")
def anomalies(spark, d):
    return rounded(an.anomalies(hourly(spark, d)))


@register(f"{WITH_H}, {alerts_sql(('price', 'volume'))} SELECT {ALERT} FROM al ORDER BY detected_at DESC, symbol, kind LIMIT 20")
def recent_anomalies(spark, d):
    return rounded(lookups.recent(an.anomalies(hourly(spark, d)), "detected_at", 20, None, "symbol", "kind"))


# ---- forecasts


@register(f"""{REC_H}, f AS (SELECT *, lag(close, 1) OVER ({W}) AS close_lag_1, lag(close, 2) OVER ({W}) AS close_lag_2, lag(close, 3) OVER ({W}) AS close_lag_3, lead(close) OVER ({W}) AS label,
 CASE WHEN close > 0 AND lag(close) OVER ({W}) > 0 THEN ln(close / lag(close) OVER ({W})) END AS log_return FROM ind)
SELECT symbol, "timestamp", {r('close', 'log_return', 'close_lag_1', 'close_lag_2', 'close_lag_3', 'label')}, CAST(hour("timestamp") AS INTEGER) AS hour, {IND} FROM f""")
def features_1h(spark, d):
    return rounded(forecast.features(hourly(spark, d)))


def _predicted(spark, d) -> DataFrame:
    path, rows = st.scratch(spark), forecast.features(hourly(spark, d))
    rows.write.parquet(path)  # used by both fits and both predictions
    early, late = forecast.split(spark.read.schema(rows.schema).parquet(path))
    return reduce(DataFrame.unionByName, [forecast.predict(forecast.fit(early, kind), late, kind) for kind in ("linear", "trees")])


@register()
def predictions(spark, d):
    return _predicted(spark, d).drop("label")


@register()
def model_eval(spark, d):
    return forecast.evaluate(_predicted(spark, d))


NAIVE = f"""{WITH_H}, nv AS (SELECT symbol, "timestamp" + INTERVAL 1 HOUR AS predicted_at, "timestamp" + INTERVAL 1 HOUR AS target_time, close AS prediction, 'naive' AS model, lead(close) OVER ({W}) AS label FROM bars)"""


@register(f"{NAIVE} SELECT symbol, model, round(sqrt(avg((prediction - label) ** 2)), 6) + 0.0 AS rmse, round(avg(abs(prediction - label)), 6) + 0.0 AS mae, round(avg(abs((prediction - label) / nullif(label, 0))), 6) + 0.0 AS mape, count(*) AS n FROM nv WHERE label IS NOT NULL GROUP BY ALL")
def naive_eval(spark, d):
    return rounded(forecast.evaluate(forecast.naive(hourly(spark, d))))


@register(f"{NAIVE} SELECT symbol, predicted_at, target_time, {r('prediction')}, model FROM nv QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY predicted_at DESC) = 1")
def latest_prediction(spark, d):
    return rounded(lookups.latest(forecast.naive(hourly(spark, d)).drop("label"), "predicted_at"))


FORWARD = f"""{WITH_H}, ft AS (SELECT symbol, "timestamp", close, lead(close) OVER ({W}) AS label, CAST(lead("timestamp") OVER ({W}) + INTERVAL 1 HOUR AS DATE) AS known FROM bars),
kn AS (SELECT * FROM ft WHERE label IS NOT NULL),
days AS (SELECT DISTINCT symbol, CAST("timestamp" AS DATE) AS day FROM ft),
md AS (SELECT days.symbol, day, count(*) AS n, avg(label) - coalesce(covar_pop(label, kn.close) / nullif(var_pop(kn.close), 0), 0) * avg(kn.close) AS b, coalesce(covar_pop(label, kn.close) / nullif(var_pop(kn.close), 0), 0) AS a
 FROM days JOIN kn ON kn.symbol = days.symbol AND known < day GROUP BY days.symbol, day HAVING count(*) >= 20)"""


@register(f"""{FORWARD}, pr AS (SELECT ft.symbol, b + a * ft.close AS p, label FROM ft JOIN md ON md.symbol = ft.symbol AND md.day = CAST("timestamp" AS DATE) WHERE label IS NOT NULL)
SELECT symbol, 'walk_forward' AS model, round(sqrt(avg((p - label) ** 2)), 6) + 0.0 AS rmse, round(avg(abs(p - label)), 6) + 0.0 AS mae, round(avg(abs((p - label) / nullif(label, 0))), 6) + 0.0 AS mape, count(*) AS n FROM pr GROUP BY symbol""")
def walk_forward_eval(spark, d):
    """A model for each symbol and day, fitted on what was known before it, and the errors of its predictions."""
    rows = forecast.features(hourly(spark, d), label_time=True).select("symbol", "timestamp", "close", "label", "label_at")
    return rounded(forecast.evaluate(walk_forward.walk_forward(rows, ["close"], least_rows=20)))


@register(f"""{FORWARD}, lm AS (SELECT * FROM md QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY day DESC) = 1)
SELECT ft.symbol, "timestamp" + INTERVAL 1 HOUR AS predicted_at, "timestamp" + INTERVAL 1 HOUR AS target_time, round(b + a * ft.close, 6) + 0.0 AS prediction, 'stored' AS model FROM ft JOIN lm ON lm.symbol = ft.symbol QUALIFY row_number() OVER (PARTITION BY ft.symbol ORDER BY "timestamp" DESC) = 1""")
def latest_model_prediction(spark, d):
    """The last bar's prediction by the newest model of each symbol, from a stored table of models."""
    path = st.scratch(spark)
    rows = forecast.features(hourly(spark, d), label_time=True).select("symbol", "timestamp", "close", "label", "label_at")
    days = rows.select("symbol", F.to_date("timestamp").alias("day")).distinct()
    fitted = walk_forward.models(walk_forward.moments(rows, ["close"]), days, 1, least_rows=20)
    writers.upsert(fitted, path, ["symbol", "day"], time="day")
    newest = lookups.latest(spark.read.parquet(path).drop("date"), "day").withColumn("day", F.lit("2024-01-01").cast("date"))
    last = lookups.latest(rows.select("symbol", "timestamp", "close"))
    return rounded(walk_forward.predicted(last, newest, ["close"], name="stored", day="2024-01-01"))


# ---- drift

HALVES = f"""WITH {T}, h AS (SELECT *, "timestamp" >= TIMESTAMP '2024-01-16' AS cur FROM trades)"""


def _psi_sql(col: str) -> str:
    edges = ", ".join(f"quantile_cont({col}, {i / 10})" for i in range(1, 10))
    return f"""(SELECT '{col}' AS "column", sum((c - r) * ln(c / r)) AS psi FROM (SELECT greatest(coalesce(count(*) FILTER (NOT cur), 0) / (SELECT count(*) FROM h WHERE NOT cur), 1e-4) AS r,
 greatest(coalesce(count(*) FILTER (cur), 0) / (SELECT count(*) FROM h WHERE cur), 1e-4) AS c FROM (SELECT cur, len(list_filter(edges, lambda v: v < {col})) AS bin FROM h, (SELECT [{edges}] AS edges FROM h WHERE NOT cur)) GROUP BY bin))"""


def _ks_sql(col: str) -> str:
    return f"""(SELECT '{col}' AS "column", max(abs(r / nr - c / nc)) AS ks FROM (SELECT sum(r) OVER (ORDER BY x) AS r, sum(c) OVER (ORDER BY x) AS c, sum(r) OVER () AS nr, sum(c) OVER () AS nc
 FROM (SELECT {col} AS x, count(*) FILTER (NOT cur) AS r, count(*) FILTER (cur) AS c FROM h GROUP BY {col})))"""


PSI = " UNION ALL ".join(f"SELECT * FROM {_psi_sql(c)}" for c in ("price", "quantity"))
KS = " UNION ALL ".join(f"SELECT * FROM {_ks_sql(c)}" for c in ("price", "quantity"))


def halves(spark, d) -> tuple[DataFrame, DataFrame]:
    t, at = trades(spark, d), F.lit("2024-01-16").cast("timestamp_ntz")
    return t.filter(F.col("timestamp") < at), t.filter(F.col("timestamp") >= at)


@register(f"{HALVES} SELECT \"column\", round(psi, 6) + 0.0 AS psi FROM ({PSI})")
def drift_psi(spark, d):
    return rounded(drift.psi(*halves(spark, d), ["price", "quantity"]))


@register(f"{HALVES} SELECT \"column\", round(ks, 6) + 0.0 AS ks FROM ({KS})")
def drift_ks(spark, d):
    ref, cur = halves(spark, d)
    return rounded(drift.ks(ref, cur, "price").unionByName(drift.ks(ref, cur, "quantity")))


@register(f"{HALVES} SELECT \"column\", 'psi' AS statistic, round(psi, 6) + 0.0 AS value, 0.2e0 AS threshold, psi >= 0.2 AS drifted FROM ({PSI}) UNION ALL SELECT \"column\", 'ks', round(ks, 6) + 0.0, 0.1e0, ks >= 0.1 FROM ({KS})")
def drift_report(spark, d):
    return rounded(drift.drift_report(*halves(spark, d), ["price", "quantity"]))


@register(f"{HALVES} SELECT \"column\", 'psi' AS statistic, 0.2e0 AS threshold, psi >= 0.2 AS drifted FROM ({PSI}) UNION ALL SELECT \"column\", 'ks', 0.1e0, ks >= 0.1 FROM ({KS})")
def drift_from_sketches(spark, d):
    """The flags of the drift report from a stored table of daily sketches."""
    path = st.scratch(spark)
    writers.upsert(sketches.daily_sketches(trades(spark, d), ["price", "quantity"]), path, ["date", "column"], time="date")
    days, cut = spark.read.parquet(path), dt.date(2024, 1, 16)
    found = sketches.drift_between(sketches.period(days, dt.date.min, cut), sketches.period(days, cut, dt.date.max))
    return found.drop("value")


# ---- lookups


@register(f"WITH {T} SELECT * FROM trades QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY \"timestamp\" DESC, trade_id DESC) = 1")
def latest_trade(spark, d):
    return lookups.latest(trades(spark, d), tie="trade_id")


@register(f"{WITH_H} SELECT symbol, \"interval\", \"timestamp\", {r(*BAR)} FROM bars WHERE symbol = 'click' AND \"timestamp\" >= TIMESTAMP '2024-01-05' AND \"timestamp\" < TIMESTAMP '2024-01-12'")
def bars_range(spark, d):
    """A week of one symbol's bars out of a stored table of bars."""
    path = st.scratch(spark)
    bars = hourly(spark, d).drop("trades").withColumn("date", F.to_date("timestamp"))
    writers.write_laid_out(bars, path, ["interval", "date"], ["symbol", "timestamp"])
    return rounded(lookups.stored_bars(spark, path, "1h", "click", "2024-01-05", "2024-01-12").select(b.BAR))


# ---- streams


@register(DEDUPED)
def dedupe_stream(spark, d):
    return ntz(st.drain(st.dedupe_stream(repeated(st.trade_stream(spark, d))), st.scratch(spark)))


@register(f"""WITH {T}, rep AS (SELECT symbol, price, quantity, "timestamp", CASE WHEN trade_id % 17 <> 0 THEN trade_id END AS trade_id, is_buyer_maker FROM trades
 UNION ALL SELECT symbol, price, quantity, "timestamp" + INTERVAL 1 SECOND, CASE WHEN trade_id % 17 <> 0 THEN trade_id END, is_buyer_maker FROM trades WHERE trade_id % 10 = 0)
SELECT * FROM rep QUALIFY (trade_id IS NULL AND "timestamp" < (SELECT max("timestamp") FROM rep) - INTERVAL 20 MINUTE)
 OR (row_number() OVER (PARTITION BY symbol, trade_id ORDER BY "timestamp") = 1 AND trade_id IS NOT NULL AND max("timestamp") OVER (PARTITION BY symbol, trade_id) < (SELECT max("timestamp") FROM rep) - INTERVAL 20 MINUTE)""")
def dedupe_earliest(spark, d):
    """The earliest of repeated trades out of a stream; ids whose last row is near the newest are still held."""
    return ntz(st.drain(late.earliest_trades(repeated(st.plain_trade_stream(spark, d))), st.scratch(spark)))


#: trades of the first half of the month that come after it: some within a day, some later; and all of the second half
LATER = """("timestamp" >= TIMESTAMP '2024-01-16' OR (trade_id % 10 = 8 AND "timestamp" >= TIMESTAMP '2024-01-15 06:00:00') OR (trade_id % 10 = 9 AND "timestamp" < TIMESTAMP '2024-01-14 12:00:00'))"""
LATE_SQL = f"""WITH {T}, fed AS (SELECT *, {LATER} AS b, time_bucket(INTERVAL 1 HOUR, "timestamp") AS start FROM trades),
w AS (SELECT max("timestamp") FILTER (NOT b) - INTERVAL 10 MINUTE AS a, max("timestamp") - INTERVAL 10 MINUTE AS z FROM fed),
m AS (SELECT fed.*, w.*, start + INTERVAL 1 HOUR AS e, b AND start + INTERVAL 25 HOUR <= a AS late FROM fed, w)
SELECT 'bar' AS kind, symbol, start AS "timestamp", round(arg_min(price, row("timestamp", trade_id)), 6) + 0.0 AS open, round(max(price), 6) + 0.0 AS high, round(min(price), 6) + 0.0 AS low,
 round(arg_max(price, row("timestamp", trade_id)), 6) + 0.0 AS close, round(sum(quantity), 6) + 0.0 AS volume, CASE WHEN bool_or(b) AND bool_or(NOT b) AND any_value(e) <= any_value(a) AND any_value(e) + INTERVAL 1 DAY <= any_value(z) THEN 2 ELSE 1 END AS version,
 CAST(NULL AS BIGINT) AS trade_id FROM m WHERE NOT late AND e <= z GROUP BY symbol, start
UNION ALL SELECT 'late', symbol, "timestamp", NULL, NULL, NULL, round(price, 6) + 0.0, round(quantity, 6) + 0.0, NULL, trade_id FROM m WHERE late"""


@register(LATE_SQL)
def late_bars(spark, d):
    """Bars in their last version, and trades that came too late: some trades come after the first half of the month."""
    folder = st.scratch(spark)
    fed = trades(spark, d).withColumn("later", F.expr(LATER.replace('"', "`").replace("TIMESTAMP ", "TIMESTAMP_NTZ ")))
    schema = TRADES.schema
    for later in (False, True):
        fed.filter(F.col("later") == later).drop("later").write.mode("append").parquet(f"{folder}/in")
        rows = st.drain(late.corrected_bars(spark.readStream.schema(schema).parquet(f"{folder}/in")), folder)
    bars = late.last_versions(rows).select(F.lit("bar").alias("kind"), "symbol", "timestamp", *BAR, "version")
    aside = late.late_trades(rows).select(F.lit("late").alias("kind"), "symbol", "timestamp", F.col("price").alias("close"), F.col("quantity").alias("volume"), "trade_id")
    return rounded(ntz(bars.unionByName(aside, allowMissingColumns=True)))


CLOSED_BARS = f"""WITH {T}, {bars_sql('1h', 'allbars')}, {CLOSED}"""


@register(f"{CLOSED_BARS} SELECT symbol, \"interval\", \"timestamp\", {r(*BAR)} FROM bars")
def ohlcv_stream(spark, d):
    bars = st.ohlcv_stream(st.dedupe_stream(st.trade_stream(spark, d)))
    return rounded(ntz(st.drain(bars, st.scratch(spark))).select(b.BAR))


@register(f"{REC_CLOSED} SELECT symbol, \"timestamp\", {IND} FROM ind")
def indicators_stream(spark, d):
    return rounded(ntz(st.drain(st.indicators_stream(st.ohlcv_stream(st.trade_stream(spark, d))), st.scratch(spark))))


@register(f"{CLOSED_BARS}, {alerts_sql(('price', 'volume'))} SELECT {ALERT} FROM al")
def alerts_stream(spark, d):
    return rounded(ntz(st.drain(st.alerts_stream(st.ohlcv_stream(st.trade_stream(spark, d))), st.scratch(spark))))


@register(f"{REC_CLOSED} SELECT symbol, \"interval\", \"timestamp\", {r('close', 'volume', 'rsi_14', 'macd', 'sma_20')} FROM ind")
def market_pipeline(spark, d):
    """The whole stream pipeline into its tables, bars and indicators read back and joined."""
    folder = st.scratch(spark)
    st.run_pipeline(st.trade_stream(spark, d), folder)
    bars, rows = spark.read.parquet(f"{folder}/ohlcv"), spark.read.parquet(f"{folder}/indicators")
    cols = ["symbol", "interval", "timestamp"]
    both = bars.select(*cols, "close", "volume").join(rows.select(*cols, "rsi_14", "macd", "sma_20"), cols)
    return rounded(ntz(both))


CLOSED_TRADES = """ct AS (SELECT * FROM trades WHERE time_bucket(INTERVAL 1 HOUR, "timestamp") + INTERVAL 1 HOUR <= (SELECT max("timestamp") FROM trades) - INTERVAL 10 MINUTE)"""


@register(DAILY.replace(WITH_H, f"WITH {T}, {CLOSED_TRADES}, {bars_sql('1h', src='ct')}").replace("FROM trades GROUP BY ALL)", "FROM ct GROUP BY ALL)"))
def daily_metrics_stream(spark, d):
    """Daily metrics that the stream pipeline keeps, after two batches of which the second changes days of the first."""
    folder = st.scratch(spark)
    hours = b.hourly_sums(trades(spark, d)).drop("interval")
    last = trades(spark, d).agg(F.max("timestamp")).first()[0]
    closed = hours.filter(F.col("timestamp") + F.expr("INTERVAL 70 MINUTES") <= F.lit(last))
    for odd in (0, 1):
        daily.refresh_daily(closed.filter(F.pmod(F.hour("timestamp"), F.lit(2)) == odd), folder)
    return rounded(spark.read.parquet(f"{folder}/daily_metrics").select("symbol", "date", *BAR, "trades", "vwap", "taker_buy_share", "volatility", "return"))


@register(f"""WITH {T}, m AS (SELECT *, CASE WHEN trade_id % 17 = 0 THEN 'malformed' ELSE concat_ws('; ', CASE WHEN trade_id % 11 = 0 THEN 'symbol: missing' END,
 CASE WHEN trade_id % 7 = 0 THEN 'price: missing' WHEN trade_id % 13 = 0 THEN 'price: type' END) END AS reasons FROM trades)
SELECT CASE WHEN reasons = '' THEN 'raw_trades' ELSE 'rejects' END AS "table", trade_id, CASE WHEN reasons = '' THEN symbol END AS symbol, CASE WHEN reasons = '' THEN price END AS price,
 CASE WHEN reasons = '' THEN quantity END AS quantity, CASE WHEN reasons = '' THEN "timestamp" END AS "timestamp", nullif(reasons, '') AS reasons FROM m""")
def pipeline_rejects(spark, d):
    """Messages of which some are broken, as a stream: the table of valid trades and the table of rejects, read back."""
    folder, text = st.scratch(spark), F.get_json_object("value", "$.trade_id")
    cut = F.when(text.cast("bigint") % 17 == 0, F.concat(F.lit("{\"trade_id\":"), text)).otherwise(F.col("value"))
    writers.to_messages(broken(spark, d)).select(cut.alias("value")).write.parquet(f"{folder}/in")
    for _ in range(2):  # the second call finds nothing new
        ingest.ingest(spark.readStream.schema("value string").parquet(f"{folder}/in"), folder, TRADES)
    rows = ingest.ingested(spark, folder, TRADES).select(F.lit("raw_trades").alias("table"), "trade_id", "symbol", "price", "quantity", "timestamp", F.lit(None).cast("string").alias("reasons"))
    number = F.regexp_extract("value", '"trade_id":(\\d+)', 1).cast("bigint")
    bad = ingest.rejected(spark, folder).select(F.lit("rejects").alias("table"), number.alias("trade_id"), F.array_join("reasons", "; ").alias("reasons"))
    return rows.unionByName(bad, allowMissingColumns=True)


@register(f"{CLOSED_BARS}, {alerts_sql(('price', 'volume'))} SELECT {ALERT} FROM al")
def market_pipeline_alerts(spark, d):
    """The alerts that the whole stream pipeline publishes, decoded from their messages."""
    folder = st.scratch(spark)
    st.run_pipeline(st.trade_stream(spark, d), folder)
    sent = readers.first_sent(spark.read.schema("key string, value string, batch bigint, number bigint").json(f"{folder}/topics/anomalies"))
    return rounded(ntz(sent.select(F.from_json("value", st.Alerts.schema).alias("v")).select("v.*")))
