"""Queries on series, signals and derivatives data, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as sc
from ..operators import derivatives, series
from .base import read, register

ORDER = ["ts", "event_id"]


def _bars(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select(F.col("event_type").alias("symbol"), "ts", "event_id", "value")


LAST = """
    b AS (
        SELECT event_type AS symbol, ts, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS back
        FROM events WHERE value IS NOT NULL
    ), k AS (
        SELECT symbol, event_id, value, count(*) OVER (PARTITION BY symbol) AS len, count(*) OVER (PARTITION BY symbol) - back + 1 AS pos,
               min(value) OVER (PARTITION BY symbol) AS lo, max(value) OVER (PARTITION BY symbol) AS hi
        FROM b WHERE back <= {n}
    ), x AS (
        SELECT symbol, event_id, value, len, pos, CASE WHEN hi > lo THEN 2 * (value - lo) / (hi - lo) - 1 ELSE -1.0 END AS x FROM k
    ), s AS (SELECT *, sqrt(greatest(0.0, 1 - x * x)) AS s FROM x)
"""


@register(f"WITH {LAST.format(n=100)} SELECT symbol, event_id, value, CAST(pos AS BIGINT) AS pos, CAST(len AS BIGINT) AS len FROM x")
def last_n_bars(spark, sf):
    return series.last_n(_bars(spark, sf), 100, "symbol", ORDER).select("symbol", "event_id", "value", F.col("pos").cast("long"), F.col("len").cast("long"))


@register(f"WITH {LAST.format(n=100)} SELECT symbol, event_id, round(x, 6) + 0.0 AS x FROM x")
def minmax_scale(spark, sf):
    kept = series.scaled(series.last_n(_bars(spark, sf), 100, "symbol", ORDER), "symbol", flat=-1.0)
    return kept.select("symbol", "event_id", (F.round("x", 6) + F.lit(0.0)).alias("x"))


@register("""
    SELECT event_type AS symbol, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS bar_start,
           arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume
    FROM events GROUP BY event_type, date_trunc('hour', ts)
""")
def ohlcv_bars(spark, sf):
    bars = series.ohlcv(_bars(spark, sf), "1 hour", price="value", tie="event_id")
    return bars.withColumn("bar_start", F.date_format("bar_start", "yyyy-MM-dd HH:mm:ss"))


@register("""
    SELECT user_id, event_id, event_type, value FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events) WHERE back = 1
""")
def latest_quote(spark, sf):
    return series.latest(read(spark, sf, "events"), "user_id", ORDER, ["event_id", "event_type", "value"])


@register("""
    WITH d AS (
        SELECT event_type AS symbol, date_trunc('day', ts) AS day, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume
        FROM events WHERE value IS NOT NULL GROUP BY 1, 2
    ), b AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY day) AS before, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS back FROM d)
    SELECT symbol, close AS price, open, high, low, volume, round(close - before, 6) AS change, round(100 * (close - before) / before, 6) AS change_pct FROM b WHERE back = 1
""")
def market_quote(spark, sf):
    """All eight fields of a quote from the last two days of ticks."""
    found = series.quote(_bars(spark, sf), price="value", tie="event_id")
    return found.withColumn("change", F.round("change", 6)).withColumn("change_pct", F.round("change_pct", 6))


_BLOCK = "avg(CASE WHEN {c} THEN x END) * avg(CASE WHEN {c} THEN x END) - avg(CASE WHEN {c} THEN s END) * avg(CASE WHEN {c} THEN s END)"
_FEATURES = {
    "diagonal_mean": "avg(2 * x * x - 1)", "diagonal_std": "stddev_pop(2 * x * x - 1)",
    "upper_left_mean": _BLOCK.format(c="pos <= floor(len / 2)"), "lower_right_mean": _BLOCK.format(c="pos > floor(len / 2)"),
    "gaf_sum_mean": "avg(x) * avg(x) - avg(s) * avg(s)",
    "gaf_sum_std": "sqrt(greatest(0.0, avg(x * x) * avg(x * x) - 2 * avg(x * s) * avg(x * s) + avg(s * s) * avg(s * s) - (avg(x) * avg(x) - avg(s) * avg(s)) * (avg(x) * avg(x) - avg(s) * avg(s))))",
    "gaf_diff_mean": "0.0", "gaf_diff_std": "sqrt(greatest(0.0, 2 * (avg(s * s) * avg(x * x) - avg(x * s) * avg(x * s))))",
    "trend_score": "avg(x) * avg(x) - avg(s) * avg(s)", "symmetry": "0.0",
    "recent_strength": _BLOCK.format(c="pos > len - 10"), "historical_strength": _BLOCK.format(c="pos <= 10"),
    "momentum": f"({_BLOCK.format(c='pos > len - 10')}) - ({_BLOCK.format(c='pos <= 10')})",
}


@register(f"WITH {LAST.format(n=100)} SELECT symbol, count(*) AS n_bars, {', '.join(f'CAST(round({v}, 6) + 0.0 AS DOUBLE) AS {k}' for k, v in _FEATURES.items())} FROM s GROUP BY symbol")
def gaf_features(spark, sf):
    """The flagship: all features of the last 100 bars of each series."""
    return series.gaf_features(_bars(spark, sf), 100, "symbol", ORDER)


@register(f"""
    WITH {LAST.format(n=20)} SELECT a.symbol, CAST(a.pos AS BIGINT) AS i, CAST(b.pos AS BIGINT) AS j,
           round(a.x * b.x - a.s * b.s, 6) + 0.0 AS gasf, round(a.s * b.x - a.x * b.s, 6) + 0.0 AS gadf
    FROM s a JOIN s b USING (symbol)
""")
def gaf_matrix(spark, sf):
    cells = series.gaf_matrix(_bars(spark, sf), 20, "symbol", ORDER)
    return cells.select("symbol", F.col("i").cast("long"), F.col("j").cast("long"), (F.round("gasf", 6) + F.lit(0.0)).alias("gasf"), (F.round("gadf", 6) + F.lit(0.0)).alias("gadf"))


@register(None)
def gaf_rgb_stats(spark, sf):
    """Pixels are made by NumPy; tests hold them against explicit matrices."""
    return series.image_stats(series.gaf_images(_bars(spark, sf), 100, "symbol", ORDER, size=64), "symbol")


SIGNALS = """
    sig AS (
        SELECT event_id, (event_id * 37 % 201 - 100) / 100.0 AS trend, (event_id * 53 % 201 - 100) / 100.0 AS momentum,
               CASE event_id % 3 WHEN 0 THEN 'bullish' WHEN 1 THEN 'bearish' ELSE 'neutral' END AS direction, (event_id * 7 % 101) / 100.0 AS confidence
        FROM events
    )
"""


def _signals(spark, sf):
    i = F.col("event_id")
    d = lambda c: c.cast("double")
    return read(spark, sf, "events").select(
        "event_id", (d(i * 37 % 201 - 100) / 100).alias("trend"), (d(i * 53 % 201 - 100) / 100).alias("momentum"),
        F.when(i % 3 == 0, "bullish").when(i % 3 == 1, "bearish").otherwise("neutral").alias("direction"), (d(i * 7 % 101) / 100).alias("confidence"),
    )


_SCORE = "CAST(greatest(0, least(100, trunc(round(50 + 20 * trend + 10 * momentum + 15 * (CASE direction WHEN 'bullish' THEN 1.0 WHEN 'bearish' THEN -1.0 ELSE 0.0 END) * confidence, 9)))) AS INT)"


def _score():
    args = [F.col(c) for c in ("trend", "momentum", "direction", "confidence")]
    raw = F.round(50 + 20 * args[0] + 10 * args[1] + 15 * sc.direction_sign(args[2]) * args[3], 9)
    return F.greatest(F.lit(0), F.least(F.lit(100), raw.cast("int")))


@register(f"""WITH {SIGNALS}, t AS (SELECT *, {_SCORE} AS score FROM sig)
    SELECT event_id, score, CASE WHEN score >= 55 THEN 'LONG' WHEN score <= 45 THEN 'SHORT' ELSE 'NEUTRAL' END AS side,
           round(least(0.95, 0.4 + 0.3 * (abs(trend) + abs(momentum) + confidence)), 6) AS fast_confidence FROM t""")
def signal_score(spark, sf):
    """Rounded at nine digits before it is truncated, as the two engines add in different orders."""
    s = _signals(spark, sf).withColumn("score", _score())
    return s.select("event_id", "score", sc.score_side(F.col("score")).alias("side"), F.round(sc.fast_confidence(F.col("trend"), F.col("momentum"), F.col("confidence")), 6).alias("fast_confidence"))


@register(f"""WITH {SIGNALS}, t AS (SELECT *, {_SCORE} AS score FROM sig)
    SELECT event_id, CASE WHEN score >= 80 THEN 'STRONG LONG' WHEN score >= 65 THEN 'LONG' WHEN score >= 55 THEN 'LEAN LONG' WHEN score >= 45 THEN 'NEUTRAL'
           WHEN score >= 35 THEN 'LEAN SHORT' WHEN score >= 20 THEN 'SHORT' ELSE 'STRONG SHORT' END AS label,
           CASE WHEN trend > 0 THEN 'Bullish' ELSE 'Bearish' END AS trend_label, CASE WHEN momentum > 0 THEN 'Positive' ELSE 'Negative' END AS momentum_label FROM t""")
def score_label(spark, sf):
    s = _signals(spark, sf).withColumn("score", _score())
    return s.select(
        "event_id", sc.score_label(F.col("score")).alias("label"),
        F.when(F.col("trend") > 0, "Bullish").otherwise("Bearish").alias("trend_label"), F.when(F.col("momentum") > 0, "Positive").otherwise("Negative").alias("momentum_label"),
    )


@register(f"""WITH {SIGNALS}, t AS (
        SELECT event_id, direction, confidence, ((CASE direction WHEN 'bullish' THEN 1.0 WHEN 'bearish' THEN -1.0 ELSE 0.0 END) * confidence
               + (CASE WHEN trend > 0 THEN 1.0 ELSE -1.0 END) * abs(momentum)) / (confidence + abs(momentum) + 0.00000001) AS e FROM sig)
    SELECT event_id, CAST(round(e, 4) + 0.0 AS DOUBLE) AS ensemble_score, CASE WHEN round(e, 9) > 0.2 THEN 'LONG' WHEN round(e, 9) < -0.2 THEN 'SHORT' ELSE 'FLAT' END AS side,
           CASE WHEN direction = 'bullish' AND confidence > 0.5 THEN 'LONG' WHEN direction = 'bearish' AND confidence > 0.5 THEN 'SHORT' ELSE 'FLAT' END AS predictor_side FROM t""")
def ensemble_decision(spark, sf):
    e = F.round(sc.ensemble_score(F.col("direction"), F.col("confidence"), F.col("trend"), F.abs("momentum")), 9)
    return _signals(spark, sf).select("event_id", (F.round(sc.ensemble_score(F.col("direction"), F.col("confidence"), F.col("trend"), F.abs("momentum")), 4) + F.lit(0.0)).alias("ensemble_score"), sc.ensemble_side(e).alias("side"), sc.predictor_side(F.col("direction"), F.col("confidence")).alias("predictor_side"))


@register("""
    WITH l AS (SELECT event_id, [value / 100, (event_id % 7) / 2.0, 1.5] AS v FROM events),
    m AS (SELECT *, greatest(v[1], v[2], v[3]) AS m FROM l)
    SELECT event_id, CASE WHEN v[1] = m THEN 'bullish' WHEN v[2] = m THEN 'bearish' ELSE 'neutral' END AS label,
           round(1 / (exp(v[1] - m) + exp(v[2] - m) + exp(v[3] - m)), 6) AS confidence FROM m
""")
def predictor_classes(spark, sf):
    """Softmax and arg max of a model's three logits (here drawn from the events)."""
    logits = F.array(F.col("value") / 100, (F.col("event_id") % 7) / 2.0, F.lit(1.5))
    return read(spark, sf, "events").select("event_id", sc.class_of(logits, ["bullish", "bearish", "neutral"]).alias("label"), F.round(F.array_max(sc.softmax(logits)), 6).alias("confidence"))


_RATES = "SELECT l_suppkey AS symbol, l_discount AS rate, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_quantity END AS oi FROM lineitem"


@register(f"""WITH r AS ({_RATES})
    SELECT symbol, round(CASE WHEN sum(coalesce(oi, 1)) > 0 THEN sum(rate * coalesce(oi, 1)) / sum(coalesce(oi, 1)) ELSE coalesce(avg(CASE WHEN rate <> 0 THEN rate END), 0) END, 6) AS rate
    FROM r WHERE rate IS NOT NULL GROUP BY symbol""")
def oi_weighted_rate(spark, sf):
    rows = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.col("l_discount").alias("rate"), F.when(F.col("l_linenumber") % 5 != 0, F.col("l_quantity")).alias("oi"))
    return derivatives.weighted_rate(rows, "symbol", "rate", "oi").withColumn("rate", F.round("rate", 6))


@register("""
    WITH f AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE (event_id * 13 % 41 - 20) / 1000.0 END AS rate FROM events)
    SELECT event_id, CASE WHEN rate IS NULL THEN 'unknown' WHEN rate > 0.01 THEN 'very_bullish' WHEN rate > 0.005 THEN 'bullish' WHEN rate > -0.005 THEN 'neutral'
           WHEN rate > -0.01 THEN 'bearish' ELSE 'very_bearish' END AS sentiment FROM f
""")
def funding_sentiment(spark, sf):
    i = F.col("event_id")
    rate = F.when(i % 11 != 0, (i * 13 % 41 - 20).cast("double") / 1000)
    return read(spark, sf, "events").select("event_id", sc.funding_sentiment(rate).alias("sentiment"))


@register("""
    WITH f AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE (event_id * 13 % 41) / 10.0 END AS ratio FROM events)
    SELECT event_id, CASE WHEN ratio IS NULL THEN 'unknown' WHEN ratio > 3 THEN 'extremely_long' WHEN ratio > 2 THEN 'heavily_long' WHEN ratio > 1.2 THEN 'slightly_long'
           WHEN ratio > 0.8 THEN 'neutral' WHEN ratio > 0.5 THEN 'slightly_short' ELSE 'heavily_short' END AS sentiment FROM f
""")
def positioning_sentiment(spark, sf):
    i = F.col("event_id")
    return read(spark, sf, "events").select("event_id", sc.positioning_sentiment(F.when(i % 11 != 0, (i * 13 % 41).cast("double") / 10)).alias("sentiment"))


_SYMBOLS = "CASE o_orderkey % 6 WHEN 0 THEN 'BTC-USD' WHEN 1 THEN 'ES=F' WHEN 2 THEN 'PEPE-USD' WHEN 3 THEN 'AAPL' WHEN 4 THEN 'ETH-USD' ELSE 'GC=F' END"


def _symbols(spark, sf):
    names = F.array(*map(F.lit, ["BTC-USD", "ES=F", "PEPE-USD", "AAPL", "ETH-USD", "GC=F"]))
    return read(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.element_at(names, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("symbol"))


@register(f"""
    SELECT o_orderkey, symbol, CASE WHEN symbol IN ('ES=F', 'GC=F') THEN NULL WHEN ends_with(symbol, '-USD') THEN replace(symbol, '-USD', '') END AS base
    FROM (SELECT o_orderkey, {_SYMBOLS} AS symbol FROM orders)
""")
def symbol_map(spark, sf):
    return derivatives.map_symbols(_symbols(spark, sf), "symbol").select("o_orderkey", "symbol", "base")


@register(f"""
    WITH r AS ({_RATES}), q AS (SELECT o_orderkey, {_SYMBOLS} AS symbol, o_totalprice FROM orders),
    d AS (SELECT CASE l_suppkey % 3 WHEN 0 THEN 'BTC' WHEN 1 THEN 'PEPE' ELSE 'XYZ' END AS base, l_suppkey, l_orderkey, l_linenumber, l_discount AS rate FROM lineitem),
    m AS (SELECT base, arg_max(rate, (l_orderkey, l_linenumber, rate)) AS rate FROM d GROUP BY base)
    SELECT q.o_orderkey, q.symbol, q.o_totalprice AS price, m.rate,
           CASE WHEN m.base IS NULL THEN 'unavailable' WHEN m.rate IS NULL THEN 'unknown' WHEN m.rate > 0.01 THEN 'very_bullish' WHEN m.rate > 0.005 THEN 'bullish' WHEN m.rate > -0.005 THEN 'neutral'
                WHEN m.rate > -0.01 THEN 'bearish' ELSE 'very_bearish' END AS funding_sentiment
    FROM q LEFT JOIN m ON m.base = CASE WHEN q.symbol IN ('ES=F', 'GC=F') THEN NULL WHEN ends_with(q.symbol, '-USD') THEN replace(q.symbol, '-USD', '') END
""")
def price_derivatives_join(spark, sf):
    rates = read(spark, sf, "lineitem").select(F.element_at(F.array(F.lit("BTC"), F.lit("PEPE"), F.lit("XYZ")), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("base"), "l_orderkey", "l_linenumber", F.col("l_discount").alias("rate"))
    now = series.latest(rates, "base", ["l_orderkey", "l_linenumber", "rate"], ["rate"])
    joined = derivatives.price_with_derivatives(_symbols(spark, sf), now, "symbol")
    return joined.select("o_orderkey", "symbol", F.col("o_totalprice").alias("price"), "rate", "funding_sentiment")


@register("""
    WITH raw AS (SELECT event_id, event_id % 5 AS k, value FROM events)
    SELECT event_id AS payload, strftime(make_timestamp(event_id * 60000 * 1000), '%Y-%m-%d %H:%M:%S') AS ts, round(value / 1000, 6) AS rate FROM raw WHERE k <> 0
""")
def funding_payload(spark, sf):
    """Vendor JSON with malformed rows (here written from the events); those are left out."""
    good = F.format_string('{"time": %d, "close": "%s"}', F.col("event_id") * 60000, F.round(F.col("value") / 1000, 6).cast("string"))
    body = F.concat(F.lit('{"code": "0", "data": ['), F.when(F.col("event_id") % 5 == 0, F.lit('{"close": "x"}')).otherwise(good), F.lit("]}"))
    raw = read(spark, sf, "events").select(F.col("event_id").alias("payload"), body.alias("body"))
    return derivatives.funding_rows(raw, "payload", "body").select("payload", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.round("rate", 6).alias("rate"))


@register("""
    SELECT event_id AS payload, CASE WHEN event_id % 4 = 1 THEN 50.0 ELSE round(value / 10, 6) END AS long_pct, 50.0 AS short_pct, CASE WHEN event_id % 4 = 2 THEN 1.0 ELSE 1.5 END AS ratio
    FROM events WHERE event_id % 4 <> 0
""")
def positioning_payload(spark, sf):
    """Vendor JSON with missing figures (defaults) and bad rows (left out), here written from the events."""
    i = F.col("event_id")
    share = F.when(i % 4 == 1, F.lit("")).otherwise(F.concat(F.lit('"longRatio": "'), F.round(F.col("value") / 10, 6).cast("string"), F.lit('", ')))
    ratio = F.when(i % 4 == 2, F.lit("")).otherwise(F.lit('"longShortRatio": "1.5", '))
    bad = F.when(i % 4 == 0, F.lit('"shortRatio": "x", ')).otherwise(F.lit(""))
    body = F.concat(F.lit('{"code": "0", "data": [{'), share, ratio, bad, F.lit('"time": 1700000000000}]}'))
    raw = read(spark, sf, "events").select(i.alias("payload"), body.alias("body"))
    return derivatives.ratio_rows(raw, "payload", "body").select("payload", F.round("long_pct", 6).alias("long_pct"), "short_pct", "ratio")
