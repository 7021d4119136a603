"""Rules on derivatives data: weighted rates, payload parsing, symbol mapping, price joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import funding_sentiment

#: Futures, which have no derivatives data.
FUTURES = ["ES=F", "NQ=F", "YM=F", "GC=F", "CL=F"]


def weighted_rate(rows: DataFrame, by: str, rate: str, interest: str) -> DataFrame:
    """Mean rate weighted by open interest (missing: 1); where the weights sum to 0 or less, the mean of the rates that are not 0, else 0.

    Rows whose rate is null are left out. One aggregation with map-side combine, whatever the skew of ``by``.
    """
    r, w = F.col(rate), F.coalesce(F.col(interest), F.lit(1.0))
    sums = rows.where(r.isNotNull()).groupBy(by).agg(F.sum(r * w).alias("_rw"), F.sum(w).alias("_w"), F.avg(F.when(r != 0, r)).alias("_plain"))
    return sums.select(by, F.when(F.col("_w") > 0, F.try_divide("_rw", "_w")).otherwise(F.coalesce("_plain", F.lit(0.0))).alias("rate"))


def _payload(raw: DataFrame, key: str, body: str, fields: str) -> DataFrame:
    parsed = F.from_json(body, f"code string, data array<struct<{fields}>>")
    return raw.select(key, parsed.alias("p")).where("p.code = '0'").select(key, F.explode("p.data").alias("d"))


def funding_rows(raw: DataFrame, key: str, body: str) -> DataFrame:
    """key, ts, rate of the vendor's funding history (times in milliseconds); rows without a time or a number are left out."""
    rows = _payload(raw, key, body, "time: bigint, close: string").select(key, F.timestamp_millis("d.time").alias("ts"), F.col("d.close").try_cast("double").alias("rate"))
    return rows.where("ts is not null and rate is not null")


def ratio_rows(raw: DataFrame, key: str, body: str) -> DataFrame:
    """key, ts, long_pct, short_pct, ratio of the vendor's positioning history; missing figures are 50, 50 and 1, rows without a time go."""
    rows = _payload(raw, key, body, "time: bigint, longRatio: string, shortRatio: string, longShortRatio: string")
    number = lambda c, d: F.coalesce(F.col(c).try_cast("double"), F.lit(d))
    bad = " or ".join(f"(d.{c} is not null and try_cast(d.{c} as double) is null)" for c in ("longRatio", "shortRatio", "longShortRatio"))
    return rows.where(f"d.time is not null and not ({bad})").select(key, F.timestamp_millis("d.time").alias("ts"), number("d.longRatio", 50.0).alias("long_pct"), number("d.shortRatio", 50.0).alias("short_pct"), number("d.longShortRatio", 1.0).alias("ratio"))


def map_symbols(rows: DataFrame, symbol: str) -> DataFrame:
    """``base``: the derivatives symbol of a quote symbol; null for futures and unknown symbols."""
    s = F.col(symbol)
    return rows.withColumn("base", F.when(~s.isin(FUTURES) & s.endswith("-USD"), F.replace(s, F.lit("-USD"), F.lit(""))))


def price_with_derivatives(prices: DataFrame, rates: DataFrame, symbol: str) -> DataFrame:
    """Every price row with its symbol's current rate and sentiment; ``unavailable`` where there is none.

    ``rates`` (base, rate) has one row a symbol; the join strategy is left to the optimiser, which splits hot symbols.
    """
    known = rates.withColumn("_known", F.lit(True))
    joined = map_symbols(prices, symbol).join(known, "base", "left")
    return joined.withColumn("funding_sentiment", F.when(F.col("_known"), funding_sentiment(F.col("rate"))).otherwise("unavailable")).drop("_known")
