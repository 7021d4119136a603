"""Ordered series: bars, last-N windows, Gramian angular fields.

The field's features never build the N x N matrix: with x the scaled series and s = sqrt(1 - x^2), every mean and spread of
cos(phi_i + phi_j) = x_i x_j - s_i s_j and sin(phi_i - phi_j) = s_i x_j - x_i s_j follows from averages of x, s, x^2, s^2, x s,
so a series is one group of a plain aggregation. Ranking the last N bars keeps N rows a series.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ohlcv(ticks: DataFrame, width: str, symbol: str = "symbol", ts: str = "ts", price: str = "price", tie: str = "tie") -> DataFrame:
    """symbol, bar_start, open, high, low, close, volume (ticks) of each bar; ticks of one time are ordered by ``tie``."""
    at = F.struct(ts, tie)
    bars = ticks.groupBy(symbol, F.window(ts, width).alias("w")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").alias("volume")
    )
    return bars.select(F.col(symbol).alias("symbol"), F.col("w.start").alias("bar_start"), "open", "high", "low", "close", "volume")


def latest(rows: DataFrame, by: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each group as a projection of ``columns``, by aggregation (no sort of the group)."""
    last = F.max_by(F.struct(*columns), F.struct(*order)).alias("r")
    return rows.groupBy(by).agg(last).select(by, *(F.col(f"r.{c}").alias(c) for c in columns))


def quote(ticks: DataFrame, symbol: str = "symbol", ts: str = "ts", price: str = "price", tie: str = "tie") -> DataFrame:
    """symbol, price, open, high, low, volume (ticks), change, change_pct: the last day of each series against the close of the day before it that has ticks.

    Days are those of the session's time zone. Without an earlier day the change is null; so is the percentage if that close is 0.
    """
    days = ohlcv(ticks.where(F.col(price).isNotNull()), "1 day", symbol, ts, price, tie)
    both = F.array_sort(F.collect_list(F.struct("bar_start", "open", "high", "low", "close", "volume")))
    last, before = F.element_at("d", -1), F.when(F.size("d") > 1, F.element_at("d", -2)["close"])
    back = Window.partitionBy("symbol").orderBy(F.col("bar_start").desc())
    two = days.withColumn("_back", F.row_number().over(back)).where("_back <= 2").groupBy("symbol").agg(both.alias("d"))
    change = last["close"] - before
    return two.select("symbol", last["close"].alias("price"), last["open"].alias("open"), last["high"].alias("high"), last["low"].alias("low"), last["volume"].alias("volume"), change.alias("change"), F.try_divide(100 * change, before).alias("change_pct"))


def last_n(bars: DataFrame, n: int, by: str, order: list[str]) -> DataFrame:
    """The last ``n`` rows of each series with ``pos`` from 1 (oldest kept) and ``len``, the number kept."""
    backward = Window.partitionBy(by).orderBy(*(F.col(c).desc() for c in order))
    kept = bars.withColumn("_back", F.row_number().over(backward)).where(F.col("_back") <= n)
    size = F.max("_back").over(Window.partitionBy(by))
    return kept.withColumn("len", size).withColumn("pos", F.col("len") - F.col("_back") + 1).drop("_back")


def scaled(series: DataFrame, by: str, value: str = "value", flat: float | None = None) -> DataFrame:
    """``x``: the value scaled to [-1, 1] within its series; a constant series keeps its values, or takes ``flat``."""
    w = Window.partitionBy(by)
    low, high, v = F.min(value).over(w), F.max(value).over(w), F.col(value)
    constant = v if flat is None else F.lit(flat)
    return series.withColumn("x", F.when(high > low, 2 * (v - low) / (high - low) - 1).otherwise(constant))


def angle_part(x: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), 1 - x * x))


#: The features in order.
FEATURES = [
    "diagonal_mean", "diagonal_std", "upper_left_mean", "lower_right_mean", "gaf_sum_mean", "gaf_sum_std", "gaf_diff_mean", "gaf_diff_std",
    "trend_score", "symmetry", "recent_strength", "historical_strength", "momentum",
]


def gaf_features(bars: DataFrame, lookback: int, by: str, order: list[str], value: str = "value", digits: int | None = 6) -> DataFrame:
    """``by``, n_bars and the features of the field of the last ``lookback`` bars of every series.

    A constant series has x = -1 throughout (the field's own scaling). Null values are left out before the window.
    """
    x0 = scaled(last_n(bars.where(F.col(value).isNotNull()), lookback, by, order), by, value, flat=-1.0)
    rows = x0.select(by, "pos", "len", "x", angle_part(F.col("x")).alias("s"))
    half = F.floor(F.col("len") / 2)
    x, s = F.col("x"), F.col("s")
    parts = {"all": F.lit(True), "first": F.col("pos") <= half, "second": F.col("pos") > half, "recent": F.col("pos") > F.col("len") - 10, "old": F.col("pos") <= 10}
    aggs = [F.count("*").alias("n_bars"), F.avg(2 * x * x - 1).alias("dm"), F.stddev_pop(2 * x * x - 1).alias("ds"), F.avg(x * x).alias("xx"), F.avg(s * s).alias("ss"), F.avg(x * s).alias("xs")]
    aggs += [F.avg(F.when(cond, v)).alias(f"{name}_{c}") for name, cond in parts.items() for c, v in (("x", x), ("s", s))]
    g = rows.groupBy(by).agg(*aggs)
    block = lambda name: F.col(f"{name}_x") * F.col(f"{name}_x") - F.col(f"{name}_s") * F.col(f"{name}_s")
    mean = block("all")
    second = F.col("xx") * F.col("xx") - 2 * F.col("xs") * F.col("xs") + F.col("ss") * F.col("ss")
    spread = F.sqrt(F.greatest(F.lit(0.0), second - mean * mean))
    cross = F.sqrt(F.greatest(F.lit(0.0), 2 * (F.col("ss") * F.col("xx") - F.col("xs") * F.col("xs"))))
    found = {
        "diagonal_mean": F.col("dm"), "diagonal_std": F.col("ds"), "upper_left_mean": F.coalesce(block("first"), F.lit(None).cast("double")), "lower_right_mean": block("second"),
        "gaf_sum_mean": mean, "gaf_sum_std": spread, "gaf_diff_mean": F.lit(0.0), "gaf_diff_std": cross, "trend_score": mean, "symmetry": F.lit(0.0),
        "recent_strength": block("recent"), "historical_strength": block("old"), "momentum": block("recent") - block("old"),
    }
    tidy = (lambda c: F.round(c, digits) + F.lit(0.0)) if digits is not None else (lambda c: c)
    return g.select(by, "n_bars", *(tidy(found[f]).alias(f) for f in FEATURES))


def gaf_matrix(bars: DataFrame, lookback: int, by: str, order: list[str], value: str = "value") -> DataFrame:
    """``by``, i, j, gasf, gadf in long form; a series has at most ``lookback`` squared cells."""
    rows = scaled(last_n(bars, lookback, by, order), by, value, flat=-1.0).select(by, "pos", "x", angle_part(F.col("x")).alias("s"))
    left = rows.select(by, F.col("pos").alias("i"), F.col("x").alias("xi"), F.col("s").alias("si"))
    right = rows.select(by, F.col("pos").alias("j"), F.col("x").alias("xj"), F.col("s").alias("sj"))
    cells = left.join(right, by)
    return cells.select(by, "i", "j", (F.col("xi") * F.col("xj") - F.col("si") * F.col("sj")).alias("gasf"), (F.col("si") * F.col("xj") - F.col("xi") * F.col("sj")).alias("gadf"))


def resize(image: np.ndarray, size: int) -> np.ndarray:
    """Bilinear, corners aligned."""
    n = len(image)
    if n == size:
        return image
    at = np.linspace(0, n - 1, size)
    low = np.minimum(at.astype(int), max(0, n - 2))
    part = at - low
    high = np.minimum(low + 1, n - 1)
    rows = image[low] * (1 - part)[:, None] + image[high] * part[:, None]
    return rows[:, low] * (1 - part) + rows[:, high] * part


def gaf_image(values: np.ndarray, size: int = 224) -> np.ndarray:
    """Height x width x 3 bytes: sum field, difference field and outer product, each scaled to 0..255."""
    v = np.asarray(values, float)
    low, high = v.min(), v.max()
    x = 2 * (v - low) / (high - low) - 1 if high - low > 1e-8 else np.zeros_like(v)
    field = x if high - low > 1e-8 else np.full_like(v, -1.0)
    s = np.sqrt(np.maximum(0, 1 - field * field))
    channels = []
    for m in (np.outer(field, field) - np.outer(s, s), np.outer(s, field) - np.outer(field, s), np.outer(x, x)):
        a, b = m.min(), m.max()
        m = (m - a) / (b - a) if b - a > 1e-8 else np.full_like(m, 0.5)
        channels.append(np.clip(resize(m, size), 0, 1))
    return (np.stack(channels, -1) * 255).astype(np.uint8)


def gaf_images(bars: DataFrame, lookback: int, by: str, order: list[str], value: str = "value", size: int = 224) -> DataFrame:
    """``by``, height, width, image (binary, row-major HWC) of every series; the pixels are made in Arrow batches."""
    series = last_n(bars.where(F.col(value).isNotNull()), lookback, by, order).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v")))).alias("p"))
    kind = series.schema[by].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]):
        for part in parts:
            part["image"] = [gaf_image(np.array(v), size).tobytes() for v in part.pop("v")]
            yield part.assign(height=size, width=size)[[by, "height", "width", "image"]]

    return series.select(by, F.col("p.v").alias("v")).mapInPandas(run, f"{by} {kind}, height int, width int, image binary")


def image_stats(images: DataFrame, by: str) -> DataFrame:
    """``by``, channel, low, high, mean of each channel of the images."""
    kind = images.schema[by].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]):
        for part in parts:
            rows = []
            for key, h, w, data in zip(part[by], part["height"], part["width"], part["image"]):
                pixels = np.frombuffer(data, np.uint8).reshape(h, w, 3)
                rows += [(key, c, int(pixels[..., c].min()), int(pixels[..., c].max()), round(float(pixels[..., c].mean()), 6)) for c in range(3)]
            yield pd.DataFrame(rows, columns=[by, "channel", "low", "high", "mean"])

    return images.select(by, "height", "width", "image").mapInPandas(run, f"{by} {kind}, channel int, low int, high int, mean double")
