"""Scores, labels and parsers as column expressions; nothing here runs Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cut points and names of the labels.
SCORE_LABELS = [(80, "STRONG LONG"), (65, "LONG"), (55, "LEAN LONG"), (45, "NEUTRAL"), (35, "LEAN SHORT"), (20, "SHORT")]
FUNDING = [(0.01, "very_bullish"), (0.005, "bullish"), (-0.005, "neutral"), (-0.01, "bearish")]
POSITIONING = [(3.0, "extremely_long"), (2.0, "heavily_long"), (1.2, "slightly_long"), (0.8, "neutral"), (0.5, "slightly_short")]


def ladder(value: Column, steps: list[tuple[float, str]], last: str, strict: bool = True) -> Column:
    """The name of the first step that ``value`` is above (or, not strict, at least); ``last`` below all."""
    out = None
    for bound, name in steps:
        hit = value > bound if strict else value >= bound
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(last)


def funding_sentiment(rate: Column) -> Column:
    return F.when(rate.isNull(), "unknown").otherwise(ladder(rate, FUNDING, "very_bearish"))


def positioning_sentiment(ratio: Column) -> Column:
    return F.when(ratio.isNull(), "unknown").otherwise(ladder(ratio, POSITIONING, "heavily_short"))


def direction_sign(direction: Column) -> Column:
    return F.when(direction == "bullish", 1.0).when(direction == "bearish", -1.0).otherwise(0.0)


def signal_score(trend: Column, momentum: Column, direction: Column, confidence: Column) -> Column:
    """0 to 100; the sum is truncated towards zero before it is clamped."""
    raw = 50 + 20 * trend + 10 * momentum + 15 * direction_sign(direction) * confidence
    return F.greatest(F.lit(0), F.least(F.lit(100), raw.cast("int")))


def score_side(score: Column) -> Column:
    return F.when(score >= 55, "LONG").when(score <= 45, "SHORT").otherwise("NEUTRAL")


def score_label(score: Column) -> Column:
    return ladder(score, SCORE_LABELS, "STRONG SHORT", strict=False)


def fast_confidence(trend: Column, momentum: Column, confidence: Column) -> Column:
    return F.least(F.lit(0.95), 0.4 + 0.3 * (F.abs(trend) + F.abs(momentum) + confidence))


def ensemble_score(direction: Column, model_weight: Column, trend: Column, text_weight: Column) -> Column:
    """Weighted vote of the image model's direction and the sign of the trend (zero counts as negative)."""
    sign = F.when(trend > 0, 1.0).otherwise(-1.0)
    return (direction_sign(direction) * model_weight + sign * text_weight) / (model_weight + text_weight + 1e-8)


def ensemble_side(score: Column) -> Column:
    return F.when(score > 0.2, "LONG").when(score < -0.2, "SHORT").otherwise("FLAT")


def predictor_side(direction: Column, confidence: Column) -> Column:
    sure = confidence > 0.5
    return F.when((direction == "bullish") & sure, "LONG").when((direction == "bearish") & sure, "SHORT").otherwise("FLAT")


def channel_confidence(error: Column) -> Column:
    """1 minus the binary entropy of the error, clamped to [0, 0.5]; 0 gives 1, and 0.5 or more gives 0.5."""
    e = F.greatest(F.lit(0.0), F.least(F.lit(0.5), error))
    return F.when(e == 0, 1.0).when(e >= 0.5, 0.5).otherwise(1 + e * F.log2(e) + (1 - e) * F.log2(1 - e))


def parsed_confidence(text: Column) -> Column:
    """Confidence in a free text: error probability, else mean of the bounds, else mean of the numbers in [0, 1], else 0.5.

    A number that does not parse (as in ``0.1.``) gives 0.5 at once.
    """
    number = lambda name: F.regexp_extract(text, name + r":\s*([\d.]+)", 1)
    error, low, high = number("ERROR_PROBABILITY"), number("CONFIDENCE_LOW"), number("CONFIDENCE_HIGH")
    value = lambda x: x.try_cast("double")
    bounds = (value(low) + value(high)) / 2
    loose = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(\d+\.?\d*)"), F.lit(1)), lambda x: x.try_cast("double")), lambda x: (x >= 0) & (x <= 1))
    mean = F.aggregate(loose, F.lit(0.0), lambda a, x: a + x) / F.size(loose)
    return (
        F.when(error != "", F.coalesce(channel_confidence(value(error)), F.lit(0.5)))
        .when((low != "") & (high != ""), F.coalesce(bounds, F.lit(0.5)))
        .when(F.size(loose) > 0, mean)
        .otherwise(0.5)
    )


def parsed_decision(text: Column) -> Column:
    up = F.upper(text)
    said = F.lower(F.regexp_extract(up, r"DECISION:\s*(LONG|SHORT|FLAT)", 1))
    long, short = up.contains("LONG"), up.contains("SHORT")
    return F.when(said != "", said).when(long & ~short, "long").when(short & ~long, "short").otherwise("flat")


def gated_decision(text: Column, confidence: Column, threshold: float) -> Column:
    return F.when(confidence < threshold, "refine").otherwise(parsed_decision(text))


def pattern_score(text: Column, name: str) -> Column:
    """The first number right behind ``name`` in the lower-cased text, clamped to 1..10; 5 without one."""
    found = F.regexp_extract(F.lower(text), name + r"[:\s=]+(\d+)", 1)
    return F.when(found == "", 5).otherwise(F.greatest(F.lit(1), F.least(F.lit(10), found.try_cast("int"))))


def outcome_correct(decision: Column, change: Column) -> Column:
    return F.when(decision == "long", change > 0).when(decision == "short", change < 0).otherwise(F.abs(change) < 0.01)


def weighted_confidence(confidences: Column, weights: Column) -> Column:
    """Sum of products over the shorter length (weights are not normalised); null weights are equal, no confidences give 0.5."""
    n = F.size(confidences)
    even = F.transform(confidences, lambda c: F.lit(1.0) / n)
    total = F.aggregate(F.zip_with(confidences, F.coalesce(weights, even), lambda c, w: F.coalesce(c * w, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    return F.when(n > 0, total).otherwise(0.5)


def final_decision(decision: Column) -> Column:
    return F.when(decision.isin("long", "short", "flat"), decision).otherwise("flat")


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x))


def class_of(logits: Column, names: list[str]) -> Column:
    """The name of the largest logit, the first of equals."""
    return F.element_at(F.array(*map(F.lit, names)), F.array_position(logits, F.array_max(logits)).cast("int"))
