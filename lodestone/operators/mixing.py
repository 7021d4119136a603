"""Mixing of sources, deterministic draws, and generated training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import positions
from .twister import draws as sequence


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) drawn from the keys: the same on every run and cluster."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) / float(1 << 52)


def interleave(rows: DataFrame, source: str, order: str) -> DataFrame:
    """Rows in turn, one of each source, until the smallest source is exhausted: ``turn`` and ``place`` (the source's rank by name).

    A null source is a source, the last one by name. Within a source a null ``order`` comes first.
    """
    ranked = positions(rows, order, [source], "turn").withColumn("turn", F.col("turn") + 1)
    counts = rows.groupBy(F.col(source).alias("_named")).count()
    names = counts.select("_named", F.row_number().over(Window.orderBy(F.col("_named").asc_nulls_last())).alias("place"))  # one row a source
    least = counts.agg(F.min("count").alias("least"))
    placed = ranked.join(F.broadcast(names), F.col(source).eqNullSafe(F.col("_named"))).drop("_named")
    return placed.crossJoin(F.broadcast(least)).where(F.col("turn") <= F.col("least")).drop("least")


def ratio_mix(rows: DataFrame, source: str, order: str, shares: dict[str, float], seed: int = 42, twister: bool = False) -> DataFrame:
    """Rows of the sources drawn by share until the drawn source is exhausted: ``draw`` numbers the draws.

    Draws are numbers of a range, so they are made in parallel; a draw's rank among those of its source picks the row. Shares
    of 0 are left out; without a share above 0 the result is empty. With ``twister`` the draws are those of Python's generator
    with that seed, one ``random()`` a draw, and shares are taken in the order in which they are given.
    """
    shares = {k: v for k, v in shares.items() if v > 0}
    counts = {r[source]: r["count"] for r in rows.where(F.col(source).isin([*shares])).groupBy(source).count().collect()}
    total, low, bounds = sum(shares.values()), 0.0, []
    for name, share in shares.items() if twister else sorted(shares.items()):
        bounds.append((name, low / total, (low + share) / total))
        low += share
    spark = rows.sparkSession
    u = F.col("u") if twister else uniform(seed, F.col("draw"))
    picked = F.lit(bounds[-1][0]) if bounds else F.lit(None).cast("string")
    for name, _, high in reversed(bounds[:-1]):
        picked = F.when(u < high, name).otherwise(picked)
    many = sum(counts.values()) + 1
    drawn = sequence(spark, many, seed) if twister else spark.range(many).withColumnRenamed("id", "draw")
    draws = drawn.withColumn(source, picked).drop("u")
    ranked = positions(draws, "draw", [source]).withColumn("_rank", F.col("_rank") + 1)
    over = F.lit(False)
    for name in shares:
        over = over | ((F.col(source) == name) & (F.col("_rank") > counts.get(name, 0)))
    stop = ranked.where(over).agg(F.min("draw").alias("_stop"))
    mine = positions(rows, order, [source]).withColumn("_rank", F.col("_rank") + 1)
    return mine.join(ranked, [source, "_rank"]).crossJoin(F.broadcast(stop)).where(F.col("_stop").isNull() | (F.col("draw") < F.col("_stop"))).drop("_rank", "_stop")


def shuffled(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)


# Kinds of generated samples and their shares.
KINDS = [("gaf", 0.30), ("strategy", 0.30), ("rl", 0.15), ("cot", 0.25)]

#: Placeholders that a template may hold, with the values to draw from.
POOLS = {
    "indicator": ["RSI", "MACD", "Bollinger Bands", "EMA crossover", "ATR"],
    "asset": ["BTC", "ETH", "ES futures", "SPY"],
    "timeframe": ["1m", "5m", "15m", "1h", "4h", "1d"],
    "window": ["20", "50", "100", "200"],
    "image_size": ["32", "64", "128", "224"],
    "reward": ["sharpe ratio", "profit and loss", "drawdown penalty"],
    "regime": ["trending", "mean_reverting", "volatile", "quiet"],
}
#: Instruction, reasoning and response of each kind's templates; ``{name}`` is drawn from its pool, an unknown name stays.
TEMPLATES = {
    "gaf": [
        ("Turn {window} bars of {asset} into an angular field image of {image_size} pixels.", "Scale the closes to [-1, 1], take their angles, and fill the sum field.", "fields = angular_field(closes[-{window}:], size={image_size})"),
        ("Which features of an angular field tell whether {asset} trends on {timeframe} bars?", "The mean of the sum field and its corners compare old and recent strength.", "features = field_features(closes[-{window}:])\ntrend = features['recent'] - features['old']"),
        ("Feed angular fields of {asset} to an image model that names the regime.", "Stack sum field, difference field and outer product as channels of {image_size} pixels.", "image = stack_fields(closes[-{window}:], {image_size})\nregime = model.predict(image)  # e.g. {regime}"),
    ],
    "strategy": [
        ("Write a {timeframe} strategy for {asset} on {indicator}.", "Enter when {indicator} turns with the trend; stay flat in a {regime} market.", "def strategy(data):\n    return 'long' if signal(data, '{indicator}') > 0 else 'flat'"),
        ("Trade breakouts of the last {window} {timeframe} bars of {asset}.", "A close above the range opens a long, one below it a short; inside the range nothing happens.", "def strategy(data):\n    high, low = data[-{window}:-1].max(), data[-{window}:-1].min()\n    return 'long' if data[-1] > high else 'short' if data[-1] < low else 'flat'"),
        ("Combine {indicator} with a volatility filter for {asset}.", "In a {regime} market the signal counts only if the recent range is below its mean over {window} bars.", "def strategy(data):\n    calm = spread(data[-10:]) < spread(data[-{window}:])\n    return 'long' if calm and signal(data, '{indicator}') > 0 else 'flat'"),
    ],
    "rl": [
        ("Design a trading environment for {asset} whose reward is {reward}.", "Observations are the last {window} bars; actions are long, short, flat.", "class Env:\n    reward = '{reward}'\n    window = {window}"),
    ],
    "cot": [
        ("Is {asset} on {timeframe} bars in a {regime} regime?", "Compare recent and historical strength over {window} bars.", "DECISION: flat unless {indicator} confirms the {regime} regime."),
        ("{indicator} on {asset} rises while the price falls. What now?", "First the size of the divergence over {window} bars, then the regime, then the risk.", "DECISION: long with half the size if the regime is not {regime}."),
        ("How sure is a short on {asset} after {window} falling {timeframe} bars?", "Long runs end more often than they go on in a {regime} market; the error probability is high.", "ERROR_PROBABILITY: 0.4\nDECISION: flat"),
    ],
}


def kind_of(u: Column) -> Column:
    out, high = None, 0.0
    for name, share in KINDS[:-1]:
        high += share
        out = F.when(u < high, name) if out is None else out.when(u < high, name)
    return out.otherwise(KINDS[-1][0])


def fill(template: Column, seed: int, key: Column) -> Column:
    """Each placeholder replaced by a value drawn by (seed, key, name)."""
    for name, pool in sorted(POOLS.items()):
        pick = F.element_at(F.array(*map(F.lit, pool)), (F.pmod(F.xxhash64(F.lit(seed), key, F.lit(name)), F.lit(len(pool))) + 1).cast("int"))
        template = F.replace(template, F.lit("{" + name + "}"), pick)
    return template


def synthetic(spark, count: int, seed: int = 42) -> DataFrame:
    """sample_id, kind, instruction, reasoning, response, text of ``count`` generated samples, made on the executors."""
    ids = spark.range(count).withColumnRenamed("id", "sample_id").withColumn("kind", kind_of(uniform(seed, F.col("sample_id"))))

    def part(i: int) -> Column:
        out = F.lit(None).cast("string")
        for kind, texts in TEMPLATES.items():
            pick = F.pmod(F.xxhash64(F.lit(seed), F.col("sample_id"), F.lit("template")), F.lit(len(texts))) + 1
            out = F.when(F.col("kind") == kind, F.element_at(F.array(*(F.lit(t[i]) for t in texts)), pick.cast("int"))).otherwise(out)
        return fill(out, seed, F.col("sample_id"))

    made = ids.select("sample_id", "kind", part(0).alias("instruction"), part(1).alias("reasoning"), part(2).alias("response"))
    return made.withColumn("text", F.concat_ws("\n\n", "instruction", "reasoning", "response"))


def first_passing(rows: DataFrame, passes: Column, order: str, most: int) -> DataFrame:
    """The first ``most`` rows by ``order`` that pass: rows are counted behind the filter. The limit is kept per task first."""
    return rows.where(passes).orderBy(order).limit(most)


def parts_text(parts: Column) -> Column:
    """The text parts of a message (array of kind, text), joined by blanks; other kinds and null texts are left out."""
    said = F.filter(parts, lambda p: (p["kind"] == "text") & p["text"].isNotNull())
    return F.array_join(F.transform(said, lambda p: p["text"]), " ")


def chat_prompt(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One prompt per conversation: role tags in turn order, then an open assistant tag. Other roles are left out."""
    said = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("<|end|>\n"))
    known = messages.where(F.col("role").isin("system", "user", "assistant")).select(conv, F.struct(turn, "role", said.alias("said")).alias("m"))
    whole = known.groupBy(conv).agg(F.array_sort(F.collect_list("m")).alias("m"))
    return whole.select(conv, F.concat(F.array_join("m.said", ""), F.lit("<|assistant|>\n")).alias("prompt"))
