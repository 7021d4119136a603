"""Click-to-sale attribution: a bucketed equi-join of two streams on (client, day).

A sale may take clicks of the seven days before it, which lie on eight days; so a sale explodes to eight covering days, a click
carries its one day, and the two meet on (client, day). The range filter is the order within that key: both sides are sorted by
time together, and a running count and a running latest click tell a sale-day what it covers. No pair is formed, so a client
with a third of all rows costs its rows alone, and a day of it is a key of its own. A reducer by sale adds up the eight days.

Both streams are cut into batches and fed to a Structured Streaming query that is started anew for each. Its state (buffered
clicks, buffered sales, the largest times so far) is written per batch under the batch's number and read by the next one, so
a batch that is run again after a failure writes the same rows again. Times are whole microseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

DAY = 86_400_000_000
HOUR = 3_600_000_000
#: A sale takes clicks of so many microseconds before it, and they lie on so many days.
WINDOW, DAYS = 7 * DAY, 8
#: Batches wait for rows that are late by no more than this.
LATENESS = 6 * HOUR
#: Rows of one kind: a click (``id`` is its click_id) or a sale (``id`` is its sale_id); ``row`` is the row's own number.
ROW = "kind string, row long, id long, client_id long, at long"
STATE = "row long, id long, client_id long, at long, kind string"
RESULT = "sale_id long, late boolean, click_id long, n_clicks long"


def micros(time: str) -> Column:
    """A timestamp (without a zone, or of the session's) as microseconds since 1970."""
    since = f"cast(`{time}` as timestamp_ntz) - timestamp_ntz'1970-01-01 00:00:00'"
    return F.expr(f"cast(cast(cast({since} as interval second) as decimal(18,6)) * 1000000 as long)")


def attribute(sales: DataFrame, clicks: DataFrame) -> DataFrame:
    """sale_id, click_id, n_clicks of all ``sales``: the latest of the client's clicks within ``WINDOW`` before the sale, and their number.

    Both have row, id, client_id, at. Clicks of the sale's own time count; of clicks of one time the smaller id wins.
    """
    day = f"(at - pmod(at, {DAY})) div {DAY}"
    # probes 0 to 7 count up to the end of a covering day, or to the sale; probe 8 takes off what the first day has before the window
    i, first = F.col("i"), F.col("today") - (DAYS - 1)
    probe_day = F.when(i == DAYS, first).otherwise(first + i)
    probe_at = F.when(i == DAYS, F.col("at") - WINDOW).when(i == DAYS - 1, F.col("at")).otherwise((probe_day + 1) * DAY - 1)
    exploded = sales.withColumn("today", F.expr(day)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(DAYS))))
    probes = exploded.select(
        "client_id", probe_day.alias("day"), probe_at.alias("at"), F.when(i == DAYS, 0).otherwise(2).alias("side"), "row",
        F.lit(None).cast("long").alias("click_id"), (F.col("at") - WINDOW).alias("low"), F.when(i == DAYS, -1).otherwise(1).alias("sign"),
    )
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    held = clicks.select("client_id", F.expr(day).alias("day"), "at", F.lit(1).alias("side"), none("long", "row"), F.col("id").alias("click_id"), none("long", "low"), none("int", "sign"))
    so_far = Window.partitionBy("client_id", "day").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    click = F.col("side") == 1
    # the complement orders ids downwards, the smallest number included
    met = probes.unionByName(held).select(
        "row", "low", "sign", F.count(F.when(click, 1)).over(so_far).alias("n"), F.max(F.when(click, F.struct("at", F.bitwise_not("click_id").alias("c")))).over(so_far).alias("last")
    )
    found = met.where("row is not null and n > 0").select("row", F.lit(None).cast("long").alias("id"), (F.col("sign") * F.col("n")).alias("n"), F.when((F.col("sign") > 0) & (F.col("last.at") >= F.col("low")), F.col("last")).alias("last"))
    own = sales.select("row", "id", F.lit(0).cast("long").alias("n"), F.lit(None).cast(found.schema["last"].dataType).alias("last"))
    whole = own.unionByName(found).groupBy("row").agg(F.max("id").alias("sale_id"), F.sum("n").alias("n_clicks"), F.max("last").alias("last"))
    return whole.select("sale_id", F.bitwise_not(F.col("last.c")).alias("click_id"), "n_clicks")


def cut(clicks: DataFrame, sales: DataFrame, batches: int, shift_hours: int, scratch: Scratch) -> None:
    """Writes both tables as rows of ``ROW`` in folders by batch: ``batches`` even steps of the clicks' arrival in whole hours.

    A quarter of the rows, drawn by CRC-32 of the id, arrives ``shift_hours`` later. Clicks are taken once an id (its smallest
    arrival); rows without client or time are left out, a row without arrival arrives at its own time. Sales are clamped to
    the clicks' batches; without any click all are in the first.
    """

    def rows(df: DataFrame, kind: str, name: str, time: str) -> DataFrame:
        at = df.select(F.lit(kind).alias("kind"), F.col(name).cast("long").alias("id"), F.col("client_id").cast("long").alias("client_id"), micros(time).alias("at"), micros("arrived_at").alias("came"))
        known = at.where("client_id is not null and at is not null").withColumn("came", F.coalesce("came", "at"))
        shifted = F.when(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % 4 == 0, shift_hours).otherwise(0)
        return known.withColumn("h", F.expr(f"(came - pmod(came, {HOUR})) div {HOUR}") + shifted)

    single = rows(clicks, "click", "click_id", "ts").groupBy("id").agg(F.min(F.struct("came", "at", "client_id", "h", "kind")).alias("r")).select("r.kind", "id", "r.client_id", "r.at", "r.h")
    single = scratch.write(single, "clicks")
    ends = single.agg(F.min("h").alias("lo"), F.max("h").alias("hi")).first()
    every = single.unionByName(rows(sales, "sale", "sale_id", "sold_at").drop("came"))
    step = F.lit(0) if ends.lo is None else F.expr(f"{batches} * (h - {ends.lo}L) div {ends.hi - ends.lo + 1}L")
    number = F.least(F.greatest(step, F.lit(0)), F.lit(batches - 1)).cast("int")
    dealt = every.select("kind", F.monotonically_increasing_id().alias("row"), "id", "client_id", "at", number.alias("batch"))
    dealt.write.partitionBy("batch").parquet(f"{scratch.root}/cut")
    scratch.drop("clicks")


class Attribution:
    """The stateful step of a batch, and what the stream leaves open at its end.

    The watermark of a batch is the smaller of the largest click time and the largest sale time of all batches before it, less
    ``LATENESS``; there is none until both exist. Clicks before it are discarded, sales before it are given out as late, and
    all buffered sales before it are closed; then clicks that no sale can take any more are evicted.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def state(self, spark: SparkSession, number: int) -> DataFrame:
        """What batch ``number`` left, by kind: click, sale, and the largest times so far as ``top click`` and ``top sale``."""
        return spark.createDataFrame([], STATE) if number < 0 else spark.read.schema(STATE).parquet(f"{self.root}/state/{number}")

    def watermark(self, spark: SparkSession, number: int) -> int | None:
        """Of the batch behind ``number``, from its two largest times."""
        top = {r.kind: r.at for r in self.state(spark, number).where(F.col("kind").isin("top click", "top sale")).select("kind", "at").collect()}
        return min(top.values()) - LATENESS if len(top) == 2 else None

    def step(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mark = self.watermark(spark, number - 1)
        passed = F.lit(False) if mark is None else F.col("at") < mark
        held, new, kind = self.state(spark, number - 1), batch.select("row", "id", "client_id", "at", "kind"), F.col("kind")
        kept = held.where(kind.isin("click", "sale")).unionByName(new.where((kind == "sale") | ~passed))
        clicks = kept.where(kind == "click")
        if mark is None:
            self.give(spark.createDataFrame([], RESULT), number)
        else:
            late = new.where((kind == "sale") & passed).select(F.col("id").alias("sale_id"), F.lit(True).alias("late"), F.lit(None).cast("long").alias("click_id"), F.lit(0).cast("long").alias("n_clicks"))
            self.give(self.closed(held.where((kind == "sale") & passed), clicks).unionByName(late), number)
            kept = kept.where((kind == "sale") & ~passed).unionByName(clicks.where(F.col("at") >= mark - WINDOW))
        seen = held.where(kind.isin("top click", "top sale")).unionByName(new.withColumn("kind", F.concat(F.lit("top "), kind)))
        none = F.lit(None).cast("long")
        tops = seen.groupBy("kind").agg(F.max("at").alias("at")).select(none.alias("row"), none.alias("id"), none.alias("client_id"), "at", "kind")
        kept.unionByName(tops).write.mode("overwrite").partitionBy("kind").parquet(f"{self.root}/state/{number}")

    def closed(self, sales: DataFrame, clicks: DataFrame) -> DataFrame:
        return attribute(sales, clicks).select("sale_id", F.lit(False).alias("late"), "click_id", "n_clicks")

    def give(self, df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/out/batch={number}")

    def finish(self, last: int) -> DataFrame:
        """Closes what is left after batch ``last`` as the batch behind it; all results."""
        spark = self.spark
        held = self.state(spark, last)
        self.give(self.closed(held.where("kind = 'sale'"), held.where("kind = 'click'")), last + 1)
        out = spark.read.schema(f"{RESULT}, batch int").parquet(f"{self.root}/out")
        return out.select("sale_id", "batch", "late", "click_id", "n_clicks")


def attribute_stream(clicks: DataFrame, sales: DataFrame, batches: int = 12, shift_hours: int = 240) -> DataFrame:
    """sale_id, batch, late, click_id, n_clicks of every sale with a client and a time, by a stream of ``batches`` batches.

    Clicks need click_id, client_id, ts, arrived_at, sales sale_id, client_id, sold_at, arrived_at; other columns are not read,
    whatever their names and however long their texts. Rows without client or time are left out; clicks count once an id (null
    is an id), repeated sales each. A null arrival counts as the row's own time. Of clicks of one time the smaller id wins. Empty
    tables give an empty result; without clicks there is no watermark, and all sales close at the end.
    """
    spark = clicks.sparkSession
    scratch = Scratch(spark, "attribution")
    cut(clicks, sales, batches, shift_hours, scratch)
    work = Attribution(spark, scratch.root)
    feed = f"{scratch.root}/feed"
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs
    store = paths.Path(scratch.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(paths.Path(feed))
    for number in range(batches):
        name = paths.Path(f"{scratch.root}/cut/batch={number}")
        if store.exists(name):  # a batch is published whole, by renaming its folder
            store.rename(name, paths.Path(f"{feed}/batch={number}"))
        else:
            spark.createDataFrame([], ROW).write.parquet(f"{feed}/batch={number}")
        stream = spark.readStream.schema(f"{ROW}, batch int").parquet(feed)
        stream.writeStream.foreachBatch(work.step).option("checkpointLocation", f"{scratch.root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        if number > 1:  # a batch that is run again reads the state before it
            scratch.drop(f"state/{number - 2}")
    return work.finish(batches - 1)
