"""Structured Streaming forms of bars, dedup, packing and rolling series.

State is Spark's own (joins, windows, stateful processors), or a table that is written per batch under the batch's number, so
that a batch that is replayed after a failure writes the same rows again: exactly once in effect.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import ffd, minhash, series
from ..operators.ranking import positions
from ..operators.tables import Tables


def read_stream(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def stream_ohlcv(ticks: DataFrame, width: str = "5 minutes", late: str = "10 minutes", symbol: str = "symbol", price: str = "price", tie: str = "tie") -> DataFrame:
    """Bars of a tick stream; a bar is given out once the watermark has passed it, later ticks are dropped."""
    at = F.struct("ts", tie)
    bars = ticks.withWatermark("ts", late).groupBy(symbol, F.window("ts", width).alias("w")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").alias("volume")
    )
    return bars.select(F.col(symbol).alias("symbol"), F.col("w.start").alias("bar_start"), "open", "high", "low", "close", "volume")


def event_windows(events: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per type in tumbling or sliding windows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of a user that end after ``gap`` without an event."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def unique_events(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first row of each key of a stream with ``ts``; a key is remembered until the watermark has passed its time, so state stays bounded.

    Repeats may differ in their times by no more than ``late``. Null keys are a key; rows without a time stay as they come.
    """
    timed = events.where(F.col("ts").isNotNull()).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    return timed.unionByName(events.where(F.col("ts").isNull()))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def clear(spark: SparkSession, pattern: str) -> None:
    """Removes the folders that the pattern names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in store.globStatus(at) or []:
        store.delete(found.getPath(), True)


def made(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    return path


def sign_stream(docs: DataFrame, out: str, checkpoint: str, num_perm: int, family: str) -> StreamingQuery:
    """Stores the rows of a stream (doc_id, text) once under ``out/texts/came=<batch>`` (row, doc_id, text), and under ``out/signed/came=<batch>`` row, doc_id, tie, sig."""

    def step(batch: DataFrame, number: int) -> None:
        spark, at = batch.sparkSession, f"{out}/texts/came={number}"
        tables = Tables(spark, f"sign-{number}")
        numbered = batch.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        numbered.write.mode("overwrite").parquet(at, compression="zstd")
        rows = minhash.signed_rows(spark.read.schema(TEXTS).parquet(at), tables, num_perm, 5, 42, family, carry=["row"])
        rows.select(F.col("_carried0").alias("row"), "doc_id", "tie", "sig").write.mode("overwrite").parquet(f"{out}/signed/came={number}")
        tables.drop()

    return docs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Rows of the texts, and of the two tables that the dedup stream reads. A row's number is its own within its batch.
TEXTS = "row long, doc_id long, text string"
SIGNED = "row long, doc_id long, tie long, sig binary, came int"
KEPT = "row long, doc_id long, sig binary, text string, batch int"


def shared_buckets(signed: DataFrame, kept: DataFrame, num_perm: int, threshold: float) -> DataFrame:
    """came, row, batch, old: each signed row of a stream once with its ``came`` alone, and once for every bucket it shares with a row kept before it.

    A stream-stream join by a hash of (band, key): the state store holds the numbers of the kept rows by bucket, not their signatures
    (which would lie there once a band), and a batch looks up the buckets of its own rows. Signed rows leave the state as soon as
    no kept row from before them can still come.
    """

    def banded(rows: DataFrame, name: str, number: str) -> DataFrame:
        # times begin at one second: a watermark of zero drops what is at zero
        at = F.timestamp_seconds(F.col(number) + 1).alias(f"{name}_at")
        keyed = minhash.bands(rows.select(F.col("row").alias("node"), "sig", at), num_perm, threshold, [f"{name}_at"])
        return keyed.select(F.xxhash64("band", "key").alias(f"{name}_bucket"), F.col("node").alias(f"{name}_row"), f"{name}_at").withWatermark(f"{name}_at", "0 seconds")

    new, old = banded(signed, "new", "came"), banded(kept, "old", "batch")
    number = lambda c: (F.unix_seconds(c) - 1).cast("int")
    met = new.join(old, F.expr("new_bucket = old_bucket and old_at < new_at"), "inner")
    hits = met.select(number("new_at").alias("came"), F.col("new_row").alias("row"), number("old_at").alias("batch"), F.col("old_row").alias("old"))
    return signed.select("came", *(F.lit(None).cast(kind).alias(c) for c, kind in (("row", "long"), ("batch", "int"), ("old", "long")))).unionByName(hits)


def dedup_stream(docs: DataFrame, out: str, checkpoint: str, num_perm: int = 128, threshold: float = 0.7, family: str = "mix", most: int = 0) -> StreamingQuery:
    """First-wins dedup of a stream (doc_id, text): a row goes if it is similar to one kept before, or to an earlier one of its batch.

    Rows of a batch are walked as ``minhash.dedup`` walks them: repeated rows, rows of one doc_id, null ids and null texts have the
    same defined results. Kept rows and their signatures are appended to ``out/batch=<number>``; ``most`` above 0 stops keeping
    after so many. The query reads its own kept rows back as a second stream, into the state of a join by bucket: a batch
    reads its own rows and what the batch before kept, and of the index only the buckets that its rows have. Rows that share a bucket
    with a kept one are compared by whole signatures, which are read from ``out`` then; a batch without such rows reads none.

    On disk lie the kept rows and, as state, a hash and two numbers for each bucket of theirs; texts and signatures of a batch go when it
    is done, shuffle files when the query that made them ends. Runs until all that the stream holds is done, and returns the stopped query; a later run goes on from the checkpoint.
    """
    spark = docs.sparkSession
    signed = f"{checkpoint}/signed"

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        tables = Tables(spark, f"dedup-{number}")
        counts = lambda n: f"{checkpoint}/counts/{n}"
        had = spark.read.parquet(counts(number - 1)).first()["n"] if most and exists(spark, counts(number - 1)) else 0
        count = lambda n: spark.range(1).select(F.lit(n).alias("n")).write.mode("overwrite").parquet(counts(number)) if most else None
        got = tables.write(batch, "got")
        came = [r.came for r in got.where("row is null").select("came").distinct().collect()]  # one number a signed batch
        if not came:
            tables.drop()
            return count(had)
        node = lambda number, row: F.concat_ws("-", number, row)
        new = spark.read.schema(SIGNED).parquet(signed).where(F.col("came").isin(came)).withColumn("node", node("came", "row"))
        pairs = tables.write(got.where("row is not null").select(node("batch", "old").alias("lo"), node("came", "row").alias("hi")).distinct(), "pairs")
        open_ = new
        if not pairs.isEmpty():
            index = spark.read.schema(KEPT).parquet(out).select(node("batch", "row").alias("node"), "sig")
            near = minhash.similar(pairs, new, num_perm, threshold, index, minhash.band_shape(num_perm, threshold))
            open_ = tables.write(new.join(near.select(F.col("hi").alias("node")).distinct(), "node", "left_anti"), "open")
        stays = tables.write(minhash.kept_rows(open_.drop("row").withColumnRenamed("node", "row"), tables, num_perm, threshold, by="came").withColumnRenamed("row", "node"), "stays")
        tables.remove("classes")
        if most:
            stays = tables.write(open_.join(stays, "node").orderBy("came", F.col("doc_id").asc_nulls_last(), "tie", "row").limit(max(0, most - had)).select("node"), "chosen")
        # kept rows of a signed batch carry its number as their time; the folder has the micro-batch's own
        for at in sorted(came):
            own = stays.where(F.col("node").startswith(f"{at}-"))
            if not own.isEmpty():
                rows = open_.where(F.col("came") == at).join(own, "node").select("row", "doc_id", "sig")
                texts = spark.read.schema(TEXTS).parquet(f"{checkpoint}/texts/came={at}").select("row", "text")
                rows.join(texts, "row").select("row", "doc_id", "sig", "text").write.mode("overwrite").parquet(f"{out}/batch={at}", compression="zstd")
        count(had + stays.count() if most else 0)
        tables.drop()

    read = lambda schema, path: spark.readStream.schema(schema).parquet(made(spark, path))
    with small_disk(spark):
        sign_stream(docs, checkpoint, f"{checkpoint}/sign", num_perm, family).awaitTermination()
        met = shared_buckets(read(SIGNED, signed), read(KEPT, out), num_perm, threshold)
        query = met.writeStream.foreachBatch(step).option("checkpointLocation", f"{checkpoint}/dedup").trigger(processingTime="0 seconds").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    for name in ("signed", "texts"):  # all of it is done
        clear(spark, f"{checkpoint}/{name}/came=*")
    return query


def pack_stream(samples: DataFrame, out: str, checkpoint: str, target: int, separator: int, buffer: int = 1000) -> StreamingQuery:
    """First-fit packing of a stream (doc_id, tokens) in buffers in order of arrival; what does not fill a buffer waits for the next batch.

    Within a batch rows come by doc_id, null first. Ids are carried whole: of any size, negative, repeated or null. Null
    tokens count as none. The waiting rows are written beside the packed ones (``rest=<number>``) and are fewer than a buffer;
    ``finish_packing`` packs them at the end.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        tables = Tables(spark, f"pack-{number}")
        new = batch.select("doc_id", F.coalesce(F.col("tokens").cast("long"), F.lit(0).cast("long")).alias("tokens"), F.lit(number).cast("long").alias("came"))
        rows = tables.write(positions(new, "doc_id", name="at", ties=["tokens"]), "new")
        before = f"{out}/rest={number - 1}"
        if exists(spark, before):  # the rows that wait come first
            rest = spark.read.schema(rows.schema).parquet(before)
            rows = tables.write(rest.unionByName(rows.withColumn("at", F.col("at") + rest.count())), "rows")
        full = rows.count() // buffer
        ordered = rows.withColumn("shard", F.expr(f"at div {buffer}"))
        packed = ffd.pack_shards(ordered.where(F.col("shard") < full), ["shard"], target, separator, order="at", keep=["doc_id"])
        packed.select("doc_id", "shard", "sequence", "slot").write.mode("overwrite").parquet(f"{out}/packed/batch={number}")
        waits = ordered.where(F.col("shard") >= full).withColumn("at", F.col("at") - full * buffer)
        waits.select(*rows.columns).write.mode("overwrite").parquet(f"{out}/rest={number}")
        tables.drop()

    return samples.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finish_packing(spark: SparkSession, out: str, last: int, target: int, separator: int) -> DataFrame:
    rest = spark.read.parquet(f"{out}/rest={last}").withColumn("shard", F.lit(0).cast("long"))
    return ffd.pack_shards(rest, ["shard"], target, separator, order="at", keep=["doc_id"]).select("doc_id", "sequence", "slot")


class Ring(StatefulProcessor):
    """The last ``n`` values of a series, by (ts, tie), with a timer that closes the series when it has been idle too long.

    State is the ring (at most ``n`` rows) and the timer's time. Rows that come late take their place in the ring by time.
    """

    def __init__(self, n: int, idle_ms: int):
        self.n, self.idle = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", "us long, tie long, value double")
        self.due = handle.getValueState("due", "ms long")

    def row(self, key, held: list, closed: bool) -> pd.DataFrame:
        return pd.DataFrame({"symbol": [key[0]], "us": [held[-1][0]], "n": [len(held)], "values": [[v for *_, v in held]], "closed": [closed]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.ring.get())
        for part in rows:
            held += list(zip(part["us"].tolist(), part["tie"].tolist(), part["value"].tolist()))
            held = sorted(map(tuple, held))[-self.n :]
        self.ring.put(held)
        due = held[-1][0] // 1000 + self.idle
        if self.due.exists() and self.due.get()[0] != due:
            self.handle.deleteTimer(self.due.get()[0])
        self.due.update((due,))
        self.handle.registerTimer(due)
        yield self.row(key, held, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = sorted(map(tuple, self.ring.get()))
        self.ring.clear()
        self.due.clear()
        if held:
            yield self.row(key, held, True)

    def close(self) -> None:
        pass


#: Rows that a task gathers before it cuts them to the last of each series, and that it holds at most after that.
GATHERED = 50_000


def latest_rows(rows: DataFrame, n: int, by: str, order: list[str]) -> DataFrame:
    """Rows of a stream or table that can be among the last ``n`` of their series: of each task those (null first), so few rows are shuffled.

    A task holds rows of many series for a bounded while only; then it gives them out and starts anew.
    """

    def last(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [(c, "ascending") for c in (by, *order)], null_placement="at_start"))
        named = table.column(by).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        ends = np.append(np.flatnonzero(named[1:] != named[:-1]) + 1, len(named))
        back = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(named))
        return table.take(pa.array(np.flatnonzero(back <= n)))

    def run(parts: Iterator[pa.RecordBatch]):
        held, new = [], 0
        for part in parts:
            held.append(part)
            new += part.num_rows
            if new >= GATHERED:
                held, new = last(pa.Table.from_batches(held)).combine_chunks().to_batches(), 0
                if sum(p.num_rows for p in held) > GATHERED:
                    yield from held
                    held = []
        if any(p.num_rows for p in held):
            yield from last(pa.Table.from_batches(held)).to_batches()

    return rows.mapInArrow(run, rows.schema)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings for what is started inside; the session's own come back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keyed_state(spark: SparkSession):
    """A stream started inside keeps its state in RocksDB, which stateful processors need; the session's own setting comes back."""
    return settings(spark, {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"})


def small_disk(spark: SparkSession):
    """A stream started inside packs its state, and shuffle files go when the query that made them ends, not when the driver collects garbage."""
    return settings(spark, {"spark.sql.streaming.stateStore.compression.codec": "zstd", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def rolling_last(ticks: DataFrame, n: int, idle_seconds: int = 86_400, late: str = "10 minutes") -> DataFrame:
    """The last ``n`` values of each series of a stream (symbol, ts, tie, value) after every batch: symbol, us, n, values, closed.

    A series without a tick for ``idle_seconds`` of event time gives a last row with ``closed`` and is forgotten; null ticks are
    left out, and ticks later than the watermark are dropped. Start it within ``keyed_state``, in append mode. Tasks cut their
    part of a batch to the last ``n`` of each series first; the watermark sees the latest tick all the same.
    """
    own = ticks.where("symbol is not null and ts is not null and value is not null")
    rows = own.select("symbol", "ts", F.unix_micros("ts").alias("us"), F.col("tie").cast("long").alias("tie"), F.col("value").cast("double").alias("value"))
    rows = latest_rows(rows, n, "symbol", ["us", "tie", "value"]).withWatermark("ts", late)
    return rows.groupBy("symbol").transformWithStateInPandas(Ring(n, idle_seconds * 1000), f"symbol {ticks.schema['symbol'].dataType.simpleString()}, us long, n int, values array<double>, closed boolean", "Append", "eventTime")


def replies(requests: DataFrame, answer) -> DataFrame:
    """A reply stream for JSON requests (column value): symbol and the answer's columns; malformed requests are left out."""
    parsed = F.from_json(F.col("value").cast("string"), "symbol string, data array<double>")
    return answer(requests.select(parsed.alias("r")).where("r.symbol is not null").select("r.symbol", "r.data"))


def serve(requests: DataFrame, answer, out: str, checkpoint: str) -> StreamingQuery:
    """Requests of a stream stored under ``out/requests`` and their replies under ``out/replies``, by batch.

    A batch that is replayed writes the same files again, so each request is stored and answered once.
    """

    def step(batch: DataFrame, number: int) -> None:
        asked = Tables(batch.sparkSession, f"serve-{number}").write(replies(batch, lambda r: r), "asked")
        asked.write.mode("overwrite").parquet(f"{out}/requests/batch={number}")
        answer(asked).write.mode("overwrite").parquet(f"{out}/replies/batch={number}")

    return requests.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch(ticks: DataFrame, out: str, checkpoint: str, n: int, by: str = "symbol") -> int:
    """Runs a tick stream (by, ts, tie, value) to its end; after every batch the last ``n`` ticks of each series and their features are written.

    A batch reads the ticks that the one before kept, at most ``n`` a series; the answer is the last batch's number.
    """
    done = [0]

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(by, "ts", "tie", "value")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/ticks/batch={number - 1}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{out}/ticks/batch={number - 1}"))
        series.last_n(rows, n, by, ["ts", "tie"]).select(*rows.columns).write.mode("overwrite").parquet(f"{out}/ticks/batch={number}")
        kept = spark.read.schema(rows.schema).parquet(f"{out}/ticks/batch={number}")
        series.gaf_features(kept, n, by, ["ts", "tie"]).write.mode("overwrite").parquet(f"{out}/features/batch={number}")
        done[0] = number

    ticks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return done[0]
