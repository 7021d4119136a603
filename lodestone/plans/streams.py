"""Queries that run a stream over the tables to its end and return what it gave out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.tables import Tables
from ..sources import messages
from ..streaming import streams
from .base import read, register
from .text import _GRAMS, _greedy_sql


def _finished(spark, frame, sink: str):
    """Runs a stream into a written table and returns the table."""
    tables = Tables(spark, sink)
    path = f"{tables.root}/out"
    frame.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{tables.root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(path)


def _events(spark, sf):
    events = streams.read_stream(spark, f"{sf}/events.parquet*", read(spark, sf, "events").schema)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


_LATE = "(SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


@register(f"""
    SELECT event_type AS symbol, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS bar_start, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
           arg_max(value, (ts, event_id)) AS close, count(*) AS volume
    FROM events GROUP BY event_type, time_bucket(INTERVAL 1 HOUR, ts) HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= {_LATE}
""")
def stream_ohlcv(spark, sf):
    """Bars that the watermark has passed when the stream ends."""
    ticks = _events(spark, sf).select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("tie"), F.col("value").alias("price"))
    bars = _finished(spark, streams.stream_ohlcv(ticks, "1 hour"), "ohlcv")
    return bars.withColumn("bar_start", F.date_format("bar_start", "yyyy-MM-dd HH:mm:ss"))


@register(f"""
    SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total
    FROM events GROUP BY time_bucket(INTERVAL 1 DAY, ts), event_type HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= {_LATE}
""")
def stream_windows(spark, sf):
    out = _finished(spark, streams.event_windows(_events(spark, sf), "1 day"), "windows")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@register(f"""
    SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total
    FROM (SELECT *, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events)
    GROUP BY s, event_type HAVING s + INTERVAL 12 HOUR <= {_LATE}
""")
def stream_sliding(spark, sf):
    """Windows of twelve hours that begin every six."""
    out = _finished(spark, streams.event_windows(_events(spark, sf), "12 hours", "6 hours"), "sliding")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@register(f"""
    WITH b AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 DAY THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM b)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, no HAVING max(ts) + INTERVAL 1 DAY <= {_LATE}
""")
def stream_sessions(spark, sf):
    """Sessions of a user that a day without events ends."""
    out = _finished(spark, streams.sessions(_events(spark, sf), "1 day"), "sessions")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@register("""
    SELECT event_type AS symbol, event_id AS seq, CASE WHEN value > 100 THEN 'long' ELSE 'flat' END AS decision, CASE WHEN event_id % 10 = 0 THEN 'malformed' ELSE 'stored' END AS kind FROM events WHERE event_id % 10 <> 0
""")
def stream_replies(spark, sf):
    """Requests as JSON messages, stored and answered batch by batch; malformed ones get no reply."""
    tables = Tables(spark, "replies")
    said = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("event_type").alias("symbol"), F.array(F.col("event_id").cast("double"), "value").alias("data"))))
    answer = lambda r: r.select("symbol", F.col("data")[0].cast("long").alias("seq"), F.when(F.col("data")[1] > 100, "long").otherwise("flat").alias("decision"))
    streams.serve(_events(spark, sf).select(said.alias("value")), answer, tables.root, f"{tables.root}/checkpoint").awaitTermination()
    stored = spark.read.parquet(f"{tables.root}/requests").select("symbol", F.col("data")[0].cast("long").alias("seq"))
    return spark.read.parquet(f"{tables.root}/replies").drop("batch").join(stored, ["symbol", "seq"]).withColumn("kind", F.lit("stored"))


@register("""
    WITH b AS (SELECT event_type AS symbol, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS back FROM events)
    SELECT symbol, count(*) AS n_bars, round(avg(value), 4) AS mean FROM b WHERE back <= 100 GROUP BY symbol
""")
def stream_features(spark, sf):
    """The polling loop: with every batch the last 100 ticks of each series are kept and their field features written anew."""
    tables = Tables(spark, "features")
    ticks = _events(spark, sf).select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("tie"), "value")
    last = streams.watch(ticks, tables.root, f"{tables.root}/checkpoint", 100)
    kept = spark.read.parquet(f"{tables.root}/ticks/batch={last}")
    found = spark.read.parquet(f"{tables.root}/features/batch={last}").select("symbol", "n_bars")
    return kept.groupBy("symbol").agg(F.round(F.avg("value"), 4).alias("mean")).join(found, "symbol")


def _fed(spark, tables, rows, by: str, count: int):
    """Publishes ``rows`` one after another in ``count`` even steps of the whole number ``by``; gives the path to read each time."""
    ends = rows.agg(F.min(by).alias("lo"), F.max(by).alias("hi")).first()
    lo, hi = ends.lo or 0, ends.hi or 0
    number = F.coalesce(F.expr(f"cast({count} * cast(`{by}` - {lo}L as decimal(38,0)) div {hi - lo + 1}L as int)"), F.lit(0))
    rows.withColumn("_batch", number).write.partitionBy("_batch").parquet(f"{tables.root}/cut", compression="zstd")
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(tables.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path(f"{tables.root}/feed"))
    for i in range(count):
        if store.rename(path(f"{tables.root}/cut/_batch={i}"), path(f"{tables.root}/feed/{i}")) or i == 0:
            yield f"{tables.root}/feed/*"


@register(f"WITH RECURSIVE {_GRAMS}, {_greedy_sql('v')} SELECT doc_id FROM decided WHERE kept")
def stream_dedup(spark, sf):
    """Documents come in three batches by doc_id, the stream being started anew for each; what stays is what one greedy pass keeps."""
    tables = Tables(spark, "stream-dedup")
    docs = read(spark, sf, "documents").select("doc_id", "text")
    for feed in _fed(spark, tables, docs, "doc_id", 3):
        streams.dedup_stream(streams.read_stream(spark, feed, docs.schema), f"{tables.root}/out", f"{tables.root}/checkpoint", family="sha256")
    return spark.read.schema(streams.KEPT).parquet(f"{tables.root}/out").select("doc_id")


@register("""
    WITH b AS (SELECT event_type AS symbol, value, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS back FROM events)
    SELECT symbol, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS until, CAST(count(*) AS INT) AS n, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high FROM b WHERE back <= 100 GROUP BY symbol
""")
def stream_rolling(spark, sf):
    """The ring of the last 100 values of each series as state of a stateful processor, over four batches by time with a restart before each."""
    tables = Tables(spark, "rolling")
    events = read(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tie"), "value").withColumn("us", F.unix_micros("ts"))
    for feed in _fed(spark, tables, events, "us", 4):
        rolled = streams.rolling_last(streams.read_stream(spark, feed, events.schema), 100)
        with streams.keyed_state(spark):
            query = rolled.writeStream.format("parquet").option("path", f"{tables.root}/out").option("checkpointLocation", f"{tables.root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    out = spark.read.schema(rolled.schema).parquet(f"{tables.root}/out").where("not closed")
    last = out.groupBy("symbol").agg(F.max_by(F.struct("us", "n", "values"), "us").alias("r")).select("symbol", "r.*")
    mean = F.aggregate("values", F.lit(0.0), lambda a, x: a + x) / F.col("n")
    return last.select("symbol", F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss").alias("until"), "n", F.round(mean, 4).alias("mean"), F.array_min("values").alias("low"), F.array_max("values").alias("high"))


@register("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT DISTINCT event_id, ts, event_type, value FROM events) GROUP BY event_type")
def stream_unique(spark, sf):
    """Events that come twice, as from a source that delivers at least once, counted once: exact repeats go within the watermark."""
    events = _events(spark, sf).select("event_id", "ts", "event_type", "value")
    out = _finished(spark, streams.unique_events(events.unionByName(events), ["event_id"]), "unique")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@register("SELECT event_type AS symbol, event_id AS seq, CASE WHEN value > 100 THEN 'long' ELSE 'flat' END AS decision FROM events WHERE event_id % 10 <> 0")
def stream_messages(spark, sf):
    """Requests as JSON lines of a message log, in by the streaming source and out by its idempotent sink; malformed ones get no reply."""
    messages.register(spark)
    tables = Tables(spark, "messages")
    said = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("event_type").alias("symbol"), F.array(F.col("event_id").cast("double"), "value").alias("data"))))
    read(spark, sf, "events").select(said.alias("value")).write.text(f"{tables.root}/in")
    answer = lambda r: r.select("symbol", F.col("data")[0].cast("long").alias("seq"), F.when(F.col("data")[1] > 100, "long").otherwise("flat").alias("decision"))
    replied = streams.replies(spark.readStream.format("message_log").load(f"{tables.root}/in"), answer)
    replied.writeStream.format("message_log").option("checkpointLocation", f"{tables.root}/checkpoint").trigger(availableNow=True).start(f"{tables.root}/out").awaitTermination()
    return messages.written(spark, f"{tables.root}/out", "symbol string, seq long, decision string")


@register(None)
def stream_pack(spark, sf):
    tables = Tables(spark, "stream-pack")
    docs = streams.read_stream(spark, f"{sf}/documents.parquet*", read(spark, sf, "documents").schema)
    samples = docs.select("doc_id", F.least(F.floor(F.length("text") / 4), F.lit(8192 - 15)).alias("tokens"))
    query = streams.pack_stream(samples, f"{tables.root}/out", f"{tables.root}/checkpoint", 8192, 5)
    query.awaitTermination()
    last = query.lastProgress["batchId"] if query.lastProgress else 0
    done = spark.read.schema("doc_id long, shard long, sequence long, slot long, batch int").parquet(f"{tables.root}/out/packed")
    rest = streams.finish_packing(spark, f"{tables.root}/out", last, 8192, 5).withColumn("shard", F.lit(-1).cast("long")).withColumn("batch", F.lit(last))
    return done.unionByName(rest)
