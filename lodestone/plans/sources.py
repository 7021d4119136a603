"""Queries that write the tables to a sink or a source's layout and read them back, with their DuckDB equivalents."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import models
from ..functions import scoring as sc
from ..functions import text as tx
from ..operators import derivatives, memory, mixing, series, vectors
from ..operators.tables import Tables
from ..sources import readers, sinks
from .base import read, register
from .market import ORDER, _bars
from .text import _KNOW, _knowledge, _memories


#: The languages of the documents, each of which is a folder of the source.
LANGUAGES = ["de", "en", "es", "fr"]


@register("""
    WITH r AS (SELECT doc_id, lang, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn, dense_rank() OVER (ORDER BY lang) AS place FROM documents)
    SELECT doc_id, lang AS language, turn, place, md5(text) AS md5 FROM r WHERE turn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang))
""")
def source_code_corpus(spark, sf):
    """Folders by language, of which one is missing; the others take turns."""
    tables = Tables(spark, "code")
    docs = read(spark, sf, "documents")
    for lang in LANGUAGES:
        docs.where(F.col("lang") == lang).select(F.col("text").alias("content"), "lang", F.col("doc_id").alias("size")).write.parquet(f"{tables.root}/data/{lang}")
    found = readers.code_corpus(spark, tables.root, [*LANGUAGES, "missing"], order="size")
    return found.select(F.col("size").alias("doc_id"), "language", F.col("turn").cast("long"), F.col("place").cast("long"), F.md5("content").alias("md5"))


_SHAPES = """md5(CASE doc_id % 3 WHEN 0 THEN '### Instruction:' || chr(10) || source || chr(10) || chr(10) || '### Response:' || chr(10) || text
    WHEN 1 THEN '### Question:' || chr(10) || source || chr(10) || chr(10) || '### Answer:' || chr(10) || text ELSE text END)"""


def _shapes(spark, sf):
    k = F.col("doc_id") % 3
    only = lambda n, c: F.when(k == n, F.col(c))
    return read(spark, sf, "documents").select(only(0, "source").alias("instruction"), only(0, "text").alias("output"), only(1, "source").alias("question"), only(1, "text").alias("answer"), only(2, "text").alias("text"))


def _sampled(rows):
    return rows.select(F.md5(tx.sample_text(*(F.col(c) for c in ("instruction", "output", "question", "answer", "text")), F.struct(*rows.columns))).alias("md5"))


@register(f"SELECT {_SHAPES} AS md5 FROM documents")
def source_finance_fallback(spark, sf):
    """The primary source is missing, so the JSON lines of the fallback are read."""
    tables = Tables(spark, "finance")
    _shapes(spark, sf).write.json(f"{tables.root}/fallback")
    return _sampled(readers.finance_samples(spark, f"{tables.root}/primary", f"{tables.root}/fallback"))


@register(f"SELECT {_SHAPES} AS md5 FROM documents")
def source_instructions(spark, sf):
    tables = Tables(spark, "instructions")
    return _sampled(readers.instructions(spark, tables.write(_shapes(spark, sf), "rows").inputFiles()[0].rsplit("/", 1)[0]))


@register("""
    SELECT event_type AS symbol, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS bar_start, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
           arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
    FROM events GROUP BY event_type, date_trunc('hour', ts)
""")
def source_bars_csv(spark, sf):
    """Bars written as CSV with a header and read by the reader of bars."""
    tables = Tables(spark, "bars")
    made = series.ohlcv(_bars(spark, sf), "1 hour", price="value", tie="event_id").withColumnRenamed("bar_start", "ts")
    made.select("symbol", "ts", "open", "high", "low", "close", "volume").write.option("header", True).csv(f"{tables.root}/bars")
    back = readers.bars(spark, f"{tables.root}/bars", "csv")
    return back.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("bar_start"), "open", "high", "low", "close", "volume")


def _fetch(url: str, timeout: float) -> str:
    """The offline stand-in of a vendor: two rates from the address's length, an error for one of its names."""
    name = url.rsplit("/", 1)[1]
    if name == "ASIA":
        raise OSError("no route")
    return json.dumps({"code": "0", "data": [{"time": 1_700_000_000_000 + i, "close": str(len(name) * (i + 1) / 1000)} for i in range(2)]})


@register("""
    SELECT r_name AS name, i AS step, CAST(round(length(r_name) * (i + 1) / 1000.0, 6) AS DOUBLE) AS rate FROM region, range(2) t(i) WHERE r_name <> 'ASIA'
""")
def source_payloads(spark, sf):
    """A request a partition through the data source of payloads; one that fails gives no rows."""
    spark.dataSource.register(readers.payload_source(_fetch))
    names = [r["r_name"] for r in read(spark, sf, "region").select("r_name").collect()]  # five rows
    raw = spark.read.format("payloads").option("urls", "\n".join(f"https://vendor.invalid/{n}" for n in names)).load()
    rows = derivatives.funding_rows(raw, "url", "body")
    return rows.select(F.substring_index("url", "/", -1).alias("name"), (F.unix_millis("ts") - 1_700_000_000_000).alias("step"), F.round("rate", 6).alias("rate"))


@register("SELECT role AS user_id, count(*) AS memories, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role")
def sink_bucketed(spark, sf):
    """A table bucketed by user: the aggregation on it needs no shuffle."""
    tables = Tables(spark, "bucketed")
    name = "memories_" + tables.root.rsplit("-", 1)[1]
    sinks.save_table(_memories(spark, sf), name, "user_id", 4, f"{tables.root}/table")
    return spark.table(name).groupBy("user_id").agg(F.count("*").alias("memories"), F.sum(F.length("content")).alias("chars"))


@register("SELECT md5(text) AS md5, source FROM documents")
def sink_jsonl(spark, sf):
    path = f"{Tables(spark, 'jsonl').root}/out"
    sinks.write_jsonl(read(spark, sf, "documents"), path)
    return spark.read.schema("text string, source string").json(path).select(F.md5("text").alias("md5"), "source")


@register("SELECT 'synthetic' AS source, 2000 AS samples, 4 AS kinds")
def sink_synthetic(spark, sf):
    """Generated samples written as JSON lines, counted by the writer and by a reader."""
    path = f"{Tables(spark, 'synthetic').root}/out"
    n = sinks.write_synthetic(mixing.synthetic(spark, 2000), path)
    back = spark.read.schema("instruction string, response string, text string, source string, type string").json(path)
    full = back.where("instruction is not null and response is not null and text is not null")
    return full.groupBy("source").agg(F.when(F.count("*") == n, F.count("*").cast("int")).alias("samples"), F.count_distinct("type").cast("int").alias("kinds"))


@register("""
    SELECT o_orderkey, o_orderpriority AS symbol, CAST((o_orderkey % 100) / 100.0 AS DOUBLE) AS confidence, '{"status":"' || o_orderstatus || '"}' AS features FROM orders
""")
def sink_csv(spark, sf):
    """Records written as CSV, their nested features as JSON text, and read back."""
    path, o = f"{Tables(spark, 'csv').root}/out", F.col("o_orderkey")
    rows = read(spark, sf, "orders").select(o, F.col("o_orderpriority").alias("symbol"), ((o % 100).cast("double") / 100).alias("confidence"), F.struct(F.col("o_orderstatus").alias("status")).alias("features"))
    kind = "o_orderkey long, symbol string, confidence double, features string"
    return spark.read.schema(kind).option("header", True).csv(path) if sinks.write_csv(rows, path) else spark.createDataFrame([], kind)


@register("SELECT label, CAST(2 * count(*) AS BIGINT) AS vectors, CAST(64 AS BIGINT) AS least, CAST(64 AS BIGINT) AS most FROM embeddings GROUP BY label")
def sink_vectors(spark, sf):
    """Vectors of a checked dimension appended twice."""
    path = f"{Tables(spark, 'vectors').root}/out"
    for _ in range(2):
        sinks.append_vectors(memory.check_dimension(read(spark, sf, "embeddings"), 64), path)
    n = F.size("embedding").cast("long")
    return spark.read.parquet(path).groupBy("label").agg(F.count("*").alias("vectors"), F.min(n).alias("least"), F.max(n).alias("most"))


@register(None)
def sink_pictures(spark, sf):
    """Base64 of the colour-mapped field of each series, single and dual; tests decode them."""
    kept = series.last_n(_bars(spark, sf).where("value is not null"), 100, "symbol", ORDER)
    values = kept.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda p: p["value"]).alias("v"))
    one, two = (sinks.images_base64(sinks.field_pictures(values, "symbol", "v", 64, dual), "symbol") for dual in (False, True))
    return one.withColumnRenamed("png", "single").join(two.withColumnRenamed("png", "dual"), "symbol")


@register(None)
def predictor_heads(spark, sf):
    """The stand-in model on the field images: classes and confidences of its three heads, and the number of features."""
    images = series.gaf_images(_bars(spark, sf), 100, "symbol", ORDER, size=64)
    names = {"regime": ["trending", "mean_reverting", "volatile", "quiet"], "direction": ["bullish", "bearish", "neutral"], "volatility": ["calm", "normal", "elevated", "explosive"]}
    found = models.predictions(images, "symbol", models.Pooled(), models.Pooled.HEADS, size=64, with_features=True)
    found = found.select("symbol", "features", *(F.col(h).alias(f"{h}_logits") for h in names))
    of = lambda h: F.col(f"{h}_logits")
    heads = [c for h, classes in names.items() for c in (sc.class_of(of(h), classes).alias(h), F.round(F.array_max(sc.softmax(of(h))), 6).alias(f"{h}_confidence"))]
    return found.select("symbol", *heads, F.size("features").alias("n_features"))


@register("""
    WITH t AS (SELECT doc_id, least(strlen(text), 256) AS n FROM documents)
    SELECT doc_id, CAST(n AS BIGINT) AS tokens, CAST(256 - n AS BIGINT) AS padding FROM t
""")
def tokenised_rows(spark, sf):
    """Rows of 256 ids, cut and padded, by a tokenizer of bytes."""
    rows = models.tokenised(read(spark, sf, "documents"), lambda t: [1 + b for b in t.encode()], 256, 0)
    count = lambda c, test: F.size(F.filter(c, test)).cast("long")
    return rows.select("doc_id", count("attention_mask", lambda x: x == 1).alias("tokens"), count("input_ids", lambda x: x == 0).alias("padding"))


@register(f"WITH {_KNOW} SELECT category, key, value, t AS created_at FROM old")
def knowledge_json(spark, sf):
    """Knowledge saved as JSON lines and loaded again."""
    path = f"{Tables(spark, 'knowledge').root}/out"
    rows = _knowledge(spark, sf)
    sinks.save_knowledge(rows.withColumn("created_at", F.timestamp_seconds("created_at")).withColumn("updated_at", F.timestamp_seconds("updated_at")), path)
    return readers.knowledge(spark, path).select("category", "key", "value", F.unix_seconds("created_at").alias("created_at"))


@register("""
    WITH u AS (
        SELECT 'patterns' AS category, 'p' || l_partkey AS key, '{"description":"' || l_returnflag || '","success_rate":' || CAST(CAST(l_discount AS DOUBLE) AS VARCHAR) || ',"market_conditions":["' || l_linestatus || '"]}' AS value,
               row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC) AS back FROM lineitem)
    SELECT category, key, value FROM u WHERE back = 1
    UNION ALL SELECT 'trade_history', CAST(event_id AS VARCHAR), '{"entry_price":1.5,"exit_price":2.5,"direction":"long","pnl":1.0,"pattern_used":' || CASE WHEN event_id % 2 = 0 THEN 'null' ELSE '"p1"' END || ',"notes":""}' FROM events
""")
def knowledge_typed(spark, sf):
    """Patterns and trades added as typed knowledge: the last of a key stays."""
    l = read(spark, sf, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name"), F.col("l_returnflag").alias("description"), F.col("l_discount").cast("double").alias("success_rate"), F.array("l_linestatus").alias("market_conditions"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"))
    price = lambda x: F.lit(x)
    e = read(spark, sf, "events").select("event_id", price(1.5).alias("entry_price"), price(2.5).alias("exit_price"), F.lit("long").alias("direction"), price(1.0).alias("pnl"), F.when(F.col("event_id") % 2 == 1, "p1").alias("pattern_used"), F.lit("").alias("notes"))
    changes = memory.typed_changes(l, "patterns", "name", "seq", "seq").unionByName(memory.typed_changes(e, "trade_history", "event_id", "event_id", "event_id"))
    none = changes.limit(0).select("category", "key", "value", "metadata", F.col("at").alias("created_at"), F.col("at").alias("updated_at"))
    return memory.upsert(none, changes).select("category", "key", "value")


@register("""
    WITH top AS (SELECT max(conv_id * 1000 + turn) AS top FROM conversations),
    n AS (SELECT event_id, '{"type":"' || event_type || '"}' AS content, row_number() OVER (ORDER BY ts, event_id) AS n FROM events)
    SELECT conv_id * 1000 + turn AS id, md5(text) AS content_md5 FROM conversations
    UNION ALL SELECT top + n, md5(content) FROM n, top
""")
def memory_add(spark, sf):
    """Structured memories added behind the stored ones, as JSON with ids that go on."""
    e = read(spark, sf, "events").select("event_id", F.lit("user").alias("user_id"), F.lit("s").alias("session_id"), F.struct(F.col("event_type").alias("type")).alias("content"), F.lit("{}").alias("metadata"), F.col("ts").cast("timestamp").alias("created_at"))
    return memory.add_memories(_memories(spark, sf), e, ["event_id"]).select("id", F.md5("content").alias("content_md5"))


@register("SELECT conv_id * 1000 + turn AS id FROM conversations WHERE conv_id * 1000 + turn <> 3001 AND role <> 'assistant'")
def memory_forget(spark, sf):
    """One memory deleted by id, then all of a user cleared."""
    return memory.clear_memories(memory.delete_memory(_memories(spark, sf), 3001), "assistant").select("id")


@register("""
    SELECT conv_id, md5(string_agg('<|' || role || '|>' || chr(10) || 'seen: ' || text || '<|end|>' || chr(10), '' ORDER BY turn, role) || '<|assistant|>' || chr(10)) AS prompt_md5
    FROM conversations WHERE role IN ('system', 'user', 'assistant') GROUP BY conv_id
""")
def chat_prompt_parts(spark, sf):
    """Messages of text and image parts: the texts, joined by blanks, make the prompt."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    parts = F.array(part("text", F.lit("seen:")), part("image", F.lit("a.png")), part("text", F.col("text")), part("text", F.lit(None).cast("string")))
    said = read(spark, sf, "conversations").select("conv_id", "turn", "role", mixing.parts_text(parts).alias("text"))
    return mixing.chat_prompt(said).select("conv_id", F.md5("prompt").alias("prompt_md5"))


@register(None)
def vector_topk_approx(spark, sf):
    """Cosine neighbours through an index of quantised vectors; tests measure its recall against all vectors."""
    v = read(spark, sf, "embeddings")
    found = vectors.VectorIndex(v, 10).search(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")))
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))
