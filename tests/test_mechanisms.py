"""Word automaton, table functions, message log, vector index, rolling state."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import keywords, udtfs
from lodestone.functions import text as tx
from lodestone.operators import ffd, memory, minhash, vectors
from lodestone.plans import text as plans
from lodestone.sources import messages
from lodestone.streaming import streams


def brute_counts(text, words, patterns):
    inside = lambda w: re.search(rf"(?i)\b{re.escape(w)}\b", text)
    return sum(1 for w in words if inside(w)), sum(1 for p in patterns if re.search(p, text, re.IGNORECASE | re.ASCII))


def test_automaton_equals_single_passes():
    """The default lists on texts made of their own words, parts of them, and pieces of the patterns."""
    rng = random.Random(3)
    parts = [*tx.KEYWORDS, *plans._QUANT, "class", "def", "next (self", "max", "position size", "_", "-", ".", " ", "\n", "9", "é", "sharpe", "env.step(", "RSI", "Ta_"]
    finder = keywords.Finder(tx.KEYWORDS, tx.HIGH_VALUE)
    for _ in range(400):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", "\n", "_", "x"]) for _ in range(rng.randrange(1, 25)))
        assert finder.count(text) == brute_counts(text, tx.KEYWORDS, tx.HIGH_VALUE), text
    assert finder.count("") == (0, 0) and keywords.Finder([], []).count("rsi") == (0, 0)
    assert keywords.Finder(["rsi", "RSI"], []).count("an rsi") == (2, 0)


def test_pieces_never_ask_for_too_much():
    assert keywords.pieces(r"GASF|GADF|MTF") == [["gasf"], ["gadf"], ["mtf"]]
    assert keywords.pieces(r"class\s+\w*Strategy\w*") == [["class", "strategy"]]
    assert keywords.pieces(r"def\s+on_(data|bar|tick|trade)") == [["def", "on_"]]
    assert keywords.pieces(r"ab?c+d*ef") == [["ef"]] and keywords.pieces(r"env\.step\s*\(") == [["env.step"]]


def test_counts_in_batches(spark):
    docs = spark.createDataFrame([(1, "a MACD and rsi", "x"), (2, None, None), (3, "x" * 100_000 + " rsi", "y"), (3, "", "y")], "doc_id long, text string, words_of string")
    got = [(r.words, r.high, r.score) for r in keywords.scored(docs, tx.KEYWORDS, tx.HIGH_VALUE).orderBy("doc_id", F.length("text").desc()).collect()]
    assert got == [(2, 0, 2), (0, 0, 0), (1, 0, 1), (0, 0, 0)]
    assert keywords.scored(docs.limit(0), ["a"], ["b"]).count() == 0


def test_table_functions_in_sql(spark, sf):
    got, want = plans.pack_table_function(spark, sf), plans.pack_buffered(spark, sf)
    assert sorted(map(tuple, got.select("shard", "doc_id", "sequence", "slot").collect())) == sorted(map(tuple, want.select("shard", "doc_id", "sequence", "slot").collect()))
    udtfs.register(spark)
    spark.createDataFrame([(None, None, 5, 10, 1), (None, 7, None, 10, 1), (2, 2**60 + 7, 4, 10, 1)], "shard long, doc_id long, tokens long, target int, separator int").createOrReplaceTempView("odd_samples")
    rows = spark.sql("SELECT * FROM first_fit(TABLE(odd_samples) PARTITION BY shard ORDER BY doc_id NULLS FIRST)").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(None, None, 0, 0), (None, 7, 0, 1), (2, 2**60 + 7, 0, 0)], key=str)
    grams = spark.sql("SELECT * FROM char_grams(TABLE(SELECT 1L AS doc_id, 'Ab  cab' AS text, 3 AS n UNION ALL SELECT 2L, NULL, 3))").collect()
    assert sorted(map(tuple, grams)) == [(1, " ca"), (1, "ab "), (1, "b c"), (1, "cab"), (2, "")]


def test_packing_keeps_ids_whole(spark):
    """Ids beyond 2 ** 53 beside a null, negative ones, null tokens and null groups."""
    ids = [None, 2**53 + 1, 2**60 + 7, -(2**63), 5, 5]
    df = spark.createDataFrame([(None, i, 10 if k else None) for k, i in enumerate(ids)], "shard long, doc_id long, tokens long")
    got = ffd.pack_shards(df, ["shard"], 25, 5).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted(ids, key=str) and all(r.shard is None for r in got)


def test_stream_pack_keeps_ids_whole(spark, tmp_path):
    ids = [2**41 + 5, 5, -7, None, 2**62, -(2**63)]
    for k in range(2):
        spark.createDataFrame([(i, 3) for i in ids], "doc_id long, tokens long").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    src = streams.read_stream(spark, f"{tmp_path}/in/*", "doc_id long, tokens long", files=1)
    streams.pack_stream(src, f"{tmp_path}/out", f"{tmp_path}/ck", 20, 1, buffer=5).awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out/packed").select("doc_id").union(streams.finish_packing(spark, f"{tmp_path}/out", 1, 20, 1).select("doc_id"))
    assert sorted((r.doc_id for r in rows.collect()), key=str) == sorted(ids * 2, key=str)


def test_null_texts_are_empty(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "i int, t string")
    got = df.select(tx.verdict(F.col("t"), ["a"], []).alias("v"), tx.light_pass(F.col("t"), ["a"]).alias("l"), tx.priority(F.col("t"), ["a"], []).alias("p"), ffd.token_estimate(F.col("t")).alias("n"), ffd.bucket_of(ffd.token_estimate(F.col("t"))).alias("b")).collect()
    assert [tuple(r) for r in got] == [("too_short", False, 0.0, 0, 4096)] * 2


def neighbours(data, queries, k):
    x = data / np.maximum(np.linalg.norm(data, axis=1, keepdims=True), 1e-30)
    return np.argsort(-np.round(x[queries] @ x.T, 9), axis=1, kind="stable")[:, :k]


@pytest.mark.parametrize(("n", "clusters"), [(1000, 0), (6000, 0), (6000, 60)])
def test_index_recall_at_two_sizes(spark, n, clusters):
    """Recall at 10 is 0.9 or more while at most a tenth of the vectors are scored; clustered vectors need few lists as well."""
    rng = np.random.default_rng(n + clusters)
    data = rng.standard_normal((n, 32))
    if clusters:
        data = rng.standard_normal((clusters, 32))[rng.integers(0, clusters, n)] * 3 + data * 0.3
    v = spark.createDataFrame([(i, row) for i, row in enumerate(data.astype(np.float32).tolist())], "vec_id long, embedding array<float>")
    index = vectors.VectorIndex(v, 10, most_sample=3000)
    asked = list(range(0, n, 100))
    got = index.search(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")))
    rows = got.collect()
    assert len(rows) == 10 * len(asked) and index.codes.count() == n
    want = {(q, int(i)) for q, own in zip(asked, neighbours(data.astype(np.float32).astype(float), asked, 10)) for i in own}
    assert len({(r.query_id, r.vec_id) for r in rows} & want) >= 0.9 * len(want)
    assert index.quantiser.depth <= n / 10
    if clusters:
        assert index.quantiser.probes <= len(index.quantiser.centres) / 4


def test_index_on_the_tables(spark):
    for sf in ("sf0.01", "sf0.1"):
        v = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
        q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
        index = vectors.VectorIndex(v, 10)
        near, every = ({(r.query_id, r.vec_id) for r in found.collect()} for found in (index.search(q), memory.top_k(q, v, 10, cosine=True)))
        assert len(near & every) >= 0.9 * len(every) and index.quantiser.depth <= index.total / 10


def test_index_edges(spark):
    kind = "vec_id long, embedding array<float>"
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.9, 0.1]), (2, None), (3, [1.0]), (4, [None, 1.0]), (5, [0.0, 0.0]), (6, [0.0, 1.0]), (7, [])] + [(10 + i, [1.0, i / 50]) for i in range(60)]
    v = spark.createDataFrame(rows, kind)
    index = vectors.VectorIndex(v, 3, recall=1.0)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [1.0]), (None, [0.0, 1.0])], "query_id long, query array<float>")
    got = index.search(asked).collect()
    assert index.codes.count() == 65 and sorted({r.query_id for r in got}, key=str) == [1, None]
    assert sum(r.query_id == 1 for r in got) == 6 and all(r.score == 1.0 for r in got if r.query_id == 1 and r.rank <= 2)
    assert vectors.VectorIndex(v.limit(0)).search(asked).count() == 0


def test_exact_neighbours_of_odd_rows(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [None, 1.0]), (None, [0.0, 1.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, None), (9, [1.0])], "query_id long, query array<float>")
    assert sorted((r.vec_id for r in memory.top_k(q, v, 5, cosine=True).collect()), key=str) == [1, 1, None]
    assert memory.top_k(q.limit(0), v, 5).count() == memory.top_k(q, v.limit(0), 5).count() == 0


def ticks(spark, path, parts):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, "symbol string, ts timestamp, tie long, value double").coalesce(1).write.parquet(f"{path}/in/{k}")
        src = streams.read_stream(spark, f"{path}/in/*", "symbol string, ts timestamp, tie long, value double")
        with streams.keyed_state(spark):
            q = streams.rolling_last(src, 3, idle_seconds=3600).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()


def test_ring_and_timer(spark, tmp_path):
    """Rings over restarts, late rows within the ring, and a series that is closed when idle and begins anew."""
    import datetime as dt

    t = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    ticks(spark, tmp_path, [
        [("a", t(0), 0, 1.0), ("a", t(1), 0, 2.0), ("b", t(2), 0, 9.0), (None, t(1), 0, 1.0), ("a", None, 0, 1.0), ("a", t(3), 0, None)],
        [("a", t(5), 1, 4.0), ("a", t(5), 0, 3.0), ("a", t(4), 0, 2.5)],
        [("a", t(300), 0, 7.0)],
        [("b", t(301), 0, 8.0)],
    ])
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    open_ = sorted((r.symbol, r.us, list(r["values"])) for r in rows if not r.closed)
    assert [(s, v) for s, _, v in open_] == [("a", [1.0, 2.0]), ("a", [2.5, 3.0, 4.0]), ("a", [7.0]), ("b", [9.0]), ("b", [8.0])] or [(s, v) for s, _, v in open_][1] == ("a", [2.5, 3.0, 4.0])
    assert ("b", [9.0]) in [(r.symbol, list(r["values"])) for r in rows if r.closed]
    assert ("b", [8.0]) in [(s, v) for s, _, v in open_]


def test_message_log(spark, tmp_path):
    """Offsets are segments; a batch that is committed again changes nothing; unfinished files are not seen."""
    messages.register(spark)
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for k in range(2):
        spark.createDataFrame([(f'{{"k": {k}, "i": {i}}}',) for i in range(5)], "value string").coalesce(1).write.text(f"{src}/{k}")
        query = spark.readStream.format("message_log").load(src).selectExpr("segment", "line", "value").writeStream.format("message_log").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start(out)
        query.awaitTermination()
        assert messages.written(spark, out, "segment int, line long, value string").count() == 5 * (k + 1)
    writer = messages.LogWriter(out, ["value"])
    again = writer.write(iter([("twice",)]))
    assert len(messages.names(f"{out}/data", ".json")) >= 3
    writer.commit([again, None], 0)  # batch 0 is there already
    stray = writer.write(iter([("stray",)]))
    got = messages.written(spark, out, "segment int, line long, value string")
    assert got.count() == 10 and got.select("segment", "line").distinct().count() == 10
    writer.abort([stray], 9)
    assert messages.written(spark, f"{tmp_path}/none", "value string").count() == 0


def test_log_reader_splits_blocks(tmp_path):
    (tmp_path / "a.json").write_bytes(b"one\ntw\xc3\xb6\n\nlast")
    reader = messages.LogReader(str(tmp_path))
    (part,) = reader.partitions(reader.initialOffset(), reader.latestOffset())
    rows = [r for batch in reader.read(part) for r in batch.to_pylist()]
    assert [(r["line"], r["value"]) for r in rows] == [(0, "one"), (1, "twö"), (2, ""), (3, "last")]
