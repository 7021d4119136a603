import base64
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import models
from lodestone.operators import ffd, memory, mixing
from lodestone.operators.series import gaf_images
from lodestone.plans import sources
from lodestone.plans import streams as plans
from lodestone.sources import readers, sinks
from lodestone.streaming import streams


def test_code_corpus(spark, tmp_path):
    spark.createDataFrame([("x = 1", "python")], "content string, lang string").write.parquet(f"{tmp_path}/data/python")
    got = readers.code_corpus(spark, str(tmp_path), ["python", "missing"]).collect()
    assert [(r.content, r.language, r.size) for r in got] == [("x = 1", "python", None)]
    with pytest.raises(FileNotFoundError):
        readers.code_corpus(spark, str(tmp_path), ["missing"])


def test_finance_fallback(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"question":"q","answer":"a"}\n{"text":"t"}\n')
    df = readers.finance_samples(spark, f"{tmp_path}/none", f"{tmp_path}/a.json")
    from lodestone.functions.text import sample_text

    text = sample_text(*(F.col(c) for c in ("instruction", "output", "question", "answer", "text")), F.struct(*df.columns))
    assert {r.t for r in df.select(text.alias("t")).collect()} == {"### Question:\nq\n\n### Answer:\na", "t"}
    with pytest.raises(FileNotFoundError):
        readers.finance_samples(spark, f"{tmp_path}/none", f"{tmp_path}/none")


def test_payload_source(spark):
    def fetch(url, timeout):
        if "bad" in url:
            raise OSError("no route")
        return '{"code":"0","data":[]}'

    spark.dataSource.register(readers.payload_source(fetch))
    rows = {r.url: r.body for r in spark.read.format("payloads").option("urls", "http://a\nhttp://bad").load().collect()}
    assert '"0"' in rows["http://a"] and '"-1"' in rows["http://bad"]


def test_sinks(spark, tmp_path):
    made = mixing.synthetic(spark, 20)
    assert sinks.write_synthetic(made, f"{tmp_path}/s") == 20 and spark.read.json(f"{tmp_path}/s").count() == 20
    with pytest.raises(ValueError):
        sinks.write_synthetic(made, f"{tmp_path}/s", "json")
    assert not sinks.write_csv(made.limit(0), f"{tmp_path}/c")
    assert sinks.write_csv(made.withColumn("m", F.create_map(F.lit("a"), F.lit(1))), f"{tmp_path}/c") and spark.read.option("header", True).option("multiLine", True).csv(f"{tmp_path}/c").columns[-1] == "m"


def test_png(spark):
    bars = spark.createDataFrame([("a", i, i, float(i % 7)) for i in range(30)], "symbol string, ts long, event_id long, value double")
    images = gaf_images(bars, 100, "symbol", ["ts", "event_id"], size=16)
    assert sinks.images_base64(images, "symbol").first().png.startswith("iVBORw0KGgo")
    assert sinks.images_base64(images, "symbol", most=10).count() == 0


def test_pictures(spark, sf):
    """Base64 PNG of the field through the colour map, alone and beside the difference field."""
    for r in sources.sink_pictures(spark, sf).collect():
        for coded, wide in ((r.single, 64), (r.dual, 128)):
            data = base64.b64decode(coded)
            assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (wide, 64)
    ends = sinks.coloured(np.array([[-1.0, 0.0, 1.0]]))
    assert [tuple(int(x) for x in c) for c in ends[0]] == sinks.COLOURS


def test_model_input_forms():
    """Bytes or floats, channels last or first, are the same input; it is square, normalised and sized."""
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (224, 224, 3)).astype(np.uint8)
    want = models.model_input(image)
    assert want.shape == (3, 224, 224)
    assert np.allclose(want[1], (image[..., 1] / 255 - 0.456) / 0.224)
    for other in (image.transpose(2, 0, 1), image.astype(np.float32), (image / 255).astype(np.float32)):
        assert np.abs(models.model_input(other) - want).max() < 0.02
    assert models.model_input(image[:, :100]).shape == (3, 224, 224)


def test_predictions(spark, sf):
    rows = sources.predictor_heads(spark, sf).collect()
    assert len(rows) == 5 and all(r.n_features == 768 and 0.25 <= r.regime_confidence <= 1 and 1 / 3 <= r.direction_confidence <= 1 for r in rows)


def test_models(spark):
    df = spark.createDataFrame([(1, "def f(): return 'long'"), (2, "def ("), (3, None)], "id int, code string")
    assert [r.ok for r in df.orderBy("id").select(models.valid_syntax(F.col("code")).alias("ok")).collect()] == [True, False, True]
    assert df.select(models.generate(F.col("code"), models.Canned("ok")).alias("a")).distinct().count() == 1
    bars = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("b", 1, 1.0)], "s string, ts int, value double")
    assert {r.s: r.decision for r in models.run_strategy(bars, "last_move", "s", "ts").collect()} == {"a": "long", "b": "flat"}
    rows = spark.createDataFrame([(1, 0.9), (2, 0.1), (3, 0.5)], "id int, c double")
    got = {r.id: r.refinements for r in models.refined(rows, "c", lambda d: d.withColumn("c", F.col("c") + 0.2), 0.78).collect()}
    assert got == {1: 0, 2: 3, 3: 2}


def test_embedding_and_tokens(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")

    class Broken:
        def embed(self, texts):
            raise OSError("no route")

    v = [r.v for r in df.orderBy("doc_id").select(models.embed(F.col("text"), models.Hashed(8), 8).alias("v")).collect()]
    assert sum(x * x for x in v[0]) == pytest.approx(1) and v[1] == [0.0] * 8
    assert df.select(models.embed(F.col("text"), Broken(), 3).alias("v")).first().v == [0.0] * 3
    got = {r.doc_id: r for r in models.tokenised(df, lambda t: [len(w) for w in t.split()], 3, 0).collect()}
    assert got[1].input_ids == [1, 1, 0] and got[1].attention_mask == [1, 1, 0] and got[2].attention_mask == [0, 0, 0]


def test_stream_dedup_equals_batches(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k in range(3):
        docs.where(f"doc_id % 3 = {k}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    src = streams.read_stream(spark, f"{tmp_path}/in/*", docs.schema, files=1)
    streams.dedup_stream(src, f"{tmp_path}/out", f"{tmp_path}/ck", num_perm=32).awaitTermination()
    kept = spark.read.parquet(f"{tmp_path}/out")
    assert kept.groupBy("doc_id").count().where("count > 1").count() == 0
    assert kept.groupBy("sig").count().where("count > 1").count() == 0
    assert docs.select("text").distinct().count() >= kept.count() > 150


def test_stream_pack_keeps_all(spark, sf):
    got = plans.stream_pack(spark, sf)
    assert got.count() == got.select("doc_id").distinct().count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_stream_pack_carries_rest(spark, tmp_path):
    for k in range(3):
        spark.range(k * 70, k * 70 + 70).select(F.col("id").alias("doc_id"), (F.col("id") % 50 + 1).alias("tokens")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    src = streams.read_stream(spark, f"{tmp_path}/in/*", "doc_id long, tokens long", files=1)
    q = streams.pack_stream(src, f"{tmp_path}/out", f"{tmp_path}/ck", 100, 5, buffer=100)
    q.awaitTermination()
    packed = spark.read.parquet(f"{tmp_path}/out/packed")
    rest = streams.finish_packing(spark, f"{tmp_path}/out", 2, 100, 5)
    assert packed.count() == 200 and rest.count() == 10
    assert packed.select("doc_id").union(rest.select("doc_id")).distinct().count() == 210
