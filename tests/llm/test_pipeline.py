import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, "123 456", "en", "s", 7), (9002, docs.where("doc_id = 2").first().text + " ", "en", "s", 1), (9003, "", None, None, 0)], docs.schema)
    docs = docs.unionByName(extra)
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas()) if name == "packing" else spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = {k: {r.doc_id for r in d.select("doc_id").collect()} for k, d in seen.items()}
    assert {9001, 9003}.isdisjoint(ids["language"]) and len(ids["language"]) == 201
    toxic = toxicity.tag_toxicity(seen["language"], spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1")
    assert ids["toxicity"] == ids["language"] - {r.doc_id for r in toxic.collect()}
    texts = {r.doc_id: re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in seen["toxicity"].collect()}
    assert len(ids["exact dedup"]) == len(set(texts.values())) == len({texts[i] for i in ids["exact dedup"]})
    sets = {r.doc_id: {tuple(w[i : i + 5]) for w in [r.text.lower().split()] for i in range(max(1, len(w) - 4))} for r in seen["exact dedup"].collect()}
    up = {i: i for i in sets}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in sets:
        for b in sets:
            if b < a and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    assert ids["near dedup"] == {i for i in sets if root(i) == i}
    assert ids["packing"] == ids["near dedup"]
    assert seen["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_texts_stay_where_no_language_can_be_learned(spark):
    docs = spark.createDataFrame([(1, "plain words", None), (2, "漢字 🙂", None), (3, "123 !!", None), (4, "", None), (5, None, None)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.by_language(spark, docs, SF).collect()} == {1, 2}


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, set_key string, held_out string, kept int, length int"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, name):
    """Null and empty texts, null ids, repeated rows, one id on two texts and clashing columns, stage by stage; empty tables too."""
    stage = dict(corpus_pipeline.STAGES)[name]
    base = " ".join(f"plain{i} words{i % 7}" for i in range(30))
    texts = [(1, base), (1, base), (2, base + " tail"), (2, "something else entirely in here"), (3, None), (4, ""), (5, "12 34"), (None, "a row without an id"), (None, base), (6, "é")]
    rows = [(i, t, "en", None, None, 0.5, 7, "x", "y", 1, 2) for i, t in texts]
    docs = spark.createDataFrame(rows, ODD)
    out = stage(spark, docs, SF)
    assert stage(spark, docs.limit(0), SF).count() == 0
    if name == "packing":
        assert Counter(r.doc_id for r in out.collect()) == Counter(i for i, _ in texts)
        return
    assert out.columns == docs.columns
    got, every = Counter(map(tuple, out.collect())), Counter(rows)
    assert all(got[r] <= every[r] for r in got)
    stays = Counter((r[0], r[1]) for r in got.elements())
    if name == "language":
        assert stays == Counter(x for x in texts if x[1] and re.search("[a-zé]", x[1]))
    elif name == "toxicity":
        assert all(got[r] in (0, every[r]) for r in every) and stays[(2, "something else entirely in here")]
    elif name == "exact dedup":
        assert stays == Counter([(1, base), (2, base + " tail"), (2, "something else entirely in here"), (3, None), (5, "12 34"), (None, "a row without an id"), (6, "é")])
    else:
        assert stays == Counter([(1, base), (2, "something else entirely in here"), *texts[4:]])
