"""Core dedup by rows and by buckets, in batch and as a stream."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import minhash
from lodestone.operators.tables import Tables
from lodestone.plans import text as plans
from lodestone.streaming import streams

SCHEMA = "doc_id long, text string, row string, sig int, kept boolean"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, False) for i, t in rows], SCHEMA)


def signed(text, perms=32, ngram=5):
    return minhash.Hasher(perms, 42, "sha256", most=10**7).signature(minhash.grams(text or "", ngram))


def greedy(rows, perms=32, threshold=0.7, verify=True, ngram=5):
    """The rows that stay, one by one: places in ``rows``, in the order they are walked (doc_id, null last)."""
    bands, wide = minhash.band_shape(perms, threshold)
    stay = []
    for at in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0)):
        s = signed(rows[at][1], perms, ngram)
        shares = lambda k: any((s[b * wide : (b + 1) * wide] == k[b * wide : (b + 1) * wide]).all() for b in range(bands))
        if not any(shares(k) and (not verify or (s == k).mean() >= threshold) for _, k in stay):
            stay.append((at, s))
    return [at for at, _ in stay]


def family(n, seed, changes=12, size=300):
    rng = random.Random(seed)
    base = [rng.choice("abcdefghij ") for _ in range(size)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(changes)):
            own[rng.randrange(size)] = rng.choice("klmnop")
        out.append("".join(own))
    return out


def test_rows_are_judged_by_themselves(spark):
    """Repeated rows, one id on several texts, null and extreme ids, null and empty texts: each row stays or goes by itself."""
    rows = [(1, "the same words again"), (1, "the same words again"), (1, "something else entirely"), (2, "the same words again"), (-(2**63), "far down below zero"), (2**63 - 1, "far up above all"), (None, "far up above all"), (None, "only without an id"), (None, "only without an id"), (7, None), (8, ""), (None, None)]
    got = minhash.dedup(frame(spark, rows), num_perm=32, carry=True)
    assert got.columns == ["doc_id", "text", "row", "sig", "kept", "kept"]
    kept = sorted((tuple(r[:2]) for r in got.collect() if r[-1]), key=str)
    assert kept == sorted((rows[i] for i in greedy(rows)), key=str)
    every = minhash.dedup(frame(spark, rows), num_perm=32)
    assert every.count() == len(rows) and every.where("kept").count() == 6
    stats = minhash.dedup_stats(every).first()
    assert (stats.total, stats.duplicates, stats.unique) == (12, 6, 6)
    unique = minhash.unique_documents(frame(spark, rows).drop("kept"), num_perm=32)
    assert unique.columns == ["doc_id", "text", "row", "sig"] and unique.count() == 6
    assert [r.doc_id for r in minhash.unique_documents(frame(spark, rows).drop("kept"), most=2, num_perm=32).collect()] == [-(2**63), 1]
    assert minhash.dedup(frame(spark, [])).collect() == []


@pytest.mark.parametrize(("verify", "few"), [(True, 50_000), (False, 50_000), (True, 0), (False, 60)])
def test_hot_buckets_equal_greedy(spark, monkeypatch, verify, few):
    monkeypatch.setattr(minhash, "FEW", few)
    rows = [(i, t) for i, t in enumerate(family(60, 1) + family(40, 2, 120) + family(20, 3, 3, 40))]
    random.Random(5).shuffle(rows)
    got = minhash.dedup(frame(spark, rows), num_perm=32, verify=verify)
    assert sorted(r.doc_id for r in got.where("kept").collect()) == sorted(rows[i][0] for i in greedy(rows, verify=verify))


def graph(spark, pairs, groups):
    """Nodes held in buckets, and the function that says which pairs are alike; pairs seen are counted."""
    held = spark.createDataFrame([(n, b, min(g)) for b, g in enumerate(groups) for n in g], "node long, band int, first long")
    alike, seen = spark.createDataFrame(pairs, "lo long, hi long"), []

    def chosen(met):
        seen.append(met.count())
        return met.join(alike, ["lo", "hi"], "left_semi")

    return held, chosen, seen


def walk(nodes, pairs, groups):
    share = {(a, b) for g in groups for a in g for b in g if a < b} & set(pairs)
    stay = []
    for n in sorted(nodes):
        if not any((a, n) in share for a in stay):
            stay.append(n)
    return set(stay)


@pytest.mark.parametrize("seed", range(4))
def test_first_wins_over_buckets(spark, seed):
    """Random graphs over random buckets, with chains, against a walk node by node."""
    rng = random.Random(seed)
    groups = [sorted(rng.sample(range(60), rng.choice([2, 3, 8, 30]))) for _ in range(12)]
    nodes = {n for g in groups for n in g}
    pairs = sorted({tuple(sorted(rng.sample(sorted(nodes), 2))) for _ in range(rng.choice([30, 200]))})
    held, chosen, _ = graph(spark, pairs, groups)
    found = minhash.first_wins(held, chosen, Tables(spark, "t"), most=8).collect()
    assert {r.node for r in found} == nodes and len(found) == len(nodes)
    assert {r.node for r in found if r.kept} == walk(nodes, pairs, groups)


def test_a_family_costs_its_size(spark):
    """10,000 near copies that share all of four buckets: the pairs met grow as the family, not as its square."""
    met = {}
    for n in (2_500, 10_000):
        held = spark.range(n).crossJoin(spark.range(4).withColumnRenamed("id", "band")).select(F.col("id").alias("node"), F.col("band").cast("int"), F.lit(0).cast("long").alias("first"))
        seen = []

        def alike(pairs):
            seen.append(pairs.count())  # noqa: B023
            return pairs

        kept = minhash.first_wins(held, alike, Tables(spark, "t")).where("kept").collect()
        assert [r.node for r in kept] == [0]
        met[n] = sum(seen)
    assert met[10_000] == 9_999 and met[2_500] == 2_499


def test_unlike_bucket_is_decided_in_few_rounds(spark):
    """300 nodes of one bucket of which none are alike: every pair has to be seen, but hundreds of nodes are decided a round."""
    held = spark.range(300).select(F.col("id").alias("node"), F.lit(0).alias("band"), F.lit(0).cast("long").alias("first"))
    rounds = []

    def none(pairs):
        rounds.append(pairs.count())
        return pairs.where("false")

    assert minhash.first_wins(held, none, Tables(spark, "t")).where("kept").count() == 300 and len(rounds) <= 6


def test_corpus_pipeline_keeps_each_row_once(spark, tmp_path):
    """A repeated document comes out once, one without an id or with an extreme one is not lost, and code goes before finance."""
    body = "\n".join(f"the thing und les line {i} of the licensed code" for i in range(12))
    texts = [(5, body), (5, body), (None, "no id at all, but a text"), (-(2**63), "far below"), (2**63 - 1, "far above"), (1, body.replace("line 3", "line 3!")), (9, None)]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = plans.corpus_pipeline(spark, str(tmp_path)).where("source <> 'synthetic'").collect()
    assert sorted(((r.doc_id, r.source) for r in got), key=str) == sorted([(1, "code"), (None, "cot"), (-(2**63), "cot"), (2**63 - 1, "cot"), (9, "cot")], key=str)


def test_recall_of_the_bands(spark, sf):
    """Of the pairs of documents at a true similarity of 0.7 or more, how many share a band: all of the near copies here."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: minhash.grams(r.text or "", 5) for r in docs.collect()}
    ids = sorted(texts)
    true = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if min(len(texts[a]), len(texts[b])) >= 0.7 * max(len(texts[a]), len(texts[b])) and len(texts[a] & texts[b]) >= 0.7 * len(texts[a] | texts[b])}
    tables = Tables(spark, "recall")
    rows = minhash.signed_rows(docs, tables, 128, 5, 42, "sha256")
    nodes = minhash.classes(rows, tables)
    pairs = minhash.linked(rows, nodes, minhash.candidates(minhash.buckets(nodes, 128, 0.7))).collect()
    first = {r.doc_id: r.other for r in pairs if r.kind == "member"}
    near = {(r.doc_id, r.other) for r in pairs if r.kind == "pair"}
    found = {(a, b) for a, b in true if first[a] == first[b] or tuple(sorted((first[a], first[b]))) in near}
    assert len(found) >= 0.9 * len(true) > 0


def test_merged_signature_is_the_minimum(spark):
    rows = [(i, t, s) for i, (t, s) in enumerate(zip(family(30, 4) + [None, "", "ab"], [None, "a", "b"] * 11))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = {}
    for r in minhash.merged_signatures(docs, "source", num_perm=8, groups=2).collect():
        got.setdefault(r.source, {})[r.i] = int.from_bytes(r.low, "big")
    for s in (None, "a", "b"):
        want = np.min([signed(t, 8) for _, t, own in rows if own == s], axis=0)
        assert [got[s][i] for i in range(8)] == want.tolist()


def fed(spark, path, parts):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{path}/in/{k}")
        yield streams.read_stream(spark, f"{path}/in/*", "doc_id long, text string")


def test_stream_dedup_equals_a_walk(spark, tmp_path):
    """Three starts on one checkpoint; rows of a batch are walked after all that was kept before, odd rows included."""
    rows = [(i, t) for i, t in enumerate(family(30, 7) + family(20, 8, 80))]
    random.Random(2).shuffle(rows)
    rows += [rows[0], (None, rows[3][1]), (None, "a text without an id"), (90, None), (91, ""), (2**62, "far up")]
    parts, want, queries = [rows[:20], rows[20:35], rows[35:]], [], []
    for k, docs in enumerate(fed(spark, tmp_path, parts)):
        queries.append(streams.dedup_stream(docs, f"{tmp_path}/out", f"{tmp_path}/ck", num_perm=32, family="sha256"))
        want += sorted(parts[k], key=lambda r: (r[0] is None, r[0] or 0))
    stays = []
    for r in want:
        if len(greedy([(i, t) for i, (_, t) in enumerate([*stays, r])])) == len(stays) + 1:
            stays.append(r)
    got = spark.read.schema(streams.KEPT).parquet(f"{tmp_path}/out")
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(stays, key=str)


def test_stream_reads_new_rows_only(spark, tmp_path):
    """What a start reads is its own batch (once for each side of the union) and what it kept itself, however much the index holds."""
    read = []
    for docs in fed(spark, tmp_path, [[(100 * k + i, t) for i, t in enumerate(family(10, 50 + 10 * k + i, 1)[0] for i in range(10))] for k in range(4)]):
        query = streams.dedup_stream(docs, f"{tmp_path}/out", f"{tmp_path}/ck", num_perm=16)
        read.append(sum(p["numInputRows"] for p in query.recentProgress))
    assert read[1:] == [30, 30, 30] and spark.read.schema(streams.KEPT).parquet(f"{tmp_path}/out").count() == 40


def test_stream_stops_at_a_cap(spark, tmp_path):
    for docs in fed(spark, tmp_path, [[(k * 10 + i, f"w{k}x{i} q{i}z{k} " * 9) for i in range(4)] for k in range(2)]):
        streams.dedup_stream(docs, f"{tmp_path}/out", f"{tmp_path}/ck", num_perm=16, most=5)
    assert sorted(r.doc_id for r in spark.read.schema(streams.KEPT).parquet(f"{tmp_path}/out").collect()) == [0, 1, 2, 3, 10]
