import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scoring as sc
from lodestone.functions import text as tx
from lodestone.operators import ffd, memory, minhash, mixing, ranking
from lodestone.operators.tables import Tables
from lodestone.plans import text as plans


def column(spark, texts, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", expression(F.col("t")).alias("x")).orderBy("i").collect()]


def test_verdicts(spark):
    body = "\n".join(["import x"] * 9)
    comment = lambda n: "\n".join(["# rsi macd"] * n + ["code"] * (10 - n))
    wide = "\n".join(["rsi macd " + "x" * 191] * 10)
    marked = lambda at: "\n".join(["rsi macd"] * (at - 1) + ["DO NOT EDIT"] + ["rsi"] * 4)
    texts = [body, body + "\nrsi", body + "\nsharpe ratio", "\n".join(["rsi macd"] * 2001), comment(8), comment(7), marked(10), marked(11), wide, wide + "x" * 2, body + "\nbt. macd", body + "\nbt.x macd", body + "\nTA_RSI macd", body + "\nrsi rsi rsi"]
    want = ["too_short", "no_keywords", "pass", "too_long", "low_quality", "pass", "low_quality", "pass", "pass", "low_quality", "no_keywords", "pass", "no_keywords", "no_keywords"]
    assert column(spark, texts, lambda t: tx.verdict(t, tx.KEYWORDS, tx.HIGH_VALUE)) == want
    assert len(tx.KEYWORDS) == 71 and len(tx.HIGH_VALUE) == 16


def test_confidence(spark):
    h = lambda e: 1 + e * math.log2(e) + (1 - e) * math.log2(1 - e)
    texts = ["ERROR_PROBABILITY: 0.1", "ERROR_PROBABILITY: 0.49", "ERROR_PROBABILITY: 0", "ERROR_PROBABILITY: 0.9", "ERROR_PROBABILITY: 0.1.", "CONFIDENCE_LOW: 0.6\nCONFIDENCE_HIGH: 0.8", "maybe 0.4 or 0.8, 12 bars", "none"]
    want = [h(0.1), h(0.49), 1.0, 0.5, 0.5, 0.7, 0.6, 0.5]
    assert column(spark, texts, sc.parsed_confidence) == [pytest.approx(w, abs=1e-9) for w in want]


def test_decisions_and_scores(spark):
    assert column(spark, ["DECISION: short", "go long", "long or short", "hold", "decision:  FLAT long"], sc.parsed_decision) == ["short", "long", "flat", "flat", "flat"]
    assert column(spark, ["trend: 8", "trend strength: 8", "trend = 15", "trend 0"], lambda t: sc.pattern_score(t, "trend")) == [8, 5, 10, 1]
    rows = [(0.5, 0.2, "bullish", 0.6), (-0.5, -0.2, "bearish", 0.6), (0.0, 0.0, "neutral", 0.0), (-0.0301, 0.0, "neutral", 0.0)]
    df = spark.createDataFrame(rows, "t double, m double, d string, c double")
    got = [r.s for r in df.select(sc.signal_score(F.col("t"), F.col("m"), F.col("d"), F.col("c")).alias("s")).collect()]
    assert got == [71, 29, 50, 49]


def test_ensemble(spark):
    rows = [("bullish", 0.6, 1.0, 0.8), ("bearish", 0.6, 1.0, 0.8), ("neutral", 0.9, 1.0, 0.2)]
    s = sc.ensemble_score(F.col("d"), F.col("c"), F.col("t"), F.col("w"))
    got = spark.createDataFrame(rows, "d string, c double, t double, w double").select(s.alias("s"), sc.ensemble_side(s).alias("x")).collect()
    assert [r.x for r in got] == ["LONG", "FLAT", "FLAT"] and got[1].s == pytest.approx(0.1429, abs=1e-4) and got[2].s == pytest.approx(0.1818, abs=1e-4)


def test_formats(spark):
    assert column(spark, ["a ### Implementation: b"], lambda t: tx.phi_format(t, F.lit("synthetic"))) == ["<|user|>\na \n\n<|assistant|>\n b<|end|>"]
    got = column(spark, ["x\n```python\nimport numpy as np\ny\n```\nz", "plain"], tx.code_block)
    assert got[0] == "import pandas as pd\n\nimport numpy as np\ny" and got[1] == "import numpy as np\nimport pandas as pd\nplain"
    assert column(spark, ["a```b"], tx.code_block) == ["import numpy as np\nimport pandas as pd\na"]


def brute_signature(text, n, perms, seed):
    import hashlib

    t = " ".join(text.lower().split())
    grams = [t[i : i + n] for i in range(len(t) - n + 1)] if len(t) >= n else [t]
    return [min(int(hashlib.sha256(g.encode() + (seed + i).to_bytes(4, "little")).hexdigest()[:16], 16) for g in grams) for i in range(perms)]


def test_signatures_and_bands(spark):
    assert [minhash.band_shape(128, t) for t in (0.5, 0.7, 0.8, 0.85, 0.9)] == [(32, 4), (16, 8), (8, 16), (8, 16), (8, 16)]
    assert minhash.Hasher(1, 42, "sha256").row("hello")[0] == 0x65C21C4404100405
    texts = ["", "ab", "A  b\tC", "a b c", "hello world, again", "Größe ändern"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "doc_id long, text string")
    for r in minhash.signatures(docs, num_perm=16).collect():
        text = "" if r.doc_id == 99 else texts[r.doc_id]
        assert [int.from_bytes(r.sig[8 * i : 8 * i + 8], "big") for i in range(16)] == brute_signature(text, 5, 16, 42)


def test_first_wins_is_not_components(spark):
    def kept(pairs):
        held = spark.createDataFrame([(n, b, p[0]) for b, p in enumerate(pairs) for n in p], "node long, band int, first long")
        return {r.node for r in minhash.first_wins(held, lambda met: met, Tables(spark, "t")).where("kept").collect()}

    assert kept([(1, 2), (2, 3)]) == {1, 3}
    assert kept([(1, 2), (1, 3)]) == {1}
    random.seed(3)
    pairs = sorted({tuple(sorted(random.sample(range(60), 2))) for _ in range(90)})
    stay = []
    for n in sorted({x for p in pairs for x in p}):
        if not any((a, n) in pairs for a in stay):
            stay.append(n)
    assert kept(pairs) == set(stay)


def test_dedup_equals_greedy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 120")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    kept, hasher, (bands, wide) = [], minhash.Hasher(32, 42, "sha256", most=10**7), minhash.band_shape(32, 0.7)
    for r in rows:
        s = hasher.signature(minhash.grams(r.text, 5))
        shares = [k for k in kept if any((s[b * wide : (b + 1) * wide] == k[1][b * wide : (b + 1) * wide]).all() for b in range(bands)) and (s == k[1]).mean() >= 0.7]
        if not shares:
            kept.append((r.doc_id, s))
    got = minhash.dedup(docs, num_perm=32)
    assert {r.doc_id for r in got.where("kept").collect()} == {k for k, _ in kept}
    stats = minhash.dedup_stats(got).first()
    assert (stats.total, stats.unique) == (len(rows), len(kept))


def test_first_fit():
    assert ffd.first_fit([80, 50, 40, 30, 20, 10], 100, 5) == [[0, 5], [1, 2], [3, 4]]
    random.seed(1)
    for _ in range(50):
        lengths = [random.randint(1, 90) for _ in range(40)]
        found = ffd.first_fit(lengths, 100, 5)
        assert sorted(i for s in found for i in s) == list(range(40))
        assert all(sum(lengths[i] + 5 for i in s) <= 100 for s in found)


def test_first_fit_equals_a_scan():
    """The tree finds the sequence that a look at every open one finds, whatever the lengths; oversize samples stand alone."""

    def scan(lengths, target, separator, full=0.9):
        open_, out = [], []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            cost = lengths[i] + separator
            at = next((k for k, (_, used) in enumerate(open_) if used + cost <= target), None)
            if at is None:
                open_.append(([i], cost))
            else:
                open_[at] = ([*open_[at][0], i], open_[at][1] + cost)
            while open_ and open_[0][1] >= full * target:
                out.append(open_.pop(0)[0])
        return out + [held for held, _ in open_]

    random.seed(4)
    for n in [0, 1, 2, *range(3, 120, 7)]:
        for top in (20, 60, 130):
            lengths = [random.randint(0, top) for _ in range(n)]
            assert ffd.first_fit(lengths, 100, 5) == scan(lengths, 100, 5)


def test_positions_equal_a_sort(spark):
    """Sparse, dense and hot numbers, null orders and null groups, in few cells or many."""
    random.seed(5)
    rows = [(i, random.choice([None, "a", "b"]), random.choice([None, random.randrange(10**15), random.randrange(50), 7])) for i in range(600)]
    want = {}
    for g in (None, "a", "b"):
        for place, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))):
            want[r[0]] = place
    df = spark.createDataFrame(rows, "i long, g string, o long")
    for cells in (1, 3, 40):
        assert {r.i: r.p for r in ranking.positions(df, "o", ["g"], "p", ["i"], cells).collect()} == want
    assert sorted(r["_rank"] for r in ranking.positions(df, "o").collect()) == list(range(600))


def test_samples_are_cut_or_skipped(spark):
    df = spark.createDataFrame([(1, 10), (2, 85), (3, 86)], "doc_id long, tokens long")
    assert [r.tokens for r in ffd.fitting(df, "tokens", 100, 5).orderBy("doc_id").collect()] == [10, 85, 85]
    assert [r.doc_id for r in ffd.fitting(df, "tokens", 100, 5, truncate=False).orderBy("doc_id").collect()] == [1, 2]


def test_hasher_keeps_what_is_used():
    small, large = (minhash.Hasher(16, 42, "sha256", most=m) for m in (40, 10**6))
    for i in range(60):
        grams = {"always", "often" if i % 2 else "rare", *(f"g{i}-{k}" for k in range(i % 50))}
        assert (small.signature(grams) == large.signature(grams)).all()
        assert "always" in small.rows or len(grams) > 40
    with pytest.raises(ValueError, match="permutations"):
        minhash.pair_similarity(None, None, 128, 64)


def test_shards_and_rows(spark):
    docs = spark.createDataFrame([(i * 7, 10 + i % 5) for i in range(2500)], "doc_id long, tokens long")
    shards = {r.doc_id: r.shard for r in ffd.with_shard(docs, "doc_id", 1000).collect()}
    assert shards == {i * 7: i // 1000 for i in range(2500)}
    placed = spark.createDataFrame([(0, 0, 0, [1, 2, 3]), (0, 0, 1, [4])], "shard int, sequence long, slot long, ids array<int>")
    r = ffd.packed_rows(placed, ["shard"], 8, [9], 0).first()
    assert r.input_ids == [1, 2, 3, 9, 4, 9, 0, 0] and r.attention_mask == [1] * 6 + [0] * 2 and r.labels[-2:] == [-100, -100]
    assert [tuple(b) for b in r.boundaries] == [(0, 3), (4, 5)] and r.padding_tokens == 2
    empty = ffd.pack_stats(spark.createDataFrame([], "num_samples long, total_tokens long"), 8).first()
    assert (empty.samples, empty.utilisation, empty.samples_per_sequence) == (0, 0.0, 0.0)


def test_mixing(spark):
    rows = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(300)], "doc_id long, origin string")
    mixed = mixing.ratio_mix(rows, "origin", "doc_id", {"a": 0.5, "b": 0.4}).orderBy("draw").collect()
    assert [r.draw for r in mixed] == list(range(len(mixed)))
    for name in "ab":
        own = [r.doc_id for r in mixed if r.origin == name]
        assert own == sorted(own) == [i for i in range(300) if (i % 3 > 0) == (name == "a")][: len(own)]
    assert any(sum(r.origin == n for r in mixed) == c for n, c in (("a", 200), ("b", 100)))
    kinds = {r["kind"]: r["count"] for r in mixing.synthetic(spark, 10_000).groupBy("kind").count().collect()}
    assert all(abs(kinds[k] / 10_000 - share) < 0.02 for k, share in mixing.KINDS)
    assert not any(re.search(r"\{\w+\}", r.text) for r in mixing.synthetic(spark, 200).collect())


def test_memories(spark):
    stored = spark.createDataFrame([], "id long, user_id string, session_id string, content string, metadata string, created_at timestamp")
    new = spark.sql("select 'u' user_id, 's' session_id, 'trade was successful' content, '{}' metadata, timestamp '2024-01-01' created_at union all select 'u', 's', 'Long idea', '{}', timestamp '2024-01-02'")
    stored = memory.add_memories(stored, new)
    assert [r.id for r in memory.all_memories(stored, "u").collect()] == [2, 1]
    assert [r.content for r in memory.search(stored, "long", "u").collect()] == ["Long idea"]
    assert "trade" in memory.context(memory.search(stored, "trade", "u")).first().context
    assert memory.delete_memory(stored, 1).count() == 1 and memory.clear_memories(stored, "u").count() == 0
    assert memory.search(stored, "long", "other").count() == 0


def test_flywheel(spark):
    records = spark.createDataFrame([("a", "long", 0.7), ("b", "long", 0.7), ("c", "long", 0.95), ("d", "short", 0.05), ("e", "long", 0.7)], "symbol string, decision string, confidence double")
    said = spark.createDataFrame([(1, "b", "long", "fine"), (2, "c", "long", "ok"), (3, "d", "short", "incorrect"), (5, "e", "long", "WRONG"), (4, "e", "long", "hm"), (6, "a", "short", "wrong")], "ts long, symbol string, decision string, feedback string")
    got = {r.symbol: (round(r.quality_score, 6), r.feedback) for r in memory.refine(records, said).collect()}
    assert got == {"a": (0.7, ""), "b": (0.8, "fine"), "c": (1.0, "ok"), "d": (0.0, "incorrect"), "e": (0.6, "hm; WRONG")}


def test_knowledge(spark):
    kind = "category string, key string, value string, metadata string, created_at long, updated_at long"
    stored = spark.createDataFrame([("c", "k", "v", "{}", 1, 1), ("c", "gone", "v", "{}", 1, 1), ("c", "u", "v", "{}", 1, 1)], kind)
    changes = spark.createDataFrame([("c", "k", "w", "{}", "add", 5, 1), ("c", "gone", None, None, "delete", 6, 2), ("c", "u", "x", "{}", "update", 7, 3), ("c", "new", "n", "{}", "update", 8, 4)], "category string, key string, value string, metadata string, op string, at long, seq long")
    got = {r.key: (r.value, r.created_at, r.updated_at) for r in memory.upsert(stored, changes).collect()}
    assert got == {"k": ("w", 5, 5), "u": ("x", 1, 7), "new": ("n", 8, 8)}


def test_dedup_of_the_survey(spark):
    """The number of documents that stay at this size, which components (867) would miss."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert minhash.dedup(docs).where("kept").count() == 868


def test_word_dedup(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "d c b a"), (3, "x y"), (4, None), (5, "")], "doc_id long, text string")
    assert [r.doc_id for r in minhash.unique_documents(docs, ngram=0, family="mix", verify=False).collect()] == [1, 3, 4]
    assert [r.doc_id for r in minhash.unique_documents(docs, most=2, ngram=0, family="mix").collect()] == [1, 3]


def test_lsh_links_every_document(spark, sf, tmp_path):
    """Classes and pairs of both queries, spread over their members, are all pairs that brute force finds."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id < 100")
    near = docs.where("doc_id < 8").select((F.col("doc_id") + 1000).alias("doc_id"), F.concat("text", F.lit(" one more")).alias("text"))
    same = docs.where("doc_id < 5").select((F.col("doc_id") + 2000).alias("doc_id"), F.upper(F.concat(F.lit(" \n"), "text")).alias("text"))
    more = spark.createDataFrame([(3000, None), (3001, ""), (3002, "alone in its class")], "doc_id long, text string")
    docs.unionByName(near).unionByName(same).unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    hasher = minhash.Hasher(128, 42, "sha256", most=10**7)
    sigs = {r.doc_id: hasher.signature(minhash.grams(r.text or "", 5)) for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()}
    bands, wide = minhash.band_shape(128, 0.7)
    want = {False: set(), True: set()}
    for a in sigs:
        for b in sigs:
            if a < b:
                agree = sigs[a] == sigs[b]
                if agree.reshape(bands, wide).all(1).any():
                    want[False].add((a, b))
                    if agree.mean() >= 0.7:
                        want[True].add((a, b))
    for query, verified in ((plans.lsh_candidates, False), (plans.lsh_verified_pairs, True)):
        rows = query(spark, str(tmp_path)).collect()
        of = {r.doc_id: r.other for r in rows if r.kind == "member"}
        assert set(of) == set(sigs) and sum(r.kind == "member" for r in rows) == len(sigs)
        assert all(r.copies == sum(k == r.other for k in of.values()) for r in rows if r.kind == "member")
        assert of[2001] == 1 and of[3001] == 3000 and of[3002] == 3002
        pairs = {(r.doc_id, r.other) for r in rows if r.kind == "pair"}
        assert {(a, b) for a in of for b in of if a < b and (of[a] == of[b] or tuple(sorted((of[a], of[b]))) in pairs)} == want[verified]


def test_corpus_pipeline_is_whole(spark, tmp_path):
    """Documents that fail the filter are the second source, deduplicated behind those that pass, whatever their ids."""
    code = "\n".join(f"value{i} = the thing of the licensed index {i * i}" for i in range(12))
    rows = [(1, " ".join(code.split("\n"))), (2, "Profits rose in the third quarter, said the bank."), (3, "Profits rose in the third quarter, said the bank."), (7, code), (8, code.upper())]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = plans.corpus_pipeline(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.source) for r in got if r.source != "synthetic"} == {(7, "code"), (2, "cot")}
    assert sum(r.source == "synthetic" for r in got) == 5000
    text = {r.source: r.text for r in got if r.doc_id in (2, 7) and r.source != "synthetic"}
    assert text["cot"] == tx.PHI["cot"].replace("{}", rows[1][1]) and text["code"] == tx.PHI["code"].replace("{}", code)
    scores = {r.doc_id: r.priority for r in plans.corpus_priority_score(spark, str(tmp_path)).collect()}
    assert all(r.priority == scores[r.doc_id] for r in got if r.source != "synthetic") and scores[7] > 0


def test_packing_keeps_null_keys(spark, tmp_path):
    rows = [(1, "a", "x" * 400), (2, None, "x" * 400), (None, "a", "x" * 400), (None, None, "x" * 400), (3, "a", "x" * 40000)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = plans.pack_ffd(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), str(r.source)) for r in got) == sorted((str(i), str(s)) for i, s, _ in rows)
