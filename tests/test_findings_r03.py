"""What the findings of round 3 named."""

import datetime as dt
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.functions import models, udtfs
from lodestone.functions import text as tx
from lodestone.operators import memory, minhash
from lodestone.operators.tables import Tables
from lodestone.streaming import streams


def test_memories_of_one_time_come_by_their_ties(spark):
    """events of one time are numbered by event_id, as the SQL of memory_add numbers them, not by content."""
    at = dt.datetime(2024, 1, 1)
    kinds = "id long, user_id string, session_id string, content string, metadata string, created_at timestamp"
    stored = spark.createDataFrame([(7, "u", "s", "old", "{}", at)], kinds)
    new = spark.createDataFrame([(3, "b"), (2, "c"), (4, "a")], "event_id long, content string").select("event_id", F.lit("u").alias("user_id"), F.lit("s").alias("session_id"), "content", F.lit("{}").alias("metadata"), F.lit(at).alias("created_at"))
    got = memory.add_memories(stored, new, ["event_id"])
    assert got.columns == stored.columns
    assert [(r.id, r.content) for r in got.orderBy("id").collect()] == [(7, "old"), (8, "c"), (9, "b"), (10, "a")]


def test_missed_grams_lower_signatures(spark):
    """F3 and what shares its step: with a table of 40 n-grams the others are hashed apart, and every signature is the same."""
    texts = ["", "ab", None, "Größe ändern, immer wieder und noch einmal", *(f"text {i} of words {i * 7919} {'long ' * (i % 5)}and more {i * i}" for i in range(120))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for ngram in (5, 0):
        whole = minhash.Hasher(16, 42, "sha256", most=10**7)
        want = {i: whole.signature(minhash.grams(t or "", ngram)).astype(">u8").tobytes() for i, t in enumerate(texts)}
        for most in (0, 40):
            rows = minhash.signed_rows(docs, Tables(spark, "missed"), 16, ngram, 42, "sha256", carry=True, most=most)
            assert rows.columns == ["row", "doc_id", "tie", "sig", "_carried0", "_carried1"]
            got = rows.collect()
            assert {r.doc_id: bytes(r.sig) for r in got} == want and len(got) == len(texts)
            assert all(r._carried1 == texts[r.doc_id] for r in got)


def test_a_full_table_gives_its_misses_out():
    """n-grams that the table has no room for are named, not hashed; F12: the family mersenne keeps no table."""
    hasher = minhash.Hasher(8, 42, "sha256", most=3)
    low, missed = hasher.partial({"a", "b", "c"})
    assert not missed and len(hasher.rows) == 3 and (low == hasher.signature({"a", "b", "c"})).all()
    low, missed = hasher.partial({"a", "d", "e"})
    assert sorted(missed) == ["d", "e"] and (low == hasher.row("a")).all() and "d" not in hasher.rows
    words = {f"w{i}" for i in range(3000)}
    family = minhash.Hasher(16, 1, "mersenne")
    assert (family.signature(words) == np.min([family.row(w) for w in words], axis=0)).all()
    assert not family.rows and len(family.table) <= 1024


def test_texts_are_encoded_in_slices(spark):
    """F8: a worker encodes a bounded length of text at a time, every text whole and once."""
    texts = ["a" * 30, None, "", "b" * 250, "c" * 90, "d" * 20, "e"]
    part = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts, pa.string())], names=["doc_id", "text"])
    for most, sizes in ((100, [3, 1, 1, 2]), (10**6, [7]), (1, [1, 2, 1, 1, 1, 1])):
        got = list(models.slices(part, 1, most))
        assert [t for p in got for t in p.column(1).to_pylist()] == texts
        assert max(p.num_rows for p in got) == max(sizes) and all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= most for p in got)
    assert not list(models.slices(part.slice(0, 0), 1, 100))


def test_neighbours_by_parts_of_a_block(spark):
    """a block's queries meet its vectors in parts; 300 queries of one block have what brute force finds."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8)).round(3)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    asked = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    for cosine in (False, True):
        y = x / np.linalg.norm(x, axis=1, keepdims=True) if cosine else x
        want = np.lexsort((np.broadcast_to(np.arange(300), (300, 300)), -np.round(y @ y.T, 9)), axis=1)[:, :5]
        got = {(r.query_id, r["rank"]): r.vec_id for r in memory.top_k(asked, v, 5, cosine).collect()}
        assert got == {(i, k + 1): int(want[i, k]) for i in range(300) for k in range(5)}


def test_grams_are_counted_in_their_partition(spark, monkeypatch):
    """a partition gives one row an n-gram and its count, not one a text and n-gram; null and short texts count as they did."""
    texts = ["abcabc", "abc", None, "", "Xabc abc"] * 40
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    want = Counter(g for t in texts for g in minhash.grams(t or "", 3))
    for most in (2, 10**6):
        monkeypatch.setattr(udtfs.CharGramCounts.func, "most", most)
        udtfs.register(spark)
        parts = spark.sql("SELECT * FROM char_gram_counts(TABLE(SELECT text, 3 AS n FROM {docs}))", docs=docs).collect()
        summed = Counter()
        for r in parts:
            summed[r.gram] += r.docs
        assert summed == want
    assert len(parts) <= 2 * len(want)


def test_mix_family_hashes_an_ngram_of_a_slice_once(spark, monkeypatch):
    """signatures of the family mix are those of its rows, without a table; texts with an n-gram in common hash it once."""
    texts = ["", "a", "abcd", "abcde", "a\x00b\x00c\x00", " X  y ", "Größe 𝔘𝔫𝔦 ändern", "".join(map(chr, range(0x4E00, 0x6E00))), "ab", *(f"the same words again and again {i % 7}" for i in range(200))]
    hasher = minhash.Hasher(16, 42, "mix")
    want = {n: [np.min([hasher.row(g) for g in minhash.grams(t, n)], axis=0) for t in texts] for n in (1, 3, 5, 9, 0)}
    plain, hashed = minhash.bases, []
    monkeypatch.setattr(minhash, "bases", lambda found: plain(hashed.append(g) or g for g in found))
    for n, sigs in want.items():
        assert all((a == b).all() for a, b in zip(hasher.signatures(texts, n), sigs, strict=True))
    hashed.clear()
    hasher.signatures(texts[9:], 5)
    assert sorted(hashed) == sorted(set().union(*(minhash.grams(t, 5) for t in texts[9:]))) and not hasher.rows
    monkeypatch.setattr(minhash, "SLICE", 40)
    assert all((a == b).all() for a, b in zip(hasher.signatures(texts, 5), want[5], strict=True))
    docs = spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id long, text string").repartition(3)
    got = minhash.signed_rows(docs, Tables(spark, "mix"), 16, 5, 42, "mix").collect()
    assert {r.doc_id: bytes(r.sig) for r in got} == {i: s.astype(">u8").tobytes() for i, s in enumerate(want[5])} | {None: want[5][0].astype(">u8").tobytes()}


def test_lines_of_a_text_are_told_apart_in_one_pass(spark):
    """the quality test, which took three passes of regular expressions, on odd lines and marks."""
    long, mark = "x" * 201, "do not edit"
    texts = ["", "a", " \t\r\x0b\x0c\x1c\x1d\x1e\x1f", "#a\n #b\n\x1f#c\nd", "#a\n\n \n#b\nc\nd", f"{long}", f"{long}\n", f"{'x' * 200}\n \n", "\x85", " #a", "a\n" * 9 + mark, "a\n" * 10 + mark, "\n" * 9 + mark.upper(), None, "# a", "a\r\n# b\r\n# c\r\n"]

    def good(t):
        filled = [x for x in t.split("\n") if x.strip(tx.SPACES)]
        code = [x for x in filled if not x.lstrip(tx.SPACES).startswith("#")]
        head = "\n".join(t.split("\n")[:10]).lower()
        return bool(filled) and not len(code) < 0.3 * len(filled) and not any(m in head for m in tx.GENERATED) and not sum(map(len, filled)) / len(filled) > 200

    got = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", tx.good_quality(F.col("text")).alias("good")).collect()
    assert {r.i: r.good for r in got} == {i: good(t or "") for i, t in enumerate(texts)}
    assert "regexp_replace" not in str(tx.good_quality(F.col("text")))


def test_tasks_cut_series_before_their_state(spark, monkeypatch):
    """F16: a task gives out no more than the last n rows of each series, all that can be among the last n of the whole; null ties are first."""
    rng = np.random.default_rng(2)
    rows = [(f"s{i % 7}", int(t), None if i % 50 == 0 else i, float(v)) for i, (t, v) in enumerate(zip(rng.integers(0, 400, 3000), rng.normal(size=3000)))]
    table = spark.createDataFrame(rows, "symbol string, us long, tie long, value double").repartition(3)
    key = lambda r: (r[1], r[2] is not None, r[2] or 0, r[3])
    whole = {s: sorted((r for r in rows if r[0] == s), key=key)[-20:] for s in {r[0] for r in rows}}
    for most in (10**6, 300, 5):
        monkeypatch.setattr(streams, "GATHERED", most)
        got = [tuple(r) for r in streams.latest_rows(table, 20, "symbol", ["us", "tie", "value"]).collect()]
        assert {s: sorted((r for r in got if r[0] == s), key=key)[-20:] for s in whole} == whole
        assert len(set(got)) == len(got) and not Counter(got) - Counter(rows)
        assert most < 100 or len(got) <= 3 * 7 * 20
    assert not streams.latest_rows(table.limit(0), 20, "symbol", ["us"]).count()
    ticks = spark.readStream.format("rate").load().select(F.lit("a").alias("symbol"), F.col("timestamp").alias("ts"), F.col("value").alias("tie"), F.lit(1.0).alias("value"))
    assert "MapInArrow" in streams.rolling_last(ticks, 3)._jdf.queryExecution().analyzed().toString()


def test_texts_are_signed_in_slices(spark, monkeypatch):
    """a worker takes a bounded length of texts out of an Arrow batch at a time, whatever their number; rows and signatures stay."""
    texts = ["", None, "a b", *(f"w{i} " * 400 for i in range(60)), "long " * 5000, "c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    most, plain = 10_000, minhash.Hasher.signatures

    def bounded(self, some, ngram):
        if len(some) > 1 and sum(len(t.encode()) for t in some) > most:
            raise MemoryError("too many texts at once")
        return plain(self, some, ngram)

    monkeypatch.setattr(minhash, "TAKEN", most, raising=False)
    monkeypatch.setattr(minhash, "spread", lambda d: d)
    for family, ngram in (("mersenne", 0), ("mix", 5)):
        hasher = minhash.Hasher(16, 1, family)
        want = {i: hasher.signature(minhash.grams(t or "", ngram)).astype(">u8").tobytes() for i, t in enumerate(texts)}
        with monkeypatch.context() as m:
            m.setattr(minhash.Hasher, "signatures", bounded)
            rows = minhash.signed_rows(docs, Tables(spark, "slices"), 16, ngram, 1, family).collect()
        assert {r.doc_id: bytes(r.sig) for r in rows} == want and len({r.row for r in rows}) == len(texts)
