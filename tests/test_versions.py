"""Versioned knowledge, the bucketed table's plan, packing queries held against Python, and the light variant's own family."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import models
from lodestone.operators import ffd, memory, minhash, series
from lodestone.plans import text as plans
from lodestone.sources import sinks, versions

CHANGE = "category string, key string, value string, metadata string, op string, at long, seq long"


def fold(rows, changes):
    """Knowledge as a dict, change by change."""
    held = dict(rows)
    for c, k, value, meta, op, at, _ in sorted(changes, key=lambda x: x[-1]):
        if op == "delete":
            held.pop((c, k), None)
        else:
            held[c, k] = (value, meta, held[c, k][2] if (c, k) in held and op != "add" else at, at)
    return held


def drawn(seed, n=120):
    rng = random.Random(seed)
    return [(rng.choice(["c", None]), rng.choice(["k1", "k2", "k3", None]), f"v{i}", "{}", rng.choice(["add", "update", "update", "delete", None]), 100 + i, i) for i in range(n)]


def content(df):
    return {(r.category, r.key): (r.value, r.metadata, r.created_at, r.updated_at) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_upserts_equal_a_walk(spark, tmp_path, seed):
    """Cut into many versions, into two, or all in one: the same rows; old versions stay readable through a compaction."""
    changes = drawn(seed)
    frame = lambda rows: spark.createDataFrame(rows, CHANGE)
    base = {("c", "k1"): ("old", "{}", 1, 2), (None, "k9"): ("kept", "{}", 3, 3)}
    rows = spark.createDataFrame([(*k, *v) for k, v in base.items()], versions.ROWS)
    for cuts in ([0, 120], [0, 61, 120], [0, 20, 40, 60, 80, 100, 120]):
        table = versions.VersionedTable(spark, f"{tmp_path}/{len(cuts)}")
        assert table.version() == -1 and table.read().count() == 0
        table.create(rows)
        for a, b in zip(cuts[:-1], cuts[1:]):
            table.upsert(frame(changes[a:b]), most_deltas=4)
        assert content(table.read()) == fold(base, changes)
    assert len(table.manifest(table.version())["deltas"]) < 4  # it was compacted on the way
    with pytest.raises(ValueError, match="already"):
        table.create(rows)


def test_readers_and_failed_writers(spark, tmp_path):
    table = versions.VersionedTable(spark, str(tmp_path))
    table.create(spark.createDataFrame([("c", "k", "v", "{}", 1, 1)], versions.ROWS))
    old = table.read()
    table.upsert(spark.createDataFrame([("c", "k", None, None, "delete", 5, 1), ("c", "n", "w", "{}", "update", 6, 2)], CHANGE))
    table.compact()
    assert content(old) == {("c", "k"): ("v", "{}", 1, 1)} and content(table.read(1)) == content(table.read()) == {("c", "n"): ("w", "{}", 6, 6)}
    # data without a manifest, and a manifest that was never renamed, are not seen
    table._written(versions.net(spark.createDataFrame([("c", "x", "lost", "{}", "add", 9, 1)], CHANGE)), "delta")
    (tmp_path / "log" / "_half").write_text("{")
    assert table.version() == 2 and content(table.read()) == {("c", "n"): ("w", "{}", 6, 6)}
    assert not table.commit(2, {"base": None, "deltas": []}) and table.commit(3, table.manifest(2))


def test_a_lost_race_takes_the_next_version(spark, tmp_path, monkeypatch):
    table, other = versions.VersionedTable(spark, str(tmp_path)), versions.VersionedTable(spark, str(tmp_path))
    change = lambda k, seq: spark.createDataFrame([("c", k, "v", "{}", "add", seq, seq)], CHANGE)
    seen = table.version
    raced = []

    def version():
        now = seen()
        if not raced:
            raced.append(other.upsert(change("other", 1)))  # another writer comes between reading the version and committing
        return now

    monkeypatch.setattr(table, "version", version)
    assert table.upsert(change("mine", 2)) == 1 and raced == [0]
    assert {r.key for r in other.read().collect()} == {"mine", "other"}


def test_bucketed_lookups_do_not_shuffle(spark):
    rows = spark.range(2000).select(F.col("id"), (F.col("id") % 50).cast("string").alias("user_id"), F.lit("x").alias("content"))
    sinks.save_table(rows, "bucketed_memories", "user_id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        t = spark.table("bucketed_memories")
        plan = t.groupBy("user_id").count().join(t.alias("b"), "user_id")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert t.where("user_id = '7'").count() == 40
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_memories")


def scan(lengths, target, separator, full=0.9):
    """First fit decreasing by a look at every open sequence."""
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


def test_packing_queries_equal_python(spark, sf):
    """The whole results of the packing queries, from the texts on."""
    docs = sorted((r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect())
    places = lambda rows, found: {(rows[i], s, k) for s, held in enumerate(found) for k, i in enumerate(held)}
    cut = lambda text, most: min(len(text) // 4, most - 15)
    want = places([d for d, *_ in docs], scan([cut(t, 8192) for *_, t in docs], 8192, 5))  # fewer than a buffer
    assert {(r.doc_id, r.sequence, r.slot) for r in plans.pack_buffered(spark, sf).collect()} == want
    got = {}
    for r in plans.pack_ffd(spark, sf).collect():
        got.setdefault(r.source, set()).add((r.doc_id, r.sequence, r.slot))
    for source in {s for _, s, _ in docs}:
        own = [(d, t) for d, s, t in docs if s == source]
        assert got[source] == places([d for d, _ in own], scan([cut(t, 8192) for _, t in own], 8192, 5))
    got = {}
    for r in plans.pack_dynamic(spark, sf).collect():
        got.setdefault(r.bucket, set()).add((r.doc_id, r.sequence, r.slot))
    bucket = lambda n: next((b for b in (4096, 6144, 8192, 12288, 16384) if n <= b), 16384)
    for b in {bucket(len(t) // 4) for *_, t in docs}:
        own = [(d, t) for d, _, t in docs if bucket(len(t) // 4) == b]
        assert got.pop(b) == places([d for d, _ in own], scan([cut(t, b) for _, t in own], b, 5))
    assert not got


@pytest.mark.parametrize("target", [50, 100])
def test_histogram_packing_equals_first_fit(spark, target):
    """Runs of alike sequences give the places of a sample-by-sample first fit; lengths over the target and ties included."""
    rng = random.Random(target)
    for _ in range(400):
        lengths, separator = [rng.randint(1, rng.choice([5, 30, 130])) for _ in range(rng.randrange(90))], rng.choice([0, 1, 5])
        entries, seen, got = {}, {}, {}
        for length, *entry in ffd.fit_runs([(n, lengths.count(n)) for n in set(lengths)], target, separator):
            entries.setdefault(length, []).append(entry)
        for i, n in enumerate(lengths):
            rank, seen[n] = seen.get(n, 0), seen.get(n, 0) + 1
            first, sequence, per, slot = max(e for e in entries[n] if e[0] <= rank)
            got[i] = (sequence + (rank - first) // per, slot + (rank - first) % per)
        assert got == {i: (s, k) for s, held in enumerate(ffd.first_fit(lengths, target, separator)) for k, i in enumerate(held)}
    rows = [(rng.choice(["a", None, "b"]), i * 3 - 50, rng.choice([None, rng.randrange(60)])) for i in range(700)] + [("a", None, 7)]
    found = {(r.source, r.doc_id): (r.sequence, r.slot) for r in ffd.pack_groups(spark.createDataFrame(rows, "source string, doc_id long, tokens long"), ["source"], target, 5).collect()}
    for source in ("a", None, "b"):
        own = sorted(((i, n or 0) for s, i, n in rows if s == source), key=lambda x: (x[0] is not None, x[0] or 0))
        assert all(found[source, own[i][0]] == (s, k) for s, held in enumerate(ffd.first_fit([n for _, n in own], target, 5)) for k, i in enumerate(held))


def test_packed_rows_equal_python(spark, sf):
    """Ids, masks, labels and boundaries of every row, and the sums of ``pack_stats``; once with stand-in ids, once with a tokenizer's."""
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    own = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    stand_in = lambda t: [zlib.crc32(w.encode()) % 50_000 for w in t.split(" ")]
    for query, ids_of, sep, pad in ((plans.packed_rows, stand_in, [50_001, 50_002], 0), (plans.packed_token_rows, lambda t: own.encode(t, add_special_tokens=False).ids, [50_256], 50_256)):
        ids = [ids_of(t)[: 2048 - len(sep) - 10] for _, t in docs]
        want = []
        for held in scan([len(x) for x in ids], 2048, len(sep)):
            row, ends = [], []
            for i in held:
                ends.append((len(row), len(row) + len(ids[i])))
                row += ids[i] + sep
            row = row[:2048]
            want.append((row + [pad] * (2048 - len(row)), [1] * len(row) + [0] * (2048 - len(row)), row + [-100] * (2048 - len(row)), ends, len(held), len(row)))
        got = query(spark, sf).orderBy("sequence").collect()
        assert [(r.input_ids, r.attention_mask, r.labels, [tuple(b) for b in r.boundaries], r.num_samples, r.total_tokens) for r in got] == want
        if query is plans.packed_rows:
            s = plans.pack_stats(spark, sf).first()
            assert (s.samples, s.sequences, s.tokens, s.padding) == (len(docs), len(want), sum(w[-1] for w in want), sum(2048 - w[-1] for w in want))


def test_own_family_and_shape():
    a, b = minhash.permutations(128, 1)
    row = minhash.Hasher(128, 1, "mersenne").row("word")
    import hashlib

    h = int.from_bytes(hashlib.sha1(b"word").digest()[:4], "little")
    assert row.tolist() == [(x * h + y) % 2**64 % (2**61 - 1) & (2**32 - 1) for x, y in zip(a.tolist(), b.tolist())]
    bands, rows = minhash.balanced_shape(128, 0.7)
    assert bands * rows <= 128
    errors = {s: sum(minhash.areas(0.7, *s)) for s in ((bands, rows), (bands + 1, rows), (bands - 1, rows), (bands, rows - 1), (16, 8), (32, 4)) if s[0] * s[1] <= 128}
    assert min(errors, key=errors.get) == (bands, rows)
    fp, fn = minhash.areas(0.5, 1, 1)
    assert fp == pytest.approx(0.125, abs=1e-6) and fn == pytest.approx(0.125, abs=1e-6)


def test_quotes(spark):
    rows = spark.sql("select 'a' symbol, timestamp '2024-01-01 10:00:00' ts, 1 tie, 10.0D price union all select 'a', timestamp '2024-01-03 09:00:00', 1, 12.0D union all select 'a', timestamp '2024-01-03 11:00:00', 1, 11.0D union all select 'b', timestamp '2024-01-03', 1, 5.0D union all select 'b', timestamp '2024-01-04', 1, null")
    got = {r.symbol: tuple(r)[1:] for r in series.quote(rows).collect()}
    assert got == {"a": (11.0, 12.0, 12.0, 11.0, 2, 1.0, 10.0), "b": (5.0, 5.0, 5.0, 5.0, 1, None, None)}
    assert series.quote(rows.limit(0)).count() == 0


def test_token_ids_of_odd_texts(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b <|endoftext|> c"), (None, "x")], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in models.token_ids(docs, str(public_tokenizers.path("byte_bpe_50k.json"))).collect()}
    assert got[1] == got[2] == [] and 50_256 in got[3] and len(got[None]) == 1


def test_folded_feedback_of_odd_rows(spark):
    said = spark.createDataFrame([(1, "a", "long", None), (2, "a", "long", "ok"), (3, None, "long", "wrong")], "ts long, symbol string, decision string, feedback string")
    records = spark.createDataFrame([("a", "long", 0.5), ("a", "long", 0.5), (None, "long", 0.5)], "symbol string, decision string, confidence double")
    got = sorted(((r.symbol, r.feedback, round(r.quality_score, 6)) for r in memory.refine(records, said).collect()), key=str)
    assert got == [("a", "ok", 0.6), ("a", "ok", 0.6), (None, "", 0.5)] or np.isclose(got[0][2], 0.6)
