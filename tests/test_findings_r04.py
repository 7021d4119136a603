"""What the finding of round 4 named: the disk of stream_dedup."""

import glob
import os
import random

from lodestone.operators import minhash
from lodestone.operators.tables import Tables
from lodestone.streaming import streams

from .test_dedup import family, fed, greedy


def size(path) -> int:
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_stream_dedup_needs_little_disk(spark, tmp_path):
    """state has no signature (a kilobyte for each of 16 bands before), and what a start signed goes when it is done."""
    draw, names = random.Random(4), ("spark.sql.streaming.stateStore.compression.codec", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    before = [spark.conf.get(n, None) for n in names]
    text = lambda: " ".join(str(draw.random()) for _ in range(20))
    for docs in fed(spark, tmp_path, [[(1000 * k + i, text()) for i in range(300)] for k in range(2)]):
        streams.dedup_stream(docs, f"{tmp_path}/out", f"{tmp_path}/ck")
        assert not glob.glob(f"{tmp_path}/ck/signed/came=*") + glob.glob(f"{tmp_path}/ck/texts/came=*")
    assert spark.read.schema(streams.KEPT).parquet(f"{tmp_path}/out").count() == 600
    assert size(f"{tmp_path}/ck/dedup/state") < 600 * 4000
    assert [spark.conf.get(n, None) for n in names] == before


def test_stream_goes_on_after_a_start_that_only_signed(spark, tmp_path):
    """rows that a start signed and did not walk are walked by the next one, before its own."""
    rows = [(i, t) for i, t in enumerate(family(20, 7) + family(20, 8, 80))]
    random.Random(3).shuffle(rows)
    parts, want = [rows[:15], rows[15:30], rows[30:]], []
    for k, docs in enumerate(fed(spark, tmp_path, parts)):
        if k == 1:
            streams.sign_stream(docs, f"{tmp_path}/ck", f"{tmp_path}/ck/sign", 32, "sha256").awaitTermination()
        else:
            streams.dedup_stream(docs, f"{tmp_path}/out", f"{tmp_path}/ck", num_perm=32, family="sha256")
        want += sorted(parts[k])
    stays = []
    for r in want:
        if len(greedy([(i, t) for i, (_, t) in enumerate([*stays, r])])) == len(stays) + 1:
            stays.append(r)
    got = spark.read.schema(streams.KEPT).parquet(f"{tmp_path}/out").collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(stays) and len(stays) < len(rows)
    assert {r.batch for r in got} <= {0, 1, 2} and len({(r.batch, r.row) for r in got}) == len(got)


def test_similar_pairs_have_a_band_in_common(spark):
    """pairs that meet by the hash of a bucket count only if a band is equal."""
    base = bytes(range(1, 65))  # eight positions
    most, none, few = (bytearray(base) for _ in range(3))
    most[0] = 99  # agrees in seven positions, three bands of two
    none[0] = none[16] = none[32] = none[48] = 99  # four positions, no band
    few[:40] = bytes(40)  # three positions, one band
    nodes = spark.createDataFrame([(f"n{i}", bytes(s)) for i, s in enumerate((most, none, few))], "node string, sig binary")
    lows = spark.createDataFrame([("o", base)], "node string, sig binary")
    pairs = spark.createDataFrame([("o", f"n{i}") for i in range(3)], "lo string, hi string")
    found = lambda shape: sorted((r.lo, r.hi, r.similarity) for r in minhash.similar(pairs, nodes, 8, 0.5, lows, shape).collect())
    assert found((4, 2)) == [("o", "n0", 7 / 8)]
    assert found(None) == [("o", "n0", 7 / 8), ("o", "n1", 0.5)]


def test_signing_leaves_one_table(spark):
    """the rows with the n-grams that workers missed go once they are hashed."""
    docs = spark.createDataFrame([(i, f"text {i * 7919} of {i}") for i in range(30)], "doc_id long, text string")
    tables = Tables(spark, "left")
    got = minhash.signed_rows(docs.withColumn("kind", docs.doc_id % 3), tables, 16, 5, 42, "sha256", carry=["kind"], most=20)
    assert sorted((r.doc_id, r._carried0) for r in got.collect()) == [(i, i % 3) for i in range(30)]
    root = tables.root.removeprefix("file://")
    assert os.listdir(root) == ["signed"]
