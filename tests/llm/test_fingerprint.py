import base64
import hashlib

import numpy as np
import pytest

from lodestone.llm import fingerprint as fp

from .fixtures import TEXTS, frame, rows


def test_peeling_recovers_the_difference():
    rng = np.random.default_rng(2)
    owner, key, sign, want = [], [], [], {}
    for c, (n, only_a, only_b) in enumerate([(10, 0, 0), (50, 1, 2), (200, 40, 3), (5, 300, 300), (0, 0, 7), (0, 0, 0), (1000, 2, 900)]):
        both, a, b = (rng.integers(1, 2**63, x).astype(np.uint64) >> np.uint64(16) for x in (n, only_a, only_b))
        owner += [c] * (2 * n + only_a + only_b)
        key += [both, both, a, b]
        sign += [1] * n + [-1] * n + [1] * only_a + [-1] * only_b
        want[c] = ({*a.tolist()}, {*b.tolist()})
    o, k, s = fp.differences(np.array(owner), np.concatenate(key), np.array(sign, np.int64), len(want))
    for c, (a, b) in want.items():
        assert set(k[(o == c) & (s == 1)].tolist()) == a and set(k[(o == c) & (s == -1)].tolist()) == b


def brute_sets(text):
    o, k = fp.digests([text], fp.Powers())
    return set(k.tolist())


@pytest.mark.parametrize(("buckets", "block"), [(1, 10), (5, 100_000), (64, 2_000)])
def test_rows(spark, buckets, block):
    data = [r for r in rows() if r[0] != 4] + [(4, TEXTS[4], *[None] * 7)]
    got = {r.doc_id: r for r in fp.fingerprint_documents(frame(spark, data), buckets, block).collect()}
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(data)
    for i, r in enumerate(order):
        text, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        g = got[r[0]]
        assert g.n_chars == len(text) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert g.near_edited == fp.fingerprint_likeness([g.fingerprint], [g.edited_fingerprint])[0]
        if r[0] is not None and order[(i + 1) % len(order)][0] is not None:
            assert g.near_next == fp.fingerprint_likeness([g.fingerprint], [got[order[(i + 1) % len(order)][0]].fingerprint])[0]
        for near, other in ((g.near_edited, edited), (g.near_next, after)):
            a, b = brute_sets(text), brute_sets(other)
            assert near == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        assert (g.fingerprint == g.edited_fingerprint) == (brute_sets(text) == brute_sets(edited))


def test_repeats_and_empty(spark):
    assert fp.fingerprint_documents(frame(spark, [])).count() == 0
    lone = fp.fingerprint_documents(frame(spark, [(1, "a b", *[None] * 7)])).first()
    assert lone.near_next == 1.0
    twice = fp.fingerprint_documents(frame(spark, [(1, "a b", *[None] * 7)] * 2 + [(2, "c", *[None] * 7)]), 3).collect()
    assert len(twice) == 3 and len({r.fingerprint for r in twice if r.doc_id == 1}) == 1


def test_fingerprints_give_back_their_digests():
    rng = np.random.default_rng(8)
    sets = [rng.integers(1, 2**48, n).astype(np.uint64) for n in [0, 1, 2, 3, 5, 20, 300, 40_000, *rng.integers(1, 60, 400)]]
    owner, key = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
    prints = fp.fingerprints(owner, key, len(sets))
    own, found = fp.listed(prints)
    for i, x in enumerate(sets):
        assert set(found[own == i].tolist()) == set(x.tolist())
    assert max(len(p) for p in prints[8:]) < 2000
    with pytest.raises(ValueError, match="damaged"):
        raw = bytearray(base64.b64decode(prints[6]))
        raw[200] ^= 255
        fp.listed([base64.b64encode(raw).decode()])


def test_likeness_of_stored_fingerprints(spark):
    """From the strings alone, against sets of paragraphs, one doc_id on several texts included."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[a:b]) for a, b in ((0, 400), (0, 200), (200, 400), (0, 0), (0, 390))]
    made = fp.fingerprint_documents(frame(spark, [(i // 2, t, *[None] * 7) for i, t in enumerate(texts)]), 2).select("fingerprint", "edited_fingerprint", "near_edited")
    for r in fp.compare_fingerprints(made, "fingerprint", "edited_fingerprint").collect():
        assert r.likeness == r.near_edited
    sets = [brute_sets(t) for t in texts]
    own, key = fp.digests(texts, fp.Powers())
    prints = fp.fingerprints(own, key, len(texts))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert fp.fingerprint_likeness([prints[i]], [prints[j]])[0] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    nulls = spark.createDataFrame([(None, prints[0]), (prints[0], prints[0])], "a string, b string")
    assert sorted(r.likeness or 0 for r in fp.compare_fingerprints(nulls, "a", "b").collect()) == [0, 1.0]
