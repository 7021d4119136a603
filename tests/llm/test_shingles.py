import random
import re

import numpy as np
import pytest

from lodestone.llm import common
from lodestone.llm import shingles as sh
from lodestone.llm.fingerprint import Powers

from .fixtures import frame, rows


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_set(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(data, k, percent):
    sets = [brute_set(r[1], k) for r in data]
    up = list(range(len(data)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(data)):
        for b in range(a):
            if data[a][0] is not None and data[b][0] is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    least = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(root(i))) for i, r in enumerate(data)), key=str)


def got(spark, data, k, percent):
    return sorted(map(tuple, sh.jaccard_components(frame(spark, data), k, percent).collect()), key=str)


def family(n, size, changes, seed):
    random.seed(seed)
    base = [f"w{random.randrange(400)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(random.randrange(changes)):
            w[random.randrange(size)] = f"x{random.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_edges(spark, k, percent):
    data = [r for r in rows() if len(r[1] or "") < 50_000 or k == 3]
    assert got(spark, data, k, percent) == brute(data, k, percent)


@pytest.mark.parametrize(("least", "block"), [(32, 500), (2, 7)])
def test_hot_families_equal_brute_force(spark, monkeypatch, least, block):
    monkeypatch.setattr(sh, "LEAST_FREQUENT", least)
    monkeypatch.setattr(sh, "PAIRED", least)
    links, groups = sh.verified_links, sh.candidate_groups
    monkeypatch.setattr(sh, "verified_links", lambda *a: links(*a, block=block))
    monkeypatch.setattr(sh, "candidate_groups", lambda *a: groups(*a, block=block))
    texts = family(60, 120, 6, 1) + family(40, 30, 3, 2) + family(30, 12, 2, 3) + ["A common sentence stands here in front. " + t for t in family(30, 60, 40, 4)]
    data = [(i, t, None, None, None, None, None, None, None) for i, t in enumerate(texts)]
    random.shuffle(data)
    assert got(spark, data, 3, 90) == brute(data, 3, 90)


def test_rows_of_one_id_are_judged_apart(spark):
    """A near copy under an id whose other text is unrelated links alone; brute force with ids on several texts."""
    base = family(24, 40, 3, 7) + family(6, 30, 2, 8) + ["quite another text " * 9, "quite another text " * 9, "short one"]
    random.seed(3)
    data = [(random.randrange(12), t, None, None, None, None, None, None, None) for t in base] + [(5, base[0], *[None] * 7), (3, base[0] + " tail", *[None] * 7), (5, "nothing like it at all", *[None] * 7), (None, base[0], *[None] * 7)]
    assert got(spark, data, 3, 90) == brute(data, 3, 90)


def test_what_stays_of_near_copies(spark):
    text, near = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(60)) + " more"
    data = [(3, text, "en", "s", 7, None, "x", 1, 2), (5, near, "en", "s", 8, None, "x", 1, 2), (5, "nothing like it", "en", "s", 9, None, "x", 1, 2), (4, near, None, None, None, None, None, None, None), (4, near, None, None, None, None, None, None, None), (6, None, *[None] * 7), (7, "", *[None] * 7), (7, "", *[None] * 7), (None, text, *[None] * 7)]
    docs = frame(spark, data).withColumnRenamed("name", "row").withColumnRenamed("token", "set_key")
    left = sh.without_near_copies(docs, 5, 80)
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect()), key=str) == sorted([data[0], data[2], *data[5:]], key=str)
    assert sh.without_near_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [6, 10, 24])
def test_sieve_lets_all_wanted_pass(spark, bits):
    from lodestone.llm.common import sieve

    wanted = {int(x) for x in np.random.default_rng(1).integers(-(2**62), 2**62, 300)}
    rows = spark.createDataFrame([(x, "t") for x in [*wanted, *range(3000)]], "node long, text string")
    got = {r.node for r in sieve(rows, "node", spark.createDataFrame([(x,) for x in wanted], "node long"), bits).collect()}
    assert wanted <= got and (bits < 24 or len(got) < 310)
    assert sieve(rows, "node", rows.select("node").limit(0)).count() == 0


def test_empty_table(spark):
    assert sh.jaccard_components(frame(spark, [])).count() == 0


def test_signatures_meet_whatever_is_frequent():
    """Partners within the threshold share as many signatures as promised, for any set of frequent tokens."""
    rng = np.random.default_rng(5)
    for _ in range(3000):
        percent = int(rng.choice([50, 80, 90]))
        n = int(rng.integers(2, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        lost = rng.random(len(a)) < rng.uniform(0, (100 - percent) / 100)
        b = np.unique(np.concatenate([a[~lost], rng.integers(0, 2**63, int(rng.integers(0, 1 + len(a) * (100 - percent) // 100))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < percent * (len(a) + len(b) - both) or np.array_equal(a, b):
            continue
        frequent = np.sort(rng.choice(np.union1d(a, b), int(rng.integers(0, len(a) + 1)), replace=False)) if rng.random() < 0.8 else np.union1d(a, b)
        (x, s), (y, t) = sh.signatures(a, frequent, percent), sh.signatures(b, frequent, percent)
        assert len(np.intersect1d(x, y)) >= min(s, t) >= 1


def test_sets_equal_words():
    texts = ["One two THREE four", "é É ß", "a b", "a", "", "x\ty\nz w", "a b c a b c a b c"]
    for k in (1, 3, 5):
        assert [len(s) for s in sh.shingle_sets(texts, k, Powers())] == [len(brute_set(t, k)) for t in texts]


@pytest.mark.parametrize("few", [0, 25, 10**6])
def test_components_equal_union_find(spark, monkeypatch, few):
    from lodestone.llm.common import Scratch

    monkeypatch.setattr(sh, "FEW_LINKS", few)
    random.seed(9)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(random.randrange(100, 300), random.randrange(100, 300)) for _ in range(120)] + [(1000, x) for x in range(400, 460)]
    up = {x: x for p in pairs for x in p}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in sh.components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {x: root(x) for x in {x for a, b in pairs if a != b for x in (a, b)}}


@pytest.mark.parametrize("loose", [0.05, 0.3, 0.9])
def test_forest_loses_no_link(spark, loose):
    """Groups of a family, of few and of many outsiders: what links connect is what all pairs connect."""
    rng = random.Random(int(loose * 100))
    value = {i: (rng.randrange(10**6) * 10 if rng.random() < loose else i % 3) for i in range(120)}
    rows = [(i % 2, i) for i in value] + [(7, 3), (7, 5)]
    members = common.Scratch(spark, "f").write(spark.createDataFrame(rows, "k int, node long"), "m")
    payload = spark.createDataFrame(list(value.items()), "node long, v long")

    def solve(ids, sides, values):
        return [(a, b) for x, a in enumerate(ids) for y, b in enumerate(ids[:x]) if (sides[x] == sides[y] == 0 or sides[x] != sides[y]) and abs(values[x] - values[y]) <= 1]

    found = sh.forest(members, ["k"], payload, ["v"], solve, common.Scratch(spark, "f"), "t", 9)
    got = {r.node: r.component for r in sh.components(found, common.Scratch(spark, "f")).collect()}
    up = {i: i for i in value}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for k in (0, 1, 7):
        own = [n for g, n in rows if g == k]
        for a in own:
            for b in own:
                if a != b and abs(value[a] - value[b]) <= 1:
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    assert {i: got.get(i, i) for i in value} == {i: root(i) for i in value}
