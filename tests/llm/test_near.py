import random
from math import comb

import numpy as np
import pytest

from lodestone.llm import near
from lodestone.llm.fingerprint import Powers
from lodestone.llm.shingles import shingle_sets

from .fixtures import frame, rows
from .test_shingles import brute, family


def got(spark, data, k, percent):
    found = near.near_duplicates(frame(spark, data), k, percent).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str)


@pytest.mark.parametrize(("k", "percent"), [(4, 80), (5, 80), (3, 90)])
def test_edges(spark, k, percent):
    data = rows()
    assert got(spark, data, k, percent) == brute(data, k, percent)


@pytest.mark.parametrize(("least", "block"), [(32, 2000), (3, 9)])
def test_hot_families_equal_brute_force(spark, monkeypatch, least, block):
    monkeypatch.setattr(near, "PAIRED", least)
    groups = near.candidate_groups
    monkeypatch.setattr(near, "candidate_groups", lambda *a: groups(*a, block=block))
    texts = family(60, 120, 8, 1) + family(40, 30, 4, 2) + family(30, 12, 2, 3) + ["A common sentence stands here in front. " + t for t in family(30, 60, 40, 4)]
    data = [(i, t, None, None, None, None, None, None, None) for i, t in enumerate(texts)]
    random.shuffle(data)
    assert got(spark, data, 4, 80) == brute(data, 4, 80)


def test_repeats_null_ids_and_empty_table(spark):
    texts = family(10, 50, 3, 9)
    data = [(i % 4, t, None, None, None, None, None, None, None) for i, t in enumerate(texts)] + [(None, texts[0], None, None, None, None, None, None, None)] * 2
    data += data[:3]
    assert got(spark, data, 4, 80) == brute(data, 4, 80)
    assert got(spark, [], 4, 80) == []


def test_bands_miss_as_rarely_as_stated():
    rows_ = near.band_rows(80)
    assert (1 - 0.8**rows_) ** (near.PERMS // rows_) <= near.MISS_BANDS < (1 - 0.8 ** (rows_ + 1)) ** (near.PERMS // (rows_ + 1))


@pytest.mark.parametrize("n", [16, 64, 160])
def test_bounds_equal_the_integrated_posterior(n):
    """The posterior's tail by numerical integration of the density over the similarity."""
    least, x = near.least_matches(80, n, 1e-6), np.linspace(0, 1, 200_001)

    def tail(m):
        density = x**m * (1 - x) ** (n - m) * comb(n, m) * (n + 1)
        return np.trapezoid(density[x >= 0.8 - 1e-12], x[x >= 0.8 - 1e-12])

    assert tail(least) >= 1e-6 * 0.999 and (least == 0 or tail(least - 1) < 1e-6 * 1.001)


def test_signatures_estimate_the_similarity():
    """Matches of 400 pairs of known similarity: the mean is right and no more spread than independent positions have."""
    rng = np.random.default_rng(4)
    for share in (0.5, 0.8):
        hits = []
        for _ in range(400):
            common, own = rng.integers(0, 2**63, 80, np.uint64), rng.integers(0, 2**63, (2, int(80 * (1 / share - 1) / 2)), np.uint64)
            a, b = near.minima([np.concatenate([common, own[0]]), np.concatenate([common, own[1]])])
            hits.append((a == b).mean())
        true = 80 / (80 + 2 * int(80 * (1 / share - 1) / 2))
        assert abs(np.mean(hits) - true) < 0.01 and np.var(hits) < 1.5 * true * (1 - true) / near.PERMS


def test_pruned_pairs_are_rarely_links(spark):
    """Of 400 pairs just above the threshold none is lost by bands or by the posterior."""
    rng = random.Random(11)
    texts = []
    for i in range(400):
        words = [f"v{rng.randrange(10**7)}" for _ in range(100)]
        other = list(words)
        for at in (20, 60):  # each takes four shingles from either side: 89 of 105 stay
            other[at] = f"z{i}{at}"
        texts += [" ".join(words), " ".join(other)]
    sets = shingle_sets(texts, 4, Powers())
    assert all(80 * len(np.union1d(a, b)) <= 100 * len(np.intersect1d(a, b)) for a, b in zip(sets[::2], sets[1::2]))
    data = [(i, t, None, None, None, None, None, None, None) for i, t in enumerate(texts)]
    assert got(spark, data, 4, 80) == sorted(((i, len(sets[i]), i - i % 2) for i in range(800)), key=str)
