import random

import numpy as np
import pytest

from lodestone.operators import mixing, twister
from lodestone.plans import text as plans


def test_jumps_equal_steps():
    state = np.array(random.Random(7).getstate()[1][: twister.WORDS], np.uint32)
    far = twister.words(state, 70_000 + twister.WORDS)
    assert twister.minimal().bit_length() - 1 == twister.DEGREE
    for n in (0, 1, 2, 623, 624, 19_937, 70_000):
        got, want = twister.jumped(state, twister.power(n)), far[n : n + twister.WORDS]
        assert (got[1:] == want[1:]).all() and got[0] >> 31 == want[0] >> 31  # the lower bits of the first word do not count
    two = twister.jumped(twister.jumped(state, twister.power(10**12)), twister.power(5))
    assert (two[1:] == twister.jumped(state, twister.power(10**12 + 5))[1:]).all()


@pytest.mark.parametrize(("count", "part"), [(0, 10), (1, 10), (25_000, 3_001), (2_000, 2_000)])
def test_draws_equal_the_generator(spark, count, part):
    own = random.Random(11)
    got = [r.u for r in twister.draws(spark, count, 11, part).orderBy("draw").collect()]
    assert got == [own.random() for _ in range(count)]


def walk(docs, share, seed):
    """The mix as a loop over one generator."""
    own, held = random.Random(seed), {"code": [d for d, o in docs if o == "code"], "finance": [d for d, o in docs if o != "code"]}
    at, out = {"code": 0, "finance": 0}, []
    while True:
        name = "code" if own.random() < share else "finance"
        if at[name] == len(held[name]):
            return out
        out.append((len(out), held[name][at[name]], name))
        at[name] += 1


def test_mix_equals_the_loop(spark, sf):
    docs = sorted((r.doc_id, "code" if r.lang == "en" else "finance") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect())
    got = sorted((r.draw, r.doc_id, r.origin) for r in plans.ratio_mix_twister(spark, sf).collect())
    assert got == walk(docs, 0.5 / 0.9, 42) and len(got) > 50
    rows = spark.createDataFrame([(i, "code" if i % 5 else "finance") for i in range(400)], "doc_id long, origin string")
    got = sorted((r.draw, r.doc_id, r.origin) for r in mixing.ratio_mix(rows, "origin", "doc_id", {"code": 0.5, "finance": 0.4}, seed=5, twister=True).collect())
    assert got == walk([(i, "code" if i % 5 else "finance") for i in range(400)], 0.5 / 0.9, 5)
