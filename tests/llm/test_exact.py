import hashlib
import re
from collections import defaultdict

import pytest

from lodestone.llm.exact import exact_dedup, kept_rows

from .fixtures import SCHEMA, frame, rows


def brute(data):
    groups = defaultdict(list)
    for r in data:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append((-len(r[1] or ""), r[0] is None, r[0] or 0))
    out = []
    for norm, found in groups.items():
        best = min(found)
        done = False
        for f in sorted(found):
            out.append((None if f[1] else f[2], None if best[1] else best[2], len(found), f == best and not done, hashlib.sha256(norm.encode()).hexdigest()))
            done |= f == best
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [3, 64, 4096])
def test_matches_brute_force(spark, size):
    data = [r for r in rows() if size > 3 or len(r[1] or "") < 400]
    got = exact_dedup(frame(spark, data), block_bytes=size).drop("n_chars")
    assert sorted(map(tuple, got.collect()), key=str) == brute(data)


def test_hot_group_spans_tasks(spark):
    data = [(i, "copy of one text " * 3 if i % 3 else f"own {i}", None, None, None, None, None, None, None) for i in range(3000)]
    got = exact_dedup(frame(spark, data).repartition(7), block_bytes=16).drop("n_chars")
    assert sorted(map(tuple, got.collect()), key=str) == brute(data)


def test_empty_table_and_kept_rows(spark):
    assert exact_dedup(frame(spark, [])).count() == 0
    kept = kept_rows(frame(spark))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert kept.count() == len({re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in rows()})
