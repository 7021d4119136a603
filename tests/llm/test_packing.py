import functools
import itertools
import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm.packing import BytePairs, byte_ranks, dominating, pack_documents, plan_sequences, read_tokenizer

from .fixtures import TEXTS, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def both_encoders():
    return Tokenizer.from_file(PATH), BytePairs(read_tokenizer(PATH))


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*" \n\t  a'tsé漢1.", "<|endoftext|>", "<|end"]), max_size=30).map("".join))
def test_ids_equal_library(text):
    lib, own = both_encoders()
    got = np.frombuffer(next(own.encode([text])), "<u4").tolist()
    assert got == lib.encode(text, add_special_tokens=False).ids


def test_other_files_go_through_the_library():
    spec = json.loads(read_tokenizer(PATH))
    assert byte_ranks(read_tokenizer(PATH)) is not None
    spec["pre_tokenizer"]["add_prefix_space"] = True
    changed = json.dumps(spec)
    assert byte_ranks(changed) is None
    lib = Tokenizer.from_str(changed)
    assert np.frombuffer(next(BytePairs(changed).encode(["odd case"])), "<u4").tolist() == lib.encode("odd case", add_special_tokens=False).ids


def test_special_strings_are_tokens():
    read = lambda spec, text: np.frombuffer(next(BytePairs(spec).encode([text])), "<u4").tolist()
    plain = read_tokenizer(PATH)
    assert read(plain, "a <|endoftext|> b") == [64, 220, 50256, 275]
    spec = json.loads(plain)
    spec["added_tokens"][0]["lstrip"] = True  # takes the blank in front: left to the library
    assert byte_ranks(json.dumps(spec)) is None
    assert read(json.dumps(spec), "a <|endoftext|> b") == Tokenizer.from_str(json.dumps(spec)).encode("a <|endoftext|> b", add_special_tokens=False).ids


def fewest(items, cap):
    """The smallest number of bins, by exhaustive search."""
    best = [len(items)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= cap and bins[k] not in bins[:k]:
                put(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
        put(i + 1, [*bins, items[i]])

    put(0, [])
    return best[0]


def check(runs, count, cap):
    used = Counter()
    for times, held in runs:
        assert times > 0 and sum(a * b for a, b in held) <= cap
        for a, b in held:
            used[a] += b * times
    assert used == Counter({k: v for k, v in count.items() if v})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_reduction_never_costs_a_bin(items):
    count = Counter(items)
    check(plan_sequences(count, 20), count, 20)
    w = max(items)
    found = dominating(w, count, sorted(count), 20)
    if found:
        rest = list((count - Counter(found)).elements())
        assert sum(found) <= 20 and 1 + fewest(sorted(rest, reverse=True), 20) == fewest(sorted(items, reverse=True), 20)


def test_plan_is_near_the_bound():
    random.seed(5)
    count = Counter(min(2048, int(random.lognormvariate(5.5, 1.2)) + 1) for _ in range(30_000))
    runs = plan_sequences(count, 2048)
    check(runs, count, 2048)
    bound = -(-sum(a * b for a, b in count.items()) // 2048)
    assert sum(t for t, _ in runs) <= bound + 1


@pytest.mark.parametrize("capacity", [8, 2048])
def test_pieces_and_places(spark, lib, capacity):
    got = pack_documents(frame(spark), read_tokenizer(PATH), capacity, with_ids=True).collect()
    docs = defaultdict(list)
    for r in got:
        assert zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        docs[r.doc_id].append(r)
    for i, t in itertools.chain(enumerate(TEXTS), [(None, "no id")]):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted(docs[i], key=lambda r: r.piece)
        if i == 4:
            own = own[::2]
        assert [x for r in own for x in r.ids] == ids and all(r.length == capacity for r in own[1:])
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity


def test_empty_table(spark):
    assert pack_documents(frame(spark, []), read_tokenizer(PATH)).count() == 0
