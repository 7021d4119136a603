"""One Mersenne Twister sequence, drawn in parts: every task starts at its own place of the sequence that Python's generator gives.

The state steps by a linear map over the field of two elements. With its minimal polynomial p, found from the sequence's own bits,
the state n steps on is (x ** n mod p) applied to the state: a sum of shifted windows of the next 19,937 words. So a jump costs
the same however far it goes, and only one state a part (2,500 bytes) leaves the driver.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the generator: words of state, the other word of the recurrence, its matrix, and the bits that count.
WORDS, NEAR, MATRIX, DEGREE = 624, 397, 0x9908B0DF, 19_937


def words(state: np.ndarray, count: int) -> np.ndarray:
    """The state's words and those that follow, ``count`` in all (not tempered)."""
    x = np.zeros(count + WORDS, np.uint32)
    x[:WORDS] = state
    at = WORDS
    while at < count:
        n = min(WORDS - NEAR, len(x) - at)  # so many words depend on earlier ones alone
        old = x[at - WORDS : at - WORDS + n + 1]
        y = (old[:-1] & np.uint32(0x80000000)) | (old[1:] & np.uint32(0x7FFFFFFF))
        x[at : at + n] = x[at - WORDS + NEAR : at - WORDS + NEAR + n] ^ (y >> np.uint32(1)) ^ np.where(y & np.uint32(1), np.uint32(MATRIX), np.uint32(0))
        at += n
    return x[:count]


@cache
def minimal() -> int:
    """The minimal polynomial of a step as bits, by Berlekamp and Massey's algorithm on the lowest bits of the sequence."""
    bits = (words(np.array(random.Random(1).getstate()[1][:WORDS], np.uint32), 2 * DEGREE + WORDS)[WORDS:] & np.uint32(1)).tolist()
    c = b = 1
    length, gap, seen = 0, 1, 0
    for n, bit in enumerate(bits):
        seen = seen << 1 | bit  # bit i is the value i places back
        if (c & seen).bit_count() & 1:
            c, last = c ^ (b << gap), c
            if 2 * length <= n:
                length, b, gap = n + 1 - length, last, 0
        gap += 1
    return int(format(c, "b").zfill(length + 1)[::-1], 2)


def reduced(a: int) -> int:
    p = minimal()
    while (over := a.bit_length() - 1 - DEGREE) >= 0:
        a ^= p << over
    return a


def power(n: int) -> int:
    """x ** n modulo the minimal polynomial."""
    out = 1
    for bit in format(n, "b"):
        out = reduced(int("0".join(format(out, "b")), 2))  # a square spreads the bits
        out = reduced(out << 1) if bit == "1" else out
    return out


def jumped(state: np.ndarray, polynomial: int) -> np.ndarray:
    """The state as many steps on as the polynomial is a power of x."""
    held = np.array([i for i, bit in enumerate(format(polynomial, "b")[::-1]) if bit == "1"])
    windows = np.lib.stride_tricks.sliding_window_view(words(state, DEGREE + WORDS), WORDS)
    out = np.zeros(WORDS, np.uint32)
    for a in range(0, len(held), 2048):
        out ^= np.bitwise_xor.reduce(windows[held[a : a + 2048]], axis=0)
    return out


def draws(spark: SparkSession, count: int, seed: int = 42, part: int = 1_000_000) -> DataFrame:
    """draw (from 0), u: what ``random.Random(seed).random()`` gives in turn, each part of the sequence in a task of its own.

    A draw takes two words. Parts grow with ``count`` so that no more than 512 states are made.
    """
    part = max(part, -(-count // 512))
    state = np.array(random.Random(seed).getstate()[1][:WORDS], np.uint32)  # its words are used up: the next draw steps on
    rows, ahead = [], power(2 * part) if count > part else 0
    for first in range(0, count, part):
        rows.append((first, min(part, count - first), state.astype("<u4").tobytes()))
        state = jumped(state, ahead) if first + part < count else state

    def run(batches: Iterator[pa.RecordBatch]):
        own = np.random.RandomState()
        for batch in batches:
            for first, n, key in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own.set_state(("MT19937", np.frombuffer(key, "<u4"), WORDS))
                for a in range(0, n, 100_000):
                    many = min(100_000, n - a)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first + a, first + a + many)), pa.array(own.random_sample(many))], names=["draw", "u"])

    if not rows:
        return spark.createDataFrame([], "draw long, u double")
    return spark.createDataFrame(rows, "first long, n long, state binary").repartition(len(rows), "first").mapInArrow(run, "draw long, u double")
