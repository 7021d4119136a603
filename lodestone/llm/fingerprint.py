"""Document fingerprints: invertible Bloom lookup sketches over paragraph digests.

A text's paragraphs are its lines, long lines being cut further behind words chosen by their content, so that an edit moves
no cut elsewhere. Every paragraph has a 48-bit digest (repeats count on), held in one cell of each third of a table: count,
sum of keys, sum of checks. A stored table has about 1.4 cells a digest and grows until peeling lists all of its digests, so
a fingerprint alone gives back the set it stands for, and the likeness of two texts follows from their fingerprints.

Two versions' tables subtract; peeling cells that hold a single digest recovers the digests in which the versions differ.
Where peeling sticks, both versions are sketched in a larger table with other seeds, until it succeeds; the likeness then
follows exactly from the recovered digests. All comparisons of a batch peel at once.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches


#: The fewest cells in each of the three parts of a table.
BASE = 4
PARTS = 3
#: A cut stands behind about one word in this many.
CUT = 8
#: Bits of a digest, and of a check in a stored fingerprint.
KEY_BITS, CHECK_BITS = 48, 16
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (fixed values: the constants of splitmix64)."""
    x = x + _U((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Powers:
    """Powers of the rolling base and of its inverse modulo 2 ** 64, grown on demand and kept."""

    def __init__(self):
        self.up, self.down = np.ones(1, _U), np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            base = 0x2545F4914F6CDD1D
            grow = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(n + n // 4, b, _U)]))
            self.up, self.down = grow(base), grow(pow(base, -1, 2**64))
        return self.up[:n], self.down[:n]


def digests(texts: list[str], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(text number, digest) of all paragraphs; a text's digests differ from each other (a repeat counts on)."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    buf = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
    sizes = np.array([len(r) + 1 for r in raw])
    ends = np.cumsum(sizes)  # place of the line break behind each text
    white = _WHITE[buf]
    first = np.flatnonzero(white[:-1] & ~white[1:]) + 1
    last = np.flatnonzero(~white[:-1] & white[1:])  # last byte of each word
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, _U)
    up, down = powers.upto(len(buf) + 1)
    total = np.zeros(len(buf) + 1, _U)
    np.cumsum((buf.astype(_U) + _U(1)) * up[: len(buf)], out=total[1:])
    word = mix((total[last + 1] - total[first]) * down[first])
    breaks = np.cumsum(buf == 10)
    line = breaks[first]
    cut = np.ones(len(first), bool)  # a paragraph begins at this word
    cut[1:] = (line[1:] != line[:-1]) | (word[:-1] % _U(CUT) == 0)
    begin = np.flatnonzero(cut)
    stop = np.append(begin[1:], len(first)) - 1
    a, b = first[begin], last[stop] + 1
    key = mix((total[b] - total[a]) * down[a], 1)
    owner = np.searchsorted(ends, a)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    same = np.zeros(len(key), bool)
    same[1:] = (key[1:] == key[:-1]) & (owner[1:] == owner[:-1])
    at = np.arange(len(key))
    repeat = at - np.maximum.accumulate(np.where(same, 0, at))
    return owner.astype(np.int64), mix(key + repeat.astype(_U) * _ODD, 2) >> _U(64 - KEY_BITS)


def cells(key: np.ndarray, size: np.ndarray, seed: int) -> list[np.ndarray]:
    """The key's cell in each part of a table of ``size`` cells a part."""
    return [(mix(key, 16 * seed + 5 + j) % size.astype(_U)).astype(np.int64) + j * size for j in range(PARTS)]


def tables(owner: np.ndarray, key: np.ndarray, sign: np.ndarray, start: np.ndarray, size: np.ndarray, total: int, seed: int) -> list[np.ndarray]:
    """Count, key sum and check sum of all cells; ``start`` and ``size`` by owner."""
    count, keys, checks = np.zeros(total, np.int64), np.zeros(total, _U), np.zeros(total, _U)
    signed = sign.astype(np.int64).view(_U)
    check = mix(key, 3)
    for c in cells(key, size[owner], seed):
        at = start[owner] + c
        np.add.at(count, at, sign)
        np.add.at(keys, at, key * signed)
        np.add.at(checks, at, check * signed)
    return [count, keys, checks]


def peel(table: list[np.ndarray], owner_of: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int, check_bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests recovered, as (owner, digest, sign); what stays in ``table`` could not be. Of keys and checks the low bits count."""
    count, keys, checks = table
    own_bits, low = _U(2**KEY_BITS - 1), _U(2**check_bits - 1)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    look = np.flatnonzero(count)
    while len(look):
        one = look[np.abs(count[look]) == 1]
        sign = count[one]
        key = keys[one] * sign.view(_U) & own_bits
        pure = (checks[one] - mix(key, 3) * sign.view(_U)) & low == 0
        one, sign, key = one[pure], sign[pure], key[pure]
        if not len(one):
            break
        own = owner_of[one]
        order = np.lexsort((key, own))
        own, key, sign = own[order], key[order], sign[order]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (key[1:] != key[:-1])
        own, key, sign = own[new], key[new], sign[new]
        out.append((own, key, sign))
        touched = []
        signed, check = sign.view(_U), mix(key, 3)
        for c in cells(key, size[own], seed):
            at = start[own] + c
            np.subtract.at(count, at, sign)
            np.subtract.at(keys, at, key * signed)
            np.subtract.at(checks, at, check * signed)
            touched.append(at)
        look = np.unique(np.concatenate(touched))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def differences(owner: np.ndarray, key: np.ndarray, sign: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(comparison, digest, sign) of all digests in which the two versions of each of ``n`` comparisons differ.

    Starts at the stored size and retries four times larger, with another seed, where peeling does not empty the table.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    gap = np.abs(np.bincount(owner, weights=sign, minlength=n)).astype(np.int64)
    parts = np.full(n, BASE, np.int64)
    while (small := parts * PARTS < gap).any():  # a table with fewer cells than the sizes differ by cannot be peeled
        parts[small] *= 4
    open_, seed = np.arange(n), 0
    while len(open_):
        no = np.full(n, -1, np.int64)
        no[open_] = np.arange(len(open_))
        mine = no[owner] >= 0
        own, size = no[owner[mine]], parts[open_]
        start = np.concatenate([[0], np.cumsum(size * PARTS)])
        table = tables(own, key[mine], sign[mine], start, size, int(start[-1]), seed)
        owner_of = np.repeat(np.arange(len(open_)), size * PARTS)
        a, k, s = peel(table, owner_of, start, size, seed)
        left = np.bincount(owner_of, weights=(table[0] != 0) | (table[1] != 0) | (table[2] != 0), minlength=len(open_)) > 0
        good = ~left[a]
        found.append((open_[a[good]], k[good], s[good]))
        parts[open_] *= 4
        open_, seed = open_[left], seed + 1
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (owner[:0], key[:0], sign[:0])


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """For each of ``n`` pairs of versions, common digests over all digests; two empty versions are alike."""
    owner, key = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    sign = np.concatenate([np.ones(len(a[0]), np.int64), -np.ones(len(b[0]), np.int64)])
    apart = np.bincount(differences(owner, key, sign, n)[0], minlength=n)
    both = np.bincount(owner, minlength=n)
    common = (both - apart) / 2
    return np.where(both > 0, common / np.maximum(both - common, 1), 1.0)


_CELL = np.dtype([("c", "u1"), ("low", "<u4"), ("high", "<u2"), ("h", "<u2")])


def fingerprints(owner: np.ndarray, key: np.ndarray, n: int) -> list[str]:
    """The stored sketches of ``n`` sets: base64 of the number of digests and of cells a part, then count, key sum and check sum of each cell.

    A table that does not give back all its digests grows by half until it does.
    """
    many = np.bincount(owner, minlength=n)
    size = BASE + np.ceil(many * 1.35 / PARTS).astype(np.int64)
    out: list[str] = [""] * n
    open_ = np.arange(n)
    while len(open_):
        no = np.full(n, -1, np.int64)
        no[open_] = np.arange(len(open_))
        mine = no[owner] >= 0
        own, parts = no[owner[mine]], size[open_]
        start = np.concatenate([[0], np.cumsum(parts * PARTS)])
        table = tables(own, key[mine], np.ones(len(own), np.int64), start, parts, int(start[-1]), 0)
        owner_of = np.repeat(np.arange(len(open_)), parts * PARTS)
        body = np.zeros(int(start[-1]), _CELL)
        body["c"], body["low"], body["high"], body["h"] = table[0] & 255, table[1] & _U(2**32 - 1), table[1] >> _U(32) & _U(65535), table[2] & _U(65535)
        crowded = np.bincount(owner_of, weights=table[0] > 255, minlength=len(open_)) > 0
        peel(table, owner_of, start, parts, 0)
        left = crowded | (np.bincount(owner_of, weights=table[0] != 0, minlength=len(open_)) > 0)
        for k in np.flatnonzero(~left):
            i = open_[k]
            out[i] = base64.b64encode(np.array([many[i], parts[k]], "<u4").tobytes() + body[start[k] : start[k + 1]].tobytes()).decode()
        size[open_[left]] += size[open_[left]] // 2 + 1
        open_ = open_[left]
    return out


def listed(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number, digest) of all digests that stored sketches hold, by peeling each alone."""
    raw = [base64.b64decode(x) for x in prints]
    heads = np.array([np.frombuffer(r, "<u4", 2) for r in raw], np.int64).reshape(-1, 2)
    size = heads[:, 1]
    start = np.concatenate([[0], np.cumsum(size * PARTS)])
    body = np.frombuffer(b"".join(r[8:] for r in raw), _CELL)
    table = [body["c"].astype(np.int64), body["low"].astype(_U) | body["high"].astype(_U) << _U(32), body["h"].astype(_U)]
    own, key, _ = peel(table, np.repeat(np.arange(len(raw)), size * PARTS), start, size, 0, CHECK_BITS)
    rest = (table[1] & _U(2**KEY_BITS - 1)).any() or (table[2] & _U(2**CHECK_BITS - 1)).any()
    if table[0].any() or rest or not np.array_equal(np.bincount(own, minlength=len(raw)), heads[:, 0]):
        raise ValueError("a fingerprint is damaged: its cells do not give back its digests")
    return own, key


def fingerprint_likeness(a: list[str], b: list[str]) -> np.ndarray:
    """Likeness (0 to 1) of pairs of stored fingerprints, from them alone."""
    return likeness(listed(a), listed(b), len(a)) if len(a) else np.zeros(0)


def compare_fingerprints(pairs: DataFrame, a: str, b: str, name: str = "likeness") -> DataFrame:
    """``pairs`` with the likeness of two fingerprint columns; null where either is."""
    bounded_batches(pairs)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)

    def run(parts: Iterator[pa.RecordBatch]):
        for part in parts:
            x, y = (part.column(part.schema.get_field_index(c)).to_pylist() for c in (a, b))
            at = [i for i in range(len(x)) if x[i] is not None and y[i] is not None]
            out: list[float | None] = [None] * len(x)
            for i, v in zip(at, fingerprint_likeness([x[i] for i in at], [y[i] for i in at]).tolist()):
                out[i] = v
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.float64())], names=[*part.schema.names, name])

    return pairs.mapInArrow(run, f"{kinds}, `{name}` double")


def edit(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(texts: list[str], powers: Powers) -> dict[str, list]:
    """What is returned for all texts but the last, which only follows.

    A stored fingerprint gives back its digests exactly, so the likenesses are those of the fingerprints themselves.
    """
    n = len(texts) - 1
    edited = [edit(t, f) for t, f in zip(texts, texts[1:])]
    own, other = digests(texts, powers), digests(edited, powers)
    first = own[0] < n
    mine = (own[0][first], own[1][first])
    after = (own[0][own[0] > 0] - 1, own[1][own[0] > 0])
    return {
        "n_chars": [len(t) for t in texts[:n]],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in edited],
        "fingerprint": fingerprints(*mine, n),
        "edited_fingerprint": fingerprints(*other, n),
        "near_edited": likeness(mine, other, n),
        "near_next": likeness(mine, after, n),
    }


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows (bucket, follows, key, doc_id, text), dealt and sorted so that each row's next document stands behind it.

    Documents are cut into ranges of doc_id (null first); the first rows of a range are repeated behind the range before it,
    those of the first range behind the last. Only range bounds, a few per task, go to the driver; the text moves once.
    """
    bounded_batches(docs)
    spark = docs.sparkSession
    lowest = -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(lowest)))
    n = buckets or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], max(10_000, 4 * n)).alias("c")).first()["c"] or []
    bounds = np.array(sorted(set(cuts)), np.int64)

    @F.pandas_udf("int")
    def bucket(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(), "right").astype(np.int32))

    rows = rows.withColumn("bucket", bucket("key"))
    firsts = [tuple(r) for r in rows.groupBy("bucket").agg(F.min("key").alias("key")).orderBy("bucket").collect()]
    before = [(key, firsts[i - 1][0]) for i, (_, key) in enumerate(firsts)]
    also = F.broadcast(spark.createDataFrame(before, "key long, also int"))
    dealt = rows.join(also, "key", "left").withColumn("to", F.explode(F.when(F.col("also").isNull(), F.array(F.struct("bucket", F.lit(False).alias("follows")))).otherwise(F.array(F.struct("bucket", F.lit(False).alias("follows")), F.struct(F.col("also").alias("bucket"), F.lit(True).alias("follows"))))))
    dealt = dealt.select("to.bucket", "to.follows", "key", "doc_id", "text")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "follows", "key", "text")


def fingerprint_documents(docs: DataFrame, buckets: int | None = None, block_chars: int = 1_500_000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The next document is the one that follows by ascending doc_id (null first, ties by text), after the last the first; a
    lone document follows itself. Rows of one doc_id are documents of their own, whatever their texts. Null counts as empty. A text without a word has an empty sketch; two of these are alike (1),
    one and another text are not (0). Other columns are not read; an empty table gives an empty result.
    """
    fields = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    schema = pa.schema(fields)

    def run(parts: Iterator[pa.RecordBatch]):
        powers = Powers()
        ids: list = []
        texts: list[str] = []
        size, bucket, done = 0, None, False

        def flush(last_text: str):
            found = _compare([*texts, last_text], powers)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(found[name], kind) for name, kind in fields[1:])], schema=schema)

        for part in parts:
            for b, follows, doc_id, text in zip(*(part.column(i).to_pylist() for i in range(4))):
                if b != bucket:
                    bucket, done = b, False
                if done:
                    continue  # further rows of the next range's first doc_id
                if follows or (size > block_chars and texts):
                    yield flush(text)
                    ids, texts, size, done = [], [], 0, follows
                if not follows:
                    ids.append(doc_id)
                    texts.append(text)
                    size += len(text)

    dealt = with_next(docs, buckets)
    return dealt.select("bucket", "follows", "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
