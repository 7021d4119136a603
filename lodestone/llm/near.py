"""MinHash near-dedup with sequential Bayesian verification.

A document's set is its distinct word shingles; a signature holds the minima of ``perms`` hash functions over it. Nodes (rows
with equal sets are one) whose signatures agree in a whole band are candidates. The bands are so many that a pair at the
threshold is missed with a chance of at most ``MISS_BANDS``.

Candidates are not compared by whole sets at once. Their signatures are compared batch by batch: after ``n`` positions with
``m`` matches the similarity has, from a uniform prior, the posterior Beta(m + 1, n - m + 1), and the pair goes as soon as the
chance of a similarity at the threshold falls under ``miss``. Most pairs go by their first positions, so only those travel for
all candidates; the other positions follow for what is left. Survivors form groups, and within a group every pair's whole
sets are compared, unless links already connect it: what links is exact.

A large bucket forms no pairs: its nodes are a cluster round the smallest one, divided by size and cut into blocks, each of
which meets the cluster's representatives first; only nodes that this leaves outside go on to the other blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batches, bounded_batches, join_groups, resident
from .fingerprint import Powers, mix
from .shingles import PAIRED, Links, banded_stars, components, forest, named_groups, shingle_sets, verified_groups

_U = np.uint64
#: Positions of a signature (four bytes each), and how many are compared at a time.
PERMS, STEP = 160, 16
#: Positions that travel with every candidate pair.
HEAD = 32
#: The largest chance that the bands miss a pair at the threshold.
MISS_BANDS = 1e-5
#: Signatures that one task compares with each other.
BLOCK = 2000


def band_rows(percent: int, perms: int = PERMS, most: float = MISS_BANDS) -> int:
    """The most rows a band may have for the bands to miss a pair at the threshold with a chance of at most ``most``."""
    t = percent / 100
    return max([r for r in range(1, perms + 1) if (1 - t**r) ** (perms // r) <= most], default=1)


def least_matches(percent: int, n: int, miss: float) -> int:
    """The fewest matches in ``n`` positions with which the posterior chance of the threshold is ``miss`` or more.

    The tail of Beta(m + 1, n - m + 1) above t is the chance of at most m successes in n + 1 draws of chance t.
    """
    t, total = percent / 100, 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def bounds(percent: int, perms: int, miss: float) -> list[tuple[int, int, int]]:
    """Of each batch of positions: where it begins and ends, and the matches needed by its end."""
    return [(a, min(a + STEP, perms), least_matches(percent, min(a + STEP, perms), miss)) for a in range(0, perms, STEP)]


def minima(sets: list[np.ndarray], perms: int = PERMS) -> np.ndarray:
    """A row of ``perms`` 32-bit minima for each of the sets, none of which is empty."""
    tokens, sizes = np.concatenate(sets), [len(s) for s in sets]
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    turn, odd = mix(np.arange(perms, dtype=_U), 41), mix(np.arange(perms, dtype=_U), 43) | _U(1)
    out = np.empty((len(sets), perms), np.uint32)
    for p in range(perms):
        out[:, p] = np.minimum.reduceat((tokens ^ turn[p]) * odd[p], start) >> _U(32)
    return out


def band_keys(sigs: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each whole band of each signature."""
    count = sigs.shape[1] // rows
    parts = sigs[:, : count * rows].reshape(len(sigs), count, rows).astype(_U)
    key = np.broadcast_to(mix(np.arange(count, dtype=_U), 47), parts.shape[:2])
    for r in range(rows):
        key = mix(key + parts[:, :, r], 53)
    return key


def sketch(docs: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """row (an id of its own), doc_id, tie (hash of the text), text, n_shingles, set_key, head, rest, keys of every row, written.

    ``set_key`` has 128 bits of the whole set; it and what follows are null if the set is empty. ``head`` and ``rest`` are the
    two parts of the signature.
    """
    bounded_batches(docs)
    names, per_band = ["row", "doc_id", "tie", "text", "n_shingles", "set_key", "head", "rest", "keys"], band_rows(percent)

    def run(parts: Iterator[pa.RecordBatch]):
        powers, row = resident("powers", 0, Powers), TaskContext.get().partitionId() << 33
        for part in parts:
            texts = [t or "" for t in part.column(2).to_pylist()]
            for a, b in batches(texts, 1_000_000):
                sets = shingle_sets(texts[a:b], words, powers)
                held = [i for i, s in enumerate(sets) if len(s)]
                key, head, rest, keys = ([None] * len(sets) for _ in range(4))
                if held:
                    sigs = minima([sets[i] for i in held])
                    banded = band_keys(sigs, per_band).view(np.int64)
                    for at, i in enumerate(held):
                        key[i], head[i], rest[i], keys[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), sigs[at, :HEAD].tobytes(), sigs[at, HEAD:].tobytes(), banded[at]
                ids, tie, text = (c.slice(a, b - a) for c in part.columns)
                own = [pa.array([len(s) for s in sets], pa.int64()), *(pa.array(x, pa.binary()) for x in (key, head, rest)), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + b - a)), ids, tie, text, *own], names=names)
                row += b - a

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tie"), F.col("text").cast("string").alias("text"))
    return scratch.write(plain.mapInArrow(run, "row long, doc_id long, tie long, text string, n_shingles long, set_key binary, head binary, rest binary, keys array<long>"), "sketch", "zstd")


def likely(pairs: DataFrame, nodes: DataFrame, part: str, begin: int, tests: list[tuple[int, int, int]]) -> DataFrame:
    """a, b, m of the pairs (a, b, m matches so far) that no test rules out; ``part`` of the signatures begins at ``begin``."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("m", pa.int32())])

    def run(batches_: Iterator[pa.RecordBatch]):
        for got in batches_:
            if not got.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(got.column(i).to_pylist()), np.uint32).reshape(got.num_rows, -1) for i in (3, 4))
            m, left = got.column(2).to_numpy().astype(np.int32), np.arange(got.num_rows)
            for a, b, least in tests:
                m[left] += (x[left, a - begin : b - begin] == y[left, a - begin : b - begin]).sum(1, dtype=np.int32)
                left = left[m[left] >= least]
            at = pa.array(left)
            yield pa.RecordBatch.from_arrays([got.column(0).take(at), got.column(1).take(at), pa.array(m[left])], schema=schema)

    own = lambda c, name: nodes.select(F.col("node").alias(c), F.col(part).alias(name))
    # a node may be in many pairs, and no side is of bounded size: the optimiser splits such joins
    both = pairs.hint("merge").join(own("a", "x"), "a").hint("merge").join(own("b", "y"), "b")
    return both.select("a", "b", "m", "x", "y").mapInArrow(run, "a long, b long, m int")


def paired(hits: DataFrame, nodes: DataFrame, percent: int, miss: float, scratch: Scratch) -> DataFrame:
    """a, b: likely pairs of small buckets (key, node, n); a bucket has at most ``PAIRED`` rows, so a row meets a bounded number."""
    lists = hits.groupBy("key").agg(F.collect_list(F.struct("node", "n")).alias("m"))
    fits = f"y.node > x.node and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    pairs = f"flatten(transform(m, x -> transform(filter(m, y -> {fits}), y -> struct(x.node as a, y.node as b))))"
    met = lists.select(F.explode(F.expr(pairs)).alias("p")).select("p.*").distinct().withColumn("m", F.lit(0))
    tests = bounds(percent, PERMS, miss)
    first = scratch.write(likely(met, nodes, "head", 0, [t for t in tests if t[1] <= HEAD]), "first")
    return likely(first, nodes, "rest", HEAD, [t for t in tests if t[1] > HEAD]).select("a", "b")


def clustered(hits: DataFrame, nodes: DataFrame, percent: int, miss: float, scratch: Scratch, block: int) -> DataFrame:
    """a, b: a spanning forest of the likely pairs of large buckets (centre, node, n)."""
    tests = bounds(percent, PERMS, miss)

    def solve(ids, sides, sizes, heads, rests):
        sigs = np.concatenate([np.frombuffer(b"".join(x), np.uint32).reshape(len(ids), -1) for x in (heads, rests)], 1)
        size, side, links = np.array(sizes), np.array(sides), Links(len(ids))
        crossed = len(set(sides) - {0}) > 1
        roots = np.arange(len(ids))
        for a in range(len(ids) - 1):
            ok = (roots[a + 1 :] != roots[a]) & (100 * np.minimum(size[a + 1 :], size[a]) >= percent * np.maximum(size[a + 1 :], size[a]))
            if crossed and side[a]:
                ok &= side[a + 1 :] != side[a]
            left = np.flatnonzero(ok) + a + 1
            m = np.zeros(len(left), np.int32)
            for b, c, least in tests:
                if not len(left):
                    break
                m += (sigs[left, b:c] == sigs[a, b:c]).sum(1, dtype=np.int32)
                left, m = left[m >= least], m[m >= least]
            if len(left):
                for b in left.tolist():
                    links.join(a, b)
                roots = np.array([links.root(i) for i in range(len(ids))])
        return [(ids[a], ids[b]) for a, b in links.found]

    members = banded_stars(hits, percent, scratch)
    return forest(members, ["centre", "band"], nodes.select("node", "n", "head", "rest"), ["n", "head", "rest"], solve, scratch, "clustered", block)


def candidate_groups(nodes: DataFrame, percent: int, miss: float, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """root, node: groups that hold every pair of nodes with a common band which the posterior does not rule out."""
    signed = nodes.where(100 * F.col("n") >= percent * (F.col("n") + 1)).select("node", "n", F.explode("keys").alias("key"))
    common = scratch.write(signed.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("many")).where("many > 1"), "common")
    small, large = common.where(F.col("many") <= PAIRED).select("key"), common.where(F.col("many") > PAIRED).select("key", "centre")
    near = paired(signed.join(small, "key"), nodes, percent, miss, scratch)
    far = clustered(signed.join(large, "key"), nodes, percent, miss, scratch, block)
    found = components(near.unionByName(far), scratch, "candidate")
    scratch.drop("common")
    return found.select(F.col("component").alias("root"), "node")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row: documents link when 100 * intersection >= percent * union.

    Words are runs of anything but space and 0x09-0x0D, A-Z lower-cased; a text of fewer than ``words`` words is one shingle.
    A pair at the threshold is missed with a chance of about ``MISS_BANDS`` + ``miss`` a batch at most; links are confirmed on
    whole sets. Null and empty texts have no shingle and link with nothing: they are kept, with their own doc_id as component.
    Rows with a null doc_id link with nothing either, have a null component and are kept. A document stays if its doc_id is its
    component; of rows that share that doc_id and are linked, all have the component, and all are marked kept. Repeated rows are
    returned each, and rows of one doc_id with different texts are judged apart. Very long texts count whole; other columns are
    not read; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "near")
    every = sketch(docs, words, percent, scratch)
    named = every.where("set_key is not null and doc_id is not null")
    first = F.min(F.struct("doc_id", "tie", "row")).alias("first")
    whole = named.groupBy("set_key").agg(first, F.count("*").alias("copies"), F.first(F.struct(F.col("n_shingles").cast("int").alias("n"), "head", "rest", "keys")).alias("s"))
    nodes = scratch.write(whole.select("set_key", F.col("first.row").alias("node"), "first", "copies", "s.*"), "nodes")
    links = verified_groups(every, candidate_groups(nodes, percent, miss, scratch), words, percent, scratch)
    groups = named_groups(nodes, components(links, scratch), scratch)
    narrow = named.select("doc_id", "n_shingles", "set_key")
    linked = join_groups(narrow, groups, ["set_key"], "copies", narrow.count()).select("doc_id", "n_shingles", "component_id")
    alone = every.where("set_key is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
