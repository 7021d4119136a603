"""Near-duplicate removal by MinHash and banded LSH, first wins.

Signatures are made in Arrow batches: a document's signature is the minimum over its n-grams' rows of hashes. A worker holds
the rows of the n-grams that it met first; of the slow family, the n-grams that its table has no room for go to one place
each, are hashed there once in the whole job, and only hashes that can still be a minimum come back. Every row has a number of its own, so rows that share a doc_id, or have none, stay apart. Rows with
equal signatures are one node, named by its first row (doc_id, null last, then hash of the text, then row number), and nodes
are numbered in that order.

Which rows stay is the lexicographically first maximal independent set of the similarity graph, without forming the graph: in
each round only the first few open nodes of every bucket (the nodes with one key in one band) are met by the bucket's other
open nodes. A node that leads all its buckets and is similar to no earlier open node stays, what is similar to it goes, and
both leave their buckets. A family of near copies so costs its size; the leaders grow in number from round to round for
buckets whose nodes are not alike. When few rows are left in buckets, one task walks them.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.models import slices
from .tables import Tables, resident

#: Rows (node, bucket) that one task walks at the end: their signatures take no more than a kilobyte each.
FEW = 50_000


def band_shape(num_perm: int, threshold: float) -> tuple[int, int]:
    """(bands, rows): the divisor of ``num_perm`` whose S-curve is nearest to one half at the threshold, the fewest bands on a tie."""
    shapes = [(b, num_perm // b) for b in range(1, num_perm + 1) if num_perm % b == 0]
    return min(shapes, key=lambda s: (abs(1 - (1 - threshold ** s[1]) ** s[0] - 0.5), s[0]))


def areas(threshold: float, bands: int, rows: int, steps: int = 1000) -> tuple[float, float]:
    """The areas of false positives (below the threshold) and false negatives (above it) of the chance that a pair shares a band."""
    part = lambda low, high, f: float(np.mean(f(low + (np.arange(steps) + 0.5) / steps * (high - low)))) * (high - low)
    shared = lambda s: 1 - (1 - s**rows) ** bands
    return part(0.0, threshold, shared), part(threshold, 1.0, lambda s: 1 - shared(s))


def balanced_shape(num_perm: int, threshold: float, false_positives: float = 0.5) -> tuple[int, int]:
    """(bands, rows) with the least weighted sum of both areas; positions that no band needs are left over. The first of equals by bands, then rows."""
    shapes = [(b, r) for b in range(1, num_perm + 1) for r in range(1, num_perm // b + 1)]
    weighed = [(false_positives * fp + (1 - false_positives) * fn) for fp, fn in (areas(threshold, b, r) for b, r in shapes)]
    return shapes[int(np.argmin(weighed))]


#: A Mersenne prime, and the largest hash of the 32-bit family.
PRIME, MAX_HASH = (1 << 61) - 1, (1 << 32) - 1


def permutations(num_perm: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of the family ``mersenne``, drawn in turn from a seeded generator."""
    drawn = np.random.RandomState(seed)
    pairs = [(drawn.randint(1, PRIME, dtype=np.uint64), drawn.randint(0, PRIME, dtype=np.uint64)) for _ in range(num_perm)]
    return tuple(np.array(x, np.uint64) for x in zip(*pairs))


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def grams(text: str, n: int) -> set[str]:
    """Distinct character n-grams of the normalised text, a shorter text being its own; with ``n`` 0, its distinct words."""
    if not n:
        return set(text.lower().split()) or {""}
    t = normalised(text)
    return {t[i : i + n] for i in range(len(t) - n + 1)} if len(t) >= n else {t}


def bases(found: Iterable[str]) -> np.ndarray:
    """The base hashes of n-grams, from which the family ``mix`` makes its rows: 64 bits of BLAKE2."""
    blake = hashlib.blake2b
    return np.frombuffer(b"".join([blake(g.encode("utf-8", "replace"), digest_size=8).digest() for g in found]), ">u8").astype(np.uint64)


#: Characters of the texts whose n-grams are numbered together.
SLICE = 2_000_000


def sliced(texts: list[str]) -> Iterator[list[str]]:
    """The texts in turn, in slices of ``SLICE`` characters at most; a longer text stands alone."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > SLICE:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def gram_bases(texts: list[str], n: int) -> list[np.ndarray]:
    """The base hashes of each normalised text's distinct n-grams, as of ``grams``; every n-gram of the texts is hashed once.

    The texts' characters are numbered from 1, so an n-gram is one number of ``n`` digits and a shorter text ends in zeros. Texts of more
    characters than a digit has values are taken by halves, and one such text by its strings.
    """
    bits = 63 // n
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    held = np.zeros(0x110000, bool)
    held[codes] = True
    alphabet = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(held)])
    if len(alphabet) > 1 << bits:
        half = len(texts) // 2
        return gram_bases(texts[:half], n) + gram_bases(texts[half:], n) if half else [bases(grams(texts[0], n))]
    number = np.zeros(0x110000, np.uint64)
    number[alphabet[1:]] = np.arange(1, len(alphabet), dtype=np.uint64)
    digits = np.concatenate([number[codes], np.zeros(n, np.uint64)])
    keys = np.zeros(len(codes) + 1, np.uint64)
    for k in range(n):
        keys = (keys << np.uint64(bits)) | digits[k : k + len(keys)]
    own, at = [], 0
    for t in texts:
        if len(t) >= n:
            own.append(np.unique(keys[at : at + len(t) - n + 1]))
        else:  # the digits of the next text are not its own
            spare = np.uint64(bits * (n - len(t)))
            own.append(keys[at : at + 1] >> spare << spare)
        at += len(t)
    ends = np.cumsum([len(k) for k in own])
    every = np.concatenate(own)
    distinct = np.unique(every)
    places = [(distinct >> np.uint64(bits * (n - 1 - k))) & np.uint64((1 << bits) - 1) for k in range(n)]
    spelled = np.stack([alphabet[p] for p in places], 1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    used = np.count_nonzero(np.stack(places), axis=0).tolist()
    base = bases(spelled[i * n : i * n + u] for i, u in enumerate(used))
    return np.split(base[np.searchsorted(distinct, every)], ends[:-1])


class Hasher:
    """Rows of ``num_perm`` hashes by n-gram. ``sha256``: first 64 bits of the digest of (n-gram, seed + i as 32 bits); ``mix``: a fast family;
    ``mersenne``: (a h + b) modulo 2 ** 64, then a Mersenne prime, of which 32 bits count; h is the first 32 bits of the SHA-1.

    The table holds ``most`` n-grams; when it is full the half that was used most stays. ``mersenne`` and ``mix`` need none.
    """

    def __init__(self, num_perm: int, seed: int, family: str, most: int = 150_000):
        self.seeds = [struct.pack("<I", seed + i) for i in range(num_perm)]
        self.odd = (np.random.default_rng(seed).integers(0, 1 << 63, num_perm, np.uint64) << np.uint64(1)) | np.uint64(1)
        self.pairs = permutations(num_perm, seed) if family == "mersenne" else None
        self.family, self.most, self.rows, self.table, self.used = family, most, {}, np.zeros((1024, num_perm), np.uint64), np.zeros(1024, np.int64)

    def row(self, gram: str) -> np.ndarray:
        data = gram.encode("utf-8", "replace")
        if self.family == "sha256":
            sha = hashlib.sha256
            return np.frombuffer(b"".join([sha(data + s).digest()[:8] for s in self.seeds]), ">u8").astype(np.uint64)
        if self.family == "mersenne":
            a, b = self.pairs
            return (a * np.uint64(int.from_bytes(hashlib.sha1(data).digest()[:4], "little")) + b) % np.uint64(PRIME) & np.uint64(MAX_HASH)
        return self.mixed(bases([gram]))

    def shrink(self) -> None:
        n = len(self.rows)
        keep = np.argsort(-self.used[:n], kind="stable")[: self.most // 2]
        place = np.full(n, -1)
        place[keep] = np.arange(len(keep))
        self.table[: len(keep)], self.used[: len(keep)] = self.table[keep], self.used[keep] // 2
        self.rows = {g: int(place[i]) for g, i in self.rows.items() if place[i] >= 0}

    def add(self, gram: str) -> int:
        """Hashes an n-gram into the table; gives its place."""
        i = self.rows[gram] = len(self.rows)
        if i >= len(self.table):
            more = min(len(self.table), max(1, self.most - len(self.table)))
            self.table, self.used = np.concatenate([self.table, np.zeros_like(self.table[:more])]), np.concatenate([self.used, np.zeros_like(self.used[:more])])
        self.table[i], self.used[i] = self.row(gram), 0
        return i

    def permuted(self, found: set[str]) -> np.ndarray:
        """The signature of the family ``mersenne``, whose rows cost less than a table of them."""
        a, b = self.pairs
        first = np.array([int.from_bytes(hashlib.sha1(g.encode("utf-8", "replace")).digest()[:4], "little") for g in found], np.uint64)
        low = np.full(len(a), MAX_HASH, np.uint64)
        for k in range(0, len(first), 1024):
            x = first[k : k + 1024, None] * a + b
            x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))  # modulo the prime, but for what is at or above it
            x = np.where(x >= PRIME, x - np.uint64(PRIME), x) & np.uint64(MAX_HASH)
            low = np.minimum(low, x.min(0))
        return low

    def mixed(self, base: np.ndarray) -> np.ndarray:
        """The signature of the family ``mix`` from the n-grams' base hashes: a row costs less than its way through a table."""
        low = np.full(len(self.odd), ~np.uint64(0))
        for k in range(0, len(base), 1024):
            x = base[k : k + 1024, None] * self.odd
            x ^= x >> np.uint64(29)
            x *= self.odd[::-1]
            low = np.minimum(low, x.min(0))
        return low

    def signatures(self, texts: list[str], ngram: int) -> list[np.ndarray]:
        """The signatures of texts. Of the family ``mix`` each n-gram that a slice of the texts has is hashed once."""
        if self.family != "mix" or not ngram:
            return [self.signature(grams(t, ngram)) for t in texts]
        return [self.mixed(base) for part in sliced([normalised(t) for t in texts]) for base in gram_bases(part, ngram)]

    def partial(self, found: set[str]) -> tuple[np.ndarray, list[str]]:
        """The signature of the n-grams that the table holds or has room for, and the other n-grams."""
        places = list(map(self.rows.get, found))
        missed = []
        if None in places:
            for k, g in enumerate(found):
                if places[k] is None:
                    if len(self.rows) < self.most:
                        places[k] = self.add(g)
                    else:
                        missed.append(g)
            places = [i for i in places if i is not None]
        return (self.table[places].min(0) if places else np.full(self.table.shape[1], ~np.uint64(0))), missed

    def signature(self, found: set[str]) -> np.ndarray:
        if self.family == "mersenne":
            return self.permuted(found)
        if self.family == "mix":
            return self.mixed(bases(found))
        if len(self.rows) + len(found) > self.most:
            self.shrink()
        low = None
        at = []
        for g in found:
            i = self.rows.get(g)
            if i is None:
                if len(self.rows) >= self.most:  # a text with more n-grams than the table holds
                    r = self.row(g)
                    low = r if low is None else np.minimum(low, r)
                    continue
                i = self.add(g)
            at.append(i)
        if at:
            self.used[at] += 1
            own = self.table[at].min(0)
            low = own if low is None else np.minimum(low, own)
        return low


def spread(docs: DataFrame) -> DataFrame:
    """``docs``, dealt out only where they would come in fewer partitions than twice the cores, as a small file does."""
    spark = docs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    a_partition = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    bytes_ = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # the optimizer's estimate; starts no job
    return docs if bytes_ >= 2 * cores * a_partition else docs.repartition(4 * cores)


#: Bytes of texts that a worker takes out of an Arrow batch at a time to sign them.
TAKEN = 4_000_000

#: N-grams of one task's set that ``gram_rows`` holds before it gives them out.
HELD = 200_000


def lowered(rows: DataFrame, tables: Tables, num_perm: int, seed: int, family: str) -> DataFrame:
    """``rows`` (row, sig, missed and others) without ``missed``, the signatures lowered by the hashes of the n-grams missed.

    The n-grams meet by name, so each is hashed in one task whatever the number of rows that have it. Of its hashes a row gets
    those that are no larger than the largest of its signature, which is all that can lower it.
    """
    plain = rows.drop("missed")
    if rows.where(F.size("missed") > 0).isEmpty():
        return plain
    entry, schema = np.dtype([("i", "<u2"), ("h", "<u8")]), pa.schema([("row", pa.int64()), ("lows", pa.binary())])

    def hashed(parts: Iterator[pa.RecordBatch]):
        hasher = Hasher(num_perm, seed, family)
        last, own = None, None
        for part in parts:
            for k in range(0, part.num_rows, 4096):
                some = part.slice(k, 4096)
                found, place, table = some.column(2).to_pylist(), [], []
                for g in found:
                    if g != last or own is None:
                        last, own = g, hasher.row(g)
                        table.append(own)
                    elif not table:  # goes on from the slice before
                        table.append(own)
                    place.append(len(table) - 1)
                bound = np.frombuffer(b"".join(some.column(1).to_pylist()), ">u8").astype(np.uint64)
                hashes = np.stack(table)[place]
                at, i = np.nonzero(hashes <= bound[:, None])
                lows = np.empty(len(at), entry)
                lows["i"], lows["h"] = i, hashes[at, i]
                counts = np.bincount(at, minlength=len(found))
                ends = np.concatenate([[0], np.cumsum(counts) * entry.itemsize]).astype(np.int32)
                flat = pa.BinaryArray.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(ends), pa.py_buffer(lows.tobytes())])
                yield pa.RecordBatch.from_arrays([some.column(0), flat], schema=schema).filter(pa.array(counts > 0))

    def merged(parts: Iterator[pa.RecordBatch]):
        for part in parts:
            sigs = []
            for sig, lows in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                own = np.frombuffer(sig, ">u8").astype(np.uint64)
                new = np.frombuffer(b"".join(lows), entry)
                np.minimum.at(own, new["i"], new["h"])
                sigs.append(own.astype(">u8").tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sigs, pa.binary())], names=["row", "sig"])

    highest = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(num_perm - 1)), lambda i: F.substring("sig", i * 8 + 1, F.lit(8))))
    left = rows.where(F.size("missed") > 0).select("row", highest.alias("bound"), "missed").select("row", "bound", F.explode("missed").alias("gram"))
    found = left.repartition("gram").sortWithinPartitions("gram").mapInArrow(hashed, "row long, lows binary")
    new = tables.write(found.groupBy("row").agg(F.collect_list("lows").alias("lows")).join(rows.select("row", "sig"), "row").select("row", "sig", "lows").mapInArrow(merged, "row long, sig binary"), "lowered")
    both = plain.join(new.select("row", F.col("sig").alias("_new")), "row", "left")
    signed = tables.write(both.select(*(F.coalesce("_new", "sig").alias("sig") if c == "sig" else c for c in plain.columns)), "signed")
    for name in ("rows", "lowered"):
        tables.remove(name)
    return signed


def signatures(docs: DataFrame, num_perm: int = 128, ngram: int = 5, seed: int = 42, family: str = "sha256") -> DataFrame:
    """doc_id and sig, the signature as ``num_perm`` big-endian 64-bit numbers in one binary. A null text counts as empty."""
    return signed_rows(docs.select("doc_id", "text"), Tables(docs.sparkSession, "signatures"), num_perm, ngram, seed, family).select("doc_id", "sig")


def signed_rows(docs: DataFrame, tables: Tables, num_perm: int, ngram: int, seed: int, family: str, carry: bool | list[str] = False, most: int = 150_000) -> DataFrame:
    """row (a number of its own), doc_id, tie (hash of the text), sig of every row, written; with ``carry`` its columns, or those named, as ``_carried0``, ..

    A worker keeps the rows of ``most`` n-grams from task to task; what the slow family misses in them, ``lowered`` hashes. Besides
    these it holds an Arrow batch, at most ``TAKEN`` bytes of its texts (or one longer text) as strings, and the n-grams of the text at hand.
    """
    carried = docs.columns if carry is True else carry or []
    more = [F.col(f"`{c}`").alias(f"_carried{i}") for i, c in enumerate(carried)]
    kinds = "".join(f", _carried{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carried))
    slow = family == "sha256"
    names = ["row", "doc_id", "tie", "sig", *(["missed"] if slow else []), *(f"_carried{i}" for i in range(len(more)))]

    def run(parts: Iterator[pa.RecordBatch]):
        hasher = resident("hasher", (num_perm, seed, family, most), lambda: Hasher(num_perm, seed, family, most))
        row = TaskContext.get().partitionId() << 33
        for whole in parts:
            for part in (p for k in range(0, whole.num_rows, 1000) for p in slices(whole.slice(k, 1000), 2, TAKEN)):
                texts = part.column(2).to_pylist()
                if slow:
                    sigs, missed = zip(*(hasher.partial(grams(t or "", ngram)) for t in texts))
                else:
                    sigs, missed = hasher.signatures([t or "" for t in texts], ngram), None
                own = [pa.array([s.astype(">u8").tobytes() for s in sigs], pa.binary()), *([pa.array(missed, pa.list_(pa.string()))] if slow else [])]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(sigs))), *part.columns[:2], *own, *part.columns[3:]], names=names)
                row += len(sigs)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tie"), F.col("text").cast("string").alias("text"), *more)
    rows = tables.write(spread(plain).mapInArrow(run, "row long, doc_id long, tie long, sig binary" + (", missed array<string>" if slow else "") + kinds), "rows")
    return lowered(rows, tables, num_perm, seed, family) if slow else rows


def classes(rows: DataFrame, tables: Tables, by: str | None = None) -> DataFrame:
    """node, row, doc_id, copies, sig of every distinct signature: its first row, and nodes numbered in the order of their first rows.

    ``by`` names a column that goes before the doc_id in that order. What is sorted is one narrow row a class.
    """
    order = [*([by] if by else []), "z", "doc_id", "tie", "row"]
    first = F.min(F.struct(*(F.col("doc_id").isNull().alias("z") if c == "z" else F.col(c) for c in order))).alias("first")
    narrow = rows.groupBy(F.sha2("sig", 256).alias("key")).agg(first, F.count("*").alias("copies")).select("first.*", "copies")
    ordered = narrow.orderBy(*order).select(F.monotonically_increasing_id().alias("node"), "row", "doc_id", "copies")
    return tables.write(tables.write(ordered, "ordered").join(rows.select("row", "sig"), "row").select("node", "row", "doc_id", "copies", "sig"), "classes")


def merged_signatures(docs: DataFrame, by: str, num_perm: int = 128, ngram: int = 5, seed: int = 42, family: str = "sha256", groups: int = 1000) -> DataFrame:
    """``by``, i, low: the signature of all n-grams of each group's texts, position by position as eight bytes, big-endian.

    Distinct n-grams of a group meet by name, so each is hashed once in the whole job; a task keeps one partial signature a
    group (at most ``groups`` at a time, then it gives them out) and partials merge by their minimum, so a hot group costs one
    row a task and position. A null group is a group, a null text counts as empty.
    """
    kind = docs.schema[by].dataType.simpleString()
    names = [by, "sig"]

    def cut(parts: Iterator[pa.RecordBatch]):
        held: dict = {}
        own, size = None, 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array([k for k, s in held.items() for _ in s], own), pa.array([g.encode("utf-8", "replace").decode() for s in held.values() for g in s], pa.string())], names=[by, "gram"])
        for part in parts:
            own = part.schema.field(0).type
            for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                into = held.setdefault(k, set())
                size -= len(into)
                into |= grams(t or "", ngram)
                size += len(into)
                if size >= HELD:
                    yield out()
                    held, size = {}, 0
        if held:
            yield out()

    def run(parts: Iterator[pa.RecordBatch]):
        hasher = Hasher(num_perm, seed, family)
        held: dict = {}
        last, row, own = None, None, None
        give = lambda: pa.RecordBatch.from_arrays([pa.array([*held], own), pa.array([s.astype(">u8").tobytes() for s in held.values()], pa.binary())], names=names)
        for part in parts:
            own = part.schema.field(0).type
            for k, g in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if g != last or row is None:
                    last, row = g, hasher.row(g)
                if k in held:
                    np.minimum(held[k], row, out=held[k])
                else:
                    if len(held) >= groups:
                        yield give()
                        held = {}
                    held[k] = row.copy()
        if held:
            yield give()

    found = spread(docs.select(by, F.col("text").cast("string").alias("text"))).mapInArrow(cut, f"`{by}` {kind}, gram string")
    # the second shuffle is the first one's: the n-gram alone decides the place
    partial = found.repartition("gram").dropDuplicates([by, "gram"]).sortWithinPartitions("gram").mapInArrow(run, f"`{by}` {kind}, sig binary")
    places = F.transform(F.sequence(F.lit(0), F.lit(num_perm - 1)), lambda i: F.struct(i.alias("i"), F.substring("sig", i * 8 + 1, F.lit(8)).alias("low")))
    return partial.select(by, F.explode(places).alias("p")).groupBy(by, F.col("p.i").alias("i")).agg(F.min("p.low").alias("low"))


def agreement(a: Column, b: Column, num_perm: int) -> Column:
    """Share of equal positions of two signatures."""
    same = F.aggregate(F.sequence(F.lit(0), F.lit(num_perm - 1)), F.lit(0), lambda n, i: n + (F.substring(a, i * 8 + 1, F.lit(8)) == F.substring(b, i * 8 + 1, F.lit(8))).cast("int"))
    return same / num_perm


def pair_similarity(left: DataFrame, right: DataFrame, left_perm: int, right_perm: int) -> DataFrame:
    """doc_id, similarity of two tables of signatures that meet by doc_id; different numbers of permutations are an error."""
    if left_perm != right_perm:
        raise ValueError(f"signatures of {left_perm} and {right_perm} permutations cannot be compared")
    both = left.select("doc_id", F.col("sig").alias("a")).join(right.select("doc_id", F.col("sig").alias("b")), "doc_id")
    return both.select("doc_id", agreement(F.col("a"), F.col("b"), left_perm).alias("similarity"))


def bands(nodes: DataFrame, num_perm: int, threshold: float, keep: list[str] | None = None, shape: tuple[int, int] | None = None) -> DataFrame:
    """node, band, key (and the columns ``keep``) of every band; the key is the band's part of the signature itself, so it cannot collide."""
    count, rows = shape or band_shape(num_perm, threshold)
    each = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda b: F.struct(b.alias("band"), F.substring("sig", b * (8 * rows) + 1, F.lit(8 * rows)).alias("key")))
    keep = keep or []
    return nodes.select("node", *keep, F.explode(each).alias("b")).select("node", "b.band", "b.key", *keep)


def buckets(nodes: DataFrame, num_perm: int, threshold: float, shape: tuple[int, int] | None = None) -> DataFrame:
    """node, band, first: a bucket of two nodes or more is known by its band and its first node."""
    keyed = bands(nodes, num_perm, threshold, shape=shape)
    shared = keyed.groupBy("band", "key").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keyed.join(shared, ["band", "key"]).select("node", "band", "first")


def candidates(held: DataFrame) -> DataFrame:
    """Pairs lo < hi of nodes that share a bucket, of rows (node, band, first)."""
    return held.withColumnRenamed("node", "lo").join(held.withColumnRenamed("node", "hi"), ["band", "first"]).where("lo < hi").select("lo", "hi").distinct()


def similar(pairs: DataFrame, nodes: DataFrame, num_perm: int, threshold: float, lows: DataFrame | None = None, shape: tuple[int, int] | None = None) -> DataFrame:
    """lo, hi, similarity of the pairs whose signatures agree in at least ``threshold`` of the positions.

    ``lows`` has the nodes of lo if they are others; ``shape`` (bands, rows) leaves out pairs that have no band in common.
    """
    names = ["lo", "hi", "similarity"]

    def run(parts: Iterator[pa.RecordBatch]):
        for part in parts:
            a, b = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint64).reshape(-1, num_perm) for i in (2, 3))
            same = a == b
            share = same.sum(1) / num_perm
            met = same[:, : shape[0] * shape[1]].reshape(-1, *shape).all(2).any(1) if shape else True
            at = pa.array(np.flatnonzero((share >= threshold) & met))
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(share).take(at)], names=names)

    own = lambda rows, c, name: rows.select(F.col("node").alias(c), F.col("sig").alias(name))
    kind = pairs.schema["lo"].dataType.simpleString()
    both = pairs.join(own(nodes, "hi", "b"), "hi").join(own(nodes if lows is None else lows, "lo", "a"), "lo")
    return both.select("lo", "hi", "a", "b").mapInArrow(run, f"lo {kind}, hi {kind}, similarity double")


def walked(held: DataFrame, nodes: DataFrame, num_perm: int, threshold: float, verify: bool) -> DataFrame:
    """node, kept of few nodes of buckets, walked in order in one task."""

    def run(parts: Iterator[pa.RecordBatch]):
        stay: dict = {}
        for part in parts:
            kept = []
            for where, sig in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                own = np.frombuffer(sig, np.uint64) if verify else None
                mates = [m for b in where for m in stay.get((b["band"], b["first"]), ())]
                kept.append(not (((np.stack(mates) == own).sum(1) / num_perm >= threshold).any() if verify and mates else mates))
                if kept[-1]:
                    for b in where:
                        stay.setdefault((b["band"], b["first"]), []).append(own)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.bool_())], names=["node", "kept"])

    rows = held.groupBy("node").agg(F.collect_list(F.struct("band", "first")).alias("where"))
    signed = rows.join(nodes.select("node", "sig"), "node") if verify else rows.withColumn("sig", F.lit(None).cast("binary"))
    return signed.select("node", "where", "sig").coalesce(1).sortWithinPartitions("node").mapInArrow(run, "node long, kept boolean")


def first_wins(held: DataFrame, alike, tables: Tables, leaders: int = 1, most: int = 256, finish=None) -> DataFrame:
    """node, kept of all nodes of buckets (node, band, first): a node stays unless an earlier node that stays shares a bucket with it and is alike.

    ``alike`` gives of pairs (lo, hi) those that are. In a round the ``leaders`` first open nodes of every bucket are met by
    its other open nodes, each pair once; the leaders grow fourfold up to ``most``. A node that leads all its buckets has met all
    earlier open nodes, and all later ones have met it, so it is decided for good. The first open node of all is one, so rounds
    end; a bucket whose nodes are not alike is decided ``most`` nodes a round. ``finish`` decides what is left when that is no
    more than ``FEW`` rows.
    """
    bucket, turn, done = ["band", "first"], 0, []
    held = tables.write(held, "held0")
    while left := held.count():
        if finish and left <= FEW:
            done.append(tables.write(finish(held), f"decided{turn}"))
            held = held.limit(0)
            break
        rank = F.row_number().over(Window.partitionBy(*bucket).orderBy("node"))
        lead = tables.write(held.withColumn("rank", rank).where(F.col("rank") <= leaders).select(*bucket, F.col("node").alias("lo")), f"lead{turn}")
        met = held.withColumnRenamed("node", "hi").join(lead, bucket).where("lo < hi").select("lo", "hi").distinct()
        near = tables.write(alike(met).select("lo", "hi"), f"near{turn}")
        leads = lead.groupBy(F.col("lo").alias("node")).agg(F.count("*").alias("leads")).join(held.groupBy("node").agg(F.count("*").alias("own")), "node").where("leads = own").select("node")
        stays = leads.join(near.select(F.col("hi").alias("node")).distinct(), "node", "left_anti")
        gone = near.join(stays.select(F.col("node").alias("lo")), "lo", "left_semi").select(F.col("hi").alias("node")).distinct()
        done.append(tables.write(stays.withColumn("kept", F.lit(True)).unionByName(gone.withColumn("kept", F.lit(False))), f"decided{turn}"))
        open_ = held.join(done[-1].select("node"), "node", "left_anti")
        for name in (f"lead{turn - 1}", f"near{turn - 1}", f"held{turn - 1}"):
            tables.remove(name)
        turn, leaders = turn + 1, min(4 * leaders, most)
        held = tables.write(open_, f"held{turn}")
    out = held.select("node", F.lit(True).alias("kept"))
    for d in done:
        out = out.unionByName(d)
    return out


def kept_rows(rows: DataFrame, tables: Tables, num_perm: int, threshold: float, verify: bool = True, by: str | None = None, shape: tuple[int, int] | None = None) -> DataFrame:
    """row of the signed rows that stay, walked by ``by`` first if it is given."""
    nodes = classes(rows, tables, by)
    alike = (lambda pairs: similar(pairs, nodes, num_perm, threshold)) if verify else (lambda pairs: pairs)
    decided = first_wins(buckets(nodes, num_perm, threshold, shape), alike, tables, finish=lambda held: walked(held, nodes, num_perm, threshold, verify))
    return nodes.select("node", "row").join(decided.where("not kept"), "node", "left_anti").select("row")


def dedup(docs: DataFrame, num_perm: int = 128, threshold: float = 0.7, ngram: int = 5, seed: int = 42, family: str = "sha256", verify: bool = True, carry: bool = False, by: str | None = None, shape: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, kept of every row (with ``carry`` all columns and kept): a row goes if it is similar to an earlier one that stays.

    Rows are walked by doc_id (null last), then by hash of the text, with ``carry`` first by the column that ``by`` names; each is judged by itself: of repeated rows one stays, rows
    that share a doc_id with different texts are told apart, rows without a doc_id take part as the last ones. Null texts count
    as empty, and empty texts are equal. ``ngram`` 0 compares words; without ``verify`` a common band is enough; ``shape`` is
    (bands, rows) where it is not that of ``band_shape``. Texts count whole; an empty table gives an empty result.
    """
    tables = Tables(docs.sparkSession, "minhash")
    rows = signed_rows(docs, tables, num_perm, ngram, seed, family, carry)
    stays = kept_rows(rows, tables, num_perm, threshold, verify, by and f"_carried{docs.columns.index(by)}", shape).withColumn("kept", F.lit(True))
    own = [F.col(f"_carried{i}").alias(c) for i, c in enumerate(docs.columns)] if carry else [F.col("doc_id")]
    return rows.join(stays, "row", "left").select(*own, F.coalesce("kept", F.lit(False)).alias("kept"))


def unique_documents(docs: DataFrame, most: int = 0, **settings) -> DataFrame:
    """The rows that stay (see ``dedup``), by doc_id, null last; with ``most`` above 0, the first so many."""
    kept = dedup(docs, carry=True, **settings).where("kept").select(*docs.columns).orderBy(F.col("doc_id").asc_nulls_last())
    return kept.limit(most) if most else kept


def linked(rows: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of two kinds: ``member`` (doc_id, other: its class's first doc_id, copies) for every row, ``pair`` (doc_id, other, 0 copies) for pairs (lo, hi) of classes.

    Two rows are linked if their classes are the same or a pair. Where pairs have a similarity, a member's is 1.
    """
    more = ["similarity"] if "similarity" in pairs.columns else []
    key = F.sha2("sig", 256).alias("key")
    own = rows.select("doc_id", key).join(nodes.select(key, F.col("doc_id").alias("other"), "copies"), "key").select(F.lit("member").alias("kind"), "doc_id", "other", "copies", *(F.lit(1.0).alias(c) for c in more))
    named = lambda c, name: nodes.select(F.col("node").alias(c), F.col("doc_id").alias(name))
    met = pairs.join(named("lo", "doc_id"), "lo").join(named("hi", "other"), "hi")
    return own.unionByName(met.select(F.lit("pair").alias("kind"), "doc_id", "other", F.lit(0).cast("long").alias("copies"), *more))


def dedup_stats(decided: DataFrame) -> DataFrame:
    return decided.agg(F.count("*").alias("total"), F.count_if(~F.col("kept")).alias("duplicates"), F.count_if("kept").alias("unique")).select("total", "duplicates", "unique", F.coalesce(F.try_divide("duplicates", "total"), F.lit(0.0)).alias("rate"))
