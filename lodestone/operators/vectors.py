"""Approximate nearest vectors: inverted lists of product-quantised residuals, scanned as codes, and an exact re-rank.

A vector goes to the list of its nearest centre; what the centre leaves of it is cut into parts, each named by one byte, the
nearest entry of the part's codebook. Lists grow in number with the table (its square root). A search scans the codes of the
lists nearest to a query, a fraction of the vectors' bytes, and scores only the best ``depth`` of them on the vectors
themselves. Centres and codebooks are fitted on a bounded sample; how many lists to scan and how deep to re-rank is measured on
that sample, so that both follow the data: few lists where vectors cluster, most where they don't.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import Tables

#: Parts of the lists, and multiples of k, among which calibration chooses the least that serves.
SHARES = (1 / 32, 1 / 16, 1 / 8, 1 / 4, 3 / 8, 1 / 2, 5 / 8, 3 / 4, 7 / 8, 1.0)
DEPTHS = (1, 2, 3, 4, 6, 8, 12, 16)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` means of the rows of ``x`` (fewer if there are fewer rows); a mean that loses its rows stays where it was."""
    k = min(k, len(x))
    means = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, means)
        count = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], 1)
        means[count > 0] = sums[count > 0] / count[count > 0, None]
    return means


def nearest(x: np.ndarray, means: np.ndarray) -> np.ndarray:
    half = (means**2).sum(1) / 2
    return np.concatenate([(x[a : a + 4096] @ means.T - half).argmax(1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


class Quantiser:
    """Centres and codebooks, of unit vectors; ``probes`` lists are to be scanned and ``depth`` vectors to be re-ranked."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 3, rounds: int = 6):
        rng = np.random.default_rng(seed)
        x = unit(sample)
        self.d = x.shape[1]
        self.parts = min(self.d, max(32, self.d // 8))
        self.cuts = np.linspace(0, self.d, self.parts + 1).astype(int)
        self.centres = k_means(x, lists, rounds, rng)
        left = x - self.centres[nearest(x, self.centres)]
        self.books = [k_means(left[:, a:b], 256, rounds, rng) for a, b in zip(self.cuts[:-1], self.cuts[1:])]
        self.probes, self.depth = len(self.centres), 0

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list and the code of each unit vector."""
        own = nearest(x, self.centres)
        left = x - self.centres[own]
        codes = [nearest(left[:, a:b], book) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books)]
        return own, np.stack(codes, 1).astype(np.uint8)

    def decode(self, own: int | np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.centres[own] + np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], 1)

    def probed(self, queries: np.ndarray) -> np.ndarray:
        """The lists that each unit query scans, the nearest first."""
        return np.argsort(-(queries @ self.centres.T), axis=1, kind="stable")[:, : self.probes]

    def calibrate(self, sample: np.ndarray, k: int, target: float, queries: int = 200) -> None:
        """Sets the fewest probes and then the least depth with which sampled queries find ``target`` of their true ``k`` in the sample."""
        x = unit(sample)
        own, codes = self.encode(x)
        q = x[:: max(1, len(x) // queries)]
        true = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :k]
        near, order = q @ self.decode(own, codes).T, np.argsort(-(q @ self.centres.T), axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
        of_list = place[:, own]  # how near the list of each sampled vector is to each query
        held = np.take_along_axis(of_list, true, 1)
        lists = len(self.centres)
        self.probes = next((p for p in (max(1, int(np.ceil(s * lists))) for s in SHARES) if (held < p).mean() >= (1 + target) / 2), lists)
        scan = np.where(of_list < self.probes, near, -np.inf)
        rank = (scan[:, None, :] > np.take_along_axis(scan, true, 1)[:, :, None]).sum(2) if len(x) * len(q) * k < 2**27 else np.stack([(s[None] > s[t][:, None]).sum(1) for s, t in zip(scan, true)])
        found = lambda depth: ((rank < depth) & (held < self.probes)).mean()
        self.depth = next((m * k for m in DEPTHS if found(m * k) >= target), DEPTHS[-1] * k)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d)


class VectorIndex:
    """The index of a table of vectors (vec_id, embedding); every vector of its dimension is in it, repeated and null ids too.

    ``most_sample`` bounds what it is fitted on, drawn by hash of row numbers; ``recall`` is the aim of the calibration. Vectors
    that are null, or hold nulls, or have another dimension than the first of the sample, are left out.
    """

    def __init__(self, vectors: DataFrame, k: int = 10, most_sample: int = 20_000, recall: float = 0.96):
        self.spark, self.k = vectors.sparkSession, k
        self.tables = tables = Tables(self.spark, "index")
        held = vectors.where("embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null)")
        rows = tables.write(held.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")), "vectors")
        total = rows.count()
        share = int((1 << 30) * min(1.0, 1.2 * most_sample / max(1, total))) + 1
        drawn = rows.where(F.pmod(F.xxhash64("row", F.lit(5)), F.lit(1 << 30)) < share)
        sample = [r.embedding for r in drawn.orderBy(F.xxhash64("row", F.lit(5))).limit(most_sample).select("embedding").collect()]
        self.total = total
        if not sample:
            self.quantiser = None
            return
        d = len(sample[0])
        own = np.array([s for s in sample if len(s) == d], float)
        self.quantiser = q = Quantiser(own, max(1, min(int(total**0.5), len(own) // 16)))
        q.calibrate(own, k, recall)
        q.depth = max(k, min(2 * q.depth, total // 10))
        self.vectors = rows.where(F.size("embedding") == d)

        def run(parts: Iterator[pa.RecordBatch]):
            for part in parts:
                if part.num_rows:
                    lists, codes = q.encode(unit(matrix(part.column(1), d)))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["row", "list", "code"])

        self.codes = tables.write(self.vectors.select("row", "embedding").mapInArrow(run, "row long, list int, code binary"), "codes")

    def blocks(self, df: DataFrame, columns: list[str], size: int) -> DataFrame:
        """list and arrays of the columns: the rows of a list in blocks of about ``size``, dealt by hash."""
        counts = df.groupBy("list").count().select("list", F.ceil(F.col("count") / size).cast("int").alias("n"))  # one row a list
        dealt = df.join(counts, "list").withColumn("block", F.pmod(F.xxhash64(columns[0]), F.col("n")).cast("int"))
        return dealt.groupBy("list", "block").agg(*(F.collect_list(c).alias(c) for c in columns)).drop("block")

    def search(self, queries: DataFrame, rows: int = 4096) -> DataFrame:
        """query_id, vec_id, score, rank: for each query (query_id, query) the best by cosine of the ``depth`` best by code; ties by vec_id.

        Null queries, and queries with nulls or of another dimension, give no row. Repeated queries are answered each.
        """
        empty = self.spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
        if self.quantiser is None:
            return empty
        q, d = self.quantiser, self.quantiser.d
        valid = queries.where((F.size("query") == d) & ~F.exists("query", lambda x: x.isNull()))
        asked = self.tables.write(valid.select(F.monotonically_increasing_id().alias("ask"), F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<float>").alias("query")), f"asked-{uuid.uuid4().hex[:8]}")

        def spread(parts: Iterator[pa.RecordBatch]):
            for part in parts:
                if part.num_rows:
                    lists = q.probed(unit(matrix(part.column(1), d)))
                    at = pa.array(np.repeat(np.arange(part.num_rows), lists.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(lists.ravel().astype(np.int32)), part.column(0).take(at), part.column(1).take(at)], names=["list", "ask", "query"])

        def scan(parts: Iterator[pa.RecordBatch]):
            for part in parts:
                for at in range(part.num_rows):
                    own, asks = part.column(0)[at].as_py(), part.column(1)[at].values.to_numpy(zero_copy_only=False)
                    ids = part.column(3)[at].values.to_numpy(zero_copy_only=False)
                    left = unit(matrix(part.column(2)[at].values, d))
                    right = q.decode(own, np.frombuffer(b"".join(part.column(4)[at].as_py()), np.uint8).reshape(len(ids), -1))
                    many = min(q.depth, len(ids))
                    for a in range(0, len(asks), 128):
                        near = left[a : a + 128] @ right.T
                        best = np.argpartition(-near, many - 1, axis=1)[:, :many]
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asks[a : a + 128], many)), pa.array(ids[best].ravel()), pa.array(np.take_along_axis(near, best, 1).ravel())], names=["ask", "row", "near"])

        asks = self.blocks(asked.select("ask", "query").mapInArrow(spread, "list int, ask long, query array<float>"), ["ask", "query"], rows // 4)
        met = asks.join(self.blocks(self.codes, ["row", "code"], rows), "list").select("list", "ask", "query", "row", "code").mapInArrow(scan, "ask long, row long, near double")
        by_code = F.row_number().over(Window.partitionBy("ask").orderBy(F.col("near").desc(), "row"))
        chosen = met.withColumn("n", by_code).where(F.col("n") <= q.depth).select("ask", "row")

        def exact(parts: Iterator[pa.RecordBatch]):
            for part in parts:
                if part.num_rows:
                    score = np.round((unit(matrix(part.column(3), d)) * unit(matrix(part.column(4), d))).sum(1), 9)
                    yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(score)], names=["ask", "query_id", "vec_id", "score"])

        both = chosen.join(self.vectors, "row").join(asked, "ask").select("ask", "query_id", "vec_id", "embedding", "query")
        scored = both.mapInArrow(exact, "ask long, query_id long, vec_id long, score double")
        rank = F.row_number().over(Window.partitionBy("ask").orderBy(F.col("score").desc(), "vec_id"))
        return scored.withColumn("rank", rank).where(F.col("rank") <= self.k).drop("ask")
