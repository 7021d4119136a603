"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each text becomes a dozen statistics (shares of character classes, repetition, word shapes), put on log or logit scales.
Per class, mean and covariance come from sums over all labelled training rows, reduced on the cluster; the covariance is
shrunk towards the pooled one and towards its diagonal. The Cholesky factors are computed once and cached in the model;
the score is the logistic of the difference of the log densities (Mahalanobis distances by triangular solves).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, held_out

#: Byte classes: 0 other, 1 lower or non-ASCII letter, 2 upper, 3 digit, 4 white, 5 sentence mark, 6 bracket or quote, 7 symbol.
_CLASS = np.zeros(256, np.intp)
for _k, _bytes in enumerate([b"", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\f\v", b".,;:?", b"()[]{}\"'-", b"!#$%&*+/<=>@\\^_`|~"]):
    _CLASS[list(_bytes)] = _k
_CLASS[128:] = 1
N_STATS = 12


def statistics(text: str) -> list[float]:
    """The transformed statistics of one whole text; an empty text has those of no evidence."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    lower, upper, digit, white, mark, quote, symbol = np.bincount(_CLASS[raw], minlength=8)[1:8].tolist()
    words = text.split()
    n, chars, letters = len(words), len(raw), lower + upper
    logit = lambda a, b, k=1.0: float(np.log((a + k * 0.05) / (b - a + k)))
    kinds = len(set(words))
    again = sum(map(eq, words, words[1:]))
    far = sum(map(eq, words, words[2:])) - again
    return [
        logit(upper, letters), logit(symbol, chars), logit(digit, chars), logit(mark, chars), logit(quote, chars), logit(white, chars),
        logit(again, n), logit(max(0, far), n), float(np.log1p(kinds) / np.log1p(n)) if n else 1.0, float(np.log1p(letters / n)) if n else 0.0,
        logit(sum(not w[-1].isalnum() for w in words), n), float(np.log1p(n)),
    ]


@dataclass
class Discriminant:
    """Means, Cholesky factors and log priors of the classes 0 and 1, on standardised statistics."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    priors: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of ``x``."""
        z, logs = (x - self.centre) / self.scale, []
        for mean, factor, prior in zip(self.means, self.factors, self.priors):
            y = forward_solve(factor, (z - mean).T)
            logs.append(prior - np.log(np.diag(factor)).sum() - 0.5 * (y * y).sum(0))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def forward_solve(lower: np.ndarray, b: np.ndarray) -> np.ndarray:
    """y with ``lower`` @ y = b, row by row."""
    y = np.empty_like(b)
    for i in range(len(lower)):
        y[i] = (b[i] - lower[i, :i] @ y[:i]) / lower[i, i]
    return y


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = 0.2, diagonal: float = 0.1) -> Discriminant:
    """From (count, sum, sum of outer products) per class. A class without rows takes the pooled statistics and a count of 0.5."""
    total = sum(s[0] for s in sums.values())
    if not total:
        one = np.eye(N_STATS)
        return Discriminant(np.zeros(N_STATS), np.ones(N_STATS), [np.zeros(N_STATS)] * 2, [one, one], [np.log(0.5)] * 2)
    centre = sum(s[1] for s in sums.values()) / total
    spread = sum(s[2] for s in sums.values()) / total - np.outer(centre, centre)
    scale = np.sqrt(np.maximum(np.diag(spread), 1e-6))
    every = spread / np.outer(scale, scale)
    means, factors, priors = [], [], []
    own = {}
    for k in (0, 1):
        n, s, ss = sums.get(k, (0.0, centre * 0, spread * 0))
        mean = s / n if n else centre
        cov = (ss / n - np.outer(mean, mean)) / np.outer(scale, scale) if n else every
        own[k] = (n, (mean - centre) / scale, cov)
    within = sum(n * cov for n, _, cov in own.values()) / total
    for n, mean, cov in own.values():
        mixed = (1 - pooled) * cov + pooled * within
        mixed = (1 - diagonal) * mixed + diagonal * np.diag(np.diag(mixed)) + 1e-3 * np.eye(N_STATS)
        means.append(mean)
        factors.append(np.linalg.cholesky(mixed))
        priors.append(float(np.log((n + 0.5) / (total + 1))))
    return Discriminant(centre, scale, means, factors, priors)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stats (array of double) of every row; null counts as empty."""
    bounded_batches(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("stats", pa.list_(pa.float64()))])

    def run(parts: Iterator[pa.RecordBatch]):
        for part in parts:
            stats = [statistics(t or "") for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(stats, schema.field(1).type)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, stats array<double>")


def class_sums(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products of ``stats`` per label (rows: label, stats), reduced to one row a task first."""
    d = N_STATS
    schema = pa.schema([("label", pa.int32()), ("n", pa.float64()), ("sums", pa.list_(pa.float64()))])

    def run(parts):
        found = {}
        for part in parts:
            y, x = part.column(0).to_numpy(zero_copy_only=False), part.column(1).values.to_numpy(zero_copy_only=False)
            x = x.reshape(-1, d) if len(x) else np.zeros((0, d))
            for k in np.unique(y):
                own = x[y == k]
                n, s, ss = found.get(int(k), (0.0, np.zeros(d), np.zeros((d, d))))
                found[int(k)] = (n + len(own), s + own.sum(0), ss + own.T @ own)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([v[0] for v in found.values()]), pa.array([[*v[1], *v[2].ravel()] for v in found.values()], schema.field(2).type)], schema=schema)

    each = rows.select(F.col("label").cast("int"), "stats").mapInArrow(run, "label int, n double, sums array<double>")
    whole = each.select("label", "n", F.posexplode("sums")).groupBy("label", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("v"))
    found = {}
    for r in whole.orderBy("label", "pos").collect():  # at most 2 x (12 + 144) rows
        found.setdefault(r["label"], (r["n"], []))[1].append(r["v"])
    return {k: (n, np.array(v[:d]), np.array(v[d:]).reshape(d, d)) for k, (n, v) in found.items()}


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; fitted on ``labels`` (doc_id, quality) outside the fold.

    Null and empty texts are scored by the statistics of an empty text. Repeated rows are scored each, and count once per
    label row in the fit; null labels are left out; with no label at all every score is 0.5; a score of 0.5 predicts 1. Other
    columns are not read; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.write(document_statistics(docs).withColumn("held_out", held_out(F.col("doc_id"), folds, fold)), "stats")
    known = labels.where("quality in (0, 1)").select("doc_id", F.col("quality").alias("label"))
    sums = class_sums(stats.where("not held_out").join(known, "doc_id").select("label", "stats"))
    model = fit(sums)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(parts):
        for part in parts:
            x = part.column(2).values.to_numpy(zero_copy_only=False).reshape(-1, N_STATS)
            p = model.score(x)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], schema=schema)

    return stats.select("doc_id", "held_out", "stats").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
