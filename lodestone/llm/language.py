"""Language identification by string kernels.

A text is the set of its character n-grams of blended lengths (1 to 3), over lower-cased characters. The alphabet has a-z,
one symbol for everything that is no letter, and 101 symbols that all further letters share by code point: alphabets of a
hundred letters keep theirs apart, while the signs of larger scripts fall on one another. The kernel of two texts
is the sum over the lengths of their normalised numbers of common n-grams. Some training texts serve as Nyström landmarks;
the kernel rows against them are mapped to Nyström features, on which one-versus-rest kernel ridge regression is solved.
Scoring multiplies batches: the (texts x n-grams) presence matrix with the (n-grams x languages) matrix into which the
landmarks and dual weights are folded once, since the kernel is linear in presence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, bounded_batches, carried, held_out

#: Symbols of the kernel's alphabet: 0 everything that is no letter, 1-26 a-z, the others for further letters by code point.
SYMBOLS = 128
LENGTHS = (1, 2, 3)


def symbols(text: str) -> np.ndarray:
    """The text as symbols: lower-cased, runs of other characters as one 0, a 0 at either end."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    plain = (code >= 97) & (code <= 122)
    rest = (code >= 0xAA) & (code != 0xD7) & (code != 0xF7) & ~((code >= 0x2000) & (code < 0x2C00)) & ~((code >= 0x3000) & (code < 0x3041))
    out = np.where(plain, code - 96, np.where(rest, 27 + code * 2654435761 % 2**32 % (SYMBOLS - 27), 0))
    out = np.concatenate([[0], out, [0]])
    return out[np.concatenate([[True], (out[1:] != 0) | (out[:-1] != 0)])]


def codes(text: str) -> list[np.ndarray]:
    """For each length the n-gram at every place, as an integer below SYMBOLS ** length."""
    s = symbols(text)
    out, now = [], s
    for n in LENGTHS:
        if n > 1:
            now = now[:-1] * SYMBOLS + s[n - 1 :] if len(s) >= n else now[:0]
        out.append(now)
    return out


@dataclass
class KernelModel:
    """For each length a table from n-gram code to column (0: unknown) and the folded weights; the languages; the offsets."""

    languages: list[str]
    tables: list[np.ndarray]
    weights: list[np.ndarray]
    offset: np.ndarray
    sharpness: float

    def margins(self, texts: list[str], rows: int = 64) -> np.ndarray:
        out = np.zeros((len(texts), len(self.languages)))
        for a in range(0, len(texts), rows):
            found = [codes(t) for t in texts[a : a + rows]]
            for k, (table, weight) in enumerate(zip(self.tables, self.weights)):
                present = np.zeros((len(found), len(weight)), np.float32)
                for i, f in enumerate(found):
                    present[i, table[f[k]]] = 1
                present[:, 0] = 0
                norm = np.sqrt(np.maximum(present.sum(1, keepdims=True), 1))
                out[a : a + rows] += (present @ weight) / norm
        return out + self.offset

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        m = self.margins(texts) * self.sharpness
        p = np.exp(m - m.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        at = p.argmax(1)
        return [self.languages[i] for i in at], p[np.arange(len(at)), at]


def fit(texts: list[str], langs: list[str], n_landmarks: int = 240, ridge: float = 1e-2) -> KernelModel:
    """Landmarks are dealt evenly over the languages, in the order of the rows."""
    languages = sorted(set(langs))
    if not languages:
        return KernelModel([], [], [], np.zeros(0), 1.0)
    y = np.array([[1.0 if g == x else -1.0 for x in languages] for g in langs])
    per = -(-n_landmarks // len(languages))
    marks = sorted(i for x in languages for i in [j for j, g in enumerate(langs) if g == x][:per])
    found = [codes(t) for t in texts]
    tables, presents = [], []
    kernel = 0.0
    for k, n in enumerate(LENGTHS):
        seen = np.unique(np.concatenate([np.unique(found[i][k]) for i in marks]))
        table = np.zeros(SYMBOLS**n, np.int32)
        table[seen] = np.arange(1, len(seen) + 1)
        present = np.zeros((len(texts), len(seen) + 1), np.float32)
        for i, f in enumerate(found):
            present[i, table[f[k]]] = 1
        present[:, 0] = 0
        present /= np.sqrt(np.maximum(present.sum(1, keepdims=True), 1))
        kernel = kernel + present @ present[marks].T
        tables.append(table)
        presents.append(present[marks])
    kernel = np.asarray(kernel, np.float64)
    values, vectors = np.linalg.eigh(kernel[marks])
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])  # Nyström map
    z = kernel @ root
    share = np.array([langs.count(g) for g in langs], float)
    w = (1 / share)[:, None]  # each language weighs alike
    mean = (z * w).sum(0) / w.sum()
    target = (y * w).sum(0) / w.sum()
    c = z - mean
    beta = np.linalg.solve(c.T @ (c * w) + ridge * np.eye(c.shape[1]) / max(1, len(languages)), c.T @ ((y - target) * w))
    dual = root @ beta
    margin = kernel @ dual + (target - mean @ beta)
    gap = np.sort(margin, 1)
    wide = float(np.median(gap[:, -1] - gap[:, -2])) if len(languages) > 1 else 1.0
    return KernelModel(languages, tables, [(p.T @ dual).astype(np.float32) for p in presents], target - mean @ beta, 4.0 / max(wide, 1e-3))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def training_sample(docs: DataFrame, folds: int, fold: int, per_language: int, most_chars: int, most_languages: int, most_texts: int) -> list[tuple[str, str]]:
    """(text, lang) of at most ``per_language`` training rows of each of the most frequent languages, by hash order.

    Rows without a letter or of more than ``most_chars`` code points are not sampled, repeated rows once. The lowest hashes of
    (doc_id, text) are picked on the cluster; the driver gets at most ``most_texts`` rows, whatever repeats.
    """
    text = F.col("text").cast("string")
    rows = docs.where(F.col("lang").isNotNull() & text.isNotNull() & ~held_out(F.col("doc_id"), folds, fold) & (F.length(text) <= most_chars) & text.rlike(r"\p{L}"))
    rows = rows.select("lang", text.alias("text"), F.pmod(F.xxhash64("doc_id", text, F.lit(17)), F.lit(1 << 50)).alias("draw"))
    several = F.approx_count_distinct("draw").alias("several")  # repeated rows draw alike
    counts = rows.groupBy("lang").agg(F.count("*").alias("count"), several).orderBy(F.col("count").desc(), "lang").limit(most_languages).collect()
    if not counts:
        return []
    each = max(1, min(per_language, most_texts // len(counts)))
    shares = [(r["lang"], int((1 << 50) * min(1.0, 1.5 * each / max(1, r["several"]))) + 1) for r in counts]
    few = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, share long"))
    drawn = rows.join(few, "lang").where("draw < share").groupBy("lang", "draw").agg(F.min("text").alias("text"))
    ranked = drawn.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).where(F.col("no") <= each)
    return [(r["text"], r["lang"]) for r in ranked.orderBy("lang", "no").toLocalIterator()]


def identify(docs: DataFrame, folds: int = 5, fold: int = 0, per_language: int = 400, n_landmarks: int = 240, most_chars: int = 20_000, most_languages: int = 100, most_texts: int = 4000, carry: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, from whole texts; with ``carry`` also its columns as ``_carried0``, ...

    The model is fitted on a bounded sample of rows with a language outside the held-out fold: at most ``per_language`` texts
    of each of the ``most_languages`` most frequent languages, ``most_texts`` in all, none longer than ``most_chars``. Texts
    that are null or have no letter are ``und`` with score 0, as are all texts if nothing could be learned. Languages that tie
    go by name. Repeated rows are predicted each; other columns are not read; an empty table gives an empty result.
    """
    bounded_batches(docs)
    sample = training_sample(docs, folds, fold, per_language, most_chars, most_languages, most_texts)
    model = fit([t for t, _ in sample], [x for _, x in sample], n_landmarks)
    more, kinds, names = carried(docs, carry)
    own_names = ["doc_id", "held_out", "lang_pred", "score", *(f"_carried{i}" for i in range(len(names)))]

    def run(parts: Iterator[pa.RecordBatch]):
        for part in parts:
            texts = part.column(2).to_pylist()
            for a, b in batches(texts):
                own = [t if has_letter(t) else None for t in texts[a:b]]
                found, scores = model.predict([t or "" for t in own])
                found = [n if t else "und" for n, t in zip(found, own)]
                scores = [float(s) if t else 0.0 for s, t in zip(scores, own)]
                ids, held, _, *rest = (c.slice(a, b - a) for c in part.columns)
                yield pa.RecordBatch.from_arrays([ids, held, pa.array(found, pa.string()), pa.array(scores, pa.float64()), *rest], names=own_names)

    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), folds, fold).alias("held_out"), F.col("text").cast("string").alias("text"), *more)
    return mine.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double" + kinds)
