"""Toxic spans and document scores by a linear-chain conditional random field.

The field has two states, clean and toxic. A token's toxic state is weighted by hashed features: the word, its beginnings and
ending, its shape, and the words before and behind it; transitions have weights of their own. Only features of several
training documents get a weight. Labels mark documents, so the tokens' labels are found in two turns: first the tokens whose
word or beginning stands in toxic documents far more often than in clean ones, behind many different words (so that copies
of one document make no cues); then, after a fit, the tokens of toxic documents that the field's own marginals hold toxic,
on which it is fitted again. Forward-backward marginals give spans (tokens of at least 0.5) and, through a logistic fitted
on the training documents, a score.

Words are runs of ASCII letters, digits, underscores and characters beyond ASCII but for punctuation, in lower case. All
documents of a batch are one sequence whose chain starts anew at each document. Forward and backward ratios are Moebius maps
of the ratio before, so blocks of tokens are composed side by side and then joined: inference is exact, for texts of any length.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, bounded_batches, carried, held_out, resident
from .fingerprint import Powers, mix

_U = np.uint64
#: Lengths in bytes of the word beginnings that are features, and of the ending.
STEMS = (4, 5, 6, 7)
ENDING = 3
#: Features a token: word, beginnings, ending, shape, word before, word behind. The first ``OWN`` can be cues.
OWN, N_FEATURES = 1 + len(STEMS), 4 + 1 + len(STEMS)
#: Hashed features fall on this many places; the place behind the last has no weight.
PLACES = 1 << 22
#: Log odds from which a cue labels a token.
STRONG = 2.0
_WORD = np.zeros(256, bool)
_WORD[128:] = True
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123)]] = True
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
#: Punctuation and blanks beyond ASCII.
_MARKS = re.compile("[\u0080-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u00d7\u00f7\u2000-\u206f\u2e00-\u2e7f\u3000-\u3003\u3008-\u3020\uff01-\uff0f]")


def plain(text: str) -> str:
    """The text in lower case, character by character, with blanks for punctuation beyond ASCII: places stay as they are."""
    low = text.lower()
    if low.isascii():
        return low
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return _MARKS.sub(" ", low)


@dataclass
class Tokens:
    """The words of some texts: owner (text number), places in the text's bytes, features by place, whether one starts a text."""

    owner: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    features: np.ndarray
    opens: np.ndarray


def tokens(texts: list[str], powers: Powers) -> Tokens:
    raw = [plain(t).encode("utf-8", "replace") for t in texts]
    buf = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
    begin = np.cumsum([1, *(len(r) + 1 for r in raw)])
    word = _WORD[buf]
    first = np.flatnonzero(~word[:-1] & word[1:]) + 1
    stop = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    size = stop - first
    up, down = powers.upto(len(buf) + 1)
    total = np.zeros(len(buf) + 1, _U)
    np.cumsum((buf.astype(_U) + _U(1)) * up[: len(buf)], out=total[1:])
    base, shift = total[first], down[first]
    put = lambda x: (x & _U(PLACES - 1)).astype(np.int32)
    features = np.full((N_FEATURES, len(first)), PLACES, np.int32)
    name = mix((total[stop] - base) * shift, 31)
    features[0] = put(name)
    for k, n in enumerate(STEMS, 1):
        longer = np.flatnonzero(size > n)
        at = first[longer]
        features[k, longer] = put(mix((total[at + n] - base[longer]) * shift[longer], 40 + n))
    longer = np.flatnonzero(size > ENDING + 1)
    at = stop[longer] - ENDING
    features[OWN, longer] = put(mix((total[stop[longer]] - total[at]) * down[at], 50))
    digits = np.concatenate([[0], np.cumsum(_DIGIT[buf])])
    features[OWN + 1] = put(mix((np.minimum(size, 20) * 2 + (digits[stop] > digits[first])).astype(_U), 51))
    owner = np.searchsorted(begin, first, "right") - 1
    opens = np.ones(len(first), bool)
    opens[1:] = owner[1:] != owner[:-1]
    inner = np.flatnonzero(~opens)
    features[OWN + 2, inner] = put(mix(name[inner - 1], 52))
    features[OWN + 3, inner - 1] = put(mix(name[inner], 53))
    return Tokens(owner, first - begin[owner], stop - begin[owner], features, opens)


def all_tokens(texts: list[str], most_chars: int = 1_000_000) -> Tokens:
    """The tokens of many texts, made in batches so that only their features are held."""
    powers, parts = Powers(), []
    for a, b in batches(texts, most_chars):
        part = tokens(texts[a:b], powers)
        part.owner = (part.owner + a).astype(np.int32)
        parts.append(part)
    if not parts:
        return tokens([], powers)
    return Tokens(*(np.concatenate([getattr(p, name) for p in parts], -1) for name in ("owner", "start", "stop", "features", "opens")))


def chained(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """x with x[t] = (a[t] x[t-1] + b[t]) / (c[t] x[t-1] + d[t]) and 1 before the first, all coefficients positive or 0.

    Blocks of tokens are composed side by side; the blocks' maps then give each block's first value.
    """
    n = len(a)
    if not n:
        return np.zeros(0)
    long = max(1, min(128, int(math.sqrt(n / 8))))
    wide = -(-n // long)
    pad = lambda x, v: np.concatenate([x, np.full(wide * long - n, v)]).reshape(wide, long).T.copy()
    a, b, c, d = pad(a, 1.0), pad(b, 0.0), pad(c, 0.0), pad(d, 1.0)
    p, q, r, s = a[0], b[0], c[0], d[0]
    for t in range(1, long):
        p, q, r, s = a[t] * p + b[t] * r, a[t] * q + b[t] * s, c[t] * p + d[t] * r, c[t] * q + d[t] * s
        if t % 4 == 0:
            norm = 1 / (p + q + r + s)
            p, q, r, s = p * norm, q * norm, r * norm, s * norm
    x, at = 1.0, np.empty(wide)
    for k, (e, f, g, h) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist())):
        at[k] = x
        x = (e * x + f) / (g * x + h)
    out = np.empty((long, wide))
    for t in range(long):
        out[t] = at = (a[t] * at + b[t]) / (c[t] * at + d[t])
    return out.T.ravel()[:n]


def ratios(emit: np.ndarray, opens: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward ratios of the toxic to the clean state at every token, and the emission weights' exponentials."""
    (m00, m01), (m10, m11) = np.exp(move)
    e = np.exp(np.clip(emit, -25.0, 25.0))
    forward = chained(np.where(opens, 0.0, e * m11), np.where(opens, e, e * m01), np.where(opens, 0.0, m10), np.where(opens, 1.0, m00))
    last, later = np.append(opens[1:], True), np.append(e[1:], 1.0)
    back = chained(*(x[::-1] for x in (np.where(last, 0.0, later * m11), np.where(last, 1.0, m10), np.where(last, 0.0, later * m01), np.where(last, 1.0, m00))))[::-1]
    return forward, back, e


def marginals(emit: np.ndarray, opens: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Probability of the toxic state at every token."""
    forward, back, _ = ratios(emit, opens, move)
    both = forward * back
    return both / (1 + both)


@dataclass
class Field:
    """Places with a weight and their weights, the transitions, and the logistic of the document score."""

    places: np.ndarray
    weights: np.ndarray
    move: np.ndarray
    logistic: np.ndarray

    def table(self) -> np.ndarray:
        out = np.zeros(PLACES + 1, np.float32)
        out[self.places] = self.weights
        return out


def evidence(p: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` documents what its score rests on: 1, the largest marginal as log odds, the log of the expected toxic tokens.

    Marginals under 0.2 don't add up: else a long text would be toxic by its length."""
    top = np.zeros(n)
    np.maximum.at(top, owner, p)
    top = np.minimum(top, 1 - 1e-6)
    many = np.bincount(owner, weights=np.where(p >= 0.2, p, 0.0), minlength=n)
    return np.stack([np.ones(n), np.maximum(-8.0, np.log((top + 1e-9) / (1 - top))), np.log1p(many)], 1)


def emissions(table: np.ndarray, features: np.ndarray) -> np.ndarray:
    """The sum of each token's weights."""
    out = np.zeros(features.shape[1])
    for f in features:
        out += table[f]
    return out


def score(model: Field, table: np.ndarray, texts: list[str], powers: Powers) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """The documents' scores, and their toxic spans (start, end in code points, mean marginal)."""
    found = tokens(texts, powers)
    p = marginals(emissions(table, found.features), found.opens, model.move)
    x = evidence(p, found.owner, len(texts))
    spans: list[list[tuple[int, int, float]]] = [[] for _ in texts]
    bad = np.flatnonzero(p >= 0.5)
    if len(bad):
        cut = np.flatnonzero((np.diff(bad) > 1) | found.opens[bad[1:]]) + 1
        for run in np.split(bad, cut):
            i = int(found.owner[run[0]])
            raw = plain(texts[i]).encode("utf-8", "replace")
            place = lambda at: len(raw[:at].decode("utf-8", "replace"))  # noqa: B023, E731
            spans[i].append((place(found.start[run[0]]), place(found.stop[run[-1]]), float(p[run].mean())))
    return 1 / (1 + np.exp(-np.clip(x @ model.logistic, -30, 30))), spans


def distinct(owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of two numbers, the second one a place."""
    both = np.sort((owner.astype(np.int64) << 24) | place)
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    return both >> 24, both & ((1 << 24) - 1)


def document_counts(found: Tokens, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By place: toxic and clean documents that have it as a word or beginning, and documents that have it as any feature."""
    bad, good, every = (np.zeros(PLACES + 1, np.int32) for _ in range(3))
    for k, f in enumerate(found.features):
        docs, places = distinct(found.owner, f)
        every += np.bincount(places, minlength=PLACES + 1).astype(np.int32)
        if k < OWN:
            side = toxic[docs] == 1
            bad += np.bincount(places[side], minlength=PLACES + 1).astype(np.int32)
            good += np.bincount(places[~side], minlength=PLACES + 1).astype(np.int32)
    every[PLACES] = bad[PLACES] = 0
    return bad, good, every


def find_cues(found: Tokens, bad: np.ndarray, good: np.ndarray, toxic: np.ndarray, least: int, share: float) -> np.ndarray:
    """Log odds by place of words and beginnings that are cues, else 0, from the documents that have them.

    A cue needs ``least`` toxic documents, ``share`` of them all, and left neighbours that differ in at least 0.4 of them.
    """
    n1, n0 = int(toxic.sum()), int(len(toxic) - toxic.sum())
    able = bad >= max(least, share * n1)
    lefts, mine = np.zeros(PLACES + 1, np.int32), np.flatnonzero(toxic[found.owner] == 1)
    for f in found.features[:OWN]:
        here = mine[able[f[mine]]]
        lefts += np.bincount(distinct(found.features[OWN + 2][here], f[here])[1], minlength=PLACES + 1).astype(np.int32)
    odds = np.zeros(PLACES + 1, np.float32)
    at = np.flatnonzero(able)
    at = at[lefts[at] >= np.maximum(least, 0.4 * bad[at])]
    odds[at] = np.log((bad[at] + 0.5) / (n1 + 1)) - np.log((good[at] + 0.5) / (n0 + 1))
    return odds


def climb(features: np.ndarray, n: int, opens: np.ndarray, y: np.ndarray, weight: np.ndarray, move: np.ndarray, rounds: int, l2: float, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the ``n`` features in use (the last has none) and transitions after steps up the conditional likelihood."""
    pull, pull_move = np.full(n, 1e-2), np.full((2, 2), 1e-2)
    inner = np.flatnonzero(~opens)
    before = y[inner - 1] * 2 + y[inner]
    gold = np.bincount(before, minlength=4).reshape(2, 2).astype(float)
    for _ in range(rounds):
        f, b, e = ratios(emissions(weight, features), opens, move)
        both = f * b
        off = y - both / (1 + both)
        grad = -l2 * weight
        for x in features:
            grad += np.bincount(x, weights=off, minlength=n)
        grad[-1] = 0.0
        (m00, m01), (m10, m11) = np.exp(move)
        r, eq = f[inner - 1], e[inner] * b[inner]
        joint = np.stack([np.full(len(r), m00), m01 * eq, m10 * r, m11 * r * eq])
        grad_move = gold - (joint / joint.sum(0)).sum(1).reshape(2, 2) - l2 * move
        pull, pull_move = pull + grad**2, pull_move + grad_move**2
        weight, move = weight + rate * grad / np.sqrt(pull), move + rate * grad_move / np.sqrt(pull_move)
    return weight, move


def fit(texts: list[str], toxic: list[int], weights: list[float], least: int = 3, share: float = 0.01, rounds: int = 16, l2: float = 2.0) -> Field:
    """A field from whole texts, document labels and sampling weights. Without both labels every score is the mean label (or 0)."""
    mean = float(np.average(toxic, weights=weights)) if toxic else 0.0
    prior = math.log((mean + 1e-3) / (1 - mean + 1e-3))
    none = Field(np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros((2, 2)), np.array([prior, 0.0, 0.0]))
    if not toxic or min(toxic) == max(toxic):
        return none
    label = np.array(toxic)
    found = all_tokens(texts)
    if not len(found.owner):
        return none
    mine = label[found.owner] == 1
    bad, good, every = document_counts(found, label)
    odds = find_cues(found, bad, good, label, least, share)
    y = (mine & (np.max([odds[f] for f in found.features[:OWN]], axis=0) >= STRONG)).astype(np.int64)
    # features of several documents, numbered from 0
    used = np.flatnonzero(every >= least)
    del bad, good, every, odds
    number = np.full(PLACES + 1, len(used), np.int32)
    number[used] = np.arange(len(used))
    features, owner, opens = number[found.features], found.owner, found.opens
    del found, number
    weight, move = np.zeros(len(used) + 1), np.zeros((2, 2))
    for turn, steps in enumerate((rounds, rounds // 2)):
        weight, move = climb(features, len(used) + 1, opens, y, weight, move, steps, l2)
        if turn == 0:
            y = (mine & (marginals(emissions(weight, features), opens, move) >= 0.5)).astype(np.int64)
    x = evidence(marginals(emissions(weight, features), opens, move), owner, len(texts))
    w, theta = np.array(weights), np.array([prior, 0.0, 0.0])
    for _ in range(50):  # Newton steps of a ridge logistic
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (w * (label - p)) - 0.5 * theta * [0, 1, 1]
        hess = x.T @ (x * (w * p * (1 - p))[:, None]) + 0.5 * np.diag([1e-6, 1, 1])
        theta = theta + np.linalg.solve(hess, grad)
    keep = np.abs(weight[:-1]) > 0.02
    return Field(used[keep], weight[:-1][keep].astype(np.float32), move, theta)


def training_sample(docs: DataFrame, labels: DataFrame, folds: int, fold: int, most: dict[int, int], most_chars: int) -> DataFrame | None:
    """doc_id, text, toxic, weight of at most ``most[label]`` labelled training rows per label, by hash order of their ids; None without any."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"), folds, fold)).select("doc_id", "toxic").distinct()
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30))
    share = F.lit(0)
    for k, n in counts.items():
        share = F.when(F.col("toxic") == k, F.lit(int((1 << 30) * min(1.0, most[k] / n)) + 1)).otherwise(share)
    ids = known.withColumn("at", draw).where(F.col("at") < share)
    picked: dict[int, list[tuple[int, int]]] = {}
    for r in ids.toLocalIterator():  # about the sum of ``most`` rows, whatever the corpus
        picked.setdefault(r["toxic"], []).append((r["at"], r["doc_id"]))
    rows = [(i, k, counts[k] / min(len(v), most[k])) for k, v in picked.items() for _, i in sorted(v)[: most[k]]]
    if not rows:
        return None
    chosen = docs.sparkSession.createDataFrame(rows, "doc_id long, toxic int, weight double")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull() & (F.length("text") <= most_chars)).join(F.broadcast(chosen), "doc_id")
    # one text an id, whatever repeats: partial aggregation leaves at most one row an id and task
    return found.groupBy("doc_id", "toxic", "weight").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def fitted(sample: DataFrame | None) -> Field:
    """The field of a sample, fitted in one task on the cluster; the driver gets its places and weights alone."""
    names = ["places", "weights", "move", "logistic"]

    def run(parts: Iterator[pa.RecordBatch]):
        rows = [row for part in parts for row in zip(*(c.to_pylist() for c in part.columns))]
        model = fit([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])
        kinds = {"places": "<i8", "weights": "<f4", "move": "<f8", "logistic": "<f8"}
        yield pa.RecordBatch.from_arrays([pa.array([getattr(model, n).astype(kinds[n]).tobytes()]) for n in names], names=names)

    if sample is None:
        return fit([], [], [])
    ordered = sample.repartition(1).sortWithinPartitions("doc_id", "toxic").select("text", "toxic", "weight")
    row = ordered.mapInArrow(run, ", ".join(f"{n} binary" for n in names)).first()
    if row is None:
        return fit([], [], [])
    read = lambda name, kind: np.frombuffer(row[name], kind)
    return Field(read("places", "<i8"), read("weights", "<f4"), read("move", "<f8").reshape(2, 2), read("logistic", "<f8"))




def tag_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, most_toxic: int = 1200, most_clean: int = 2400, most_chars: int = 20_000, threshold: float = 0.3, carry: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (start, end, marginal) of every row, from whole texts.

    With ``carry`` the rows' columns come along as ``_carried0``, ....

    The field is fitted on a bounded sample of labelled rows outside the held-out fold: at most ``most_toxic`` and
    ``most_clean``, none longer than ``most_chars``, one text a doc_id (the lowest hash where it has several); all of their
    tokens are trained on. Null and empty texts have no tokens and get the score of a text without evidence, as every text
    does where the labels do not tell two classes apart. A doc_id labelled both ways counts once each way. Scores that tie at
    the threshold are toxic. Offsets count code points, the end excluded. Repeated rows are scored each; other columns are
    not read; an empty table gives an empty result.
    """
    bounded_batches(docs)
    model = fitted(training_sample(docs, labels, folds, fold, {1: most_toxic, 0: most_clean}, most_chars))
    name = zlib.crc32(model.places.tobytes() + model.weights.tobytes() + model.logistic.tobytes())
    more, kinds, names = carried(docs, carry)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
    own_names = ["doc_id", "held_out", "score", "predicted", "spans", *(f"_carried{i}" for i in range(len(names)))]

    def run(parts: Iterator[pa.RecordBatch]):
        powers, table = resident("powers", 0, Powers), resident("toxic places", name, model.table)
        for part in parts:
            texts = part.column(2).to_pylist()
            for a, b in batches(texts, 1_000_000):
                scores, found = score(model, table, [t or "" for t in texts[a:b]], powers)
                spans = [[{"start": s, "end": e, "marginal": m} for s, e, m in x] for x in found]
                ids, held, _, *rest = (c.slice(a, b - a) for c in part.columns)
                yield pa.RecordBatch.from_arrays([ids, held, pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32)), pa.array(spans, span), *rest], names=own_names)

    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), folds, fold).alias("held_out"), F.col("text").cast("string").alias("text"), *more)
    return mine.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int,marginal:double>>" + kinds)
