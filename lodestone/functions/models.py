"""Model and strategy boundaries: registered functions behind Arrow, with offline stand-ins. No code is ever loaded from text."""

from __future__ import annotations

import ast
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tables import resident

from ..operators.series import resize


class TextModel(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class Canned:
    """Answers every prompt alike: the offline stand-in."""

    def __init__(self, answer: str):
        self.answer = answer

    def generate(self, prompts: list[str]) -> list[str]:
        return [self.answer] * len(prompts)


def generate(prompt: Column, model: TextModel) -> Column:
    """The model's answers, in Arrow batches."""

    @F.pandas_udf("string")
    def answer(prompts: pd.Series) -> pd.Series:
        return pd.Series(model.generate(prompts.fillna("").tolist()))

    return answer(prompt)


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Hashed:
    """Unit vectors from hashed words: the offline stand-in of an embedding service."""

    def __init__(self, dimension: int):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dimension
            for w in t.lower().split():
                v[zlib.crc32(w.encode()) % self.dimension] += 1.0
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / norm for x in v])
        return out


def embed(text: Column, model: Embedder, dimension: int) -> Column:
    """Vectors of the texts in Arrow batches; where the model fails, zeros."""

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        try:
            return pd.Series(model.embed(texts.fillna("").tolist()))
        except OSError:
            return pd.Series([[0.0] * dimension] * len(texts))

    return vectors(text)


def valid_syntax(code: Column) -> Column:
    """Whether the text parses as Python; it is not run."""

    @F.pandas_udf("boolean")
    def parses(texts: pd.Series) -> pd.Series:
        def one(t: str) -> bool:
            try:
                ast.parse(t or "")
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                return False
            return True

        return texts.map(one)

    return parses(code)


# Channel means and spreads of the image model's input.
MEANS, SPREADS = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def model_input(image: np.ndarray, size: int = 224) -> np.ndarray:
    """3 x size x size floats of an image: bytes, or floats up to 1 or up to 255; channels last or (three of them) first."""
    if image.ndim == 3 and image.shape[0] == 3:
        image = image.transpose(1, 2, 0)
    if image.dtype.kind == "f":
        image = image * 255 if image.max(initial=0.0) <= 1 else image
    scaled = image.astype(np.uint8).astype(float) / 255
    side = min(scaled.shape[:2])
    top, left = (scaled.shape[0] - side) // 2, (scaled.shape[1] - side) // 2
    square = scaled[top : top + side, left : left + side]
    sized = np.stack([resize(square[..., c], size) for c in range(3)])
    return (sized - np.reshape(MEANS, (3, 1, 1))) / np.reshape(SPREADS, (3, 1, 1))


class ImageModel(Protocol):
    def features(self, batch: np.ndarray) -> np.ndarray: ...

    def logits(self, features: np.ndarray) -> dict[str, np.ndarray]: ...


class Pooled:
    """The offline stand-in of an image model: averages of 16 x 16 patches as 768 features, fixed sums of them as logits."""

    #: The heads and their numbers of classes.
    HEADS = {"regime": 4, "direction": 3, "volatility": 4}

    def features(self, batch: np.ndarray) -> np.ndarray:
        n, channels, side, _ = batch.shape
        cut = np.linspace(0, side, 17).astype(int)[:-1]
        return np.add.reduceat(np.add.reduceat(batch, cut, 2), cut, 3).reshape(n, -1) / (side / 16) ** 2

    def logits(self, features: np.ndarray) -> dict[str, np.ndarray]:
        return {name: np.stack([features[:, k::n].mean(1) for k in range(n)], 1) for name, n in self.HEADS.items()}


def predictions(images: DataFrame, by: str, model: ImageModel, heads: dict[str, int], size: int = 224, with_features: bool = False) -> DataFrame:
    """``by``, the logits of each head (arrays of double) and, if wanted, the features of images (height, width, image bytes).

    Images of an Arrow batch go through the model together; softmax and arg max are left to column expressions.
    """
    kind = images.schema[by].dataType.simpleString()
    schema = f"{by} {kind}, " + ", ".join(f"{h} array<double>" for h in heads) + ", features array<float>" * with_features

    def run(parts: Iterator[pd.DataFrame]):
        for part in parts:
            if not len(part):
                continue
            batch = np.stack([model_input(np.frombuffer(d, np.uint8).reshape(h, w, 3), size) for h, w, d in zip(part["height"], part["width"], part["image"])])
            features = model.features(batch)
            out = {by: part[by].to_numpy()} | {h: v.tolist() for h, v in model.logits(features).items() if h in heads}
            yield pd.DataFrame(out | ({"features": features.tolist()} if with_features else {}))

    return images.select(by, "height", "width", "image").mapInPandas(run, schema)


#: Reviewed strategies by name: a frame of one series in, a decision out.
STRATEGIES: dict[str, Callable[[pd.DataFrame], str]] = {}


def strategy(name: str):
    def add(run: Callable[[pd.DataFrame], str]):
        STRATEGIES[name] = run
        return run

    return add


@strategy("last_move")
def last_move(data: pd.DataFrame) -> str:
    if len(data) < 2:
        return "flat"
    change = data["value"].iloc[-1] - data["value"].iloc[-2]
    return "long" if change > 0 else "short" if change < 0 else "flat"


def run_strategy(bars: DataFrame, name: str, by: str, order: str) -> DataFrame:
    """``by`` and the decision of a registered strategy; another answer is flat, a failing one null. One series a task."""
    chosen, kind = STRATEGIES[name], bars.schema[by].dataType.simpleString()

    def one(part: pd.DataFrame) -> pd.DataFrame:
        try:
            said = chosen(part.sort_values(order).reset_index(drop=True))
            said = said if said in ("long", "short", "flat") else "flat"
        except Exception:  # noqa: BLE001  a strategy that fails decides nothing
            said = None
        return pd.DataFrame({by: [part[by].iloc[0]], "decision": [said]})

    return bars.groupBy(by).applyInPandas(one, f"{by} {kind}, decision string")


#: Bytes of text that a worker encodes at a time; an encoding takes some two hundred bytes a token while it lives.
CHARACTERS = 400_000


def slices(part: pa.RecordBatch, text: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts, column number ``text``, have ``most`` bytes together; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(part.column(text)), 0).to_numpy(zero_copy_only=False).tolist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held + n > most and i > start:
            yield part.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield part.slice(start)


def token_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of a ``tokenizers`` file without special tokens; ``path`` must be readable on every executor. A null text has none.

    A worker keeps the tokenizer from task to task.
    """

    def run(parts: Iterator[pa.RecordBatch]):
        from tokenizers import Tokenizer

        own = resident("tokenizer", path, lambda: Tokenizer.from_file(path))
        for part in parts:
            for some in slices(part, 1, CHARACTERS):
                found = [np.array(e.ids, np.int32) for e in own.encode_batch([t or "" for t in some.column(1).to_pylist()], add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def tokenised(docs: DataFrame, encode: Callable[[str], list[int]], most: int, pad: int) -> DataFrame:
    """doc_id, input_ids, attention_mask, cut at and padded to ``most``; ``encode`` is pluggable."""

    def run(parts: Iterator[pd.DataFrame]):
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "ids": [encode(t or "")[:most] for t in part["text"]]})

    ids = docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids array<int>")
    gap = F.lit(most) - F.size("ids")
    return ids.select("doc_id", F.concat("ids", F.array_repeat(F.lit(pad), gap)).alias("input_ids"), F.concat(F.array_repeat(F.lit(1), F.size("ids")), F.array_repeat(F.lit(0), gap)).alias("attention_mask"))


def refined(rows: DataFrame, confidence: str, step: Callable[[DataFrame], DataFrame], threshold: float, rounds: int = 3) -> DataFrame:
    """Rows below the threshold go through ``step`` again, at most ``rounds`` times: ``refinements`` counts. The rows stay distributed."""
    open_, done = rows.withColumn("refinements", F.lit(0)), None
    for _ in range(rounds):
        sure = open_.where(F.col(confidence) >= threshold)
        done = sure if done is None else done.unionByName(sure)
        again = step(open_.where(~(F.col(confidence) >= threshold) | F.col(confidence).isNull()))
        open_ = again.withColumn("refinements", F.col("refinements") + 1)
    return open_ if done is None else done.unionByName(open_)
