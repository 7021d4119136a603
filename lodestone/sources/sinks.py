"""Sinks: JSON lines, CSV, images as text, bucketed tables."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.series import resize


def write_jsonl(samples: DataFrame, path: str, columns: list[str] | None = None) -> None:
    samples.select(*(columns or ["text", "source"])).write.mode("overwrite").json(path)


def write_synthetic(samples: DataFrame, path: str, kind: str = "jsonl") -> int:
    """instruction, response, text, source, type as JSON lines; returns how many. Other kinds are an error."""
    if kind != "jsonl":
        raise ValueError(f"unknown kind: {kind}")
    rows = samples.select("instruction", "response", "text", F.lit("synthetic").alias("source"), F.col("kind").alias("type"))
    rows.write.mode("overwrite").json(path)
    return rows.count()


def write_csv(rows: DataFrame, path: str) -> bool:
    """CSV with a header, nested columns as JSON; without rows nothing is written and the answer is False."""
    if rows.isEmpty():
        return False
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("struct", "map", "array") else F.col(f.name) for f in rows.schema]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(path)
    return True


def save_table(rows: DataFrame, name: str, by: str, buckets: int, path: str | None = None) -> None:
    """A table bucketed and sorted by a key: later joins and lookups on it do not shuffle. With ``path`` its files stand there."""
    writer = rows.write.mode("overwrite").format("parquet").bucketBy(buckets, by).sortBy(by)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def save_knowledge(rows: DataFrame, path: str) -> None:
    """All knowledge rows as JSON lines, in place of what stood there."""
    rows.select("category", "key", "value", "metadata", "created_at", "updated_at").write.mode("overwrite").json(path)


def append_vectors(rows: DataFrame, path: str) -> None:
    """Appends vectors; the folder is made if it is missing."""
    rows.write.mode("append").parquet(path)


def png(pixels: np.ndarray) -> bytes:
    """An RGB image as PNG bytes."""
    h, w, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


#: Fixed colours of the map from low to high: dark blue, teal, yellow.
COLOURS = [(68, 1, 84), (33, 145, 140), (253, 231, 37)]


def coloured(field: np.ndarray) -> np.ndarray:
    """Height x width x 3 bytes of a field in [-1, 1] through the colour map."""
    at = np.clip((field + 1) / 2, 0, 1) * (len(COLOURS) - 1)
    return np.stack([np.interp(at, range(len(COLOURS)), [c[k] for c in COLOURS]) for k in range(3)], -1).round().astype(np.uint8)


def field_pictures(series: DataFrame, by: str, values: str, size: int = 224, dual: bool = False) -> DataFrame:
    """``by``, height, width, image of the sum field through the colour map; ``dual`` puts the difference field beside it."""
    kind = series.schema[by].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]):
        for part in parts:
            made = []
            for v in part[values]:
                v = np.asarray(v, float)
                low, high = v.min(), v.max()
                x = 2 * (v - low) / (high - low) - 1 if high > low else np.full_like(v, -1.0)
                s = np.sqrt(np.maximum(0, 1 - x * x))
                fields = [np.outer(x, x) - np.outer(s, s)] + [np.outer(s, x) - np.outer(x, s)] * dual
                made.append(np.concatenate([coloured(resize(f, size)) for f in fields], 1))
            yield pd.DataFrame({by: part[by], "height": [m.shape[0] for m in made], "width": [m.shape[1] for m in made], "image": [m.tobytes() for m in made]})

    return series.select(by, values).mapInPandas(run, f"{by} {kind}, height int, width int, image binary")


def images_base64(images: DataFrame, by: str, most: int | None = None) -> DataFrame:
    """``by`` and png (base64) of images (height, width, image); with ``most``, only texts shorter than that."""
    kind = images.schema[by].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]):
        for part in parts:
            made = [png(np.frombuffer(d, np.uint8).reshape(h, w, 3)) for h, w, d in zip(part["height"], part["width"], part["image"])]
            yield pd.DataFrame({by: part[by], "png": made})

    coded = images.select(by, "height", "width", "image").mapInPandas(run, f"{by} {kind}, png binary").select(by, F.base64("png").alias("png"))
    return coded if most is None else coded.where(F.length("png") < most)
