"""What the training-data operators share: input tables, written intermediate tables, and a join that survives hot keys."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Groups with more than this share of all rows count as hot; there are at most ``1 / HOT_SHARE`` of them.
HOT_SHARE = 0.001


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables in the shared folder named by ``spark.checkpoint.dir``.

    A written table cuts the lineage: a lost executor costs the running stage only. ``drop`` removes a table that is no
    longer read; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="lodestone-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._remove, self.root)

    def write(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        """Write and read back; the schema is given, so reading starts no job."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path, compression=compression)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._remove(f"{self.root}/{name}")

    def _remove(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        if jvm is None:
            return
        try:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may have ended; the folder's owner clears it
            return


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row per group, safe for hot groups.

    Groups above ``HOT_SHARE`` of ``total`` rows number at most ``1 / HOT_SHARE``, so broadcasting them is bounded at any
    scale; the rest is joined by a shuffle in which no key holds more than that share. ``rows`` is read twice and should be
    a written table. Keys must not be null.
    """
    least = max(1, int(total * HOT_SHARE))
    hot, cold = groups.where(F.col(size) > least), groups.where(F.col(size) <= least)
    few = F.broadcast(hot)
    return rows.join(few, keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))


def sieve(rows: DataFrame, key: str, wanted: DataFrame, bits: int = 24) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``wanted`` (a column of that name), before they are shuffled.

    A bitmap of hashed keys, 2 ** ``bits`` bits whatever the number of keys, goes over the driver to all workers (2 MB, and
    as many words of 64 bits to the driver at most). It lets every wanted row pass, and others the more, the fuller it is.
    """
    place = F.pmod(F.xxhash64(key, F.lit(31)), F.lit(1 << bits)).cast("int")
    words = wanted.select(place.alias("h")).groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, h & 63)")).alias("m"))
    table = np.zeros(1 << (bits - 6), np.int64)
    for w, m in words.collect():
        table[w] = m
    known = rows.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def held(places: pd.Series) -> pd.Series:
        h = places.to_numpy()
        return pd.Series(known.value[h >> 6] >> (h & 63) & 1 == 1)

    return rows.where(held(place))


def resident(name: str, key, make):
    """A worker's own object, made once per process and key and kept between tasks; another key replaces it.

    Functions reach the executors by value, with module globals of their own, so the store hangs on the interpreter.
    """
    store = sys.__dict__.setdefault("_lodestone_kept", {})
    if name not in store or store[name][0] != key:
        store[name] = (key, make())
    return store[name][1]


def bounded_batches(df: DataFrame, rows: int = 500) -> None:
    """Texts go to Python workers in batches of at most ``rows``: buffers on both sides stay small however long a session lives.

    A smaller setting of the session is left as it is.
    """
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, rows)


def batches(texts: list, most_chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of at most ``most_chars`` characters each (a longer text stands alone): bounds a worker's memory."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > most_chars:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def held_out(doc_id, folds: int, fold: int):
    """True for the documents of the held-out fold: crc32 of the id as text. A null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds) == fold


def carried(docs: DataFrame, carry: bool) -> tuple[list, str, list[str]]:
    """Columns that an Arrow operator passes through under names of its own: to select, as schema text, and the first names."""
    names = docs.columns if carry else []
    chosen = [F.col(f"`{c}`").alias(f"_carried{i}") for i, c in enumerate(names)]
    return chosen, "".join(f", _carried{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names)), names
