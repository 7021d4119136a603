"""Table functions for SQL text: rows to many rows, in Arrow batches.

``register`` makes them known to a session; a table argument with PARTITION BY hands a function one partition at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import ffd, minhash


@F.arrow_udtf(returnType="doc_id long, gram string")
class CharGrams:
    """Distinct character n-grams of rows (doc_id, text, n), as ``minhash.grams`` cuts them; a null text counts as empty."""

    def eval(self, table: pa.RecordBatch) -> Iterator[pa.Table]:
        for i, t, n in zip(*(table.column(k).to_pylist() for k in range(3))):
            found = sorted(minhash.grams(t or "", n))
            yield pa.table({"doc_id": pa.array([i] * len(found), pa.int64()), "gram": pa.array(found, pa.string())})


@F.arrow_udtf(returnType="gram string, docs long")
class CharGramCounts:
    """In how many of a partition's rows (text, n) each n-gram of ``CharGrams`` stands; given out, perhaps in parts, when ``most`` are held."""

    most = 300_000

    def __init__(self):
        self.held: Counter = Counter()

    def given(self) -> pa.Table:
        out = pa.table({"gram": pa.array([*self.held], pa.string()), "docs": pa.array([*self.held.values()], pa.int64())})
        self.held.clear()
        return out

    def eval(self, table: pa.RecordBatch) -> Iterator[pa.Table]:
        for t, n in zip(*(table.column(k).to_pylist() for k in range(2))):
            self.held.update(minhash.grams(t or "", n))
            if len(self.held) >= self.most:
                yield self.given()

    def terminate(self) -> Iterator[pa.Table]:
        if self.held:
            yield self.given()


@F.arrow_udtf(returnType="shard long, doc_id long, sequence long, slot long")
class FirstFit:
    """First-fit-decreasing places of a partition's rows (shard, doc_id, tokens, target, separator), in the order they come; null tokens count as none."""

    def __init__(self):
        self.held: list[pa.RecordBatch] = []

    def eval(self, table: pa.RecordBatch) -> Iterator[pa.Table]:
        self.held.append(table)
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        if not self.held:
            return
        rows = pa.Table.from_batches(self.held)
        lengths = [n or 0 for n in rows.column(2).to_pylist()]
        found = ffd.first_fit(lengths, rows.column(3)[0].as_py(), rows.column(4)[0].as_py())
        at = pa.array([i for s in found for i in s], pa.int64())
        places = {"sequence": [k for k, s in enumerate(found) for _ in s], "slot": [k for s in found for k in range(len(s))]}
        yield pa.table({"shard": rows.column(0).take(at), "doc_id": rows.column(1).take(at)} | {k: pa.array(v, pa.int64()) for k, v in places.items()})


def register(spark: SparkSession) -> None:
    spark.udtf.register("char_grams", CharGrams)
    spark.udtf.register("char_gram_counts", CharGramCounts)
    spark.udtf.register("first_fit", FirstFit)
