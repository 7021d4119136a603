"""Stored memories, vectors, knowledge and feedback."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import positions


def add_memories(stored: DataFrame, new: DataFrame, ties: list[str] | None = None) -> DataFrame:
    """``stored`` (id, user_id, session_id, content, metadata, created_at) and the new rows with ids that go on from the largest.

    A map or struct as content becomes JSON text. New rows are numbered by time, then by the columns ``ties`` (which may be
    more than those of ``stored``), then content.
    """
    kind = new.schema["content"].dataType.typeName()
    content = F.to_json("content") if kind in ("map", "struct", "array") else F.col("content")
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    timed = new.withColumn("content", content).withColumn("_at", F.unix_micros("created_at"))
    numbered = positions(timed, "_at", name="_n", ties=[*(ties or []), "content"]).crossJoin(F.broadcast(top))
    return stored.unionByName(numbered.withColumn("id", F.col("_top") + F.col("_n") + 1).select(*stored.columns))


def mine(stored: DataFrame, user: str, session: str | None = None) -> DataFrame:
    own = stored.where(F.col("user_id") == user)
    return own if session is None else own.where(F.col("session_id") == session)


def search(stored: DataFrame, query: str, user: str, session: str | None = None, limit: int = 5) -> DataFrame:
    """The newest memories that contain the query, case aside; ``%`` and ``_`` in it are wildcards. The filter reaches the scan."""
    return mine(stored, user, session).where(F.col("content").ilike(f"%{query}%")).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def all_memories(stored: DataFrame, user: str, session: str | None = None) -> DataFrame:
    return mine(stored, user, session).orderBy(F.col("created_at").desc(), F.col("id").desc())


def delete_memory(stored: DataFrame, memory_id: int) -> DataFrame:
    return stored.where(F.col("id") != memory_id)


def clear_memories(stored: DataFrame, user: str) -> DataFrame:
    return stored.where(~F.col("user_id").eqNullSafe(F.lit(user)))


def context(found: DataFrame, limit: int = 5, separator: str = "\n") -> DataFrame:
    """One row: the contents of the newest ``limit`` memories in one text."""
    top = found.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)
    parts = F.array_sort(F.collect_list(F.struct((-F.unix_micros("created_at")).alias("t"), (-F.col("id")).alias("i"), "content")))
    return top.agg(parts.alias("p")).select(F.array_join("p.content", separator).alias("context"))


def budgeted(found: DataFrame, by: str, order: list[Column], text: str, budget: int, limit: int = 10) -> DataFrame:
    """The first rows of each group, up to ``limit``, while their texts' running length fits into ``budget``: ``rank`` and ``running``."""
    w = Window.partitionBy(by).orderBy(*order)
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    running = F.sum(F.length(text)).over(Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("running", running).where(F.col("running") <= budget)


def chunked(vectors: DataFrame, key: str, value: str, rows: int) -> DataFrame:
    """ids, matrix: at most ``rows`` vectors a row, the matrix as little-endian doubles. Vectors of a chunk have one dimension."""
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("matrix", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]):
        for part in parts:
            for a in range(0, part.num_rows, rows):
                own = part.slice(a, rows)
                flat = own.column(1).cast(pa.list_(pa.float64())).flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([own.column(0).to_pylist()], schema.field(0).type), pa.array([flat.astype("<f8").tobytes()])], schema=schema)

    return vectors.select(F.col(key).cast("long"), value).where(F.col(value).isNotNull()).mapInArrow(run, "ids array<long>, matrix binary")


def top_k(queries: DataFrame, vectors: DataFrame, k: int, cosine: bool = False, rows: int = 4096) -> DataFrame:
    """query_id, vec_id, score, rank: the best ``k`` of all vectors for each query (query_id, query); ties by vec_id.

    Blocks of queries meet blocks of vectors, one matrix product each, and only a block's best go on; neither side has to fit
    anywhere as a whole. Null vectors, those with null entries, and those of another dimension than the first query's, are no
    neighbours of any and have none; repeated rows count each.
    """
    whole = lambda df, c: df.where(F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull()) & (F.size(c) > 0))
    asked = whole(queries, "query").select(F.size("query").alias("d")).first()
    dimension = asked.d if asked else 0
    queries, vectors = whole(queries, "query").where(F.size("query") == dimension), whole(vectors, "embedding").where(F.size("embedding") == dimension)
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def unit(x: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

    def run(parts: Iterator[pa.RecordBatch]):
        for part in parts:
            for at in range(part.num_rows):
                asked, ids = part.column(0)[at].as_py(), np.array(part.column(2)[at].as_py())  # ids may be null
                q, v = (np.frombuffer(part.column(i)[at].as_buffer(), "<f8").reshape(len(x), -1) for i, x in ((1, asked), (3, ids)))
                if cosine:
                    q, v = unit(q), unit(v)
                for first in range(0, len(asked), 128):
                    scores = np.round(q[first : first + 128] @ v.T, 9)
                    best = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
                    many = best.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked[first : first + 128], many), pa.int64()), pa.array(ids[best].ravel()), pa.array(np.take_along_axis(scores, best, 1).ravel())], schema=schema)

    left = chunked(queries, "query_id", "query", rows // 4).select(F.col("ids").alias("qi"), F.col("matrix").alias("qm"))
    met = left.crossJoin(chunked(vectors, "vec_id", "embedding", rows)).mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def check_dimension(vectors: DataFrame, dimension: int) -> DataFrame:
    """Rows as they are, null vectors too; a vector of another dimension fails the query."""
    return vectors.where(F.assert_true(F.col("embedding").isNull() | (F.size("embedding") == dimension)).isNull())


def upsert(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Knowledge (category, key, value, metadata, created_at, updated_at) after changes (.., op, at, seq) in order of ``seq``.

    ``add`` replaces a row with a new creation time, ``update`` keeps the creation time (and adds an absent row), ``delete``
    removes it. Changes of a key fold in one group; hot keys hold as many rows as there are changes to them.
    """
    old = stored.select("category", "key", F.struct(F.lit(-1).cast("long").alias("seq"), F.lit("add").alias("op"), "value", "metadata", F.col("created_at").alias("born"), F.col("updated_at").alias("at")).alias("c"))
    new = changes.select("category", "key", F.struct("seq", "op", "value", "metadata", F.col("at").alias("born"), "at").alias("c"))
    rows = old.unionByName(new)
    last_cut = F.max(F.when(F.col("c.op") == "delete", F.col("c.seq")))
    last_add = F.max(F.when(F.col("c.op") == "add", F.col("c.seq")))
    g = rows.groupBy("category", "key").agg(F.max_by("c", "c.seq").alias("last"), last_cut.alias("cut"), last_add.alias("added"))
    first = rows.join(g.select("category", "key", F.coalesce("cut", F.lit(-2)).alias("cut"), F.coalesce("added", F.lit(-2)).alias("added")), ["category", "key"]).where("c.seq > cut and c.seq >= added and c.op <> 'delete'")
    born = first.groupBy("category", "key").agg(F.min_by("c.born", "c.seq").alias("created_at"))
    return g.where("last.op <> 'delete'").join(born, ["category", "key"]).select("category", "key", "last.value", "last.metadata", "created_at", F.col("last.at").alias("updated_at"))


#: The categories of typed knowledge and the fields of their values.
TYPED = {
    "patterns": ["description", "success_rate", "market_conditions"],
    "market_regimes": ["characteristics", "recommended_strategies"],
    "trade_history": ["entry_price", "exit_price", "direction", "pnl", "pattern_used", "notes"],
}


def typed_changes(rows: DataFrame, category: str, key: str, at: str, seq: str) -> DataFrame:
    """Changes for ``upsert`` that add typed knowledge: the category's fields of ``rows`` as JSON (a null field stays in it)."""
    fields = F.to_json(F.struct(*TYPED[category]), {"ignoreNullFields": "false"})
    return rows.select(F.lit(category).alias("category"), F.col(key).cast("string").alias("key"), fields.alias("value"), F.lit("{}").alias("metadata"), F.lit("add").alias("op"), F.col(at).alias("at"), F.col(seq).alias("seq"))


def search_knowledge(stored: DataFrame, query: str, category: str | None = None) -> DataFrame:
    rows = stored if category is None else stored.where(F.col("category") == category)
    return rows.where(F.contains(F.lower("key"), F.lit(query.lower())) | F.contains(F.lower("value"), F.lit(query.lower())))


def pattern_performance(trades: DataFrame, pattern: str, pnl: str) -> DataFrame:
    """count, win_rate, avg_pnl per pattern; a trade without profit is no win."""
    return trades.groupBy(pattern).agg(F.count("*").alias("count"), F.avg((F.col(pnl) > 0).cast("int")).alias("win_rate"), F.avg(pnl).alias("avg_pnl"))


def folded(feedback: DataFrame) -> DataFrame:
    """symbol, decision, feedback (all texts in order of arrival, then by text), bad: one row a key, before any record is met.

    Null texts are left out of the text; a null symbol or decision meets no record.
    """
    bad = F.lower("feedback").contains("incorrect") | F.lower("feedback").contains("wrong")
    said = F.array_sort(F.collect_list(F.struct("ts", "feedback")))
    return feedback.groupBy("symbol", "decision").agg(said.alias("f"), F.max(F.coalesce(bad, F.lit(False))).alias("bad")).select("symbol", "decision", F.array_join("f.feedback", "; ").alias("feedback"), "bad")


def rated(records: DataFrame, folded_: DataFrame) -> DataFrame:
    """Every record with the folded feedback on its (symbol, decision), null if there is none, and ``quality_score``."""
    joined = records.join(folded_.withColumn("_said", F.lit(True)), ["symbol", "decision"], "left")
    bonus = F.when(F.col("_said"), 0.1).otherwise(0.0) - F.when(F.coalesce("bad", F.lit(False)), 0.2).otherwise(0.0)
    return joined.withColumn("quality_score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence") + bonus))).drop("_said", "bad")


def refine(records: DataFrame, feedback: DataFrame) -> DataFrame:
    """Every record with the feedback (ts, symbol, decision, feedback) on its (symbol, decision), joined in order of arrival, and a quality score."""
    return rated(records, folded(feedback)).withColumn("feedback", F.coalesce("feedback", F.lit("")))


def trading_records(results: DataFrame) -> DataFrame:
    """The thirteen fields of a record with their defaults, from whatever columns ``results`` has."""
    # fixed values: the fields and their defaults
    defaults = {"symbol": "unknown", "decision": "flat", "confidence": 0.0, "trend": "", "momentum": "", "refinements": 0, "funding_rate": None, "long_short_ratio": None, "funding_sentiment": None, "positioning_sentiment": None}
    kinds = {"confidence": "double", "refinements": "int", "funding_rate": "double", "long_short_ratio": "double"}
    have = set(results.columns)

    def field(name, default):
        kind = kinds.get(name, "string")
        own = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        return (own if default is None else F.coalesce(own, F.lit(default))).alias(name)

    features = F.to_json("features") if "features" in have and results.schema["features"].dataType.typeName() in ("struct", "map") else F.lit("{}")
    stamp = F.col("timestamp") if "timestamp" in have else F.current_timestamp()
    return results.select(stamp.alias("timestamp"), *(field(n, d) for n, d in defaults.items()), features.alias("features"))
