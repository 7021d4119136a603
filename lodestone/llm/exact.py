"""Exact dedup by deterministic block naming.

Each text, without ASCII white space, is cut into blocks of a fixed number of bytes. All blocks are sorted and get their
rank among the distinct blocks as an integer name; adjacent names are then paired and the pairs named likewise, level by
level, until each document has a single name. Two texts are equal if and only if they have as many blocks and the same
name: nothing rests on a hash being free of collisions (hashes only deal the rows out).

At scale the text is shuffled once, at the first level; later levels move integers. The sort deals rows out by (hash,
salt), so copies of one text spread over tasks; a name that spans tasks is settled from one small record per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bounded_batches, join_groups

#: The characters that do not count: space and 0x09 to 0x0D.
WHITE = bytes([0x20, *range(0x09, 0x0E)])

_CUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("sha", T.BinaryType()),
        T.StructField("n_blocks", T.IntegerType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("block", T.BinaryType()),
    ]
)


def _cut(parts: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("sha", pa.binary()), ("n_blocks", pa.int32()), ("pos", pa.int32()), ("block", pa.binary())])
    for part in parts:
        ids, texts, chars = (part.column(i).to_pylist() for i in range(3))
        rows, held = [], 0
        for doc_id, text, n in zip(ids, texts, chars):
            text = text.translate(None, WHITE)
            sha, count = hashlib.sha256(text).digest(), max(1, -(-len(text) // size))
            for pos in range(count):
                rows.append((doc_id, n, sha, count, pos, text[pos * size : (pos + 1) * size]))
            held += len(text)
            if held > 8_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


def _rank(parts: Iterator[pa.RecordBatch], n_keep: int) -> Iterator[pa.RecordBatch]:
    """Ranks of the distinct keys within a sorted task, and a record of the keys of its first and last run of equal hashes.

    The last two columns are the hash ``h`` and the key; the ``n_keep`` columns before them go through.
    """
    task = TaskContext.get().partitionId()
    rank, last, run = -1, None, None
    first_h, tail_h, firsts, tails, tail_at, rows = None, None, [], [], 0, 0
    schema = None
    for part in parts:
        hs, keys = part.column(n_keep).to_pylist(), part.column(n_keep + 1).to_pylist()
        ranks = []
        for now in zip(hs, keys):
            if now != last:
                rank, last = rank + 1, now
                if rank == 0:
                    first_h = now[0]
                if now[0] == first_h:
                    firsts.append(now[1])
                if now[0] != tail_h:
                    tail_h, tails, tail_at = now[0], [], rank
                tails.append(now[1])
            ranks.append(rank)
        rows += len(ranks)
        n = len(ranks)
        kept = [part.column(i) for i in range(n_keep)]
        schema = schema or pa.schema([*(part.schema.field(i) for i in range(n_keep)), ("task", pa.int32()), ("rank", pa.int64()), ("edge", pa.list_(pa.struct([("h", pa.int64()), ("rank", pa.int64()), ("key", part.schema.field(n_keep + 1).type)])))])
        yield pa.RecordBatch.from_arrays([*kept, pa.array([task] * n, pa.int32()), pa.array(ranks, pa.int64()), pa.nulls(n, schema.field("edge").type)], schema=schema)
    if schema is not None:
        edge = [{"h": first_h, "rank": i, "key": k} for i, k in enumerate(firsts)]
        if tail_h != first_h:
            edge += [{"h": tail_h, "rank": tail_at + i, "key": k} for i, k in enumerate(tails)]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, schema.field(i).type) for i in range(n_keep)), pa.array([task], pa.int32()), pa.array([rank + 1], pa.int64()), pa.array([edge], schema.field("edge").type)], schema=schema)


def name_keys(df: DataFrame, key: str, scratch: Scratch, label: str) -> DataFrame:
    """``df`` with its column ``key`` replaced by ``name``: equal names for equal keys, and for those alone.

    ``key`` is binary. Rows are sorted by (hash of the key, key) over all tasks; the name is the key's rank. What the driver
    gets is one record per task, with the keys whose hash opens or closes the task (one each, but for hash collisions).
    """
    keep = [c for c in df.columns if c != key]
    dealt = df.withColumn("_h", F.xxhash64(key)).withColumn("_salt", F.xxhash64(*keep))
    dealt = dealt.repartitionByRange("_h", "_salt").sortWithinPartitions("_h", key).select(*keep, "_h", key)
    kind = df.schema[key].dataType
    edge = T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("rank", T.LongType()), T.StructField("key", kind)]))
    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in keep), T.StructField("task", T.IntegerType()), T.StructField("rank", T.LongType()), T.StructField("edge", edge)])
    ranked = scratch.write(dealt.mapInArrow(partial(_rank, n_keep=len(keep)), schema), label)
    spark = df.sparkSession
    shifts, fixed, known, known_h, free = [], [], {}, None, 0
    for row in ranked.where("edge is not null").select("task", "rank", "edge").orderBy("task").collect():
        h0, first_n = row.edge[0].h, sum(e.h == row.edge[0].h for e in row.edge)
        if known_h != h0:
            known, known_h = {}, h0
        new = 0
        for e in row.edge[:first_n]:
            at = known.get(bytes(e.key))
            if at is None:
                at = known[bytes(e.key)] = free + new
                new += 1
            fixed.append((row.task, e.rank, at))
        # ranks from first_n on are new keys, numbered on
        shift = free + new - first_n
        shifts.append((row.task, shift))
        if len(row.edge) > first_n:
            known, known_h = {bytes(e.key): e.rank + shift for e in row.edge[first_n:]}, row.edge[-1].h
        free = row.rank + shift if row.rank > first_n else free + new
    shift_df = F.broadcast(spark.createDataFrame(shifts, "task int, _shift long"))
    fixed_df = F.broadcast(spark.createDataFrame(fixed, "task int, rank long, _fixed long"))
    named = ranked.where("edge is null").join(shift_df, "task").join(fixed_df, ["task", "rank"], "left")
    return named.select(*keep, F.coalesce("_fixed", F.col("rank") + F.col("_shift")).alias("name"))


def exact_dedup(docs: DataFrame, block_bytes: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Texts are equal when identical after deleting space and 0x09-0x0D; null counts as empty, and empty texts are equal to
    each other. Of equal texts the one with the most code points, then the smallest doc_id (null last) stays. Rows repeated
    with the same doc_id and text are separate documents of one group, of which one is kept. Other columns are not read, so
    clashing names do not matter; an empty table gives an empty result.
    """
    bounded_batches(docs)
    scratch = Scratch(docs.sparkSession, "exact")
    raw = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(doc_id).cast("long"), raw.cast("binary"), F.length(raw).cast("long"))
    row = ["doc_id", "n_chars", "sha", "n_blocks"]
    level = name_keys(texts.mapInArrow(partial(_cut, size=block_bytes), _CUT), "block", scratch, "blocks").withColumn("copies", F.lit(1).cast("long"))
    done, depth = level.where("n_blocks = 1").select(*row, "name", "copies"), 0
    most = level.agg(F.max("n_blocks")).first()[0] or 1
    while (1 << depth) < most:
        depth += 1
        even = F.col("pos") % 2 == 0
        pairs = level.where(F.col("n_blocks") > (1 << (depth - 1))).groupBy(*row, F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"), F.sum(F.when(even, F.col("copies"))).alias("copies")
        )
        pairs = pairs.select(*row, "pos", "copies", F.unhex(F.concat(F.lpad(F.hex("a"), 16, "0"), F.lpad(F.hex("b"), 16, "0"))).alias("pair"))
        level = scratch.write(name_keys(pairs, "pair", scratch, f"pairs{depth}"), f"level{depth}")
        scratch.drop(f"pairs{depth}")
        done = done.unionByName(level.where(F.col("n_blocks") <= (1 << depth)).select(*row, "name", "copies"))
    members = scratch.write(done.groupBy(*row, "name").agg(F.sum("copies").alias("copies")), "members")
    scratch.drop("blocks")
    first = F.min(F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i")))
    groups = scratch.write(members.groupBy("n_blocks", "name").agg(first.alias("first"), F.sum("copies").alias("group_size"), F.count("*").alias("n")), "groups")
    joined = join_groups(members, groups, ["n_blocks", "name"], "n", members.count())
    stays = joined["doc_id"].eqNullSafe(joined["first.i"]) & (joined["n_chars"] == -joined["first.c"])
    each = joined.withColumn("stays", stays).withColumn("copy", F.explode(F.expr("sequence(1, copies)")))
    return each.select("doc_id", F.col("first.i").alias("keep_id"), "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "n_chars")


def kept_rows(docs: DataFrame, block_bytes: int = 4096) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns; of repeated rows one stays."""
    kept = exact_dedup(docs, block_bytes).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), F.col("n_chars").alias("_n"))
    plain = F.coalesce(F.col("text"), F.lit(""))
    mine = docs.withColumn("_sha", normalised_sha(plain)).withColumn("_n", F.length(plain).cast("long")).withColumn("_id", F.col("doc_id").cast("long"))
    same = kept.withColumn("_null", F.col("_id").isNull()).withColumn("_id", F.coalesce("_id", F.lit(0)))
    mine = mine.withColumn("_null", F.col("_id").isNull()).withColumn("_id", F.coalesce("_id", F.lit(0)))
    by = ["_id", "_null", "_sha", "_n"]
    one = Window.partitionBy(*by).orderBy("text")
    return mine.join(same, by, "left_semi").withColumn("_row", F.row_number().over(one)).where("_row = 1").select(*docs.columns)


def normalised_sha(text: Column) -> Column:
    """Lowercase hex SHA-256 of a text without the white space that does not count."""
    return F.sha2(F.translate(text, WHITE.decode(), "").cast("binary"), 256)
