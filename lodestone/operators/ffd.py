"""First-fit-decreasing packing in shards, and packed training rows.

First fit looks at every open sequence for every sample, so it is sequential by nature; in buffers it runs per shard of a fixed
number of samples, as many shards at a time as there are cores. A whole group of any size is packed from the histogram of its
lengths: samples of one length fill runs of alike sequences, so what one task handles is bounded by the number of lengths, and
every sample finds its place by its rank among those of its length. The row itself (ids, mask, labels, boundaries) is put
together by array functions.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import positions

#: The bucket sizes of dynamic packing.
BUCKETS = [4096, 6144, 8192, 12288, 16384]


def token_estimate(text: Column) -> Column:
    """A quarter of the characters; a null text has none."""
    return F.floor(F.coalesce(F.length(text), F.lit(0)) / 4)


def bucket_of(tokens: Column, buckets: list[int] = BUCKETS) -> Column:
    """The smallest bucket that holds the tokens, else the last. Null tokens count as none."""
    tokens, out = F.coalesce(tokens, F.lit(0)), None
    for b in buckets:
        out = F.when(tokens <= b, b) if out is None else out.when(tokens <= b, b)
    return out.otherwise(buckets[-1])


def first_fit(lengths: list[int], target: int, separator: int, full: float = 0.9) -> list[list[int]]:
    """Sequences as lists of positions, in the order they are given out.

    Longest first (stable); each sample costs its length and a separator and goes to the first open sequence with room. After
    every placement the oldest open sequences go out while they are at least ``full``; the rest follows at the end.
    """
    width = 1 << max(0, len(lengths) - 1).bit_length()
    room = [target] * (2 * width)  # a tree of the largest room; sequences not yet opened have all of it, given ones none
    held: list[list[int]] = []
    used: list[int] = []
    given = 0

    def put(at: int, free: int) -> None:
        at += width
        room[at] = free
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])

    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        cost = lengths[i] + separator
        at = len(held)
        if cost <= target:
            at = 1
            while at < width:
                at = 2 * at if room[2 * at] >= cost else 2 * at + 1
            at -= width
        if at == len(held):
            held.append([])
            used.append(0)
        held[at].append(i)
        used[at] += cost
        put(at, target - used[at])
        while given < len(held) and used[given] >= full * target:
            put(given, -target)
            given += 1
    return held


def fit_runs(counts: list[tuple[int, int]], target: int, separator: int, full: float = 0.9) -> list[tuple[int, int, int, int, int]]:
    """First fit decreasing from (length, samples) alone, as ``first_fit`` would place them: (length, rank, sequence, per, slot).

    Samples of a length, from that rank on, go ``per`` each to consecutive sequences from ``sequence`` on, at ``slot`` and behind,
    until the next entry of that length. Sequences are given out in the order in which they are opened. Adjacent sequences that
    hold the same make up a run: [first sequence, how many, used, samples each].
    """
    out: list[tuple[int, int, int, int, int]] = []
    runs: list[list[int]] = []
    opened = 0
    for length, count in sorted(counts, reverse=True):
        cost, rank, head = length + separator, 0, True  # head: all sequences before have been given out

        def fill(first: int, many: int, used: int, slot: int) -> list[list[int]]:
            """Places samples in a run; the runs that it becomes."""
            nonlocal rank, count
            room = max((target - used) // cost, 0)
            enough = max(1, -int(-(full * target - used) // cost)) if head else room  # the oldest goes out as soon as it is full
            per = min(room, enough)
            if not per or not count:
                return [[first, many, used, slot]]
            whole = min(many, count // per)
            parts = []
            if whole:
                out.append((length, rank, first, per, slot))
                rank, count = rank + whole * per, count - whole * per
                parts.append([first, whole, used + per * cost, slot + per])
            if whole < many and count:
                out.append((length, rank, first + whole, count, slot))
                parts.append([first + whole, 1, used + count * cost, slot + count])
                rank, count, whole = rank + count, 0, whole + 1
            if whole < many:
                parts.append([first + whole, many - whole, used, slot])
            return parts

        kept: list[list[int]] = []
        for at, run in enumerate(runs):
            if not count and not head:
                kept += runs[at:]
                break
            if head and run[2] >= full * target:  # it was full behind the oldest, which has gone
                continue
            for part in fill(*run):
                if head and part[2] >= full * target:
                    continue
                head = False
                kept.append(part)
        runs = kept
        if count:
            # a new sequence takes a sample whether it fits or not; while none is open before it, it goes out as soon as it is full
            head = not runs
            room = max(1, target // cost)
            per = min(room, max(1, -int(-(full * target) // cost))) if head else room
            whole, rest = divmod(count, per)
            new = []
            if whole:
                out.append((length, rank, opened, per, 0))
                new.append([opened, whole, per * cost, per])
            if rest:
                out.append((length, rank + whole * per, opened + whole, rest, 0))
                new.append([opened + whole, 1, rest * cost, rest])
            opened += whole + bool(rest)
            for part in new:
                if head and part[2] >= full * target:
                    continue
                head = False
                runs.append(part)
    return out


def with_shard(samples: DataFrame, order: str, size: int, partition: list[str] | None = None) -> DataFrame:
    """``shard``: position by ``order`` (null first) in steps of ``size``, without sorting the table in one task. Null partitions count."""
    return positions(samples, order, partition).withColumn("shard", F.floor(F.col("_rank") / size)).drop("_rank")


def pack_shards(samples: DataFrame, groups: list[str], target: Column | int, separator: int, order: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """groups, doc_id, sequence (number within the group), slot (place within the sequence) of samples (groups, doc_id, tokens, target).

    A group's samples come by ``order`` (null first, then by tokens); ids stay what they are, of any size and beside nulls.
    Null groups are groups, null tokens count as none. ``keep`` names columns that go along.
    """
    kept = [*groups, order, *(keep or [])]
    kinds = ", ".join(f"{c} {samples.schema[c].dataType.simpleString()}" for c in kept)

    def pack(part: pa.Table) -> pa.Table:
        part = part.take(pc.sort_indices(part, [(order, "ascending"), ("tokens", "ascending")], null_placement="at_start"))
        found = first_fit(part.column("tokens").to_pylist(), part.column("target")[0].as_py(), separator)
        at = pa.array([i for held in found for i in held], pa.int64())
        out = part.select(kept).take(at)
        out = out.append_column("sequence", pa.array([s for s, held in enumerate(found) for _ in held], pa.int64()))
        return out.append_column("slot", pa.array([k for held in found for k in range(len(held))], pa.int64()))

    tokens = F.coalesce(F.col("tokens").cast("long"), F.lit(0).cast("long")).alias("tokens")
    own = samples.select(*kept, tokens, (target if isinstance(target, Column) else F.lit(target)).alias("target"))
    return own.groupBy(*groups).applyInArrow(pack, f"{kinds}, sequence long, slot long")


def pack_groups(samples: DataFrame, groups: list[str], target: int, separator: int, order: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """groups, order, keep, sequence, slot of samples (groups, order, tokens): one first fit over each whole group, of any size.

    Samples of one length come by ``order`` (null first). A group's task gets one row a length; places within a length are ranked
    without sorting it in one task, and each sample meets the one row of its length. Null groups are groups, null tokens count as none.
    """
    kept = [*groups, order, *(keep or [])]
    rows = samples.select(*kept, F.coalesce(F.col("tokens").cast("long"), F.lit(0).cast("long")).alias("tokens"))
    kinds = "".join(f"_g{i} {samples.schema[g].dataType.simpleString()}, " for i, g in enumerate(groups))
    names = [f"_g{i}" for i in range(len(groups))]
    counts = rows.groupBy(*(F.col(g).alias(n) for g, n in zip(groups, names)), F.col("tokens").alias("_tokens")).count()

    def place(part: pa.Table) -> pa.Table:
        found: dict[int, list] = {}
        for length, *entry in fit_runs(list(zip(part.column("_tokens").to_pylist(), part.column("count").to_pylist())), target, separator):
            found.setdefault(length, []).append(dict(zip(("rank", "sequence", "per", "slot"), entry)))
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("rank", "sequence", "per", "slot")]))
        own = {n: [part.column(n)[0].as_py()] * len(found) for n in names}
        return pa.table({n: pa.array(v, part.schema.field(n).type) for n, v in own.items()} | {"_tokens": pa.array([*found], pa.int64()), "_at": pa.array([*found.values()], kind)})

    laid = counts.groupBy(*names).applyInArrow(place, f"{kinds}_tokens long, _at array<struct<rank:long,sequence:long,per:long,slot:long>>")
    ranked = positions(rows, order, [*groups, "tokens"], "_rank")
    same = [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(groups, names)] + [F.col("tokens") == F.col("_tokens")]
    met = ranked.join(laid, reduce(lambda a, b: a & b, same)).withColumn("_own", F.element_at(F.filter("_at", lambda x: x["rank"] <= F.col("_rank")), -1))
    past = F.col("_rank") - F.col("_own.rank")
    return met.select(*kept, (F.col("_own.sequence") + F.expr("(_rank - _own.rank) div _own.per")).alias("sequence"), (F.col("_own.slot") + past % F.col("_own.per")).alias("slot"))


def clipped(tokens: Column, most: int, separator: int) -> Column:
    """Length after truncation to a sequence with separator and ten tokens to spare."""
    return F.least(tokens, F.lit(most - separator - 10))


def fitting(samples: DataFrame, tokens: str, most: int, separator: int, truncate: bool = True) -> DataFrame:
    """Samples longer than a sequence with separator and ten tokens to spare are cut to it, or left out without ``truncate``."""
    if truncate:
        return samples.withColumn(tokens, clipped(F.col(tokens), most, separator).cast("long"))
    return samples.where(F.col(tokens) <= most - separator - 10)


def packed_rows(placed: DataFrame, groups: list[str], target: int, separator_ids: list[int], pad: int) -> DataFrame:
    """groups, sequence, input_ids, attention_mask, labels, boundaries, num_samples, total_tokens, padding_tokens of rows (.., slot, ids).

    Boundaries are those of the uncut sequence (not clipped to ``target``); labels are -100 on padding.
    """
    sep = F.array(*(F.lit(int(x)) for x in separator_ids)) if separator_ids else F.array().cast("array<int>")
    rows = placed.groupBy(*groups, "sequence").agg(F.array_sort(F.collect_list(F.struct("slot", "ids"))).alias("s"))
    joined = F.flatten(F.transform("s", lambda x: F.concat(x["ids"], sep)))
    cost = len(separator_ids)
    ends = F.aggregate("s", F.expr("cast(array() as array<struct<start:int,end:int>>)"), lambda done, x: F.concat(done, F.array(F.struct(
        F.when(F.size(done) > 0, F.element_at(done, -1)["end"] + cost).otherwise(0).alias("start"), (F.when(F.size(done) > 0, F.element_at(done, -1)["end"] + cost).otherwise(0) + F.size(x["ids"])).alias("end")))))
    cut = rows.select(*groups, "sequence", F.slice(joined, 1, target).alias("ids"), ends.alias("boundaries"), F.size("s").alias("num_samples"))
    n = F.size("ids")
    gap = F.lit(target) - n
    return cut.select(
        *groups, "sequence", F.concat("ids", F.array_repeat(F.lit(pad), gap)).alias("input_ids"), F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), gap)).alias("attention_mask"),
        F.concat("ids", F.array_repeat(F.lit(-100), gap)).alias("labels"), "boundaries", "num_samples", n.alias("total_tokens"), gap.alias("padding_tokens"),
    )


def pack_stats(sequences: DataFrame, target: int) -> DataFrame:
    """samples, sequences, tokens, padding, utilisation, samples_per_sequence of rows (num_samples, total_tokens); zeros if empty."""
    sums = sequences.agg(F.coalesce(F.sum("num_samples"), F.lit(0)).alias("samples"), F.count("*").alias("sequences"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"))
    room = F.col("sequences") * target
    return sums.select("samples", "sequences", "tokens", (room - F.col("tokens")).alias("padding"), F.coalesce(F.try_divide(F.col("tokens"), room), F.lit(0.0)).alias("utilisation"), F.coalesce(F.try_divide(F.col("samples"), F.col("sequences")), F.lit(0.0)).alias("samples_per_sequence"))
