"""Best-fit packing with Martello-Toth dominance reduction.

Documents become token pieces no longer than a sequence. Only the histogram of piece lengths (at most one row per length
up to the capacity, whatever the corpus) goes to the driver. There the reduction fixes sets of at most three pieces that
provably dominate every other set holding the same piece, many at a time; best fit, by decreasing length, places the rest.
The outcome is a bounded list of patterns with multiplicities. On the cluster each piece gets its rank among the pieces of
its length (counts by small cells and running sums, so no length is ranked in one task), and the rank picks its place.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, batches, bounded_batches, resident

#: A run of equal sequences: how many, and the (length, number of pieces) in each.
Run = tuple[int, list[tuple[int, int]]]


class BytePairs:
    """Byte-level BPE ids, as little-endian unsigned 32-bit bytes, by the vocabulary of a ``tokenizers`` file.

    Where ids follow the order of the merges and the pre-tokeniser is the plain byte-level one, the ids are ranks, and an
    encoder by ranks gives the same ids several times faster; files of another kind go through the library itself. Where an
    added token's string stands in a text it is that token, as the library reads it.
    """

    #: The byte-level pre-tokeniser's pattern (fixed value).
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, tokenizer_json: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ranks = byte_ranks(tokenizer_json)
        if ranks is None:
            from tokenizers import Tokenizer

            lib = Tokenizer.from_str(tokenizer_json)
            self.ids = lambda text: lib.encode(text, add_special_tokens=False).ids
        else:
            import tiktoken

            added = {t["content"]: t["id"] for t in json.loads(tokenizer_json).get("added_tokens", [])}
            table = tiktoken.Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=added)
            plain, marks = table.encode_ordinary, [*added]
            self.ids = lambda text: table.encode(text, allowed_special="all") if any(m in text for m in marks) else plain(text)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, without special tokens."""
        for t in texts:
            yield np.array(self.ids(t), "<u4").tobytes()


def byte_ranks(tokenizer_json: str) -> dict[bytes, int] | None:
    """The ranks of a byte-level BPE file whose ids are ranks, else None."""
    spec = json.loads(tokenizer_json)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    odd = model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("byte_fallback") or model.get("ignore_merges")
    if not plain or odd:
        return None
    # byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ... in order
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}
    added = {t["content"] for t in spec.get("added_tokens", [])}
    loose = any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if loose or any(a != b and a in b for a in added for b in added):
        return None  # such tokens take text around them, or one stands in another: only the library knows which
    vocab = {k: v for k, v in model["vocab"].items() if k not in added}
    if any(c not in of for k in vocab for c in k):
        return None
    merged = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1)) for m in model["merges"]]
    if None in merged or any(x >= y for x, y in zip(merged, merged[1:])) or len(vocab) != len(merged) + 256:
        return None
    return {bytes(of[c] for c in k): v for k, v in vocab.items()}


def token_pieces(docs: DataFrame, tokenizer_json: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): each text's ids and the end id, cut only where longer than a sequence.

    All pieces but the first are ``capacity`` long. Null counts as empty; an empty text is the end id alone.
    """
    bounded_batches(docs)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.uint32())] * with_ids
    schema = pa.schema(list(zip(names, [*kinds[:5], *([pa.list_(pa.int32())] * with_ids)])))
    end = np.asarray([end_id], "<u4").tobytes()

    def run(parts):
        table = resident("byte pairs", hash(tokenizer_json), lambda: BytePairs(tokenizer_json))
        for part in parts:
            ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            for a, b in batches(texts):
                rows = []
                for i, data in zip(ids[a:b], table.encode([t or "" for t in texts[a:b]])):
                    data += end
                    n, at = len(data) // 4, 0
                    for k in range(-(-n // capacity)):
                        size = (n - 1) % capacity + 1 if k == 0 else capacity
                        own = data[4 * at : 4 * (at + size)]
                        rows.append((i, k, at, size, zlib.crc32(own), *([np.frombuffer(own, "<i4")] * with_ids)))
                        at += size
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def dominating(w: int, count: dict[int, int], sizes: list[int], cap: int) -> list[int] | None:
    """A set with a piece of length ``w`` that dominates all others with it, by the Martello-Toth criteria, or None."""
    have = lambda x, used=(): count[x] - (x == w) - sum(x == u for u in used)
    room = cap - w
    if room and count.get(room, 0) - (room == w) > 0:
        return [w, room]  # a full sequence: whatever else stood beside w fits in the partner's place
    low: list[int] = []
    for x in sizes:  # the three smallest others
        low += [x] * min(3 - len(low), have(x))
        if len(low) == 3:
            break
    if not low or low[0] > room:
        return [w]
    top = bisect_right(sizes, room) - 1
    while have(sizes[top]) <= 0:
        top -= 1
    x = sizes[top]
    if len(low) < 2 or low[0] + low[1] > room:
        return [w, x]
    if len(low) == 3 and sum(low) <= room:
        return None  # three others may join: no criterion for sets of three holds
    best, a, b, i, j = 0, 0, 0, 0, top
    while i <= j:
        p, q = sizes[i], sizes[j]
        if have(p) <= 0:
            i += 1
        elif have(q) <= 0 or p + q > room or (i == j and have(p) < 2):
            j -= 1
        else:
            if p + q > best:
                best, a, b = p + q, q, p
            i += 1
    if x >= best:
        return [w, x]
    if a == x:
        larger: list[int] = []
        for y in sizes[bisect_right(sizes, b) :]:
            larger += [y] * min(2 - len(larger), max(0, have(y)))
            if len(larger) == 2:
                break
        if len(larger) < 2 or sum(larger) > room:
            return [w, a, b]
    return None


def reduce_instance(count: dict[int, int], cap: int) -> list[Run]:
    """Fix dominating sets, as often as the lengths at hand allow, until none is left; ``count`` shrinks in place."""
    runs, sizes, changed = [], sorted(x for x, n in count.items() if n), True
    while changed:
        changed = False
        for w in sizes[::-1]:
            while count[w]:
                found = dominating(w, count, sizes, cap)
                if not found:
                    break
                need = {x: found.count(x) for x in found}
                times = min(count[x] // n for x, n in need.items())
                runs.append((times, sorted(need.items(), reverse=True)))
                changed = True
                for x, n in need.items():
                    count[x] -= times * n
                    if not count[x]:
                        sizes.remove(x)
    return runs


def best_fit(count: dict[int, int], cap: int) -> list[Run]:
    """Best fit by decreasing length over a histogram; equal sequences are kept as one run."""
    free: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    rooms: list[int] = []

    def put(room: int, times: int, held: list[tuple[int, int]]) -> None:
        if not free.get(room):
            free[room] = []
            insort(rooms, room)
        free[room].append((times, held))

    for w in sorted((x for x, n in count.items() if n), reverse=True):
        n = count[w]
        while n:
            at = bisect_left(rooms, w)
            if at < len(rooms):
                room = rooms[at]
                times, held = free[room].pop()
                if not free[room]:
                    rooms.pop(at)
            else:
                room, times, held = cap, n, []
            each = room // w  # the same sequence stays the tightest until it takes no more
            full = min(times, n // each)
            if full:
                put(room - each * w, full, [*held, (w, each)])
                n -= full * each
            rest = times - full
            if n and rest:
                few = min(each, n)
                put(room - few * w, 1, [*held, (w, few)])
                n, rest = n - few, rest - 1
            if rest and held:
                put(room, rest, held)
    return [(times, held) for groups in free.values() for times, held in groups]


def plan_sequences(count: dict[int, int], cap: int) -> list[Run]:
    left = dict(count)
    return reduce_instance(left, cap) + best_fit(left, cap)


def places(runs: list[Run]) -> tuple[np.ndarray, ...]:
    """Sorted keys (length, first rank) and, for each, the sequence id, the pieces of this length in a sequence, and the offset."""
    rows, taken, sequence = [], {}, 0
    for times, held in runs:
        offset = 0
        for length, each in held:
            first = taken.get(length, 0)
            rows.append(((length << 40) + first, first, sequence, each, offset))
            taken[length] = first + times * each
            offset += length * each
        sequence += times
    rows.sort()
    return tuple(np.asarray([r[i] for r in rows], np.int64) for i in range(5))


def pack_pieces(pieces: DataFrame, scratch: Scratch, capacity: int = 2048, cell: int = 2000) -> DataFrame:
    """``pieces`` (a written table with doc_id, piece, length) with sequence_id and offset.

    ``cell`` is about how many pieces are ranked together; each length has as many cells as its count needs, dealt by hash,
    so that repeated rows and lengths that are very frequent spread. The driver holds at most ``capacity`` counts and some
    runs for each.
    """
    found = pieces.groupBy("length").count().collect()
    runs = plan_sequences({r["length"]: r["count"] for r in found}, capacity)
    names = [c for c in pieces.columns]
    # one number a length, at most ``capacity`` of them
    wide = pieces.sparkSession.createDataFrame([(r["length"], -(-r["count"] // cell)) for r in found], "length long, _cells long")
    place = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.lit(1)), F.col("_cells"))
    dealt = pieces.join(F.broadcast(wide), "length").withColumn("_cell", place).select(*names, "_cell")
    by = ["length", "_cell"]
    before = Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = dealt.groupBy(*by).count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy(*by).orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("_rank", F.row_number().over(inside) - 1).join(cells, by).withColumn("_rank", F.col("_rank") + F.col("_before"))
    table = pieces.sparkSession.sparkContext.broadcast(places(runs))
    n = len(names)

    def run(parts):
        keys, first, sequence, each, offset = table.value
        for part in parts:
            length, rank = (part.column(n + i).to_numpy(zero_copy_only=False) for i in range(2))
            at = np.searchsorted(keys, (length << 40) + rank, "right") - 1
            own = rank - first[at]
            seq, off = sequence[at] + own // each[at], offset[at] + own % each[at] * length
            yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.select(*names, F.col("length").alias("_length"), F.col("_rank").cast("long")).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_json: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (ids), sequence_id, offset.

    Null text counts as empty and gives one piece, the end id. Repeated rows are packed each; ties of length are broken by
    doc_id and piece. Other columns are not read; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.write(token_pieces(docs, tokenizer_json, capacity, end_id, with_ids), "pieces")
    return pack_pieces(pieces, scratch, capacity)


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
