"""N-gram Jaccard join with token-combination prefixes, and the components of its links.

A document's tokens are its distinct word shingles, as 64-bit hashes. Tokens that are frequent over the whole corpus form
classes; every other token is rare. In the order (rare before frequent, then by hash) each document takes a prefix just
long enough that a partner within the threshold must share one of its signatures: single tokens of the rare part, and pairs
of tokens of the same class of the frequent part. A prefix covers one lost token with each rare token, and all but the first
token of each class it holds; it is extended until it covers one token more than a partner may lack, and two tokens more
where rare tokens suffice: partners then share three signatures, which a common sentence alone seldom brings about.

Every row has an id of its own, so rows that share a doc_id stay apart; rows with equal sets are one node, named by its
first row. Nodes with a common signature form a cluster round their smallest node, divided by size so that only sizes
within the threshold meet. Signatures are compared first, then the whole sets of those nodes alone that share as many
signatures as they must. A large cluster is cut into blocks; each block meets a few representatives of the cluster, which
joins a family of near copies, and only nodes that this leaves outside meet the other blocks, so that a family costs its
size and no link is lost. Only links are emitted, never pairs, and a task emits fewer links than it has nodes; labels then
spread along the links.

Sets are compared by the tokens' 64-bit hashes: two different shingles count as one with a chance of about 2 ** -64 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, batches, bounded_batches, join_groups, resident, sieve
from .fingerprint import Powers, mix

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Frequent tokens number at most this many (8 bytes each), whatever the corpus.
MOST_FREQUENT = 500_000
#: Signatures that partners share at least where rare tokens suffice.
SHARED = 3
#: Signatures of up to this many nodes pair them directly.
PAIRED = 32
#: Nodes that one task compares with each other.
BLOCK = 500
#: Nodes of a large group that meet each of its blocks.
REPRESENTATIVES = 4
#: Links that one task settles at a time (16 bytes each).
FEW_LINKS = 300_000
#: A token of fewer documents is rare in any case.
LEAST_FREQUENT = 32


def shingle_sets(texts: list[str], words: int, powers: Powers) -> list[np.ndarray]:
    """For each text its sorted distinct shingles; a text of fewer words has one, of all its words."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    buf = _LOWER[np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)]
    ends = np.cumsum([len(r) + 1 for r in raw])
    space = _SPACE[buf]
    first = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    stop = np.flatnonzero(~space[:-1] & space[1:]) + 1
    up, down = powers.upto(len(buf) + 1)
    total = np.zeros(len(buf) + 1, _U)
    np.cumsum((buf.astype(_U) + _U(1)) * up[: len(buf)], out=total[1:])
    word = mix((total[stop] - total[first]) * down[first])
    chain = word
    for k in range(1, words):
        chain = mix(chain[:-1], k) + word[k:] if len(chain) > 1 else chain[:0]
    chain = mix(chain, 101)
    bounds = np.searchsorted(first, np.concatenate([[0], ends]))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(chain[a : b - words + 1]))
        elif b > a:
            short = word[a : a + 1]
            for k in range(1, b - a):
                short = mix(short, k) + word[a + k : a + k + 1]
            out.append(mix(short, 200 + b - a))
        else:
            out.append(word[:0])
    return out


def spare(n: int, percent: int) -> int:
    """How many of ``n`` tokens a partner may lack."""
    return n - (percent * n + 99) // 100


def classes_for(n: int, percent: int) -> set[int]:
    """The numbers of frequent classes in use among the possible partners' sizes."""
    of = lambda s: 1 << max(0, (s // 16).bit_length() - 1)
    return {of(s) for s in ((percent * n + 99) // 100, n, 100 * n // percent)}


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The signatures of a sorted token set, and how many of them a partner shares; ``frequent`` is sorted.

    None and 0 where no different set can be within the threshold. Two documents share at least the smaller of their numbers.
    """
    n = len(tokens)
    if not n or 100 * n < percent * (n + 1):
        return tokens[:0], 0
    need = spare(n, percent) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        often = frequent[at] == tokens
    else:
        often = np.zeros(n, bool)
    rare, common = tokens[~often], tokens[often]
    if len(rare) >= need:
        shared = min(SHARED, len(rare) - need + 1)
        return rare[: need + shared - 1], shared
    out = [rare]
    kind = mix(common, 7)
    for many in classes_for(n, percent):
        group = (kind % _U(many)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        seen = np.zeros(len(common), bool)
        seen[order] = np.concatenate([[False], group[order][1:] == group[order][:-1]])  # behind the first of its class
        covered = np.cumsum(seen)
        size = int(np.searchsorted(covered, need - len(rare))) + 1
        held, own = common[:size], group[:size]
        order = np.argsort(own, kind="stable")
        held, own = held[order], own[order]
        for gap in range(1, size):
            same = own[gap:] == own[:-gap]
            if not same.any():
                break
            out.append(mix(mix(held[:-gap][same], 11 + many) + held[gap:][same], 13))
    return np.unique(np.concatenate(out)), 1


def _texts(docs: DataFrame) -> DataFrame:
    bounded_batches(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def frequent_tokens(docs: DataFrame, words: int, percent: int, scratch: Scratch) -> np.ndarray:
    """Tokens that stand, among the lowest of their documents' tokens, in the most documents; sorted, of bounded number."""
    schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]):
        powers = resident("powers", 0, Powers)
        for part in parts:
            texts = part.column(1).to_pylist()
            for a, b in batches(texts, 1_500_000):
                low = [s[: spare(len(s), percent) + 1] for s in shingle_sets(texts[a:b], words, powers) if 100 * len(s) >= percent * (len(s) + 1) and len(s)]
                if low:
                    tokens, n = np.unique(np.concatenate(low), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n.astype(np.int64))], schema=schema)

    counts = _texts(docs).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    often = scratch.write(counts.where(F.col("n") > LEAST_FREQUENT), "counts")
    # the least count above which no more than MOST_FREQUENT tokens lie; the distinct counts are few
    least, total = LEAST_FREQUENT, 0
    for r in often.groupBy("n").count().orderBy(F.col("n").desc()).toLocalIterator():
        total += r["count"]
        if total > MOST_FREQUENT:
            least = r["n"]
            break
    rows = often.where(F.col("n") > least).select("token").toPandas()
    return np.sort(rows["token"].to_numpy(np.int64).view(_U)) if len(rows) else np.zeros(0, _U)


def sketch(docs: DataFrame, words: int, percent: int, frequent: np.ndarray, scratch: Scratch, carry: bool = False) -> DataFrame:
    """row (an id of its own), doc_id, tie (hash of the text), text, n_shingles, set_key, sigs, shared of every row; with ``carry`` its other columns.

    ``set_key`` has 128 bits of the whole set and is null if that is empty. The rows are written with their texts, so that
    later steps find a row by its id.
    """
    bounded_batches(docs)
    often = docs.sparkSession.sparkContext.broadcast(frequent)
    others = [c for c in docs.columns if c != "text"] if carry else []
    more = [F.col(f"`{c}`").alias(f"_carried{i}") for i, c in enumerate(others)]
    kinds = "".join(f", _carried{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(others))
    names = ["row", "doc_id", "tie", "text", "n_shingles", "set_key", "sigs", "shared", *(f"_carried{i}" for i in range(len(others)))]

    def run(parts: Iterator[pa.RecordBatch]):
        powers, row = resident("powers", 0, Powers), TaskContext.get().partitionId() << 33
        for part in parts:
            texts = [t or "" for t in part.column(2).to_pylist()]
            for a, b in batches(texts, 1_500_000):
                sets = shingle_sets(texts[a:b], words, powers)
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                sigs = [signatures(s, often.value, percent) for s in sets]
                ids, tie, text, *rest = (c.slice(a, b - a) for c in part.columns)
                own = [pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([x.view(np.int64) for x, _ in sigs], pa.list_(pa.int64())), pa.array([k for _, k in sigs], pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + b - a)), ids, tie, text, *own, *rest], names=names)
                row += b - a

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tie"), F.col("text").cast("string").alias("text"), *more)
    schema = "row long, doc_id long, tie long, text string, n_shingles long, set_key binary, sigs array<long>, shared int" + kinds
    return scratch.write(plain.mapInArrow(run, schema), "sketch", "zstd")


class Links:
    """Union-find over the nodes of one task, with the links found."""

    def __init__(self, n: int):
        self.up, self.found = list(range(n)), []

    def root(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = a = self.up[self.up[a]]
        return a

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.found.append((a, b))


def link_sets(sets: list[np.ndarray], sides: list[int], near) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``sets``; two sets on side 1, or two on side 2, are not compared if both sides occur.

    Side 0 meets every side. The tokens are indexed once, and one count over the index gives a set's overlaps with all others;
    ``near(a, others, common)`` then tells which link.
    """
    n = len(sets)
    links = Links(n)
    size = np.array([len(s) for s in sets])
    side = np.array(sides)
    owner = np.repeat(np.arange(n), size)
    tokens, place = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(place, kind="stable")
    posting = owner[order]
    start = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(tokens)))])
    own = np.concatenate([[0], np.cumsum(size)])
    crossed = len(set(sides) - {0}) > 1
    roots = np.arange(n)
    for a in range(n - 1):
        ok = roots != roots[a]
        ok[: a + 1] = False
        if crossed and side[a]:
            ok &= side != side[a]
        if not ok.any():
            continue
        mine = place[own[a] : own[a + 1]]
        low, many = start[mine], start[mine + 1] - start[mine]
        at = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        common = np.bincount(posting[at], minlength=n)
        others = np.flatnonzero(ok & (common > 0))
        hit = others[near(a, others, common[others])]
        if len(hit):
            for b in hit.tolist():
                links.join(a, b)
            roots = np.array([links.root(i) for i in range(n)])
    return links.found


def per_task(tasks: DataFrame, keys: list[str], columns: list[str], solve) -> DataFrame:
    """kind, a, b, g of the tasks (keys): ``solve`` gets lists of a task's columns and gives the links a-b, of kind 0.

    The first three columns are node, side and group. Where ``group`` isn't null, it is the task's group and its
    representatives; a row of kind 1 then gives for every node ``a`` the first representative ``b`` that links connect it
    with (-1: none), with the group's id ``g``. A node that is twice on a side counts once. Tasks of a partition follow each
    other, so a worker holds one at a time.
    """
    n = len(keys)
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("g", pa.int64())])

    def labels(ids, found, group):
        links, place = Links(len(ids)), {x: i for i, x in enumerate(ids)}
        for x, y in found:
            links.join(place[x], place[y])
        first = {links.root(place[r]): r for r in reversed(group["reps"])}
        return [(1, x, first.get(links.root(i), -1), group["id"]) for i, x in enumerate(ids)]

    def run(parts: Iterator[pa.RecordBatch]):
        key, held = None, [[] for _ in columns]

        def finish():
            found = solve(held[0], held[1], *held[3:]) if len(held[0]) > 1 else []
            rows = [(0, x, y, None) for x, y in found if x != y]
            if held[2][0] is not None:
                rows += labels(held[0], found, held[2][0])
            if rows:
                return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

        for part in parts:
            for row in zip(*(part.column(i).to_pylist() for i in range(n + len(columns)))):
                if row[:n] != key:
                    if key is not None and (out := finish()) is not None:
                        yield out
                    key, held = row[:n], [[] for _ in columns]
                if held[0] and (held[0][-1], held[1][-1]) == row[n : n + 2]:
                    continue
                for at, value in zip(held, row[n:]):
                    at.append(value)
        if key is not None and (out := finish()) is not None:
            yield out

    dealt = tasks.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys, *columns[:2])
    return dealt.mapInArrow(run, "kind int, a long, b long, g long")


def forest(members: DataFrame, keys: list[str], payload: DataFrame, columns: list[str], solve, scratch: Scratch, name: str, block: int) -> DataFrame:
    """Links (a, b) that connect within each group (keys) the nodes that ``solve`` links, of written members (keys, node).

    ``payload`` has node and the columns that ``solve(ids, sides, ...)`` gets. A group of up to ``block`` nodes is one task.
    A larger one is dealt into blocks, each with the group's representatives. The nodes that links of their block don't
    connect with the representative of most nodes then meet, block by block, all nodes of the group; so no pair is left out
    unless links already connect it.
    """
    lowest = [F.min(F.struct(F.xxhash64("node", F.lit(s)), "node"))["node"].alias(f"r{s}") for s in range(REPRESENTATIVES)]
    sizes = members.groupBy(*keys).agg(F.count("*").alias("n"), *lowest).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    reps = F.array(*(f"r{s}" for s in range(REPRESENTATIVES)))
    group = F.when(F.col("blocks") > 1, F.struct(F.monotonically_increasing_id().alias("id"), reps.alias("reps"))).alias("group")
    sizes = scratch.write(sizes.select(*keys, "n", "blocks", group), f"{name}-sizes")
    large = sizes.where("blocks > 1")
    dealt = join_groups(members.select(*keys, "node"), sizes, keys, "n", members.count())
    dealt = dealt.select(*keys, F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("i"), "node", "group")
    common = large.select(*keys, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), "group").select(*keys, "i", F.explode("group.reps").alias("node"), "group")

    def solved(tasks: DataFrame, by: list[str], turn: str) -> DataFrame:
        # neither side is of bounded size, so the join shuffles at any size
        return scratch.write(per_task(tasks.hint("merge").join(payload, "node"), by, ["node", "side", "group", *columns], solve), f"{name}-{turn}")

    first = solved(dealt.unionByName(common).withColumn("side", F.lit(0)), [*keys, "i"], "first")
    links, label = first.where("kind = 0").select("a", "b"), first.where("kind = 1").select("g", F.col("a").alias("node"), F.col("b").alias("rep"))
    # a representative is in every block of its group; any other node has one label
    counts = label.where("rep >= 0").groupBy("g", "rep").count()
    main = counts.groupBy("g").agg(F.max(F.struct("count", "rep"))["rep"].alias("main"))
    outside = label.join(main, "g").groupBy("g", "node").agg(F.max(F.col("rep") == F.col("main")).alias("inside")).where("not inside").select("g", "node")
    outside = scratch.write(outside, f"{name}-outside")
    if outside.isEmpty():
        return links
    wide = outside.groupBy("g").agg(F.count("*").alias("u")).join(large.select(*keys, F.col("group.id").alias("g"), "blocks", "n"), "g")
    # where most nodes are outside, blocks meet in pairs: fewer rows than outsiders against all
    wide = wide.withColumn("outer", F.ceil(F.col("u") / block).cast("int")).withColumn("paired", 2 * F.col("u") >= F.col("n"))
    wide = scratch.write(wide, f"{name}-wide")
    numbers = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    held = dealt.where("group is not null").select(*keys, "i", "node").join(wide.select(*keys, "g", "blocks", "outer", "paired"), keys)
    inner = held.where("not paired").select(*keys, "i", numbers("outer").alias("o"), "node", F.lit(2).alias("side"))
    open_ = outside.join(wide.where("not paired"), "g").select(*keys, F.pmod(F.xxhash64("node", F.lit(7)), F.col("outer")).cast("int").alias("o"), "node", F.lit(1).alias("side"), numbers("blocks").alias("i"))
    met = held.where("paired").select(*keys, "i", "node", numbers("blocks").alias("j")).where("i <> j")
    met = met.select(*keys, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("o"), "node", F.when(F.col("i") < F.col("j"), 1).otherwise(2).alias("side"))
    tasks = inner.unionByName(open_).unionByName(met).withColumn("group", F.lit(None).cast(sizes.schema["group"].dataType))
    return links.unionByName(solved(tasks, [*keys, "i", "o"], "second").select("a", "b"))


def paired_candidates(hits: DataFrame, percent: int) -> DataFrame:
    """a, b: nodes that share as many signatures of small buckets as they must, of rows (sig, node, n, shared).

    A bucket has at most ``PAIRED`` rows, so a row meets a bounded number of others.
    """
    lists = hits.groupBy("sig").agg(F.collect_list(F.struct("node", "n", "shared")).alias("m"))
    fits = f"y.node > x.node and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    pairs = f"flatten(transform(m, x -> transform(filter(m, y -> {fits}), y -> struct(x.node as a, y.node as b, least(x.shared, y.shared) as need))))"
    met = lists.select(F.explode(F.expr(pairs)).alias("p")).select("p.*")
    return met.groupBy("a", "b").agg(F.count("*").alias("c"), F.max("need").alias("need")).where("c >= need").select("a", "b")


def banded_stars(hits: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """centre, band, node: the nodes of large buckets (node, n, centre) round their smallest one, divided by size.

    Two nodes of a bucket whose sizes are within the threshold are together in at least one band of their centre.
    """
    # sizes of partners are at most one step apart
    step = F.floor(F.log("n") / float(np.log(100 / percent) * (1 + 1e-9))).cast("int")
    stars = scratch.write(hits.select("centre", "node", "n").distinct().withColumn("step", step), "stars")
    keys = ["centre", "band"]
    banded = stars.withColumn("band", F.explode(F.array(F.col("step"), F.col("step") + 1)))
    # a band holds the steps band - 1 and band; one of a single step is needed only if no mixed band has that step's nodes
    mixed = F.col("lo") != F.col("hi")
    bands = banded.groupBy(*keys).agg(F.count("*").alias("n"), F.min("step").alias("lo"), F.max("step").alias("hi")).where("n > 1")
    order = Window.partitionBy("centre").orderBy("band")
    after = (F.lead("band").over(order) == F.col("band") + 1) & F.lead(mixed).over(order)
    useful = bands.withColumn("after", F.coalesce(after, F.lit(False))).where(mixed | ((F.col("band") == F.col("lo")) & ~F.col("after"))).select(*keys)
    return scratch.write(banded.join(useful, keys).select("centre", "band", "node"), "banded")


def clustered_candidates(hits: DataFrame, nodes: DataFrame, percent: int, scratch: Scratch, block: int) -> DataFrame:
    """a, b: links of a spanning forest of the nodes that share as many signatures as they must, of rows (sig, node, n, centre).

    For large buckets: their nodes form clusters round the smallest one, divided by size, in which whole signatures are compared.
    """
    members = banded_stars(hits, percent, scratch)

    def solve(ids, sides, sizes, sigs, shared):
        size, least = np.array(sizes), np.array(shared)

        def near(a, others, count):
            fits = 100 * np.minimum(size[others], size[a]) >= percent * np.maximum(size[others], size[a])
            return fits & (count >= np.minimum(least[others], least[a]))

        return [(ids[a], ids[b]) for a, b in link_sets([np.array(x) for x in sigs], sides, near)]

    return forest(members, ["centre", "band"], nodes.select("node", "n", "sigs", "shared"), ["n", "sigs", "shared"], solve, scratch, "clustered", block)


def candidate_groups(nodes: DataFrame, percent: int, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """root, node: groups such that nodes which share as many signatures as they must are in the same one.

    Two nodes that share a signature of a large bucket are compared by all their signatures there; the signatures that any
    other two share are all of small buckets.
    """
    signed = nodes.where("shared > 0").select("node", "n", "shared", F.explode("sigs").alias("sig"))
    common = scratch.write(signed.groupBy("sig").agg(F.min("node").alias("centre"), F.count("*").alias("many")).where("many > 1"), "common")
    small, large = common.where(F.col("many") <= PAIRED).select("sig"), common.where(F.col("many") > PAIRED).select("sig", "centre")
    near = scratch.write(paired_candidates(signed.join(small, "sig"), percent), "paired")
    # large buckets hold more than PAIRED rows each; their signatures are met by a join that spreads hot ones
    far = clustered_candidates(signed.join(large, "sig"), nodes, percent, scratch, block)
    found = components(near.unionByName(far), scratch, "candidate")
    scratch.drop("common")
    return found.select(F.col("component").alias("root"), "node")


def verified_links(every: DataFrame, nodes: DataFrame, words: int, percent: int, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect what the join connects, of nodes (node, n, sigs, shared) and the sketched rows with their texts."""
    return verified_groups(every, candidate_groups(nodes, percent, scratch), words, percent, scratch, block)


def verified_groups(every: DataFrame, groups: DataFrame, words: int, percent: int, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect within each group (root, node) the nodes whose whole sets are within the threshold."""

    def solve(ids, sides, texts):
        powers, sets = resident("powers", 0, Powers), []
        texts = [t or "" for t in texts]
        for a, b in batches(texts, 1_500_000):
            sets += shingle_sets(texts[a:b], words, powers)
        size = np.array([len(s) for s in sets])
        near = lambda a, others, count: 100 * count >= percent * (size[others] + size[a] - count)
        return [(ids[a], ids[b]) for a, b in link_sets(sets, sides, near)]

    texts = scratch.write(sieve(every.select(F.col("row").alias("node"), "text"), "node", groups), "texts", "zstd")
    return forest(groups, ["root"], texts, ["text"], solve, scratch, "verified", block)


def _settled(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, up (the smallest node reachable) of all links of one task."""
    found = [(part.column(0).to_numpy(), part.column(1).to_numpy()) for part in parts if part.num_rows]
    if not found:
        return
    a, b = (np.concatenate(x) for x in zip(*found))
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    links = Links(len(nodes))
    for x, y in zip(place[: len(a)].tolist(), place[len(a) :].tolist()):
        links.join(x, y)
    up = np.array([links.root(i) for i in range(len(nodes))], np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[up])], names=["node", "up"])


def components(links: DataFrame, scratch: Scratch, name: str = "component") -> DataFrame:
    """node, component (the smallest node reachable) of the nodes of links (a, b).

    In each round every node moves up to its smallest neighbour if that is smaller, and the links between what they moved to
    go on: at least half of the nodes vanish a round, so all rounds together handle little more than the first. When no more
    than ``FEW_LINKS`` are left, one task settles them. The steps up are then chained from the last round back.
    """
    tidy = lambda df: df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = scratch.write(tidy(links.select("a", "b")), f"{name}-edges0")
    steps: list[DataFrame] = []
    while True:
        turn = len(steps)
        if edges.count() <= FEW_LINKS:
            steps.append(scratch.write(edges.coalesce(1).mapInArrow(_settled, "node long, up long"), f"{name}-step{turn}"))
            break
        near = edges.union(edges.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        step = scratch.write(near.select("node", F.least("node", "m").alias("up")), f"{name}-step{turn}")
        steps.append(step)
        up = lambda c: step.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up")).hint("merge")  # noqa: B023, E731
        edges = scratch.write(tidy(edges.join(up("a"), "a").join(up("b"), "b").select(F.col("a_up").alias("a"), F.col("b_up").alias("b"))), f"{name}-edges{turn + 1}")
        scratch.drop(f"{name}-edges{turn}")
    found = steps.pop().select("node", F.col("up").alias("component"))
    for step in reversed(steps):
        # a star's nodes all move up to one; the optimiser splits such a join
        above = found.select(F.col("node").alias("up"), F.col("component").alias("far"))
        found = step.join(above, "up", "left").select("node", F.coalesce("far", "up").alias("component"))
    return scratch.write(found, name)


def named_groups(nodes: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """set_key, copies, component_id, first_row of every node (node, set_key, first, copies), by the components found."""
    lowest = nodes.select("node", "first").join(found, "node").groupBy("component").agg(F.min("first").alias("lowest"))
    placed = nodes.join(found.join(lowest, "component"), "node", "left").withColumn("lowest", F.coalesce("lowest", "first"))
    return scratch.write(placed.select("set_key", "copies", F.col("lowest.doc_id").alias("component_id"), F.col("lowest.row").alias("first_row")), "named")


def _grouped(docs: DataFrame, words: int, percent: int, carry: bool) -> tuple[DataFrame, DataFrame]:
    """All sketched rows, and (set_key, copies, component_id, first_row) of every set that takes part."""
    scratch = Scratch(docs.sparkSession, "shingles")
    every = sketch(docs, words, percent, frequent_tokens(docs, words, percent, scratch), scratch, carry)
    named = every.where("set_key is not null and doc_id is not null")
    first = F.min(F.struct("doc_id", "tie", "row")).alias("first")
    whole = named.groupBy("set_key").agg(first, F.count("*").alias("copies"), F.first(F.struct(F.col("n_shingles").cast("int").alias("n"), "sigs", "shared")).alias("s"))
    nodes = scratch.write(whole.select("set_key", F.col("first.row").alias("node"), "first", "copies", "s.*"), "nodes")
    found = components(verified_links(every, nodes, words, percent, scratch), scratch)
    groups = named_groups(nodes, found, scratch)
    return every, groups


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: two documents link when 100 * intersection >= percent * union.

    Words are runs of anything but space and 0x09-0x0D, A-Z lower-cased. Null and empty texts have no shingle and link with
    nothing: their component is their own doc_id. Rows with a null doc_id link with nothing either and have a null component.
    Repeated rows are returned each, and rows of one doc_id with different texts are judged apart. Other columns are not read;
    an empty table gives an empty result.
    """
    every, groups = _grouped(docs, words, percent, False)
    named = every.where("set_key is not null and doc_id is not null").select("doc_id", "n_shingles", "set_key")
    linked = join_groups(named, groups, ["set_key"], "copies", named.count())
    alone = every.where("set_key is null or doc_id is null")
    return linked.select("doc_id", "n_shingles", "component_id").unionByName(alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def without_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all their columns, of which each group of linked documents keeps one: smallest doc_id, ties by hash of the text.

    What links is as in ``jaccard_components``; texts without a word and rows with a null doc_id link with nothing and stay.
    Of repeated rows one stays. Rows are told apart by ids of their own, so another text under a doc_id that goes is kept.
    """
    every, groups = _grouped(docs, words, percent, True)
    named = every.where("set_key is not null and doc_id is not null").select("row", "set_key")
    gone = join_groups(named, groups, ["set_key"], "copies", named.count()).where("row <> first_row").select("row")
    others = [c for c in docs.columns if c != "text"]
    own = {c: F.col(f"_carried{i}").alias(c) for i, c in enumerate(others)} | {"text": F.col("text")}
    return every.join(gone, "row", "left_anti").select(*(own[c] for c in docs.columns))
