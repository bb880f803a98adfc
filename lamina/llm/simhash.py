"""SimHash near-dedup with BK-trees.

A document's fingerprint has 128 bits, the majority of its distinct words'
hashes in each. Fingerprints are cut into radius + c blocks; two within the
radius agree in c of them at least (pigeonhole), so those that share the
values of c blocks form a shard, c being as many as keep shards small. A shard
is sent once to the task that searches it, and only a shard of more than
SHARD_ROWS fingerprints is cut into slices, each of which gets all the shard's
queries. In its task a slice is a forest of BK-trees: children are keyed by
their Hamming distance to the parent, and a search follows only the edges
within the radius of the query's distance. Blocks are taken in runs: in one of
them two near fingerprints differ in fewer bits than the run has blocks, so the
shard of the run's first block in which they agree has few of the run's other
bits left to differ in, and there is a tree for each value of these. Searches
go depth first in steps of VISITS nodes, which bounds a worker's memory however
many trees are met and however wide they are. The links found connect exactly
what brute force would, whatever the number of shards and slices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, hashed_tokens, in_batches, mix, partitions, small_batches, without_ids

BITS = 128
RADIUS = 17
#: Nodes compared at once, and a fourth of the children looked at, which bounds a worker's memory.
VISITS = 1 << 15
#: Links held before they are reduced to those that connect the same.
LINKS = 1 << 19
#: Blocks in a run.
RUN = 3
#: Fingerprints in one task's trees, at most.
SHARD_ROWS = 1 << 20
#: Fingerprints of small shards that are searched at once.
POOL_ROWS = 1 << 15
#: Rows that a task holds before it sends them to their shards.
FLUSH_ROWS = 1 << 19
#: What sending a fingerprint to one more shard costs, in nodes visited.
SEND_WORK = 300
#: Bytes sent to one task of the search, about.
TASK_BYTES = 64 << 20


def fingerprints(texts: pa.Array) -> np.ndarray:
    """Two 64-bit halves for each text. A text without words has a fingerprint of its exact bytes."""
    tokens, at = hashed_tokens(texts)
    second = mix(tokens + np.uint64(0xD1B54A32D192ED03))
    out = np.zeros((len(texts), 2), np.uint64)
    for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
        if b > a:
            seen, k = np.unique(tokens[a:b], return_index=True)
            words = np.empty((len(seen), 2), np.uint64)
            words[:, 0], words[:, 1] = seen, second[a:b][k]
            ones = np.add.reduce(np.unpackbits(words.view(np.uint8), axis=1), axis=0, dtype=np.int32)
            out[i] = np.packbits(2 * ones > len(seen)).view(np.uint64)
        else:
            raw = (texts[i].as_py() or "").encode()
            out[i] = np.frombuffer(hashlib.blake2b(raw, digest_size=16).digest(), np.uint64)
    return out


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, 0] ^ b[:, 0]).astype(np.int16) + np.bitwise_count(a[:, 1] ^ b[:, 1])


def blocks(m: int) -> list[tuple[int, int]]:
    """m blocks of BITS: first bit and width."""
    cuts = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def search_work(n: int, radius: int, m: int) -> float:
    """The nodes that one query of n fingerprints in m blocks is expected to visit, and the trees that it looks for."""
    near = radius // m
    probes = [(sum(comb(w, k) for k in range(near + 1)), w) for _, w in blocks(m)]
    return sum(p * (1 + 3 * n / 2.0**w) for p, w in probes)


def block_count(n: int, radius: int) -> int:
    """The number of blocks with the least expected work for n fingerprints; any gives the same pairs."""
    return min((m for m in range(2, radius + 2) if max(w for _, w in blocks(m)) <= 40), key=lambda m: search_work(n, radius, m))


def block_values(fps: np.ndarray, first: int, width: int) -> np.ndarray:
    low, high = fps[:, 0], fps[:, 1]
    if first >= 64:
        v = high >> np.uint64(first - 64)
    else:
        v = low >> np.uint64(first)
        if first + width > 64:
            v = v | high << np.uint64(64 - first)
    return v & np.uint64((1 << width) - 1)


def masks(width: int, near: int) -> np.ndarray:
    """All flips of at most near of width bits."""
    return np.array([sum(1 << b for b in bits) for k in range(near + 1) for bits in combinations(range(width), k)], np.uint64)


def joined_values(fps: np.ndarray, cuts: list[tuple[int, int]]) -> np.ndarray:
    """The values of some blocks, one beside the other."""
    out = np.zeros(len(fps), np.uint64)
    for first, width in cuts:
        out = out << np.uint64(width) | block_values(fps, first, width)
    return out


def run_parts(radius: int) -> list[tuple[list[tuple[int, int]], np.ndarray]]:
    """For each of radius + 1 blocks, the other blocks of its run and the flips of their bits that it answers for.

    Two fingerprints within the radius differ, in some run, in fewer bits than
    the run has blocks, so they agree in one of its blocks; the first such
    answers for them, and the run's blocks before it differ. No flip is there
    always, as linking needs.
    """
    cuts, out = blocks(radius + 1), []
    for k in range(radius + 1):
        run = range(k - k % RUN, min(k - k % RUN + RUN, radius + 1))
        others = [cuts[i] for i in run if i != k]
        flips = masks(sum(w for _, w in others), len(run) - 1)
        keep, right = np.ones(len(flips), bool), sum(w for _, w in others)
        for i in range(run[0], k):
            right -= cuts[i][1]
            keep &= (flips >> np.uint64(right) & np.uint64((1 << cuts[i][1]) - 1)) > 0
        out.append((others, flips[keep | (flips == 0)]))
    return out


def in_runs(radius: int, c: int) -> bool:
    """Whether shards that agree in c blocks are searched by runs; wide blocks, or several that agree, are searched in blocks of their own."""
    return c == 1 and (RUN - 1) * max(w for _, w in blocks(radius + 1)) <= 40


class ShardTrees:
    """A BK-tree for each value of shard: nodes are positions in fps, kept as arrays."""

    def __init__(self, shard: np.ndarray, fps: np.ndarray):
        self.low, self.high = np.ascontiguousarray(fps[:, 0]), np.ascontiguousarray(fps[:, 1])
        n = len(fps)
        order = np.argsort(shard, kind="stable").astype(np.int32)
        self.values, first = np.unique(shard[order], return_index=True)
        self.roots = order[first]
        sizes = np.diff(np.append(first, n))
        parent = np.repeat(self.roots, sizes)
        rest = np.ones(n, bool)
        rest[first] = False
        item, parent = order[rest], parent[rest]
        edges = []
        while len(item):
            d = np.bitwise_count(self.low[item] ^ self.low[parent]) + np.bitwise_count(self.high[item] ^ self.high[parent])
            by = np.lexsort((item, d, parent))
            item, parent, d = item[by], parent[by], d[by]
            new = np.ones(len(item), bool)
            new[1:] = (parent[1:] != parent[:-1]) | (d[1:] != d[:-1])
            edges.append((parent[new], d[new], item[new]))
            heads = np.flatnonzero(new)
            child = np.repeat(item[new], np.diff(np.append(heads, len(item))))
            item, parent = item[~new], child[~new]  # the others go down to the child on their edge
        p, d, c = (np.concatenate(x) if edges else np.zeros(0, np.int32) for x in (zip(*edges) if edges else ([], [], [])))
        by = np.lexsort((d, p))
        self.child, self.edge = c[by], d[by].astype(np.int16)
        self.ptr = np.searchsorted(p[by], np.arange(n + 1)).astype(np.int32)

    def search(self, shard: np.ndarray, query: np.ndarray, fps: np.ndarray, radius: int, linking: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) within the radius; query[i] is to be looked for in the tree of shard[i].

        With linking, not all pairs but such as connect the same: what hangs
        on a near node by an edge within the radius is near to that node, and
        its own query tells so. A crowd of near copies costs each of them one
        path instead of one pair with each other.
        """
        at = np.searchsorted(self.values, shard)
        at[at == len(self.values)] = 0
        hit = self.values[at] == shard if len(self.values) else np.zeros(len(shard), bool)
        return self.descend(query[hit], self.roots[at[hit]], fps, radius, linking)

    def descend(self, query: np.ndarray, node: np.ndarray, fps: np.ndarray, radius: int, linking: bool = False) -> tuple[np.ndarray, np.ndarray]:
        low, high = fps[:, 0], fps[:, 1]
        found, todo = [], [(query, node)]
        while todo:
            query, node = todo.pop()
            if len(query) > VISITS:
                todo.append((query[VISITS:], node[VISITS:]))
                query, node = query[:VISITS], node[:VISITS]
            a = self.ptr[node]
            n = self.ptr[node + 1] - a
            ends = np.cumsum(n)
            if len(query) > 1 and ends[-1] > 4 * VISITS:
                k = max(1, int(np.searchsorted(ends, 4 * VISITS, "right")))
                todo.append((query[k:], node[k:]))
                query, node, a, n = query[:k], node[:k], a[:k], n[:k]
            d = (np.bitwise_count(low[query] ^ self.low[node]) + np.bitwise_count(high[query] ^ self.high[node])).astype(np.int16)
            near = d <= radius
            if near.any():
                found.append((query[near], node[near]))
            some = np.flatnonzero(n)
            if not len(some):
                continue
            query, d, a, n = query[some], d[some], a[some], n[some]
            which = np.repeat(np.arange(len(query)), n)
            k = np.arange(len(which)) + np.repeat(a - np.cumsum(n) + n, n)
            edge, d = self.edge[k], d[which]
            follow = np.abs(edge - d) <= radius
            if linking:
                follow &= (edge > radius) | (d > radius)
            if follow.any():
                todo.append((query[which[follow]], self.child[k[follow]]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, least member) that connect what the pairs connect, fewer than there are members."""
    if not len(a):
        return a, b
    names, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = codes[: len(a)], codes[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(names))
    return names[moved], names[label[moved]]


def _two_words(hi, lo) -> np.ndarray:
    out = np.empty((len(lo), 2), np.uint64)
    out[:, 0] = lo.to_numpy(zero_copy_only=False).view(np.uint64)
    out[:, 1] = hi.to_numpy(zero_copy_only=False).view(np.uint64)
    return out


_ROW = np.dtype([("id", "<i8"), ("lo", "<u8"), ("hi", "<u8")])


def agreeing(n: int, radius: int, shard_rows: int) -> int:
    """How many blocks a shard agrees in, by the least expected work for n fingerprints: the copies of each, times the slices of a shard, times what sending and searching one costs."""

    def work(c: int) -> float:
        size = n / 2.0 ** sum(sorted(w for _, w in blocks(radius + c))[:c])
        inside = int(min(size, shard_rows))
        return comb(radius + c, c) * -(-size // shard_rows) * (SEND_WORK + search_work(inside, radius, block_count(inside, radius)))

    return min((1, 2, 3), key=work)


def shards(fps: np.ndarray, radius: int, c: int) -> np.ndarray:
    """The shards of each fingerprint, a column for each choice of c of radius + c blocks; the choice's number is above the blocks' values."""
    cuts = blocks(radius + c)
    values = [block_values(fps, *b) for b in cuts]
    most = np.uint64(max(w for _, w in cuts))
    out = []
    for k, chosen in enumerate(combinations(range(len(cuts)), c)):
        key = np.full(len(fps), k, np.uint64)
        for b in chosen:
            key = key << most | values[b]
        out.append(key.view(np.int64))
    return np.stack(out, 1)


class Searcher:
    """The trees of some fingerprints, which are in groups that don't meet: those of a block's run, if the groups are shards of that block, else those of the blocks whose work is least for the groups' size."""

    def __init__(self, fps: np.ndarray, group: np.ndarray, radius: int, block: int | None = None):
        self.radius = radius
        sizes = np.bincount(group)
        if block is None:
            m = block_count(int((sizes.astype(float) ** 2).sum() / max(len(fps), 1)), radius)
            parts = [([b], masks(b[1], radius // m)) for b in blocks(m)]
        else:
            parts = [run_parts(radius)[block]]
        self.parts = []
        for cuts, flips in parts:
            width = sum(w for _, w in cuts)
            tree = ShardTrees(group.astype(np.uint64) << np.uint64(width) | joined_values(fps, cuts), fps)
            root = None
            if len(sizes) << width <= 1 << 22:
                root = np.full(len(sizes) << width, -1, np.int32)
                root[tree.values.astype(np.int64)] = tree.roots
            self.parts.append((cuts, width, tree, root, flips))

    def links(self, queries: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers (query, node) of links that connect each query to all of its group that is within the radius of it, some at a time.

        The groups' fingerprints must all be queries, here or in another call:
        of two that differ in a flip, the one whose highest flipped bit is 0
        asks for the other.
        """
        for cuts, width, tree, root, flips in self.parts:
            highest = np.array([1 << f.bit_length() >> 1 for f in flips.tolist()], np.uint64)
            step = max(1, 4 * VISITS // len(flips))
            for k in range(0, len(queries), step):
                values = group[k : k + step].astype(np.uint64) << np.uint64(width) | joined_values(queries[k : k + step], cuts)
                row, flip = np.nonzero((values[:, None] & highest) == 0)
                probe = values[row] ^ flips[flip]
                row += k
                if root is None:
                    yield tree.search(probe, row, queries, self.radius, linking=True)
                else:
                    start = root[probe.astype(np.int64)]
                    hit = start >= 0
                    yield tree.descend(row[hit], start[hit], queries, self.radius, linking=True)


def _blobs(names: list[np.ndarray], rows: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
    size = rows.dtype.itemsize
    offsets = pa.py_buffer((cuts * size).astype(np.int32).tobytes())
    blobs = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, offsets, pa.py_buffer(rows.tobytes())])
    shard, piece, query = names
    return pa.record_batch([pa.array(shard), pa.array(piece), pa.array(query), blobs], ["shard", "slice", "query", "blob"])


def near_edges(reps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges (a, b), a != b, that connect the fingerprints (id, hi, lo) within the radius of each other; ids and fingerprints are distinct.

    A fingerprint is sent once to each of its shards, of which there are 18
    for up to about a billion fingerprints, and to all slices of a shard that
    has more than shard_rows. The number of tasks follows from what is sent.
    """
    spark = reps.sparkSession
    n = reps.count()
    c = agreeing(n, radius, shard_rows)
    copies = comb(radius + c, c)
    by_runs, most = in_runs(radius, c), max(w for _, w in blocks(radius + c))

    def sized(batches):
        for batch in batches:
            if batch.num_rows:
                shard, n = np.unique(shards(_two_words(batch.column(1), batch.column(2)), radius, c), return_counts=True)
                yield pa.record_batch([pa.array(shard), pa.array(n)], ["shard", "n"])

    # only shards that skewed fingerprints make larger than expected: fewer than 2 * copies * n / shard_rows
    crowded = reps.mapInArrow(sized, "shard bigint, n bigint").groupBy("shard").agg(F.sum("n").alias("n")).where(F.col("n") > shard_rows).collect() if n > shard_rows else []
    crowd = np.array(sorted((r.shard, -(-r.n // shard_rows)) for r in crowded), np.int64).reshape(-1, 2)
    shared = spark.sparkContext.broadcast(crowd)

    def send(batches):
        names, slices = shared.value[:, 0], shared.value[:, 1]

        def packed(held):
            rows = np.concatenate(held)
            fps = np.stack([rows["lo"], rows["hi"]], 1)
            shard = shards(fps, radius, c).ravel()
            row = np.repeat(np.arange(len(rows)), copies)
            at = np.minimum(np.searchsorted(names, shard), max(len(names) - 1, 0))
            pieces = np.where(names[at] == shard, slices[at], 1) if len(names) else np.ones(len(shard), np.int64)
            if pieces.sum() > 2 * FLUSH_ROWS and len(rows) > 1:
                yield from packed([rows[: len(rows) // 2]])
                yield from packed([rows[len(rows) // 2 :]])
                return
            own = (mix(rows["lo"] ^ rows["hi"])[row] % pieces.astype(np.uint64)).astype(np.int64)
            if len(names):
                many = np.repeat(np.arange(len(shard)), pieces)
                piece = np.arange(len(many)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                shard, row, query = shard[many], row[many], piece != own[many]
            else:
                piece, query = own, np.zeros(len(own), bool)
            order = np.lexsort((query, piece, shard)) if len(names) else np.argsort(shard, kind="stable")
            shard, piece, query = shard[order], piece[order], query[order]
            new = np.ones(len(order), bool)
            new[1:] = (shard[1:] != shard[:-1]) | (piece[1:] != piece[:-1]) | (query[1:] != query[:-1])
            heads = np.flatnonzero(new)
            yield _blobs([shard[heads], piece[heads].astype(np.int32), query[heads]], rows[row[order]], np.append(heads, len(order)))

        held, size = [], 0
        for batch in batches:
            rows = np.empty(batch.num_rows, _ROW)
            fps = _two_words(batch.column(1), batch.column(2))
            rows["id"], rows["lo"], rows["hi"] = batch.column(0).to_numpy(), fps[:, 0], fps[:, 1]
            held.append(rows)
            size += len(rows) * copies
            if size > FLUSH_ROWS:
                yield from packed(held)
                held, size = [], 0
        if size:
            yield from packed(held)

    def search(batches):
        key, held, size, trees, ids, left, right, found, reduced_to = None, [], 0, None, None, [], [], 0, 0

        def looked(rows, group):
            nonlocal left, right, found
            for q, node in trees.links(np.stack([rows["lo"], rows["hi"]], 1), group):
                a, b = rows["id"][q], ids[node]
                left.append(a[a != b])
                right.append(b[a != b])
                found += len(left[-1])
                if found > LINKS + reduced_to:
                    reduced()

        def reduced():
            nonlocal left, right, found, reduced_to
            a, b = forest(np.concatenate(left), np.concatenate(right))
            left, right, found, reduced_to = [a], [b], len(a), len(a)

        def planted():
            """Trees of the slices that are held, which are searched by their own fingerprints."""
            nonlocal trees, ids, held, size
            rows = np.concatenate([r for part in held for r in part])
            group = np.repeat(np.arange(len(held)), [sum(map(len, part)) for part in held])
            held, size, ids = [], 0, rows["id"]
            trees = Searcher(np.stack([rows["lo"], rows["hi"]], 1), group, radius, block)
            looked(rows, group)

        def told():
            nonlocal left, right, found, reduced_to
            reduced()
            out = pa.record_batch([pa.array(left[0]), pa.array(right[0])], ["a", "b"])
            left, right, found, reduced_to = [], [], 0, 0
            return out

        last = 0  # the number among the trees of the slice that queries are for
        block = None  # the block that the shards held agree in
        for batch in batches:
            for shard, piece, query, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                rows = np.frombuffer(blob.as_buffer(), _ROW)
                if (shard, piece) != key:
                    of = shard >> most if by_runs else None
                    if size > POOL_ROWS or size and of != block:
                        planted()
                    elif not size:
                        held = []
                    key, trees, block = (shard, piece), None, of
                    held.append([])
                if not query:
                    held[-1].append(rows)
                    size += len(rows)
                    continue
                if trees is None and held and held[-1]:
                    last = len(held) - 1
                    planted()
                if trees is not None:  # else the slice got no fingerprints of its own
                    looked(rows, np.full(len(rows), last))
                if found > LINKS:
                    yield told()
            if found > LINKS:
                yield told()
        if size:
            planted()
        if found:
            yield told()

    parts = max(partitions(spark), n * copies * _ROW.itemsize // TASK_BYTES)
    sent = reps.mapInArrow(send, "shard bigint, slice int, query boolean, blob binary")
    return sent.repartition(parts, "shard", "slice").sortWithinPartitions("shard", "slice", "query").mapInArrow(search, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id of the edges (a, b) that isn't the least of its component; root is the least.

    Large-star and small-star steps alternate until nothing changes; each
    round is kept in the shared folder. Least neighbours are aggregates, which
    are combined before the shuffle, so a hub's edges never meet in one task.
    """
    e = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    state = None
    while True:
        low = e.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        large = checkpointed(e.join(low, e["b"] == low["u"], "left").select("a", F.coalesce("m", "b").alias("b")).distinct())
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        both = large.join(low, large["a"] == low["u"]).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = checkpointed(both.unionAll(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (r.n, r.h) == state:
            return e.select(F.col("a").alias("id"), F.col("b").alias("root"))
        state = (r.n, r.h)


def classes(docs: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of every doc_id with a text, (doc_id, hi, lo), and each fingerprint's group: hi, lo, root, least (doc_id) and n (documents; one of several fingerprints is counted once).

    Equal texts have one fingerprint, so however many copies there are, what
    is searched and connected is one row.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    cols = small_batches(docs).where("doc_id is not null and text is not null").select("doc_id", "text")

    def over(batch):
        fps = fingerprints(batch.column(1))
        return pa.record_batch([batch.column(0), pa.array(fps[:, 1].view(np.int64)), pa.array(fps[:, 0].view(np.int64))], ["doc_id", "hi", "lo"])

    each = checkpointed(cols.mapInArrow(in_batches(over), f"doc_id {kind}, hi bigint, lo bigint"))
    spread = [f(c).alias(f"{n}_{c}") for c in ("hi", "lo") for n, f in (("least", F.min), ("most", F.max))]
    per = checkpointed(each.groupBy("doc_id").agg(*spread))
    one = "least_hi = most_hi and least_lo = most_lo"
    rows = per.where(one).select("doc_id", F.col("least_hi").alias("hi"), F.col("least_lo").alias("lo"), F.lit(1).alias("n"))
    several = checkpointed(each.join(per.where(f"not ({one})").select("doc_id"), "doc_id", "left_semi").distinct())
    mixed = not several.isEmpty()
    if mixed:
        main = several.groupBy("doc_id").agg(F.min(F.struct("hi", "lo")).alias("f")).select("doc_id", "f.hi", "f.lo", F.lit(1).alias("n"))
        rows = rows.unionAll(several.select("doc_id", "hi", "lo", F.lit(0).alias("n"))).unionAll(main)
    reps = rows.groupBy("hi", "lo").agg(F.min("doc_id").alias("least"), F.sum("n").alias("n"))
    reps = checkpointed(reps.select(F.monotonically_increasing_id().alias("id"), "hi", "lo", "least", "n"))
    edges = near_edges(reps.select("id", "hi", "lo"), radius, shard_rows)
    if mixed:  # a doc_id on several rows joins their groups, as an edge does
        named = several.join(reps, ["hi", "lo"]).select("doc_id", "id")
        edges = edges.unionAll(named.join(named.groupBy("doc_id").agg(F.min("id").alias("b")), "doc_id").select(F.col("id").alias("a"), "b"))
    near = reps.join(components(edges), "id", "left").withColumn("root", F.coalesce("root", "id"))
    return rows.select("doc_id", "hi", "lo"), near.select("hi", "lo", "root", "least", "n")


def grouped(docs: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, root) of every document with a doc_id and a text: root is the least doc_id of its group of near copies.

    Groups are connected: a near copy of a near copy belongs. Equal texts
    have equal fingerprints; texts without words are near only to equal ones.
    doc_ids are of any type that has an order.
    """
    rows, near = classes(docs, radius, shard_rows)
    least = near.groupBy("root").agg(F.min("least").alias("least"))
    names = near.select("hi", "lo", "root").join(least, "root").select("hi", "lo", "least")
    return rows.join(names, ["hi", "lo"]).select("doc_id", F.col("least").alias("root")).distinct()


def kept(docs: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id of the document that stays of each group, the least, and n_docs, the documents in the group.

    Null texts and doc_ids are in no group; rows that share a doc_id are one
    document. Other columns are ignored; an empty table has no groups.
    """
    near = classes(docs, radius, shard_rows)[1]
    return near.groupBy("root").agg(F.min("least").alias("doc_id"), F.sum("n").alias("n_docs")).select("doc_id", "n_docs")


def dedup(docs: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The rows of docs less near copies: of each group the document with the least doc_id stays.

    A null text or doc_id stays. Rows that share a doc_id are one document
    and stay or go together. Other columns pass through whatever their names;
    very long texts are read whole.
    """
    rows, near = classes(docs, radius, shard_rows)
    stay = near.groupBy("root").agg(F.min("least").alias("doc_id")).select("doc_id")
    gone = rows.select("doc_id").join(stay, "doc_id", "left_anti").distinct()
    return without_ids(docs, checkpointed(gone))
