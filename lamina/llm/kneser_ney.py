"""Perplexity under an interpolated modified Kneser-Ney n-gram model.

Spark counts the words of all documents first, so that each has a number, the
frequent ones small numbers. The scan tasks then pack their distinct n-grams,
as numbers of words, by shard; one shuffle brings the counts of a shard's
contexts together, and its task writes them as sorted arrays of hashes to the
shared folder. What it passes on counts the words before each shorter n-gram,
so every lower order takes one more shuffle, smaller than the last. There are
as many shards as the corpus has SHARD_TOKENS, and contexts of words so
frequent that they would crowd a shard are divided among all shards by their
next word. Workers map the arrays into memory, so the model may be larger than
any worker.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_tokens, mix, partitions, saved, scratch, small_batches

#: Tokens that a scan task counts before it passes the counts on.
FLUSH_TOKENS = 2 << 20
#: Tokens of the corpus for each shard.
SHARD_TOKENS = 2 << 20
#: Bytes of text that are scored at once.
SCORE_BYTES = 8 << 20
#: Words of the longest n-grams in op10_lm_score.
ORDER = 3
#: How far from its share of a bucket a hash is looked for first.
NEAR = 4
BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_CLASSES = 48
_32 = np.uint64(32)


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the texts' tokens, END after each text, and each text's first position; a text of n tokens has n + 1, a text of none has none."""
    tokens, at = hashed_tokens(texts)
    n = np.diff(at)
    size = np.where(n > 0, n + 1, 0)
    first = np.concatenate([[0], np.cumsum(size)])
    words = np.full(first[-1], END, np.uint64)
    inner = np.ones(len(words), bool)
    inner[first[1:][n > 0] - 1] = False
    words[inner] = tokens
    return words, first


def grams(words: np.ndarray, first: np.ndarray, order: int, begin: int) -> list[np.ndarray]:
    """The n-grams that end at each position, as a column for each of their words."""
    within = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
    columns = [words]
    for k in range(1, order):
        left = np.full(len(words), begin, words.dtype)
        left[k:] = np.where(within[k:] >= k, words[: max(len(words) - k, 0)], begin)
        columns.insert(0, left)
    return columns


def spread(numbers: np.ndarray) -> np.ndarray:
    return mix(numbers.astype(np.uint64) + np.uint64(0xA4093822299F31D0))


_SEED = np.uint64(0x452821E638D01377)


def extended(key: np.ndarray | np.uint64, column: np.ndarray) -> np.ndarray:
    """The hashes of rows that are longer by a column of spread numbers."""
    return mix(key ^ column)


def fold(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of the columns' rows."""
    out = _SEED
    for x in columns:
        out = extended(out, spread(x))
    return out


def coded(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes, and each one's number among them."""
    code, names = pd.factorize(hashes)
    order = np.argsort(names)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return names[order], rank[code]


def shard_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Which of n even ranges of 64-bit integers a key is in."""
    return ((keys >> _32) * np.uint64(n) >> _32).astype(np.int32)


def hot(context: list[np.ndarray], below: int) -> np.ndarray:
    """Which contexts are of frequent words only; numbers of words below this are frequent."""
    out = context[0] < below
    for x in context[1:]:
        out = out & (x < below)
    return out


def distinct(columns: list[np.ndarray], n: np.ndarray | None, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows in their order, and the sums of n, or how often each was there; numbers have so many bits."""
    if not len(columns[0]):
        return columns, np.zeros(0, np.int64)
    if bits * len(columns) <= 64:
        key = columns[0].astype(np.uint64)
        for c in columns[1:]:
            key = key << np.uint64(bits) | c.astype(np.uint64)
        if n is None:
            key = np.sort(key)
        else:
            order = np.argsort(key)
            key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        total = np.diff(np.append(first, len(key))) if n is None else np.add.reduceat(n[order], first)
        key, out = key[first], []
        for _ in columns:
            out.insert(0, (key & np.uint64((1 << bits) - 1)).astype(np.int64))
            key = key >> np.uint64(bits)
        return out, total
    n = np.ones(len(columns[0]), np.int64) if n is None else n
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.add.reduceat(n[order], first)


def _planes(values: np.ndarray) -> tuple[int, bytes]:
    """How many bytes the largest needs, and the values' bytes, those of one rank together, as most of the upper ones are 0."""
    size = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return size, np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def packed(arrays: list[np.ndarray]) -> bytes:
    """Non-negative integers, the first array ascending, compressed."""
    arrays = [np.diff(arrays[0], prepend=arrays[0].dtype.type(0)), *arrays[1:]]
    planes = [_planes(a) for a in arrays]
    head = np.array([len(arrays[0]), *(size for size, _ in planes)], "<i8")
    raw = b"".join(p for _, p in planes)
    return head.tobytes() + pa.Codec("zstd", 3).compress(raw, asbytes=True)


def unpacked(blob: bytes, width: int) -> list[np.ndarray]:
    head = np.frombuffer(blob[: 8 * (width + 1)], "<i8")
    n, sizes = int(head[0]), head[1:]
    raw = np.frombuffer(pa.Codec("zstd").decompress(blob[8 * (width + 1) :], int(n * sizes.sum())), np.uint8)
    out, at = [], 0
    for size in sizes.tolist():
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :size] = raw[at : at + n * size].reshape(size, n).T
        out.append(wide.view("<u8").reshape(-1))
        at += n * size
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return [out[0], *(x.view(np.int64) for x in out[1:])]


def by_shard(shard: np.ndarray, arrays: list[np.ndarray]):
    """(shard, packed rows) of each shard, in the order that the rows have."""
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], shard[order][1:] != shard[order][:-1]])) if len(order) else []
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        own = order[a:b]
        yield int(shard[own[0]]), packed([x[own] for x in arrays])


GRAM, HOT, TOLD = 0, 1, 2
ROW = "shard int, kind int, blob binary"


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["shard", "kind", "blob"])


# tables of sorted hashes


def bucket_bits(n: int) -> int:
    return max(1, (n // 16).bit_length())


def save_table(path: str, keys: np.ndarray) -> None:
    """Sorted distinct hashes: where each bucket of their upper bits begins, some 16 in each, and 32 bits more of each."""
    bits = np.uint64(bucket_bits(len(keys)))
    saved(f"{path}.at.npy", np.searchsorted(keys >> np.uint64(64) - bits, np.arange((1 << int(bits)) + 1).astype(np.uint64)).astype(np.uint32))
    saved(f"{path}.key.npy", (keys << bits >> _32).astype(np.uint32))


def save_counts(path: str, n: np.ndarray) -> None:
    """Half a byte for each count, and the places of those of 15 and more with their own arrays."""
    low = np.minimum(n, 15).astype(np.uint8)
    low = np.append(low, np.zeros(len(low) % 2, np.uint8))
    saved(f"{path}.n.npy", low[::2] | low[1::2] << 4)
    many = np.flatnonzero(n >= 15)
    saved(f"{path}.many.npy", np.stack([many, n[many]]))


def save_stats(path: str, stats: list[np.ndarray]) -> None:
    """Rows of several numbers, of which few kinds are frequent: the kinds, and each row's."""
    _, first, code = np.unique(fold(stats), return_index=True, return_inverse=True)
    saved(f"{path}.kinds.npy", np.stack([x[first] for x in stats], 1) if len(first) else np.zeros((0, len(stats)), np.int64))
    saved(f"{path}.kind.npy", code.astype(np.min_scalar_type(max(len(first) - 1, 0))))


def _lower_bound(own: np.ndarray, key: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where in [low, high) of the sorted own the first one that isn't less than each key is; high if there is none."""
    place, last = low.copy(), np.int32(len(own) - 1)
    step = 1 << max(0, int((high - low).max(initial=0)).bit_length() - 1)
    while step:
        there = place + np.int32(step - 1)
        place += np.where((there < high) & (own[np.minimum(there, last)] < key), np.int32(step), np.int32(0))
        step >>= 1
    return place


class Files:
    """The arrays of a folder, mapped into memory when they are first asked for."""

    def __init__(self, path: str):
        self.path, self.open = path, {}

    def __call__(self, name: str) -> np.ndarray:
        if name not in self.open:
            path = f"{self.path}/{name}.npy"
            small = os.path.getsize(path) < 4096  # and an empty one can't be mapped
            self.open[name] = np.load(path) if small else np.load(path, mmap_mode="r")
        return self.open[name]

    def has(self, name: str) -> bool:
        if name not in self.open:
            return os.path.exists(f"{self.path}/{name}.npy")
        return True

    def places(self, name: str, keys: np.ndarray) -> np.ndarray:
        """Where the keys are in a table, -1 for those that aren't."""
        at, own = self(f"{name}.at"), self(f"{name}.key")
        if not len(own):
            return np.full(len(keys), -1, np.int32)
        bits = np.uint64(len(at).bit_length() - 1)
        bucket = (keys >> np.uint64(64) - bits).astype(np.int64)
        key = (keys << bits >> _32).astype(np.uint32)
        low, high = at[bucket].astype(np.int32), at[bucket + 1].astype(np.int32)
        # hashes are even, so a key is near its share of the bucket; what isn't within NEAR is looked for in the whole
        guess = low + (key.astype(np.int64) * (high - low) >> 32).astype(np.int32)
        from_, to = np.maximum(guess - NEAR, low), np.minimum(guess + NEAR, high)
        place = _lower_bound(own, key, from_, to)
        hit = own[np.minimum(place, len(own) - 1)] == key
        hit &= place < high
        far = np.flatnonzero(~hit & ((place == from_) & (from_ > low) | (place == to) & (to < high)))
        if len(far):
            place[far] = _lower_bound(own, key[far], low[far], high[far])
            hit[far] = (own[np.minimum(place[far], len(own) - 1)] == key[far]) & (place[far] < high[far])
        return np.where(hit, place, -1)

    def counts(self, name: str, keys: np.ndarray) -> np.ndarray:
        place = self.places(name, keys)
        hit = np.flatnonzero(place >= 0)
        place = place[hit]
        n = (self(f"{name}.n")[place >> 1] >> (place & 1).astype(np.uint8) * np.uint8(4) & np.uint8(15)).astype(np.int64)
        many, = np.nonzero(n == 15)
        if len(many):
            where, count = self(f"{name}.many")
            n[many] = count[np.searchsorted(where, place[many])]
        out = np.zeros(len(keys), np.int64)
        out[hit] = n
        return out

    def stats(self, name: str, keys: np.ndarray, width: int) -> np.ndarray:
        place = self.places(name, keys)
        hit = np.flatnonzero(place >= 0)
        out = np.zeros((len(keys), width), np.int64)
        if len(hit):
            out[hit] = self(f"{name}.kinds")[self(f"{name}.kind")[place[hit]]]
        return out


def each_shard(shard: np.ndarray):
    """(shard, its rows) for each."""
    order = np.argsort(shard.astype(np.uint16) if len(shard) and shard.max() < 1 << 16 else shard, kind="stable")
    own = shard[order]
    cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else []
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        yield int(own[a]), order[a:b]


# the words


class Vocabulary:
    def __init__(self, told: dict):
        self.told, self.files = told, Files(told["path"])

    def numbers(self, names: np.ndarray) -> np.ndarray:
        """The numbers of sorted hashes of words; unknown ones have that of no word."""
        n = self.told["word_shards"]
        out = np.full(len(names), self.told["words"], np.int64)
        cuts = np.searchsorted(shard_of(names, n), np.arange(n + 1))
        for shard in np.flatnonzero(np.diff(cuts)):
            if not self.files.has(f"names/{shard}"):
                continue
            keys, ids = self.files(f"names/{shard}"), self.files(f"numbers/{shard}")
            own = names[cuts[shard] : cuts[shard + 1]]
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            out[cuts[shard] : cuts[shard + 1]] = np.where(keys[at] == own, ids[at], self.told["words"])
        return out


def vocabulary(docs: DataFrame, path: str) -> dict:
    """Numbers all words of docs, the more frequent (by powers of two) before the less; writes each shard's hashes and numbers."""
    spark = docs.sparkSession
    n = partitions(spark)

    def scanned(batches):
        held, size = [], 0

        def merged():
            names, total = _sum_by(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            held.clear()
            return _rows([(s, GRAM, blob) for s, blob in by_shard(shard_of(names, n), [names, total])])

        for batch in batches:
            words, first = tokens_of(batch.column(0))
            names, code = coded(words)
            total = np.bincount(code, minlength=len(names))
            texts = int((np.diff(first) > 0).sum())
            held.append((np.append(names, BEGIN), np.append(total, texts)))
            size += len(names)
            if size > FLUSH_TOKENS:
                yield merged()
                size = 0
        if held:
            yield merged()

    def counted(batches):
        shard, parts = None, []
        for batch in batches:
            for row in batch.to_pylist():
                shard = row["shard"]
                parts.append(unpacked(row["blob"], 2))
        if not parts:
            return
        names, total = _sum_by(*(np.concatenate([p[k] for p in parts]) for k in range(2)))
        names, total = names[total > 0], total[total > 0]
        if not len(names):
            return
        classes = np.frexp(total.astype(float))[1]
        order = np.argsort(-classes, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        saved(f"{path}/names/{shard}.npy", names)
        saved(f"{path}/classes/{shard}.npy", classes.astype(np.uint8))
        sizes = np.bincount(classes, minlength=_CLASSES + 1)[: _CLASSES + 1]
        found = [int(total[np.searchsorted(names, x)]) if x in names else 0 for x in (BEGIN,)]
        yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([sizes], pa.list_(pa.int64())), pa.array([int(total.sum()) - found[0]]), pa.array([found[0]])], ["shard", "sizes", "tokens", "texts"])

    rows = docs.select("text").where("text is not null").mapInArrow(scanned, ROW)
    told = rows.repartitionById(n, "shard").mapInArrow(counted, "shard int, sizes array<bigint>, tokens bigint, texts bigint").collect()
    told.sort(key=lambda r: r.shard)
    sizes = np.array([r.sizes for r in told], np.int64).reshape(-1, _CLASSES + 1)
    flat = sizes[:, ::-1].T.ravel()  # the highest class of all shards first
    start = (np.cumsum(flat) - flat).reshape(_CLASSES + 1, -1).T[:, ::-1]
    begin = {r.shard: start[k].tolist() for k, r in enumerate(told)}

    def numbered(batches):
        for batch in batches:
            for shard, first in zip(*(c.to_pylist() for c in batch.columns)):
                classes = np.load(f"{path}/classes/{shard}.npy")
                ids = np.empty(len(classes), np.int64)
                for c in np.unique(classes):
                    own = np.flatnonzero(classes == c)
                    ids[own] = first[c] + np.arange(len(own))
                saved(f"{path}/numbers/{shard}.npy", ids.astype(np.uint32) if ids.max(initial=0) < 1 << 32 else ids)
            yield pa.record_batch([pa.array([batch.num_rows])], ["n"])

    if begin:
        spark.createDataFrame([*begin.items()], "shard int, first array<bigint>").repartition(min(n, len(begin))).mapInArrow(numbered, "n bigint").agg(F.sum("n")).collect()
    out = {"path": path, "word_shards": n, "words": int(sizes.sum()), "tokens": sum(r.tokens for r in told)}
    # numbers of the words of the classes from 2 ** c on are below hot[c]
    out["from_class"] = np.cumsum(sizes.sum(0)[::-1])[::-1].tolist()
    out["begin"], out["end"] = (int(Vocabulary(out).numbers(np.array([x]))[0]) for x in (BEGIN, END))
    return out


def _sum_by(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys and the sums of n."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n[order], first) if len(key) else n


def discounts(n: np.ndarray) -> list[float]:
    """The discounts of counts 1, 2 and at least 3, from how many entries have counts 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1 or not n2:
        return [0.5, 0.75, 0.75] if n1 or n2 or n3 else [0.0, 0.0, 0.0]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2 - 3 * y * n3 / n2]
    return [float(np.clip(x, 0.0, k + 1.0)) for k, x in enumerate(d)]


def train(docs: DataFrame, order: int = 2, shard_tokens: int = SHARD_TOKENS) -> dict:
    """Counts the model of n-grams of up to order words over all texts and writes it; returns what workers need to open it.

    Null texts and texts without words teach nothing; repeated rows count as
    often as they are there; texts are read whole, however long; other columns
    are ignored. No texts make a model that knows no word.
    """
    if order < 2:
        raise ValueError("the order is at least 2")
    spark = docs.sparkSession
    docs = small_batches(docs)
    path = scratch(spark, "kneser-ney")
    told = vocabulary(docs, path)
    spark.sparkContext._jvm.System.gc()  # what the words were sent by isn't needed: Spark removes shuffles that nothing refers to
    n = max(partitions(spark), -(-told["tokens"] // shard_tokens))
    crowding = int(np.ceil(np.log2(max(shard_tokens // 4, 1)))) + 1
    below = told["from_class"][crowding] if crowding <= _CLASSES else 0
    told |= {"order": order, "shards": n, "hot": below}
    bits = max(1, told["words"].bit_length())
    of_size = 7 + 4 * (order - 1)

    def routed(columns: list[np.ndarray]) -> np.ndarray:
        """The shard of each n-gram: its context's, or its own if the context is divided."""
        if len(columns) == 1:
            return shard_of(fold(columns), n)
        route = fold(columns[:-1])
        some = np.flatnonzero(hot(columns[:-1], below))
        route[some] = fold([c[some] for c in columns])
        return shard_of(route, n)

    def scanned(batches):
        words, held, size = Vocabulary(told), [], 0

        def merged():
            columns, total = distinct([np.concatenate([h[k] for h in held]) for k in range(order)], None, bits)
            held.clear()
            return _rows([(s, GRAM, blob) for s, blob in by_shard(routed(columns), [*columns, total])])

        for batch in batches:
            hashes, first = tokens_of(batch.column(0))
            names, code = coded(hashes)
            held.append(grams(words.numbers(names)[code], first, order, told["begin"]))
            size += len(code)
            if size > FLUSH_TOKENS:
                yield merged()
                size = 0
        if size:
            yield merged()

    def gathered(batches, width: int):
        """A shard's n-grams of one width, the sums of its divided contexts' numbers, and of what is told."""
        shard, parts, crowds, of = None, [], [], np.zeros(of_size, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                shard = row["shard"]
                if row["kind"] == GRAM:
                    parts.append(unpacked(row["blob"], width + 1))
                elif row["kind"] == HOT:
                    crowds.append(unpacked(row["blob"], 5))
                else:
                    of += np.frombuffer(row["blob"], np.int64)
        if shard is None:
            return None
        if crowds:
            context = np.concatenate([c[0] for c in crowds])
            keys = np.unique(context)
            stats = [_sum_by(context, np.concatenate([c[k] for c in crowds]))[1] for k in range(1, 5)]
            save_table(f"{path}/{shard}/hot{width + 1}", keys)
            save_stats(f"{path}/{shard}/hot{width + 1}", stats)
        if not parts:
            return shard, None, None, of
        columns, total = distinct([np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(width)], np.concatenate([p[width] for p in parts]), bits)
        return shard, columns, total, of

    def table(name: str, key: np.ndarray, total: np.ndarray) -> None:
        by = np.argsort(key)
        save_table(name, key[by])
        save_counts(name, total[by])

    def level(width: int):
        def write(batches):
            got = gathered(batches, width)
            if got is None:
                return
            shard, columns, total, of = got
            rows = []
            if columns is not None:
                # n-grams are in the order of their words, so each context's lie together
                new = np.ones(len(total), bool)
                new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:-1]])
                first = np.flatnonzero(new)
                stats = [np.add.reduceat(x, first) for x in (total, *(x.astype(np.int64) for x in (total == 1, total == 2, total >= 3)))]
                context = [c[first] for c in columns[:-1]]
                key, crowd = fold(context), hot(context, below)
                table(f"{path}/{shard}/gram{width}", extended(np.repeat(key, np.diff(np.append(first, len(total)))), spread(columns[-1])), total)
                by = np.argsort(key)
                some = by[~crowd[by]]
                save_table(f"{path}/{shard}/context{width}", key[some])
                save_stats(f"{path}/{shard}/context{width}", [x[some] for x in stats])
                some = by[crowd[by]]
                rows += [(s, HOT, blob) for s, blob in by_shard(shard_of(key[some], n), [key[some], *(x[some] for x in stats)])]
                of[7 + 4 * (width - 2) : 7 + 4 * (width - 1)] += [np.sum(total == k) for k in (1, 2, 3, 4)]
                # each n-gram is one word before the shorter one
                shorter, seen = distinct(columns[1:], None, bits)
                rows += [(s, GRAM, blob) for s, blob in by_shard(routed(shorter), [*shorter, seen])]
            yield _rows([*rows, (shard % n, TOLD, of.tobytes())])

        return write

    def unigrams(batches):
        got = gathered(batches, 1)
        if got is None:
            return
        shard, columns, seen, of = got
        if columns is not None:
            table(f"{path}/{shard}/gram1", fold(columns), seen)
            of[:7] += np.array([np.sum(seen == k) for k in (1, 2, 3, 4)] + [seen.sum(), len(seen), np.sum(seen >= 3)], np.int64)
        yield pa.record_batch([pa.array([of], pa.list_(pa.int64()))], ["of"])

    counted = docs.where("text is not null").select("text").mapInArrow(scanned, ROW)
    # one job: each order's counts lie on disk once, as what the next order's tasks read
    for width in range(order, 1, -1):
        counted = counted.repartitionById(n, "shard").mapInArrow(level(width), ROW)
    found = counted.repartitionById(n, "shard").mapInArrow(unigrams, "of array<bigint>").collect()
    of = np.array([r.of for r in found] or [[0] * of_size]).sum(0)
    d1 = discounts(of[:4])
    total, kinds, many = (int(x) for x in of[4:7])
    back_off = (d1[0] * int(of[0]) + d1[1] * int(of[1]) + d1[2] * many) / total if total else 1.0
    gram_d = {width: discounts(of[7 + 4 * (width - 2) :][:4]) for width in range(2, order + 1)}
    return told | {"gram": gram_d, "word": d1, "total": total, "vocabulary": kinds, "uniform": back_off / (kinds + 1)}


class Model:
    """The model's arrays, mapped into memory when a shard is first asked for."""

    def __init__(self, told: dict):
        self.told, self.words, self.files = told, Vocabulary(told), Files(told["path"])

    def counts(self, width: int, key: np.ndarray, route: np.ndarray) -> np.ndarray:
        """How often the n-grams of these hashes, which lie in their routes' shards, were counted."""
        out = np.zeros(len(key), np.int64)
        for shard, own in each_shard(shard_of(route, self.told["shards"])):
            if self.files.has(f"{shard}/gram{width}.at"):
                out[own] = self.files.counts(f"{shard}/gram{width}", key[own])
        return out

    def contexts(self, width: int, key: np.ndarray, crowd: np.ndarray) -> np.ndarray:
        """For each context of n-grams of a width the sum of their counts, and how many of them have count 1, 2 and more; crowd are the divided ones."""
        out = np.zeros((len(key), 4), np.int64)
        for shard, own in each_shard(shard_of(key, self.told["shards"])):
            for kind, some in (("hot", own[crowd[own]]), ("context", own[~crowd[own]])):
                name = f"{shard}/{kind}{width}"
                if len(some) and self.files.has(f"{name}.at"):
                    out[some] = self.files.stats(name, key[some], 4)
        return out

    def log_probability(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural logarithms of P(word | words before it) of texts of hashed words, each order interpolated with the one below."""
        t = self.told
        less = lambda n, d: np.maximum(n - np.array([0.0, *d])[np.minimum(n, 3)], 0.0)
        names, code = coded(hashes)
        ids = self.words.numbers(names)
        alone = fold([ids])
        p = (less(self.counts(1, alone, alone), t["word"]) / max(t["total"], 1) + t["uniform"])[code]
        ids = np.append(ids, t["begin"])
        mixed, alone, frequent = spread(ids), fold([ids]), ids < t["hot"]
        columns = grams(code, first, t["order"], len(ids) - 1)
        for width in range(2, t["order"] + 1):
            d, own = t["gram"][width], columns[-width:]
            key, crowd = alone[own[0]], frequent[own[0]]
            for x in own[1:-1]:
                key, crowd = extended(key, mixed[x]), crowd & frequent[x]
            # contexts of one word are looked up once for each word
            stats = self.contexts(2, alone, frequent)[own[0]] if width == 2 else self.contexts(width, key, crowd)
            gram = extended(key, mixed[own[-1]])
            total = stats[:, 0]
            over = np.maximum(total, 1)
            n = self.counts(width, gram, np.where(crowd, gram, key))
            p = less(n, d) / over + np.where(total > 0, stats[:, 1:] @ np.array(d) / over, 1.0) * p
        return np.log(np.maximum(p, 1e-300))


def score(docs: DataFrame, told: dict) -> DataFrame:
    """(doc_id, n_tokens, log_prob, perplexity) of every row of docs.

    n_tokens counts the text's words and its end. A text that is null or has
    no words has n_tokens 0, log_prob 0 and a null perplexity. Repeated rows
    are each scored, and alike; texts are read whole, however long; doc_ids
    are of any type, other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def over(batches):
        model, held, size = Model(told), [], 0

        def scored():
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            hashes, first = tokens_of(table.column(1).combine_chunks())
            logs = np.concatenate([[0.0], np.cumsum(model.log_probability(hashes, first))])
            n, log = np.diff(first), np.diff(logs[first])
            perplexity = pa.array(np.exp(-log / np.maximum(n, 1)), mask=n == 0)
            return pa.record_batch([table.column(0).combine_chunks(), pa.array(n), pa.array(log), perplexity], ["doc_id", "n_tokens", "log_prob", "perplexity"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size > SCORE_BYTES:
                yield scored()
                size = 0
        if held:
            yield scored()

    return small_batches(docs).select("doc_id", "text").mapInArrow(over, f"doc_id {kind}, n_tokens bigint, log_prob double, perplexity double")


def perplexity(docs: DataFrame, order: int = 2) -> DataFrame:
    """score of docs under the model of all of docs."""
    return score(docs, train(docs, order))
