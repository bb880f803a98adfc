"""What the corpus operators share: the shared folder, column names, packed tokens."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a side is broadcast; beyond it the plan shuffles instead.
BROADCAST_BYTES = 32 << 20
TEXTS_PER_BATCH = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own in local mode."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lamina-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(at)
    return at


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder for files that workers open themselves."""
    base = shared_dir(spark)
    if base.startswith("file:"):
        base = "/" + base[5:].lstrip("/")
    elif "://" in base:
        raise ValueError(f"memory-mapped files need a mounted folder, not {base}")
    return f"{base}/{kind}-{uuid.uuid4().hex}"


def saved(path: str, array: np.ndarray) -> None:
    """The array in a file, whole or not at all: a task that runs twice leaves the same file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    tmp = f"{path}.{uuid.uuid4().hex}"
    with open(tmp, "wb") as f:
        np.save(f, array)
    os.replace(tmp, path)


def fitted(spark: SparkSession, kind: str, key: str, make: Callable[[], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """The arrays that make() gives for a key, kept in the shared folder: what was fitted once from the same is read."""
    base = shared_dir(spark)
    path = ("/" + base[5:].lstrip("/") if base.startswith("file:") else base) + f"/fitted-{kind}-{hashlib.sha256(key.encode()).hexdigest()[:32]}.npz"
    if "://" in path:
        return make()
    if os.path.exists(path):
        with np.load(path) as told:
            return dict(told)
    out = make()
    os.makedirs(os.path.dirname(path), exist_ok=True)
    tmp = f"{path}.{uuid.uuid4().hex}"
    with open(tmp, "wb") as f:
        np.savez(f, **out)
    os.replace(tmp, path)
    return out


def best_cut(held: DataFrame, value: Callable[[np.ndarray, np.ndarray, float, float], np.ndarray]) -> tuple[float, float | None]:
    """The score down to which taking rows (score, n, bad) is worth most, the lowest of equals, and the next lower score, None if there is none.

    value gets how many rows and bad rows are taken, for each score, and the
    numbers of all; rows of one score go together. The rows are sorted in
    ranges, of which the driver sees the sums.
    """
    spark = held.sparkSession
    by = held.groupBy("score").agg(F.sum("n").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"))
    ranged = checkpointed(by.repartitionByRange(partitions(spark), F.col("score").desc()).sortWithinPartitions(F.col("score").desc()))
    parts = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.max("score").alias("top"), F.sum("n").alias("n"), F.sum("bad").alias("bad")).collect()
    parts.sort(key=lambda r: -r.top)
    every, all_bad = sum(r.n for r in parts), sum(r.bad for r in parts)
    before, n, bad = {}, 0.0, 0.0
    for k, r in enumerate(parts):
        before[r.part] = n, bad, parts[k + 1].top if k + 1 < len(parts) else None
        n, bad = n + r.n, bad + r.bad

    def best(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        s, n, bad, part = (np.concatenate([b.column(k).to_numpy() for b in rows]) for k in range(4))
        n0, bad0, after = before[int(part[0])]
        worth = value(n0 + np.cumsum(n), bad0 + np.cumsum(bad), every, all_bad)
        k = len(worth) - 1 - int(np.argmax(worth[::-1]))
        low = float(s[k + 1]) if k + 1 < len(s) else after
        yield pa.record_batch([pa.array([float(worth[k])]), pa.array([float(s[k])]), pa.array([low], pa.float64())], ["worth", "score", "low"])

    found = ranged.withColumn("part", F.spark_partition_id()).mapInArrow(best, "worth double, score double, low double").collect()
    top = max(found, key=lambda r: (r.worth, -r.score))
    return top.score, top.low


def scratch_at(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder for a table."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def scratch_table(df: DataFrame, at: str) -> DataFrame:
    """df, written as Parquet to a path and read again."""
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def dropped(spark: SparkSession, at: str) -> None:
    """Removes a scratch table that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def hashed_share(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About most of the rows, chosen by a hash of key, or all if there are no more: the choice needs no sort, and no task sends more than its part."""
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs less the rows whose doc_id is in ids (one column, no nulls); a null doc_id stays.

    ids are broadcast up to BROADCAST_BYTES, and joined by a shuffle beyond.
    """
    (gone,) = fresh(docs, "gone_id")
    ids = ids.toDF(gone)
    if ids.count() * 16 <= BROADCAST_BYTES:
        ids = F.broadcast(ids)
    return docs.join(ids, docs["doc_id"] == ids[gone], "left_anti")


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose session now passes TEXTS_PER_BATCH rows at a time to Python unless it was set otherwise: ten thousand long texts take hundreds of MB."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(TEXTS_PER_BATCH))
    return df


def in_batches(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable:
    """mapInArrow's function of one that maps a batch."""

    def over(batches):
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None and out.num_rows:
                yield out

    return over


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95]] = True
_WORD[128:] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLOCK = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every bit depends on all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes, one after the other, and where each begins; a null is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    if pa.types.is_large_string(texts.type):
        off = np.frombuffer(texts.buffers()[1], np.int64)
    else:
        off = np.frombuffer(texts.buffers()[1], np.int32) if texts.buffers()[1] else np.zeros(1, np.int32)
    off = off[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(off):
        off = np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, off - off[0]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """raw_bytes in lower case (ASCII and Latin-1)."""
    data, off = raw_bytes(texts)
    data = _LOWER[data]
    if len(data) > 1:
        lead = np.flatnonzero(data[:-1] == 0xC3) + 1
        lead = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
        data[lead] += 32
    return data, off


def token_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the tokens (runs of letters, digits, underscores and non-ASCII) begin and end, and the first token of each text."""
    word = _WORD[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = off[(off > 0) & (off < len(data))]
    first[edge] = word[edge]
    last[edge - 1] = word[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of data; the spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    powers = np.empty(0, np.uint64)
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + _BLOCK, "right")))
        n = int(ends[j - 1] - at)
        if len(powers) < n + 1:
            size = max(n, _BLOCK) + 1
            powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _P)]), dtype=np.uint64)
            back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _PINV)]), dtype=np.uint64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data[at : at + n].astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (sums[e] - sums[s]) * back[s]
        i = j
    return mix(out)


def hashed_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all tokens, and where each text's begin (one more entry than texts)."""
    data, off = text_bytes(texts)
    starts, ends, at = token_spans(data, off)
    return span_hashes(data, starts, ends), at
