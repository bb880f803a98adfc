"""Exact dedup by content sort.

Copies that lie near each other in the input are combined before the exchange.
Sampled splitters range-partition the normalised texts, Spark's external sort
places equal ones next to each other, and neighbours are compared in full.
A range that holds more than its share, as its texts begin alike for longer
than the splitters, is divided further by a hash of the whole text.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, partitions, small_batches

#: Sampled texts for each partition of the sort.
SAMPLES_PER_PARTITION = 20
#: Characters that the driver sees of all sampled texts together, and of one: ranges of longer common beginnings are divided by a hash.
SAMPLE_TOTAL, SAMPLE_CHARS = 16 << 20, 4096
#: Rows and bytes among which a task combines copies before the exchange.
COMBINE_ROWS, COMBINE_BYTES = 10_000, 32 << 20


def normalised(text: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def splitters(sample: list[tuple[str, int]], n: int) -> list[str]:
    """Up to n - 1 keys that divide the sampled (text, length) into parts of about equal length, each cut to the shortest beginning that still does."""
    pairs = sorted((x.encode(), size) for x, size in sample)
    keys = [k for k, _ in pairs]
    ends = np.cumsum([size for _, size in pairs], dtype=np.float64) if pairs else np.zeros(1)
    out: list[str] = []
    for i in range(1, n):
        k = int(np.searchsorted(ends, i * ends[-1] / n, "right"))
        if not 0 < k < len(keys) or keys[k] == keys[k - 1]:
            continue
        low, high = keys[k - 1].decode(errors="ignore"), keys[k].decode(errors="ignore")
        m = next((j for j, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
        cut = high[: m + 1]
        if not out or cut.encode() > out[-1].encode():
            out.append(cut)
    return out


def slot(key: Column, cuts: list[str]) -> Column:
    """How many of the sorted cuts are at most key, by binary search."""
    if not cuts:
        return F.lit(0)
    steps = len(cuts).bit_length()
    table = F.lit(cuts + [None] * ((1 << steps) - 1 - len(cuts)))
    halves = F.array(*(F.lit(1 << i) for i in reversed(range(steps))))
    return F.aggregate(halves, F.lit(0), lambda at, half: F.when(F.element_at(table, at + half) <= key, at + half).otherwise(at))


def shares(sample: list[tuple[str, int]], cuts: list[str], n: int) -> list[int]:
    """For each range between the cuts, how many of n even parts the sampled (text, length) in it make, one at least."""
    bounds = [c.encode() for c in cuts]
    weight = np.zeros(len(cuts) + 1)
    for text, size in sample:
        weight[bisect_right(bounds, text.encode())] += size
    return np.maximum(1, np.round(weight * n / max(weight.sum(), 1))).astype(int).tolist()


def sorted_by_content(rows: DataFrame, docs: DataFrame, content: Column) -> DataFrame:
    """rows range-partitioned by content and sorted by it, then by doc_id with nulls last; docs are the texts that are sampled.

    Rows without content stay in as many partitions as they are in.
    """
    spark = rows.sparkSession
    n = partitions(spark)
    total = docs.count()
    want = n * SAMPLES_PER_PARTITION
    some = docs if total <= want else docs.sample(fraction=min(1.0, want / total), seed=17)
    key = normalised(F.col("text"))
    sample = some.select(F.substring(key, 1, max(64, min(SAMPLE_CHARS, SAMPLE_TOTAL // want))).alias("k"), (F.length(key) + 16).alias("size")).where("k is not null")
    sample = [(r.k, r.size) for r in sample.collect()]
    cuts = splitters(sample, n)
    parts = shares(sample, cuts, n)
    first = np.concatenate([[0], np.cumsum(parts)]).tolist()
    own = slot(content, cuts) + 1
    own = F.element_at(F.lit(first), own) + F.pmod(F.xxhash64(content), F.element_at(F.lit(parts), own).cast("long"))
    (at,) = fresh(rows, "slot")
    rows = rows.withColumn(at, F.when(content.isNull(), F.spark_partition_id() % first[-1]).otherwise(own).cast("int"))
    return rows.repartitionById(first[-1], at).sortWithinPartitions(content.asc_nulls_first(), F.col("doc_id").asc_nulls_last()).drop(at)


def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches, joined to tables of COMBINE_ROWS or COMBINE_BYTES."""
    held, rows, size = [], 0, 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= COMBINE_ROWS or size >= COMBINE_BYTES:
            rows, size = 0, 0
            yield pa.Table.from_batches([held.pop(0) for _ in range(len(held))])  # and nothing stays here
    if held:
        yield pa.Table.from_batches([held.pop(0) for _ in range(len(held))])


def combined(content: pa.ChunkedArray, ids: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have the least id of their content, nulls being the largest, and how many rows have it; rows without content are alone."""
    codes = pa.chunked_array([c.indices for c in content.dictionary_encode().chunks], pa.int32()).combine_chunks()
    alone = codes.is_null().to_numpy(zero_copy_only=False)
    codes = codes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    codes[alone] = len(codes) + np.arange(alone.sum())
    order = pa.table({"code": codes, "id": ids, "row": np.arange(len(codes))}).sort_by([("code", "ascending"), ("id", "ascending"), ("row", "ascending")])
    codes, row = order["code"].to_numpy(), order["row"].to_numpy()
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return row[first], np.diff(np.append(first, len(codes)))


def least_copies(table: pa.Table, content: int, ids: int) -> tuple[pa.Table, np.ndarray]:
    """The table's rows that combined() names, as they lie and in batches as small as its own, and how many rows each stands for; content and ids are columns."""
    row, n = combined(table.column(content), table.column(ids))
    stay = np.zeros(table.num_rows, bool)
    stay[row] = True
    return table.filter(pa.array(stay)), n[np.argsort(row)]


def _firsts(texts: pa.Array, before: pa.Scalar | None) -> np.ndarray:
    """Which rows differ from the one above in full; a null differs from all."""
    same = np.zeros(len(texts), bool)
    if len(texts) > 1:
        same[1:] = pc.equal(texts[1:], texts[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
    if before is not None and before.is_valid and texts[0].is_valid:
        same[0] = texts[0].as_py() == before.as_py()
    return ~same


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs less exact copies: of each group of equal normalised texts the row with the smallest doc_id stays.

    Null texts are no copies of anything and all stay; empty texts are copies
    of each other. Of repeated rows one stays. A null doc_id counts as the
    largest. Other columns pass through whatever their names; an empty table
    gives an empty one.
    """
    (key,) = fresh(docs, "content")
    keyed = small_batches(docs).withColumn(key, normalised(F.col("text")))
    width, text = len(docs.columns), docs.columns.index("text")
    at = docs.columns.index("doc_id")

    def combine(batches):
        for table in in_parts(batches):
            some, _ = least_copies(table, width, at)
            del table
            # most texts are normalised as they are and needn't be sent twice
            content = pc.if_else(pc.equal(some.column(width), some.column(text)), pa.scalar(None, some.column(width).type), some.column(width))
            yield from some.set_column(width, key, content).to_batches()

    def over(batches):
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = pc.coalesce(batch.column(width), batch.column(text))
            keep = _firsts(texts, before)
            before = texts[len(texts) - 1]
            yield batch.select(range(width)).filter(pa.array(keep))

    rows = keyed.mapInArrow(combine, keyed.schema)
    return sorted_by_content(rows, docs, F.coalesce(key, "text")).mapInArrow(over, docs.schema)


def copies(docs: DataFrame) -> DataFrame:
    """doc_id of each document that dedup keeps, and n_copies, the rows in its group."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    cols = small_batches(docs).select(normalised(F.col("text")).alias("content"), "doc_id")

    def combine(batches):
        for table in in_parts(batches):
            some, n = least_copies(table, 0, 1)
            del table
            yield from some.append_column("n", pa.array(n)).to_batches()

    def over(batches):
        held, n, before = None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, ids, rows = batch.column(0), batch.column(1), batch.column(2).to_numpy()
            at = np.flatnonzero(_firsts(texts, before))
            before = texts[len(texts) - 1]
            n += int(rows[: at[0]].sum()) if len(at) else int(rows.sum())
            if not len(at):
                continue
            sizes = np.add.reduceat(rows, at)
            if held is not None:
                yield pa.record_batch([pa.array([held.as_py()], ids.type), pa.array([n], pa.int64())], ["doc_id", "n_copies"])
            firsts = ids.take(pa.array(at))
            yield pa.record_batch([firsts[:-1], pa.array(sizes[:-1], pa.int64())], ["doc_id", "n_copies"])
            held, n = firsts[len(firsts) - 1], int(sizes[-1])
        if held is not None:
            yield pa.record_batch([pa.array([held.as_py()], held.type), pa.array([n], pa.int64())], ["doc_id", "n_copies"])

    rows = cols.mapInArrow(combine, f"content string, doc_id {kind}, n bigint")
    return sorted_by_content(rows, docs, F.col("content")).mapInArrow(over, f"doc_id {kind}, n_copies bigint")
