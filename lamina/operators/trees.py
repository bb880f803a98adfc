"""Merkle trees: directories' payloads and hashes, level by level from the deepest."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import digest, envelope, leb128
from ..functions.hashing import leb_hex, object_hash
from ..functions.sha256 import Sha256
from ..shared import checkpointed, small_arrow_batches


def parent(path: Column) -> Column:
    return F.slice(path, 1, F.size(path) - 1)


def ancestors(path: Column, own: bool = False) -> Column:
    """The path's proper beginnings, the root first; own adds the path itself."""
    return F.transform(F.sequence(F.lit(0), F.size(path) - (0 if own else 1)), lambda n: F.slice(path, 1, n))


def entry_hex(kind: Column, child: Column, name: Column) -> Column:
    """A tree entry's bytes in hexadecimal: type, hash, name's length, name."""
    return F.concat(kind, child, leb_hex(F.octet_length(name).cast("long")), F.lower(F.hex(name)))


def joined_entries(entry: str = "entry", name: str = "name") -> Column:
    """A directory's payload, as an aggregate: its entries in the order of their names' bytes."""
    return F.expr(f"coalesce(listagg({entry}, '') within group (order by {name}), '')")


def directory_hashes(entries: DataFrame, keys: list[str], algorithm: str = "sha2-256") -> DataFrame:
    """keys, payload_hex and hash of each directory; entries have the keys, kind ('01' or '02'), name and hash.

    A directory's payload is one value, so one directory is limited to some
    ten million entries; directories are spread over tasks.
    """
    rows = entries.select(*keys, "name", entry_hex(F.col("kind"), F.col("hash"), F.col("name")).alias("entry"))
    grouped = rows.groupBy(*keys).agg(joined_entries().alias("payload_hex"))
    return grouped.withColumn("hash", object_hash("02", F.col("payload_hex"), algorithm))


#: Bytes of a piece of a long directory's payload, and about how many of them one task hashes.
PIECE_BYTES, ROUND_BYTES = 1 << 20, 128 << 20


def long_directory_hashes(entries: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n (entries) and hash of each directory, as directory_hashes has them, for few directories of any length.

    No payload is ever one value: sorted ranges of entries become pieces, and
    pieces are hashed in rounds of ROUND_BYTES a directory. SHA-256 takes its
    bytes one after the other, so a round begins with the state that the last
    one ended in.
    """
    rows = entries.select(F.to_json(F.struct(*keys)).alias("dir"), "name", F.unhex(entry_hex(F.col("kind"), F.col("hash"), F.col("name"))).alias("entry"))
    sums = checkpointed(rows.groupBy("dir").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("entry")), F.lit(0)).alias("total")))

    def cut(batches):
        task, at = TaskContext.get().partitionId(), 0
        own, held, size = None, [], 0
        piece = lambda: pd.DataFrame({"dir": [own], "task": [task], "at": [at], "size": [size], "bytes": [b"".join(held)]})
        for batch in batches:
            for d, entry in zip(batch["dir"], batch["entry"]):
                if held and (d != own or size >= PIECE_BYTES):
                    yield piece()
                    at, held, size = at + 1, [], 0
                own = d
                held.append(entry)
                size += len(entry)
        if held:
            yield piece()

    ranges = small_arrow_batches(rows.where("entry is not null").repartitionByRange("dir", "name").sortWithinPartitions("dir", "name").select("dir", "entry"))
    pieces = checkpointed(ranges.mapInPandas(cut, "dir string, task int, at int, size long, bytes binary"))
    along = Window.partitionBy("dir").orderBy("task", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = pieces.select("dir", "task", "at", "size").withColumn("before", F.sum("size").over(along) - F.col("size")).withColumn("round", F.floor(F.col("before") / ROUND_BYTES))
    placed = checkpointed(placed.join(sums.select("dir", "total"), "dir").select("task", "at", "round", "before", "total"))
    placed, last = pieces.join(placed, ["task", "at"]), placed.agg(F.max("round").alias("n")).first().n
    states: dict[str, bytes] = {}
    done = []

    def hashed(batches):
        own = h = None
        for batch in batches:
            for d, data, before, total in zip(batch["dir"], batch["bytes"], batch["before"], batch["total"]):
                if d != own:
                    if h:
                        yield pd.DataFrame({"dir": [own], "hash": [None], "state": [h.state()]})
                    own, h = d, Sha256(states.get(d) if before else None)
                    if not before:
                        h.update(b"\2" + leb128(total))
                h.update(data)
                if before + len(data) == total:
                    yield pd.DataFrame({"dir": [d], "hash": [h.hexdigest()], "state": [None]})
                    h = None
        if h:
            yield pd.DataFrame({"dir": [own], "hash": [None], "state": [h.state()]})

    for n in range(0 if last is None else last + 1):
        own = placed.where(F.col("round") == n).repartition("dir").sortWithinPartitions("dir", "task", "at").select("dir", "bytes", "before", "total")
        ended = checkpointed(own.mapInPandas(hashed, "dir string, hash string, state binary"))
        states = {x.dir: bytes(x.state) for x in ended.where("hash is null").collect()}
        done.append(ended.where("hash is not null").select("dir", "hash"))
    out = sums.join(reduce(DataFrame.unionByName, done), "dir", "left") if done else sums.withColumn("hash", F.lit(None).cast("string"))
    kinds = ", ".join(f"`{k}` {entries.schema[k].dataType.simpleString()}" for k in keys)
    return out.select(F.from_json("dir", kinds).alias("dir"), "n", F.coalesce("hash", F.lit(digest(envelope(2, b"")).hex())).alias("hash")).select("dir.*", "n", "hash")


def build(leaves: DataFrame, directories: DataFrame | None = None, known: DataFrame | None = None, algorithm: str = "sha2-256") -> DataFrame:
    """path, hash, payload_hex of every directory above the leaves (path, hash), and of the given directories (path) even if empty.

    known (path, hash) are directories that stand as they are: they are
    entries of their parents and aren't built. The root has the empty path.
    There is one aggregation a level.
    """
    level = leaves.select("path", F.lit("01").alias("kind"), "hash")
    paths = leaves.select(F.explode(ancestors(F.col("path"))).alias("path"))
    root = leaves.sparkSession.createDataFrame([([],)], "path array<string>")
    paths = paths.unionByName(root)
    if directories is not None:
        paths = paths.unionByName(directories.select(F.explode(ancestors(F.col("path"), own=True)).alias("path")))
    if known is not None:
        paths = paths.unionByName(known.select(F.explode(ancestors(F.col("path"))).alias("path")))
        level = level.unionByName(known.select("path", F.lit("02").alias("kind"), "hash"))
        paths = paths.distinct().join(known.select("path"), "path", "left_anti")
    else:
        paths = paths.distinct()
    paths = checkpointed(paths)
    level = checkpointed(level)
    depth = paths.agg(F.max(F.size("path")).alias("n")).first().n
    done: list[DataFrame] = []
    for n in range(depth, -1, -1):
        here = paths.where(F.size("path") == n)
        children = level.where(F.size("path") == n + 1)
        if done:
            children = children.unionByName(done[-1].select("path", F.lit("02").alias("kind"), "hash"))
        rows = children.select(parent(F.col("path")).alias("path"), F.element_at("path", -1).alias("name"), "kind", "hash")
        rows = here.join(rows, "path", "left").select("path", "name", "kind", "hash")
        built = checkpointed(directory_hashes(rows, ["path"], algorithm))
        done.append(built)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("path", "hash", "payload_hex")


def versions_above(changes: DataFrame, kind: str = "01", algorithm: str = "sha2-256") -> DataFrame:
    """path, seq and hash (null: gone) of the directories right above the changed paths, at the commits that touch them.

    changes are path, seq and hash (null: a deletion) of one depth and kind. A
    directory is hashed only at the commits that change an entry of it, by a
    join on its own path: nothing is multiplied by all commits. A directory
    without entries is gone.
    """
    own = changes.select(parent(F.col("path")).alias("above"), F.element_at("path", -1).alias("name"), "seq", "hash")
    after = F.lead("seq").over(Window.partitionBy("above", "name").orderBy("seq"))
    lived = own.withColumn("until", after).where("hash is not null").withColumnRenamed("seq", "since")
    touched = own.select("above", "seq").distinct()
    rows = touched.join(lived, "above").where("since <= seq and (until is null or seq < until)")
    built = directory_hashes(rows.select("above", "seq", "name", F.lit(kind).alias("kind"), "hash"), ["above", "seq"], algorithm)
    return touched.join(built, ["above", "seq"], "left").select(F.col("above").alias("path"), "seq", "hash")
