"""Histories as relations: changes (path, seq, hash; a null hash is a deletion), states, differences, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .trees import ancestors


def last_write(events: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Of each key the columns of its last event; order decides, and must not tie."""
    last = events.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.col(order)).alias("last"))
    return last.select(*keys, *(F.col(f"last.{c}").alias(c) for c in columns))


def as_of(changes: DataFrame, seq: int | Column, columns: tuple[str, ...] = ("hash",)) -> DataFrame:
    """path and columns of what lives at commit seq."""
    return last_write(changes.where(F.col("seq") <= seq), ["path"], "seq", [*columns]).where(F.col(columns[0]).isNotNull())


def intervals(changes: DataFrame) -> DataFrame:
    """path, hash, valid_from and valid_to (null: still valid) of every version that isn't a deletion."""
    after = F.lead("seq").over(Window.partitionBy("path").orderBy("seq"))
    return changes.select("path", "hash", F.col("seq").alias("valid_from"), after.alias("valid_to")).where("hash is not null")


def diff(old: DataFrame, new: DataFrame, old_dirs: DataFrame | None = None, new_dirs: DataFrame | None = None) -> DataFrame:
    """status (A, M, D), path, old_hash and new_hash of the leaves (path, hash) that differ.

    Given both sides' directories (path), a path that is a leaf on one side and
    a directory on the other is one M, and what is below it isn't told.
    """
    a = old.select("path", F.col("hash").alias("old_hash"))
    b = new.select("path", F.col("hash").alias("new_hash"))
    rows = a.join(b, "path", "full_outer").where(~F.col("old_hash").eqNullSafe(F.col("new_hash")))
    status = F.when(F.col("old_hash").isNull(), "A").when(F.col("new_hash").isNull(), "D").otherwise("M")
    out = rows.select(status.alias("status"), "path", "old_hash", "new_hash")
    if old_dirs is None or new_dirs is None:
        return out
    turned = old.select("path").join(new_dirs.select("path"), "path").unionByName(new.select("path").join(old_dirs.select("path"), "path"))
    below = out.select("*", F.explode(ancestors(F.col("path"), own=True)).alias("at")).join(turned.select(F.col("path").alias("at")), "at", "left_semi").select("path")
    out = out.join(below, "path", "left_anti")
    both = turned.join(old.select("path", F.col("hash").alias("old_hash")), "path", "left").join(new.select("path", F.col("hash").alias("new_hash")), "path", "left")
    return out.unionByName(both.select(F.lit("M").alias("status"), "path", "old_hash", "new_hash"))


def differences_between(changes: DataFrame, first: int, second: int) -> DataFrame:
    """diff of two commits of one history in one aggregation, without building either state."""
    at = lambda seq: F.max_by(F.when(F.col("seq") <= seq, F.col("hash")), F.when(F.col("seq") <= seq, F.col("seq")))
    both = changes.where(F.col("seq") <= max(first, second)).groupBy("path").agg(at(first).alias("old_hash"), at(second).alias("new_hash"))
    both = both.where(~F.col("old_hash").eqNullSafe(F.col("new_hash")))
    status = F.when(F.col("old_hash").isNull(), "A").when(F.col("new_hash").isNull(), "D").otherwise("M")
    return both.select(status.alias("status"), "path", "old_hash", "new_hash")


def changed_per_commit(changes: DataFrame) -> DataFrame:
    """seq, status and path of every leaf that a commit changed, held against its parent."""
    before = F.lag("hash").over(Window.partitionBy("path").orderBy("seq"))
    rows = changes.select("seq", "path", "hash", before.alias("before")).where(~F.col("hash").eqNullSafe(F.col("before")))
    status = F.when(F.col("before").isNull(), "A").when(F.col("hash").isNull(), "D").otherwise("M")
    return rows.select("seq", status.alias("status"), "path", F.col("before").alias("old_hash"), F.col("hash").alias("new_hash"))


def path_log(states: DataFrame) -> DataFrame:
    """seq, hash and annotation ('added', 'deleted' or '') of the commits at which a path's state (seq, hash; null: absent) changed.

    The window is over one path's states, so it is one task by design.
    """
    before = F.lag("hash").over(Window.orderBy("seq"))
    rows = states.select("seq", "hash", before.alias("before")).where(~F.col("hash").eqNullSafe(F.col("before")))
    note = F.when(F.col("before").isNull(), "added").when(F.col("hash").isNull(), "deleted").otherwise("")
    return rows.select("seq", "hash", note.alias("annotation"))


#: Rows of a slice of runs, as long as there are no more than MOST_SLICES.
SLICE_ROWS, MOST_SLICES = 100_000, 256


def _slices(events: DataFrame, order: str) -> list:
    """Values of order that cut events into slices of about SLICE_ROWS. Only how even slices are depends on them."""
    got = events.agg(F.count("*").alias("n"), F.percentile_approx(order, [k / MOST_SLICES for k in range(1, MOST_SLICES)], 10_000).alias("at")).first()
    n = min(MOST_SLICES, -(-got.n // SLICE_ROWS))
    return sorted({got["at"][k * MOST_SLICES // n - 1] for k in range(1, n)}) if n > 1 else []


def _slice_of(order: str, bounds: list, first: int = 0) -> Column:
    """The number of bounds below order, found by halving."""
    if not bounds:
        return F.lit(first)
    half = len(bounds) // 2
    return F.when(F.col(order) <= F.lit(bounds[half]), _slice_of(order, bounds[:half], first)).otherwise(_slice_of(order, bounds[half + 1 :], first + half + 1))


def runs(events: DataFrame, key: str, order: str, shard: list[str] | None = None) -> DataFrame:
    """events with run_id: adjacent events of equal key share one; a null key is a run of its own.

    Order, a number, is total within a shard; without shards it is total over
    all events. Runs are counted in slices of the order, so that no task has a
    whole shard; how a slice begins and ends then says what its numbers lack.
    """
    shard = shard or []
    w = Window.partitionBy(*shard, "run_slice").orderBy(order)
    same = F.col(key).isNotNull() & F.lag(key).over(w).eqNullSafe(F.col(key))
    sliced = events.withColumn("run_slice", _slice_of(order, _slices(events, order)))
    first = sliced.withColumn("run_start", F.when(same, 0).otherwise(1))
    total = F.sum("run_start").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edges = first.groupBy(*shard, "run_slice").agg(F.sum("run_start").alias("n"), F.min_by(key, order).alias("begins"), F.max_by(key, order).alias("ends"))
    along = Window.partitionBy(*shard).orderBy("run_slice")  # over a row for each slice
    goes_on = F.when(F.col("begins").isNotNull() & F.lag("ends").over(along).eqNullSafe(F.col("begins")), 1).otherwise(0)
    edges = edges.withColumn("goes_on", goes_on).withColumn("before", F.sum(F.col("n") - F.col("goes_on")).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    names = [*shard, "run_slice"]
    edges = edges.select(*(F.col(c).alias(f"edge_{k}") for k, c in enumerate(names)), "before")
    numbered = first.withColumn("run_id", total).join(edges, [F.col(c).eqNullSafe(F.col(f"edge_{k}")) for k, c in enumerate(names)])
    return numbered.select(*events.columns, (F.col("run_id") + F.col("before")).alias("run_id"))


def event_class(op: Column) -> Column:
    """What a change event is: data, rebuild (the source must be read anew) or ignored."""
    return F.when(op.isin("insert", "update", "replace", "modify", "delete"), "data").when(op.isin("invalidate", "drop", "dropDatabase", "rename"), "rebuild").otherwise("ignored")


def cluster_nanos(t: Column, i: Column) -> Column:
    return t.cast("long") * 1_000_000_000 + i.cast("long")


def invalid_event(path: Column) -> Column:
    """Why an event's path can't be recorded, or null."""
    bad = lambda x: x.isNull() | (x == "") | x.contains("\t") | x.contains("\n") | x.contains("\0")
    return F.when(path.isNull() | (F.size(path) < 1), "EMALFORMED: empty path").when(F.exists(path, bad), "EMALFORMED: bad path component")


def formatted(template: str, columns: dict[str, Column]) -> Column:
    """A template's text: %H hash, %T type, %S size, %C stored size, %% a percent sign. Raises EINVAL for others before any row is read."""
    from ..errors import HistoryError

    parts, k, plain = [], 0, ""
    while k < len(template):
        if template[k] != "%":
            plain += template[k]
            k += 1
            continue
        sign = template[k + 1 : k + 2]
        if sign == "%":
            plain += "%"
        elif sign and sign in columns:
            parts += [F.lit(plain), columns[sign].cast("string")]
            plain = ""
        else:
            raise HistoryError("EINVAL", f"unknown format %{sign}")
        k += 2
    return F.concat(*parts, F.lit(plain))
