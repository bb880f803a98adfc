"""The named queries: each has a plan and, where SQL can say it, the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.canonical import canonical, long_id, row_document
from ..functions.codec import commit_payload, digest, envelope
from ..functions.hashing import blake3_hex, blob_hash, envelope_hex, leb_hex, object_hash, zstd_size
from ..operators import history
from ..operators.trees import build, long_directory_hashes, versions_above
from ..repo import Repo, fsck, reachable, walk
from ..shared import checkpointed, scratch_path, shared_dir, small_arrow_batches
from ..sources.frames import encode_frames, read_frames
from ..sources.tables import cluster_scan, collection
from ..streaming.changes import carried_runs, changes, drain, watch
from . import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLE_SQL[f.__name__] = text
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day_number(ts: Column) -> Column:
    """Days since the end of 2023: the number of a day's commit."""
    return F.datediff(ts, F.lit("2023-12-31")).cast("long")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as change events: seq, day, path, payload (null: deletion)."""
    e = table(spark, sf_dir, "events")
    payload = row_document({"_id": long_id(F.col("user_id")), "props": F.replace(F.col("props"), F.lit(" "), F.lit("")), "type": F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))})
    path = F.array(F.lit("app"), F.concat(F.lit("g"), F.col("user_id") % 5), F.col("user_id").cast("string"))
    return e.select(F.col("event_id").alias("seq"), day_number(F.col("ts")).alias("day"), path.alias("path"), F.when(F.col("event_type") != "error", payload).alias("payload"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last change of each path in each day's commit, as changes (path, seq, hash, payload)."""
    last = history.last_write(raw_events(spark, sf_dir), ["path", "day"], "seq", ["payload"])
    return last.select("path", F.col("day").alias("seq"), blob_hash(F.col("payload")).alias("hash"), "payload")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.intervals(daily(spark, sf_dir))


def directory_changes(spark: SparkSession, sf_dir: str, depth: int = 0, within: list[str] | None = None) -> DataFrame:
    """path, seq and hash (null: gone) of the directories of at least a depth, at the commits that touch them; within looks at one directory's leaves only."""
    level, kind, out = daily(spark, sf_dir).select("path", "seq", "hash"), "01", None
    if within:
        level = level.where(F.slice("path", 1, len(within)) == F.array(*map(F.lit, within)))
    for _ in range(2, depth - 1, -1):
        level, kind = checkpointed(versions_above(level, kind)), "02"
        out = level if out is None else out.unionByName(level)
    return out


def day_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, path and hash of every directory at every commit: each version stands until the next."""
    days = daily(spark, sf_dir).select("seq").distinct()
    last = days.agg(F.max("seq").alias("last"))
    v = history.intervals(directory_changes(spark, sf_dir)).crossJoin(F.broadcast(last))  # one row
    until = F.coalesce(F.col("valid_to") - 1, F.col("last"))
    return v.select("path", "hash", F.explode(F.sequence("valid_from", until)).alias("seq")).join(days, "seq", "left_semi").select("seq", "path", "hash")


def commit_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq and root of every commit: each touches its root."""
    return directory_changes(spark, sf_dir).where((F.size("path") == 0) & F.col("hash").isNotNull()).select("seq", F.col("hash").alias("root"))


def document_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.array("source", "lang", F.concat(F.lit("doc"), F.col("doc_id")))
    return d.select(path.alias("path"), blob_hash(F.col("text")).alias("hash"), F.octet_length("text").cast("long").alias("size"))


def document_objects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(objects, tree entries, root) of the documents as one snapshot."""
    leaves = checkpointed(document_leaves(spark, sf_dir))
    trees = build(leaves.select("path", "hash"))
    objects = leaves.select("hash", F.lit("blob").alias("type"), "size").unionByName(trees.select("hash", F.lit("tree").alias("type"), F.expr("length(payload_hex) div 2").alias("size"))).distinct()
    up = trees.select(F.col("path").alias("above"), F.col("hash").alias("tree_hash"))
    child = leaves.select("path", F.lit("blob").alias("type"), "hash").unionByName(trees.where(F.size("path") > 0).select("path", F.lit("tree").alias("type"), "hash"))
    entries = child.withColumn("above", F.slice("path", 1, F.size("path") - 1)).join(up, "above").select("tree_hash", F.element_at("path", -1).alias("name"), "type", F.col("hash").alias("child_hash")).distinct()
    return checkpointed(objects), checkpointed(entries), trees.where(F.size("path") == 0).select("hash")


def shown(path: str = "path"):
    return F.array_join(path, "/").alias("path")


# addresses and storage


@query(f"SELECT doc_id, {sql.blob_hash('text')} AS hash FROM documents")
def blob_hash_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", blob_hash(F.col("text")).alias("hash"))


@query(f"SELECT doc_id, strlen(text) AS n_bytes, {sql.leb('strlen(text)')} AS leb FROM documents")
def leb128_len(spark, sf_dir):
    n = F.octet_length("text").cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n_bytes"), leb_hex(n).alias("leb"))


@query(f"SELECT event_id, '01' || {sql.leb('strlen(props)')} || {sql.text_hex('props')} AS envelope FROM events")
def envelope_bytes(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", envelope_hex("01", F.lower(F.hex("props"))).alias("envelope"))


@query(f"WITH h AS (SELECT {sql.blob_hash('text')} AS hash, strlen(text) AS n FROM documents), u AS (SELECT DISTINCT hash, n FROM h) SELECT (SELECT count(*) FROM h) AS n_rows, count(*) AS n_blobs, sum(n)::BIGINT AS blob_bytes, (SELECT sum(n)::BIGINT FROM h) AS all_bytes FROM u")
def dedup_blobs(spark, sf_dir):
    h = document_leaves(spark, sf_dir).groupBy("hash", "size").agg(F.count("*").alias("k"))
    return h.agg(F.sum("k").alias("n_rows"), F.count("*").alias("n_blobs"), F.sum("size").alias("blob_bytes"), F.sum(F.col("size") * F.col("k")).alias("all_bytes"))


@query(f"WITH h AS (SELECT doc_id, {sql.blob_hash('text')} AS hash FROM documents) SELECT a.doc_id FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.hash = a.hash AND b.doc_id % 2 = 0) AND a.doc_id % 2 = 1")
def idempotent_put(spark, sf_dir):
    """What a second batch (odd documents) adds to the objects of a first (even ones)."""
    h = table(spark, sf_dir, "documents").select("doc_id", blob_hash(F.col("text")).alias("hash"))
    return h.where("doc_id % 2 = 1").join(h.where("doc_id % 2 = 0").select("hash"), "hash", "left_anti").select("doc_id")


@query()
def blake3_hash(spark, sf_dir):
    return small_arrow_batches(table(spark, sf_dir, "documents")).select("doc_id", object_hash("01", F.hex("text"), "blake3-256").alias("hash"), blake3_hex(F.encode("text", "utf-8")).alias("bare"))


@query()
def stored_size(spark, sf_dir):
    d = small_arrow_batches(table(spark, sf_dir, "documents"))
    return d.select("doc_id", zstd_size(F.unhex(envelope_hex("01", F.hex("text")))).cast("int").alias("stored"))


@query("SELECT event_id, to_base64(encode(props)) AS token, from_base64(to_base64(encode(props)))::BLOB = encode(props) AS same FROM events")
def token_base64(spark, sf_dir):
    token = F.base64(F.encode("props", "utf-8"))
    return table(spark, sf_dir, "events").select("event_id", token.alias("token"), (F.unbase64(token) == F.encode("props", "utf-8")).alias("same"))


# trees


@query(f"WITH leaf AS (SELECT o_orderstatus AS coll, o_orderkey::VARCHAR AS name, {sql.blob_hash('o_custkey::VARCHAR')} AS hash FROM orders), p AS (SELECT coll, string_agg({sql.entry('01', 'hash', 'name')}, '' ORDER BY name) AS p, count(*) AS n FROM leaf GROUP BY coll) SELECT coll, n, {sql.tree_hash('p')} AS hash FROM p")
def collection_tree_hash(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderstatus").alias("coll"), F.col("o_orderkey").cast("string").alias("name"), F.lit("01").alias("kind"), blob_hash(F.col("o_custkey").cast("string")).alias("hash"))
    return long_directory_hashes(rows, ["coll"])


@query(f"WITH {sql.DOCUMENTS} SELECT '' AS path, hash FROM t0 UNION ALL SELECT source, hash FROM t1 UNION ALL SELECT source || '/' || lang, hash FROM t2")
def root_hash(spark, sf_dir):
    return build(document_leaves(spark, sf_dir).select("path", "hash")).select(shown(), "hash")


@query(f"WITH {sql.HISTORY}, {sql.DIRECTORIES} SELECT day AS seq, '' AS path, hash FROM t0 UNION ALL SELECT day, app, hash FROM t1 UNION ALL SELECT day, app || '/' || grp, hash FROM t2")
def directory_versions(spark, sf_dir):
    return day_trees(spark, sf_dir).select("seq", shown(), "hash")


_COMMIT = """'tree ' || root || chr(10) || CASE WHEN parent IS NULL THEN '' ELSE 'parent ' || parent || chr(10) END || 'author' || chr(9) || 'app' || chr(9) || 'app@example.org' || chr(9) || 'events' || chr(9) || nanos || chr(10)
        || 'committer' || chr(9) || 'app' || chr(9) || 'app@example.org' || chr(9) || 'events' || chr(9) || nanos || chr(10) || 'process' || chr(9) || 'daily' || chr(9) || '1' || chr(9) || '-' || chr(9) || '-' || chr(10) || chr(10) || 'day ' || seq"""


_CHAIN = f"""WITH RECURSIVE {sql.HISTORY}, {sql.DIRECTORIES}, roots AS (SELECT day AS seq, hash AS root, row_number() OVER (ORDER BY day) AS n FROM t0),
    step AS (SELECT n, seq, root, NULL::VARCHAR AS parent, (seq * 1000000000)::VARCHAR AS nanos FROM roots WHERE n = 1),
    chain AS (SELECT n, seq, root, parent, sha256(unhex('03' || {sql.leb('strlen(t)')} || {sql.text_hex('t')})) AS hash FROM (SELECT *, {_COMMIT} AS t FROM step)
        UNION ALL SELECT n, seq, root, parent, sha256(unhex('03' || {sql.leb('strlen(t)')} || {sql.text_hex('t')})) AS hash
        FROM (SELECT *, {_COMMIT} AS t FROM (SELECT r.n, r.seq, r.root, c.hash AS parent, (r.seq * 1000000000)::VARCHAR AS nanos FROM chain c JOIN roots r ON r.n = c.n + 1)))"""


@query(f"{_CHAIN} SELECT seq, root, parent, hash FROM chain")
def commit_chain(spark, sf_dir):
    """Roots of all commits in one plan; only the chain is sequential: one task that holds one hash."""
    who = {"name": "app", "email": "app@example.org", "source": "events"}
    process = {"name": "daily", "version": "1", "params": "-", "correlation_id": "-"}

    def chained(batches):
        last = None
        for batch in batches:
            rows = []
            for seq, root in zip(batch["seq"].tolist(), batch["root"]):
                payload = commit_payload(root, last, who, who, process, seq * 1_000_000_000, f"day {seq}".encode())
                own = digest(envelope(3, payload)).hex()
                rows.append((seq, root, last, own))
                last = own
            yield pd.DataFrame(rows, columns=["seq", "root", "parent", "hash"])

    roots = commit_roots(spark, sf_dir).coalesce(1).sortWithinPartitions("seq")
    return roots.mapInPandas(chained, "seq long, root string, parent string, hash string")


# states


@query("SELECT user_id, first(event_type ORDER BY event_id DESC) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def batch_last_write(spark, sf_dir):
    return history.last_write(table(spark, sf_dir, "events").withColumn("o", F.col("event_id")), ["user_id"], "o", ["event_type", "event_id"])


@query(f"WITH {sql.HISTORY} SELECT array_to_string(path, '/') AS path, hash FROM live WHERE valid_from <= 10 AND (valid_to IS NULL OR 10 < valid_to)")
def snapshot_asof_commit(spark, sf_dir):
    return history.as_of(daily(spark, sf_dir), 10).select(shown(), "hash")


@query(f"WITH {sql.HISTORY}, s AS (SELECT path, first(hash ORDER BY seq DESC) AS hash FROM hashed JOIN events ON event_id = seq WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY path) SELECT array_to_string(path, '/') AS path, hash FROM s WHERE hash IS NOT NULL")
def snapshot_asof_time(spark, sf_dir):
    when = table(spark, sf_dir, "events").where("ts <= timestamp_ntz'2024-01-15 12:00:00'").select(F.col("event_id").alias("seq"))
    told = raw_events(spark, sf_dir).join(when, "seq", "left_semi").select("path", "seq", blob_hash(F.col("payload")).alias("hash"))
    return history.last_write(told, ["path"], "seq", ["hash"]).where("hash is not null").select(shown(), "hash")


@query(f"WITH {sql.HISTORY} SELECT array_to_string(path, '/') AS path, hash, valid_from, valid_to FROM live")
def leaf_intervals(spark, sf_dir):
    return versions(spark, sf_dir).select(shown(), "hash", "valid_from", "valid_to")


# differences

_DIFF = "SELECT CASE WHEN a.hash IS NULL THEN 'A' WHEN b.hash IS NULL THEN 'D' ELSE 'M' END AS status, array_to_string(path, '/') AS path, a.hash AS old_hash, b.hash AS new_hash FROM {a} a FULL JOIN {b} b USING (path) WHERE a.hash IS DISTINCT FROM b.hash"
_STATE = "(SELECT path, hash FROM live WHERE valid_from <= {d} AND (valid_to IS NULL OR {d} < valid_to))"


def _shown_diff(rows):
    return rows.select("status", shown(), "old_hash", "new_hash")


@query(f"WITH {sql.HISTORY} {_DIFF.format(a=_STATE.format(d=10), b=_STATE.format(d=20))}")
def diff_commits(spark, sf_dir):
    return _shown_diff(history.differences_between(daily(spark, sf_dir), 10, 20))


@query(f"WITH {sql.HISTORY} {_DIFF.format(a=_STATE.format(d=20), b=_STATE.format(d=10))}")
def diff_reverse(spark, sf_dir):
    return _shown_diff(history.differences_between(daily(spark, sf_dir), 20, 10))


@query(f"WITH {sql.HISTORY} SELECT 'A' AS status, array_to_string(path, '/') AS path, NULL::VARCHAR AS old_hash, hash AS new_hash FROM {_STATE.format(d=1)}")
def diff_initial(spark, sf_dir):
    """All leaves of the first commit, as its log with paths has them."""
    first = history.changed_per_commit(daily(spark, sf_dir)).where("seq = 1")
    return _shown_diff(first)


@query(f"WITH {sql.HISTORY}, d AS ({_DIFF.format(a=_STATE.format(d=10), b=_STATE.format(d=20))}) SELECT status, count(*) AS n FROM d GROUP BY status")
def diff_counts(spark, sf_dir):
    return history.differences_between(daily(spark, sf_dir), 10, 20).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {sql.HISTORY}, d AS ({_DIFF.format(a=_STATE.format(d=10), b=_STATE.format(d=20))}) SELECT * FROM d WHERE path LIKE 'app/g3/%'")
def diff_prefix(spark, sf_dir):
    told = daily(spark, sf_dir).where((F.element_at("path", 1) == "app") & (F.element_at("path", 2) == "g3"))
    return _shown_diff(history.differences_between(told, 10, 20))


@query(f"WITH {sql.HISTORY}, d AS ({_DIFF.format(a=_STATE.format(d=10), b=_STATE.format(d=20))}) SELECT *, row_number() OVER (ORDER BY string_split(path, '/')) AS place FROM d")
def diff_order(spark, sf_dir):
    """A full outer join of two states, numbered in the order of path components."""
    told = daily(spark, sf_dir)
    rows = history.diff(history.as_of(told, 10), history.as_of(told, 20))
    return rows.select("status", shown(), "old_hash", "new_hash", F.row_number().over(Window.orderBy("path")).cast("long").alias("place"))


@query(f"""WITH {sql.HISTORY}, a AS (SELECT DISTINCT path[1:2] AS path, 'group' AS hash FROM {_STATE.format(d=10)} WHERE path[2] < 'g2' UNION ALL SELECT path, hash FROM {_STATE.format(d=10)} WHERE path[2] >= 'g2'), b AS {_STATE.format(d=20)}
    SELECT 'M' AS status, array_to_string(path, '/') AS path FROM a WHERE len(path) = 2
    UNION ALL SELECT status, path FROM ({_DIFF.format(a='(SELECT * FROM a WHERE len(path) = 3)', b="(SELECT * FROM b WHERE path[2] >= 'g2')")})""")
def diff_type_change(spark, sf_dir):
    """Two collections are single documents in the old state: each is one M, and its documents aren't told."""
    told = daily(spark, sf_dir)
    new, old = history.as_of(told, 20), history.as_of(told, 10)
    low = F.element_at("path", 2) < "g2"
    old = old.where(~low).unionByName(old.where(low).select(F.slice("path", 1, 2).alias("path"), F.lit("group").alias("hash")).distinct())
    up = lambda s: s.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda n: F.slice("path", 1, n))).alias("path")).distinct()
    return history.diff(old, new, up(old), up(new)).select("status", shown())


# logs

_PATH = ["app", "g1", "1"]


@query(f"WITH {sql.HISTORY}, s AS (SELECT day AS seq, hash, lag(hash) OVER (ORDER BY day) AS before FROM daily WHERE path = ['app', 'g1', '1']) SELECT seq, hash, CASE WHEN before IS NULL THEN 'added' WHEN hash IS NULL THEN 'deleted' ELSE '' END AS annotation FROM s WHERE hash IS DISTINCT FROM before")
def log_path_blob(spark, sf_dir):
    own = daily(spark, sf_dir).where(F.col("path") == F.array(*map(F.lit, _PATH)))
    return history.path_log(own.select("seq", "hash"))


@query(f"WITH {sql.HISTORY}, {sql.DIRECTORIES}, s AS (SELECT day AS seq, hash, lag(hash) OVER (ORDER BY day) AS before FROM t2 WHERE grp = 'g1') SELECT seq, hash, CASE WHEN before IS NULL THEN 'added' WHEN hash IS NULL THEN 'deleted' ELSE '' END AS annotation FROM s WHERE hash IS DISTINCT FROM before")
def log_path_tree(spark, sf_dir):
    own = directory_changes(spark, sf_dir, 2, ["app", "g1"])
    return history.path_log(own.select("seq", "hash"))


_CHANGED = f"WITH {sql.HISTORY}, c AS (SELECT day AS seq, path, hash, lag(hash) OVER (PARTITION BY path ORDER BY day) AS before FROM daily), d AS (SELECT seq, path, CASE WHEN before IS NULL THEN 'A' WHEN hash IS NULL THEN 'D' ELSE 'M' END AS status, before AS old_hash, hash AS new_hash FROM c WHERE hash IS DISTINCT FROM before)"


@query(f"{_CHANGED} SELECT seq, count(*) AS n FROM d GROUP BY seq")
def log_oneline_counts(spark, sf_dir):
    return history.changed_per_commit(daily(spark, sf_dir)).groupBy("seq").agg(F.count("*").alias("n"))


@query(f"{_CHANGED} SELECT seq, status, array_to_string(path, '/') AS path, old_hash, new_hash FROM d")
def log_paths(spark, sf_dir):
    return history.changed_per_commit(daily(spark, sf_dir)).select("seq", "status", shown(), "old_hash", "new_hash")


@query(f"{_CHANGED} SELECT seq, count(*) AS n FROM d GROUP BY seq ORDER BY seq DESC LIMIT 5")
def log_limit(spark, sf_dir):
    return log_oneline_counts(spark, sf_dir).orderBy(F.desc("seq")).limit(5)


@query(f"WITH {sql.HISTORY}, h AS (SELECT DISTINCT day FROM daily) SELECT day AS seq, (SELECT max(day) FROM h) - day AS back FROM h WHERE day = (SELECT max(day) FROM h) - 3")
def resolve_head_n(spark, sf_dir):
    days = daily(spark, sf_dir).select("seq").distinct()
    head = days.agg(F.max("seq").alias("head"))
    return days.join(F.broadcast(head), F.col("seq") == F.col("head") - 3).select("seq", (F.col("head") - F.col("seq")).alias("back"))


@query(f"WITH {sql.HISTORY} SELECT array_to_string(path, '/') AS path, hash, payload FROM live WHERE valid_from <= 12 AND (valid_to IS NULL OR 12 < valid_to) AND path = ['app', 'g2', '7']")
def show_path(spark, sf_dir):
    own = daily(spark, sf_dir).where(F.col("path") == F.array(F.lit("app"), F.lit("g2"), F.lit("7")))
    return history.as_of(own, 12, ("hash", "payload")).select(shown(), "hash", "payload")


@query(f"WITH {sql.HISTORY} SELECT path[3] AS path, hash FROM live WHERE valid_from <= 12 AND (valid_to IS NULL OR 12 < valid_to) AND path[1] = 'app' AND path[2] = 'g2'")
def show_tree(spark, sf_dir):
    own = daily(spark, sf_dir).where((F.element_at("path", 1) == "app") & (F.element_at("path", 2) == "g2"))
    return history.as_of(own, 12).select(F.array_join(F.slice("path", 3, F.size("path") - 2), "/").alias("path"), "hash")


@query(f"{_CHAIN}, d AS (SELECT day AS seq, path, hash, lag(hash) OVER (PARTITION BY path ORDER BY day) AS before FROM daily) SELECT c.seq, c.hash, c.root, c.parent, count(*) FILTER (WHERE d.hash IS DISTINCT FROM d.before) AS n_changed FROM chain c JOIN d USING (seq) WHERE c.seq = 15 GROUP BY ALL")
def show_commit(spark, sf_dir):
    chain = commit_chain(spark, sf_dir).where("seq = 15")
    n = log_oneline_counts(spark, sf_dir).where("seq = 15").select("seq", F.col("n").alias("n_changed"))
    return chain.join(n, "seq").select("seq", "hash", "root", "parent", "n_changed")


# objects


@query(f"WITH RECURSIVE {sql.DOCUMENTS}, w AS (SELECT type, child_hash AS hash, name AS path FROM entries JOIN t0 ON tree_hash = hash UNION ALL SELECT e.type, e.child_hash, w.path || '/' || e.name FROM w JOIN entries e ON e.tree_hash = w.hash) SELECT * FROM w")
def ls_tree(spark, sf_dir):
    _, entries, root = document_objects(spark, sf_dir)
    return walk(entries, root).select("type", "hash", shown())


@query(f"WITH {sql.DOCUMENTS} SELECT hash, type, size FROM objects WHERE type IN ('tree')")
def list_objects_types(spark, sf_dir):
    return document_objects(spark, sf_dir)[0].where(F.col("type").isin("tree"))


@query(f"WITH {sql.DOCUMENTS} SELECT type || ' ' || hash || ' 100% ' || size AS line FROM objects")
def list_objects_format(spark, sf_dir):
    line = history.formatted("%T %H 100%% %S", {"H": F.col("hash"), "T": F.col("type"), "S": F.col("size")})
    return document_objects(spark, sf_dir)[0].select(line.alias("line"))


@query(f"WITH RECURSIVE {sql.DOCUMENTS}, w AS (SELECT hash, 'tree' AS type FROM t0 UNION SELECT e.child_hash, e.type FROM w JOIN entries e ON e.tree_hash = w.hash) SELECT DISTINCT hash, type FROM w")
def reachable_set(spark, sf_dir):
    _, entries, root = document_objects(spark, sf_dir)
    return reachable(entries, root.select(F.lit("tip").alias("hash"), F.col("hash").alias("root"))).where("type != 'commit'")


def _damaged(spark, sf_dir):
    """Objects and references: from a snapshot that lacks two sources' trees, and without the blobs of one language."""
    objects, entries, root = document_objects(spark, sf_dir)
    part = root.join(entries, F.col("hash") == F.col("tree_hash")).where("name not in ('src1', 'src2')").select(F.lit("tip").alias("hash"), F.col("child_hash").alias("root"))
    refs = reachable(entries, part).where("type != 'commit'")
    return objects, entries, refs


_REFS = f"WITH RECURSIVE {sql.DOCUMENTS}, w AS (SELECT hash, 'tree' AS type FROM t1 WHERE source NOT IN ('src1', 'src2') UNION SELECT e.child_hash, e.type FROM w JOIN entries e ON e.tree_hash = w.hash), refs AS (SELECT DISTINCT hash, type FROM w)"


@query(f"{_REFS} SELECT hash, type FROM objects WHERE hash NOT IN (SELECT hash FROM refs)")
def dangling_objects(spark, sf_dir):
    objects, _, refs = _damaged(spark, sf_dir)
    return objects.join(refs, "hash", "left_anti").select("hash", "type")


@query(f"{_REFS} SELECT hash, type FROM refs WHERE hash NOT IN (SELECT hash FROM objects WHERE size % 7 > 0)")
def missing_objects(spark, sf_dir):
    objects, _, refs = _damaged(spark, sf_dir)
    return refs.join(objects.where("size % 7 > 0"), "hash", "left_anti").select("hash", "type")


@query(f"{_REFS} SELECT r.hash, r.type AS expected, CASE WHEN o.size % 5 = 0 THEN 'commit' ELSE o.type END AS stored FROM refs r JOIN objects o USING (hash) WHERE o.size % 5 = 0")
def wrong_type_refs(spark, sf_dir):
    objects, _, refs = _damaged(spark, sf_dir)
    stored = objects.select("hash", F.when(F.col("size") % 5 == 0, "commit").otherwise(F.col("type")).alias("stored"))
    return refs.select("hash", F.col("type").alias("expected")).join(stored, "hash").where("stored != expected")


@query(f"{_REFS} SELECT (SELECT count(*) FROM refs) AS n_reachable, (SELECT count(*) FROM objects WHERE hash NOT IN (SELECT hash FROM refs)) AS n_dangling")
def fsck_summary(spark, sf_dir):
    objects, _, refs = _damaged(spark, sf_dir)
    both = objects.select("hash").join(refs.select("hash", F.lit(1).alias("ref")), "hash", "left")
    return both.agg(F.coalesce(F.sum("ref"), F.lit(0)).alias("n_reachable"), F.count_if(F.col("ref").isNull()).alias("n_dangling"))


@query(f"SELECT DISTINCT 'bad hash' AS problem, {sql.blob_hash('text')} AS hash FROM documents WHERE doc_id % 10 = 3")
def fsck_hash_verify(spark, sf_dir):
    """Every tenth document's bytes were changed after its hash was taken."""
    d = table(spark, sf_dir, "documents").select(blob_hash(F.col("text")).alias("hash"), F.lit("blob").alias("type"), F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary").alias("payload"))
    return fsck(d, d.select("hash", "type").distinct()).where("problem = 'bad hash'").distinct()


# change events


@query("SELECT event_type, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' WHEN 'click' THEN 'update' WHEN 'view' THEN 'drop' ELSE 'createIndexes' END AS op, CASE event_type WHEN 'view' THEN 'rebuild' WHEN 'purchase' THEN 'ignored' ELSE 'data' END AS class, count(*) AS n FROM events GROUP BY ALL")
def event_classify(spark, sf_dir):
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "click", "update").when(F.col("event_type") == "view", "drop").otherwise("createIndexes")
    return table(spark, sf_dir, "events").select("event_type", op.alias("op")).withColumn("class", history.event_class(F.col("op"))).groupBy("event_type", "op", "class").agg(F.count("*").alias("n"))


_RUNS = "WITH k AS (SELECT event_id, user_id % 4 AS shard, ts, CASE WHEN event_type <> 'view' THEN event_type END AS key FROM events), s AS (SELECT *, CASE WHEN key = lag(key) OVER (PARTITION BY shard ORDER BY event_id) THEN 0 ELSE 1 END AS first FROM k), r AS (SELECT *, sum(first) OVER (PARTITION BY shard ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run_id FROM s)"


def _keyed(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).alias("shard"), "ts", F.when(F.col("event_type") != "view", F.col("event_type")).alias("key"))
    return history.runs(e, "key", "event_id", ["shard"])


@query(f"{_RUNS} SELECT event_id, shard, run_id FROM r")
def txn_runs(spark, sf_dir):
    return _keyed(spark, sf_dir).select("event_id", "shard", "run_id")


@query(f"{_RUNS} SELECT shard, run_id, count(*) AS n, min(event_id) AS first_event, max(event_id) AS token, epoch_us(first(ts ORDER BY event_id)) * 1000 AS nanos FROM r GROUP BY shard, run_id")
def txn_batches(spark, sf_dir):
    r = _keyed(spark, sf_dir).groupBy("shard", "run_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("token"), F.min_by("ts", "event_id").alias("ts"))
    return r.select("shard", "run_id", "n", "first_event", "token", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("nanos"))


@query("SELECT event_id, (epoch_us(ts) // 1000000) * 1000000000 + event_id % 1000 AS nanos FROM events")
def cluster_time_nanos(spark, sf_dir):
    t = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", history.cluster_nanos(t, F.col("event_id") % 1000).alias("nanos"))


@query("SELECT db, coll, count(*) AS n FROM (SELECT 'geo' AS db, 'nation' AS coll FROM nation UNION ALL SELECT 'geo', 'region' FROM region UNION ALL SELECT 'sales', 'orders' FROM orders) WHERE db NOT IN ('admin', 'local', 'config') GROUP BY ALL")
def exclude_databases(spark, sf_dir):
    cluster = {"geo": {"nation": ("n_nationkey", table(spark, sf_dir, "nation")), "region": ("r_regionkey", table(spark, sf_dir, "region"))}, "sales": {"orders": ("o_orderkey", table(spark, sf_dir, "orders"))}, "admin": {"customer": ("c_custkey", table(spark, sf_dir, "customer"))}}
    return cluster_scan(cluster, ["admin", "local", "config"]).groupBy(F.element_at("path", 1).alias("db"), F.element_at("path", 2).alias("coll")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, '{\"$numberLong\":\"' || c_custkey || '\"}' AS long_id, '\"' || c_name || '\"' AS string_id, '{\"$numberInt\":\"' || c_nationkey || '\"}' AS int_id FROM customer")
def doc_id_canonical(spark, sf_dir):
    from ..functions.canonical import int_id, string_id

    return table(spark, sf_dir, "customer").select("c_custkey", long_id(F.col("c_custkey")).alias("long_id"), string_id(F.col("c_name")).alias("string_id"), int_id(F.col("c_nationkey")).alias("int_id"))


@query("SELECT n_nationkey, '{\"_id\":{\"$numberInt\":\"' || n_nationkey || '\"},\"n_name\":\"' || n_name || '\",\"n_regionkey\":{\"$numberInt\":\"' || n_regionkey || '\"}}' AS payload FROM nation")
def row_documents(spark, sf_dir):
    return collection(table(spark, sf_dir, "nation"), "geo", "nation", "n_nationkey").select(F.get_json_object("payload", "$._id.$numberInt").cast("int").alias("n_nationkey"), "payload")


@query("SELECT event_id, CASE WHEN contains(c, chr(9)) OR contains(c, chr(10)) OR c = '' THEN 'EMALFORMED: bad path component' END AS why FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'a' || chr(9) || 'b' WHEN 1 THEN '' WHEN 2 THEN 'x' || chr(10) ELSE event_type END AS c FROM events)")
def validate_events(spark, sf_dir):
    c = F.when(F.col("event_id") % 5 == 0, "a\tb").when(F.col("event_id") % 5 == 1, "").when(F.col("event_id") % 5 == 2, "x\n").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", history.invalid_event(F.array(F.lit("app"), c)).alias("why"))


@query("SELECT event_id, replace(props, ' ', '') AS props FROM events")
def canonical_json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", canonical(F.col("props")).alias("props"))


@query(f"WITH {sql.HISTORY} SELECT seq, array_to_string(path, '/') AS path, CASE WHEN NOT dead THEN payload END AS payload FROM ev")
def pipe_frames(spark, sf_dir):
    """All events written as frames, each day's in files of bounded length, and read back."""
    e = raw_events(spark, sf_dir).withColumnRenamed("seq", "ord")
    rows = read_frames(encode_frames(e, "day")).where("status = 'OK'")
    # an event meets its seq in one aggregation: with a join the frames would be made twice
    named = F.transform(F.split(F.get_json_object(F.decode("message", "utf-8"), "$.seqs"), ","), lambda seq, k: F.struct(k.cast("long").alias("ord"), F.lit(None).cast("array<string>").alias("path"), F.lit(None).cast("binary").alias("payload"), seq.cast("long").alias("seq")))
    own = F.array(F.struct("ord", "path", "payload", F.lit(None).cast("long").alias("seq")))
    both = rows.select("file", F.inline(F.when(F.col("message").isNull(), own).otherwise(F.concat(own, named))))
    return both.groupBy("file", "ord").agg(F.max("seq").alias("seq"), F.max("path").alias("path"), F.max("payload").alias("payload")).select("seq", shown(), F.decode("payload", "utf-8").alias("payload"))


@query(f"WITH {sql.HISTORY} SELECT path[2] AS coll, valid_from, count(*) AS n_versions, count(DISTINCT hash) AS n_blobs FROM live GROUP BY ROLLUP (path[2], valid_from)")
def object_statistics(spark, sf_dir):
    """Versions and distinct blobs of the history, by collection and commit, by collection, and of all."""
    v = versions(spark, sf_dir)
    return v.rollup(F.element_at("path", 2).alias("coll"), "valid_from").agg(F.count("*").alias("n_versions"), F.count_distinct("hash").alias("n_blobs"))


@query(f"{_CHAIN}, c AS (SELECT day AS seq, path, hash, lag(hash) OVER (PARTITION BY path ORDER BY day) AS before FROM daily), d AS (SELECT seq, CASE WHEN before IS NULL THEN 'A' WHEN hash IS NULL THEN 'D' ELSE 'M' END || ' ' || array_to_string(path, '/') AS line FROM c WHERE hash IS DISTINCT FROM before), m AS (SELECT seq, count(*) AS k FROM d GROUP BY seq) SELECT seq, CASE WHEN k = 1 THEN 'commit ' || hash[1:7] || '  ' || line ELSE '  ' || line END AS line FROM d JOIN m USING (seq) JOIN chain USING (seq) UNION ALL SELECT seq, 'commit ' || hash[1:7] || '  ' || k || ' events' FROM m JOIN chain USING (seq) WHERE k > 1")
def commit_summary(spark, sf_dir):
    """A line for a commit of one change; for others a heading and a line for each change."""
    d = history.changed_per_commit(daily(spark, sf_dir)).select("seq", F.concat_ws(" ", "status", F.array_join("path", "/")).alias("text"))
    n = d.groupBy("seq").agg(F.count("*").alias("n"))
    head = n.join(commit_chain(spark, sf_dir).select("seq", F.substring("hash", 1, 7).alias("abbr")), "seq")
    one = F.concat(F.lit("commit "), "abbr", F.lit("  "))
    lines = d.join(head, "seq").select("seq", F.when(F.col("n") == 1, F.concat(one, "text")).otherwise(F.concat(F.lit("  "), "text")).alias("line"))
    return lines.unionByName(head.where("n > 1").select("seq", F.concat(one, F.col("n").cast("string"), F.lit(" events")).alias("line")))


@query(f"SELECT doc_id, {sql.blob_hash('text')} IN (SELECT {sql.blob_hash('text')} FROM documents WHERE lang = 'en') AS there FROM documents")
def object_exists(spark, sf_dir):
    """Which documents' objects a store of the English ones already has."""
    h = document_leaves(spark, sf_dir)
    have = h.where(F.element_at("path", 2) == "en").select("hash").distinct().withColumn("there", F.lit(True))
    mine = h.select(F.substring(F.element_at("path", 3), 4, 20).cast("long").alias("doc_id"), "hash")
    return mine.join(have, "hash", "left").select("doc_id", F.coalesce("there", F.lit(False)).alias("there"))


@query("SELECT event_id, regexp_full_match(name, '[0-9a-f]{64}') AS valid FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN sha256(props) WHEN 1 THEN upper(sha256(props)) WHEN 2 THEN sha256(props)[1:63] ELSE sha256(props) || '0' END AS name FROM events)")
def valid_object_names(spark, sf_dir):
    h = F.sha2("props", 256)
    name = F.when(F.col("event_id") % 4 == 0, h).when(F.col("event_id") % 4 == 1, F.upper(h)).when(F.col("event_id") % 4 == 2, F.substring(h, 1, 63)).otherwise(F.concat(h, F.lit("0")))
    return table(spark, sf_dir, "events").select("event_id", name.rlike("^[0-9a-f]{64}$").alias("valid"))


# streams


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'rebuild' WHEN 'purchase' THEN 'ignored' ELSE 'data' END AS class, 'app/g' || (user_id % 5) || '/{\"$numberLong\":\"' || user_id || '\"}' AS path, CASE WHEN event_type <> 'error' THEN '{\"_id\":' || user_id || ',\"p\":' || replace(props, ' ', '') || '}' END AS payload, CASE WHEN event_id % 3 > 0 THEN '{\"id\":' || (event_id % 7) || '}/' || (event_id // 10) END AS key, epoch_us(ts) // 1000000 * 1000000000 + event_id % 10 AS nanos FROM events")
def event_changes(spark, sf_dir):
    """Change events, made of the events table, as changes: path, canonical document, transaction key, time."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "click", "update").when(F.col("event_type") == "view", "drop").otherwise("createIndexes")
    ident = F.concat(F.lit('{"_id": {"$numberLong": "'), F.col("user_id").cast("string"), F.lit('"}}'))
    document = F.concat(F.lit('{"p": '), "props", F.lit(', "_id": '), F.col("user_id").cast("string"), F.lit("}"))
    stream = e.select(
        F.col("event_id").alias("seq"), F.struct(F.base64(F.encode("props", "utf-8")).alias("_data")).alias("_id"), op.alias("operationType"), F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), (F.col("event_id") % 10).alias("i")).alias("clusterTime"),
        F.struct(F.lit("app").alias("db"), F.concat(F.lit("g"), F.col("user_id") % 5).alias("coll")).alias("ns"), ident.alias("documentKey"), document.alias("fullDocument"),
        F.when(F.col("event_id") % 3 > 0, F.concat(F.lit('{"id":'), F.col("event_id") % 7, F.lit("}"))).alias("lsid"), F.floor(F.col("event_id") / 10).alias("txnNumber"),
    )
    return changes(stream).select(F.col("seq").alias("event_id"), "class", shown(), "payload", "key", "nanos")


def _streamed(spark, sf_dir):
    """The events table as a stream: one file, so one micro-batch; the operators don't rely on that."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)


@query(f"{_RUNS} SELECT event_id, shard, run_id FROM r")
def stateful_runs(spark, sf_dir):
    """Runs over a stream, with the open run of each shard as state."""
    name = f"runs_{uuid.uuid4().hex}"
    keyed = _streamed(spark, sf_dir).select("event_id", (F.col("user_id") % 4).alias("shard"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("key"))
    out = f"{shared_dir(spark)}/{name}"
    q = carried_runs(keyed).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query(f"WITH {sql.HISTORY}, t AS (SELECT path, (day - 1) // 10 AS seq, first(hash ORDER BY ev.seq DESC) AS hash FROM hashed ev GROUP BY path, (day - 1) // 10), c AS (SELECT *, lag(hash) OVER (PARTITION BY path ORDER BY seq) AS before FROM t) SELECT seq, count(*) AS n FROM c WHERE hash IS DISTINCT FROM before GROUP BY seq")
def stream_commit(spark, sf_dir):
    """The stream of events committed to a new repository; ten days are one transaction. Returns the changes of each commit."""
    at = scratch_path(spark, "repository")
    Repo.init(spark, at)
    e = _streamed(spark, sf_dir)
    payload = row_document({"_id": long_id(F.col("user_id")), "props": F.replace(F.col("props"), F.lit(" "), F.lit("")), "type": F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))})
    path = F.array(F.lit("app"), F.concat(F.lit("g"), F.col("user_id") % 5), F.col("user_id").cast("string"))
    rows = e.select(
        F.col("event_id").alias("seq"), F.lit("data").alias("class"), path.alias("path"), F.when(F.col("event_type") != "error", payload).alias("payload"),
        F.floor((day_number(F.col("ts")) - 1) / 10).cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("nanos"), F.col("event_id").cast("string").alias("token"),
    )
    with Repo(spark, at, writable=True) as repo:
        watch(repo, rows, f"{at}/stream").awaitTermination()
        drain(repo)
    return history.changed_per_commit(Repo(spark, at).table("leaf_changes")).groupBy("seq").agg(F.count("*").alias("n"))
