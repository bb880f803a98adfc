"""Pieces of DuckDB SQL that say what the column functions compute."""

from __future__ import annotations


def leb(n: str) -> str:
    byte = lambda v: f"printf('%02x', ({v})::INT)"
    low = lambda k: byte(f"(({n}) >> {7 * k} & 127) | 128")
    top = lambda k: byte(f"({n}) >> {7 * k}")
    cases = " ".join(f"WHEN ({n}) < {1 << 7 * (k + 1)} THEN {' || '.join([*(low(j) for j in range(k)), top(k)])}" for k in range(4))
    return f"CASE {cases} ELSE {' || '.join([*(low(j) for j in range(4)), top(4)])} END"


def text_hex(text: str) -> str:
    return f"lower(hex(encode({text})))"


def blob_hash(text: str) -> str:
    return f"sha256(unhex('01' || {leb(f'strlen({text})')} || {text_hex(text)}))"


def tree_hash(payload_hex: str) -> str:
    return f"sha256(unhex('02' || {leb(f'strlen({payload_hex}) // 2')} || {payload_hex}))"


def entry(kind: str, child: str, name: str) -> str:
    return f"'{kind}' || {child} || {leb(f'strlen({name})')} || {text_hex(name)}"


#: events as changes: a document per user, five collections, a commit a day; an error deletes
HISTORY = f"""
    ev AS (SELECT event_id AS seq, date_diff('day', DATE '2023-12-31', ts::DATE) AS day, ['app', 'g' || (user_id % 5), user_id::VARCHAR] AS path, event_type = 'error' AS dead,
        '{{"_id":{{"$numberLong":"' || user_id || '"}},"props":' || replace(props, ' ', '') || ',"type":"' || event_type || '"}}' AS payload FROM events),
    hashed AS (SELECT *, CASE WHEN NOT dead THEN {blob_hash('payload')} END AS hash FROM ev),
    daily AS (SELECT path, day, first(hash ORDER BY seq DESC) AS hash, first(CASE WHEN NOT dead THEN payload END ORDER BY seq DESC) AS payload FROM hashed GROUP BY path, day),
    versions AS (SELECT path, hash, payload, day AS valid_from, lead(day) OVER (PARTITION BY path ORDER BY day) AS valid_to FROM daily),
    live AS (SELECT * FROM versions WHERE hash IS NOT NULL)"""

#: the directories of every day, built from HISTORY
DIRECTORIES = f"""
    days AS (SELECT DISTINCT day FROM daily),
    d2 AS (SELECT day, path[1] AS app, path[2] AS grp, string_agg({entry('01', 'hash', 'path[3]')}, '' ORDER BY path[3]) AS p
        FROM days JOIN live ON valid_from <= day AND (valid_to IS NULL OR day < valid_to) GROUP BY ALL),
    t2 AS (SELECT *, {tree_hash('p')} AS hash FROM d2),
    d1 AS (SELECT day, app, string_agg({entry('02', 'hash', 'grp')}, '' ORDER BY grp) AS p FROM t2 GROUP BY ALL),
    t1 AS (SELECT *, {tree_hash('p')} AS hash FROM d1),
    d0 AS (SELECT day, string_agg({entry('02', 'hash', 'app')}, '' ORDER BY app) AS p FROM t1 GROUP BY ALL),
    t0 AS (SELECT *, {tree_hash('p')} AS hash FROM d0)"""

#: documents as one snapshot of three levels
DOCUMENTS = f"""
    leaf AS (SELECT source, lang, 'doc' || doc_id AS name, {blob_hash('text')} AS hash, strlen(text) AS size FROM documents),
    p2 AS (SELECT source, lang, string_agg({entry('01', 'hash', 'name')}, '' ORDER BY name) AS p FROM leaf GROUP BY ALL),
    t2 AS (SELECT *, {tree_hash('p')} AS hash FROM p2),
    p1 AS (SELECT source, string_agg({entry('02', 'hash', 'lang')}, '' ORDER BY lang) AS p FROM t2 GROUP BY ALL),
    t1 AS (SELECT *, {tree_hash('p')} AS hash FROM p1),
    p0 AS (SELECT string_agg({entry('02', 'hash', 'source')}, '' ORDER BY source) AS p FROM t1),
    t0 AS (SELECT p, {tree_hash('p')} AS hash FROM p0),
    entries AS (SELECT t2.hash AS tree_hash, name, 'blob' AS type, leaf.hash AS child_hash FROM leaf JOIN t2 USING (source, lang)
        UNION SELECT t1.hash, lang, 'tree', t2.hash FROM t2 JOIN t1 USING (source)
        UNION SELECT t0.hash, source, 'tree', t1.hash FROM t1, t0),
    objects AS (SELECT DISTINCT hash, 'blob' AS type, size FROM leaf UNION SELECT hash, 'tree', strlen(p) // 2 FROM t2
        UNION SELECT hash, 'tree', strlen(p) // 2 FROM t1 UNION SELECT hash, 'tree', strlen(p) // 2 FROM t0)"""
