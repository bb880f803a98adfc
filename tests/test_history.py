import random

import pytest

from lamina.errors import HistoryError
from lamina.operators import history
from lamina.operators.apply import applied, check
from lamina.operators.trees import build, versions_above
from lamina.functions.codec import digest, envelope, tree_payload

PATH = "path array<string>"


class Model:
    """The semantics of a batch as nested dictionaries."""

    def __init__(self):
        self.root = {}

    def apply(self, path, payload):
        at = self.root
        for name in path[:-1]:
            at = at.setdefault(name, {})
            if not isinstance(at, dict):
                raise HistoryError("ECORRUPT", "blob on the way")
        if payload is None:
            at.pop(path[-1], None)
        else:
            at[path[-1]] = payload

    def walk(self, at=None, path=()):
        for name, child in (self.root if at is None else at).items():
            yield (*path, name), child
            if isinstance(child, dict):
                yield from self.walk(child, (*path, name))

    def leaves(self):
        return {p: c for p, c in self.walk() if not isinstance(c, dict)}

    def directories(self):
        return {p for p, c in self.walk() if isinstance(c, dict)}

    def hash(self, at=None, hashes=None, path=()):
        at = self.root if at is None else at
        entries = []
        for name, child in at.items():
            if isinstance(child, dict):
                entries.append((2, self.hash(child, hashes, (*path, name)), name))
            else:
                entries.append((1, digest(envelope(1, child)), name))
        own = digest(envelope(2, tree_payload(entries)))
        hashes[path] = own.hex()
        return own


def frames(spark, model):
    leaves = spark.createDataFrame([(list(p), digest(envelope(1, c)).hex()) for p, c in model.leaves().items()], f"{PATH}, hash string")
    return leaves, spark.createDataFrame([(list(p),) for p in model.directories()], PATH)


def test_batches_against_a_model(spark):
    r = random.Random(1)
    model = Model()
    corrupt = 0
    for _ in range(7):
        batch = []
        for _ in range(r.randint(1, 8)):
            batch.append(([r.choice("abA") for _ in range(r.randint(1, 3))], None if r.random() < 0.35 else str(r.randint(0, 3)).encode()))
        leaves, dirs = frames(spark, model)
        events = spark.createDataFrame([(k, p, b, b and digest(envelope(1, b)).hex()) for k, (p, b) in enumerate(batch)], f"ord long, {PATH}, payload binary, hash string")
        before = Model()
        for p in model.directories():
            before.apply([*p, "x"], None)
        old_leaves, old_dirs = model.leaves(), model.directories()
        try:
            trial = Model()
            import copy

            trial.root = copy.deepcopy(model.root)
            for p, b in batch:
                trial.apply(p, b)
        except HistoryError:
            corrupt += 1
            with pytest.raises(HistoryError, match="ECORRUPT"):
                check(events, leaves)
            continue
        check(events, leaves)
        changed, turned = applied(events, leaves, dirs)
        got, moved = dict(old_leaves), set(old_dirs)
        for x in changed.collect():
            got.pop(tuple(x.path), None)
            if x.hash is not None:
                got[tuple(x.path)] = bytes(x.payload)
        for x in turned.collect():
            (moved.add if x.made else moved.discard)(tuple(x.path))
        assert got == trial.leaves() and moved == trial.directories(), batch
        model = trial
    leaves, dirs = frames(spark, model)
    want = {}
    model.hash(hashes=want)
    assert {tuple(x.path): x.hash for x in build(leaves, dirs).collect()} == want
    assert corrupt < 7


def test_type_change_in_one_batch(spark):
    leaves = spark.createDataFrame([(["a"], "h")], f"{PATH}, hash string")
    bad = spark.createDataFrame([(0, ["a", "b"], b"x")], f"ord long, {PATH}, payload binary")
    with pytest.raises(HistoryError, match="a is a blob"):
        check(bad, leaves)
    check(spark.createDataFrame([(0, ["a"], None), (1, ["a", "b"], b"x")], f"ord long, {PATH}, payload binary"), leaves)


def state(spark, leaves):
    return spark.createDataFrame([(k.split("/"), v) for k, v in leaves.items()], f"{PATH}, hash string")


def dirs(spark, *paths):
    return spark.createDataFrame([(p.split("/"),) for p in paths], PATH)


def told(rows):
    return [(x.status, "/".join(x.path)) for x in rows.orderBy("path").collect()]


def test_diff_laws(spark):
    a, b = {"x/1": "p", "x/2": "q", "y.b": "r"}, {"x/1": "p", "x/2": "s", "y/x": "t"}
    one, two = state(spark, a), state(spark, b)
    assert told(history.diff(one, one)) == []
    assert told(history.diff(one, two)) == [("M", "x/2"), ("A", "y/x"), ("D", "y.b")]  # components, not joined text, are ordered
    swapped = {"A": "D", "D": "A", "M": "M"}
    assert told(history.diff(two, one)) == [(swapped[s], p) for s, p in told(history.diff(one, two))]


def test_diff_type_changes(spark):
    old, new = state(spark, {"a/b": "1", "a/c": "2", "d": "3"}), state(spark, {"a": "4", "d/e": "5"})
    assert told(history.diff(old, new, dirs(spark, "a"), dirs(spark, "d"))) == [("M", "a"), ("M", "d")]
    assert told(history.diff(state(spark, {"a": "1"}), state(spark, {}), dirs(spark), dirs(spark, "a"))) == [("M", "a")]


def test_runs(spark):
    keys = [None, "a", "a", "b", None, None, "b", "b"]
    rows = history.runs(spark.createDataFrame([*enumerate(keys)], "seq long, key string"), "key", "seq")
    assert [x.run_id for x in rows.orderBy("seq").collect()] == [1, 2, 2, 3, 4, 5, 6, 6]


def test_runs_are_counted_in_slices_of_a_shard(spark, monkeypatch):
    monkeypatch.setattr(history, "SLICE_ROWS", 7)
    rnd = random.Random(3)
    rows = [(2 * k, rnd.choice([None, 1, 2]), None if k < 150 and rnd.random() < 0.3 else "ab"[k >= 150 or rnd.random() < 0.2]) for k in range(300)]
    rnd.shuffle(rows)
    events = spark.createDataFrame(rows, "seq long, shard long, key string")
    for shard in ([], ["shard"]):
        want, last = {}, {}
        for seq, own, key in sorted(rows):
            before, n = last.get(own if shard else 0, (None, 0))
            n += key is None or key != before
            last[own if shard else 0] = key, n
            want[seq] = n
        assert {x.seq: x.run_id for x in history.runs(events, "key", "seq", shard).collect()} == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = history.runs(events, "key", "seq").groupBy(history.F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 1  # not all in one


def test_format_template(spark):
    f = spark.range(1).select(history.formatted("%H-%%%T", {"H": history.F.lit("h"), "T": history.F.lit("t")}).alias("x"))
    assert f.first().x == "h-%t"
    for bad in ("%X", "%"):
        with pytest.raises(HistoryError, match="EINVAL"):
            history.formatted(bad, {"H": history.F.lit("h")})


def test_versions_above_against_every_commit(spark):
    """The directories at the commits that touch them are those of the whole state there."""
    r = random.Random(5)
    rows, state, want = [], {}, {}
    for seq in range(20):
        for name in r.sample("abc", 1):
            path = (r.choice("xy"), name)
            dead = r.random() < 0.6
            rows = [c for c in rows if c[:2] != (list(path), seq)] + [(list(path), seq, None if dead else f"{r.getrandbits(256):064x}")]
            state[path] = rows[-1][2]
        for d in {c[0][0] for c in rows if c[1] == seq}:
            live = [(1, bytes.fromhex(h), p[1]) for p, h in state.items() if p[0] == d and h]
            want[d, seq] = digest(envelope(2, tree_payload(live)), "sha2-256").hex() if live else None
    got = versions_above(spark.createDataFrame(rows, "path array<string>, seq long, hash string"))
    assert {(x.path[0], x.seq): x.hash for x in got.collect()} == want and None in want.values()


def test_long_directories_are_hashed_in_rounds(spark, monkeypatch):
    from lamina.operators import trees

    monkeypatch.setattr(trees, "PIECE_BYTES", 100)
    monkeypatch.setattr(trees, "ROUND_BYTES", 1000)
    rows = [(d, f"é{k * 7919 % 1000}", digest(str(k).encode()).hex()) for d, n in (("a", 100), (None, 9), ("b", 1)) for k in range(n)]
    entries = spark.createDataFrame(rows, "coll string, name string, hash string").withColumn("kind", trees.F.lit("01"))
    got = {r.coll: (r.n, r.hash) for r in trees.long_directory_hashes(entries, ["coll"]).collect()}
    for d, n in (("a", 100), (None, 9), ("b", 1)):
        payload = tree_payload([(1, bytes.fromhex(h), name) for own, name, h in rows if own == d])
        assert got.pop(d) == (n, digest(envelope(2, payload)).hex())
    assert not got
