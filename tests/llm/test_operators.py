"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import html
import itertools
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lamina.llm import decontaminate, exact_dedup, html_extract, kneser_ney, packing, quality, secret_scan, simhash, toxicity, url_rules
from lamina.llm.common import fitted, hashed_tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
#: Names that the operators use themselves.
CLASH = "content string, gone_id long, score double, root long, hi long, k long, n long, n_tokens string, TEXT_ string, `count` int"
SYLLABLES = "ba be bi bo bu da de di do du ka ke ki ko ku la le li lo lu ma me mi mo mu na ne ni no nu".split()


def word(r):
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))


def prose(r, n):
    return " ".join(word(r) for _ in range(n))


def frame(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"])[i % len(sources or ["s"])], None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, wordless and very long texts, repeated rows, ties, and clashing columns."""
    r = random.Random(4)
    long = prose(r, 30_000)
    rows = [(1, "one two three", "en", "a", 3), (1, "one two three", "en", "a", 3), (2, "one  two\nthree ", "en", "a", 3), (3, None, "en", "a", None), (4, None, None, None, None), (None, "one two three", "en", "a", 3), (None, None, None, None, None), (5, "", "en", "a", 0), (6, "", "en", None, 0), (7, long, "en", "http://h/p/q", 9), (8, long, None, "h/p", 9), (9, "!!! ???", "en", "a", 7), (10, "!!! ???", "en", "a", 7), (11, "é" * 5000 + " \U0001f600", "fr", "", 1)]
    names = CLASH.split(", ")
    return spark.createDataFrame([(*x, *[None] * len(names)) for x in rows], f"{DOCS}, {CLASH}")


def empty(spark):
    return spark.createDataFrame([], f"{DOCS}, {CLASH}")


# 1


def test_exact_dedup_against_brute_force(spark):
    r = random.Random(1)
    base = [prose(r, r.randint(1, 60)) for _ in range(60)]
    texts = [r.choice(base).replace(" ", r.choice([" ", "  ", "\n"]), 2) for _ in range(400)]
    docs = frame(spark, texts)
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[" ".join(t.split())].append(i)
    assert {r.doc_id for r in exact_dedup.dedup(docs).collect()} == {min(g) for g in groups.values()}
    assert {(r.doc_id, r.n_copies) for r in exact_dedup.copies(docs).collect()} == {(min(g), len(g)) for g in groups.values()}


def test_exact_dedup_odd(spark, odd):
    out = exact_dedup.dedup(odd)
    assert out.columns == odd.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter([1, 3, 4, None, 5, 7, 9, 11])
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_copies) for r in exact_dedup.copies(odd).collect()) == [(-1, 1), (1, 4), (3, 1), (4, 1), (5, 2), (7, 2), (9, 2), (11, 1)]
    assert exact_dedup.dedup(empty(spark)).count() == 0 and exact_dedup.copies(empty(spark)).count() == 0


def test_combined_copies_keep_small_batches():
    """What a task combines is sent on in batches as small as they came, and isn't held while it is."""
    r = random.Random(15)
    texts = [None if k % 50 == 7 else f"text {r.randrange(3000)} " * 40 for k in range(8000)]
    ids = [None if k % 60 == 3 else r.randrange(5000) for k in range(8000)]
    sent = ([pa.record_batch([pa.array(texts[k : k + 500], pa.string()), pa.array(ids[k : k + 500], pa.int64())], ["content", "id"])] for k in range(0, 8000, 500))
    parts = exact_dedup.in_parts(b for some in sent for b in some)
    table = next(parts)
    rows, n = exact_dedup.least_copies(table, 0, 1)
    assert max(b.num_rows for b in rows.append_column("n", pa.array(n)).to_batches()) <= 500
    groups = defaultdict(list)
    for k, (t, i) in enumerate(zip(texts, ids)):
        groups[(t, k if t is None else 0)].append((i is None, i or 0))
    want = Counter((t, None if min(g)[0] else min(g)[1], len(g)) for (t, _), g in groups.items())
    assert Counter((x["content"], x["id"], k) for x, k in zip(rows.to_pylist(), n.tolist())) == want
    held = pa.total_allocated_bytes()
    del table
    assert pa.total_allocated_bytes() < held - 2_000_000
    assert list(parts) == []


def test_splitters_divide_evenly():
    r = random.Random(2)
    keys = ["license " * 30 + prose(r, 5) for _ in range(2000)]
    cuts = exact_dedup.splitters([(k, 1) for k in keys], 8)
    assert cuts == sorted(cuts, key=str.encode) and len(cuts) == 7
    sizes = Counter(sum(c.encode() <= k.encode() for c in cuts) for k in keys)
    assert max(sizes.values()) < 2 * 2000 / 8
    heavy = exact_dedup.splitters([(k, 1 + 1000 * (k < sorted(keys)[100])) for k in keys], 8)
    assert sum(k < heavy[-1] for k in keys) < 120  # parts are even in length, not in number
    assert exact_dedup.splitters([("a", 1)] * 50, 8) == [] and exact_dedup.splitters([], 8) == []


def test_exact_dedup_of_long_common_beginnings_and_hot_texts(spark, monkeypatch):
    """More than the splitters see is alike, a third of the rows are one text, and many have none: every task gets its part, and the result is whole."""
    monkeypatch.setattr(exact_dedup, "SAMPLE_CHARS", 64)
    r = random.Random(31)
    texts = ["license " * 40 + prose(r, 3) for _ in range(900)] + ["hot  text"] * 500 + [None] * 100
    r.shuffle(texts)
    docs = frame(spark, texts).repartition(4)
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[i if t is None else " ".join(t.split())].append(i)
    assert {(x.doc_id, x.n_copies) for x in exact_dedup.copies(docs).collect()} == {(min(g), len(g)) for g in groups.values()}
    assert {x.doc_id for x in exact_dedup.dedup(docs).collect()} == {min(g) for g in groups.values()}
    rows = docs.withColumn("content", exact_dedup.normalised(exact_dedup.F.col("text")))
    parts = exact_dedup.sorted_by_content(rows, docs, exact_dedup.F.col("content")).where("text is null or text != 'hot  text'").groupBy(exact_dedup.F.spark_partition_id()).count()
    assert max(x["count"] for x in parts.collect()) < 600
    few = [k for k, n in enumerate(exact_dedup.shares([("a" * 64, 1)] * 90 + [("b", 1)] * 10, ["b"], 4)) if n > 1]
    assert few == [0]


# 2


def edited(r, text, n):
    words = text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = word(r)
    return " ".join(words)


def test_simhash_pairs_are_exact(spark):
    r = random.Random(3)
    base = [prose(r, 80) for _ in range(40)]
    texts = base + [edited(r, r.choice(base), r.randint(0, 6)) for _ in range(160)]
    docs = frame(spark, texts)
    fps = simhash.fingerprints(pa.array(texts))
    near = defaultdict(set)
    for a, b in itertools.combinations(range(len(texts)), 2):
        if int(simhash.hamming(fps[a : a + 1], fps[b : b + 1])[0]) <= simhash.RADIUS:
            near[a].add(b)
            near[b].add(a)
    root = {}
    for i in range(len(texts)):
        if i not in root:
            todo = [i]
            while todo:
                j = todo.pop()
                if root.setdefault(j, i) == i:
                    todo += [k for k in near[j] if k not in root]
    assert len(set(root.values())) < 150
    for limit in (simhash.SHARD_ROWS, 7):
        got = {x.doc_id: x.root for x in simhash.grouped(docs, shard_rows=limit).collect()}
        assert got == root
    named = docs.withColumn("doc_id", simhash.F.concat(simhash.F.lit("d"), simhash.F.lpad("doc_id", 4, "0")))
    name = lambda i: f"d{i:04}"
    assert {x.doc_id: x.root for x in simhash.grouped(named).collect()} == {name(i): name(r) for i, r in root.items()}
    assert {x.doc_id for x in simhash.dedup(named).collect()} == {name(r) for r in root.values()}


def test_simhash_sends_few_rows_at_any_size():
    for n, copies in ((10, 18), (10_000, 18), (15_000_000, 18), (1_000_000_000, 171), (50_000_000_000, 1140)):
        c = simhash.agreeing(n, simhash.RADIUS, simhash.SHARD_ROWS)
        size = n / 2.0 ** sum(sorted(w for _, w in simhash.blocks(simhash.RADIUS + c))[:c])
        assert math.comb(simhash.RADIUS + c, c) * -(-size // simhash.SHARD_ROWS) <= copies


def test_simhash_shards_leave_no_pair_out():
    r = np.random.default_rng(8)
    a = r.integers(0, 1 << 63, (100, 2)).astype(np.uint64)
    b = a.copy()
    for i in range(100):
        for bit in r.choice(128, simhash.RADIUS, replace=False):
            b[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    for c in (1, 2, 3):
        assert (simhash.shards(a, simhash.RADIUS, c) == simhash.shards(b, simhash.RADIUS, c)).any(1).all()


def test_simhash_crowd_of_near_copies(spark):
    """A third of all fingerprints are within a few bits of one: each costs a path, not a pair with each other."""
    r = np.random.default_rng(9)
    fps = r.integers(0, 1 << 63, (3000, 2)).astype(np.uint64)
    for i in range(1000):
        fps[i] = fps[0]
        for bit in r.choice(128, 6, replace=False):
            fps[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    rows = [(i, int(hi), int(lo)) for i, (lo, hi) in enumerate(fps.view(np.int64).tolist())]
    reps = spark.createDataFrame(rows, "id long, hi long, lo long").dropDuplicates(["hi", "lo"])
    for limit in (simhash.SHARD_ROWS, 50):
        edges = simhash.near_edges(reps, shard_rows=limit)
        found = edges.collect()
        assert len(found) < 40 * 3000 and all(x.a < 1000 and x.b < 1000 for x in found)
        assert len({x.id for x in simhash.components(edges).collect()}) == reps.where("id < 1000").count() - 1


def test_bk_tree_search_is_exact():
    r = np.random.default_rng(1)
    fps = r.integers(0, 1 << 63, (300, 2)).astype(np.uint64)
    fps[150:] = fps[:150] ^ (np.uint64(1) << r.integers(0, 63, (150, 2)).astype(np.uint64))
    shard = r.integers(0, 5, 300).astype(np.uint64)
    trees = simhash.ShardTrees(shard, fps)
    q, node = trees.search(shard, np.arange(300), fps, 3)
    want = {(a, b) for a in range(300) for b in range(300) if shard[a] == shard[b] and simhash.hamming(fps[a : a + 1], fps[b : b + 1])[0] <= 3}
    assert set(zip(q.tolist(), node.tolist())) == want and len(q) == len(want)


def test_bk_tree_search_is_bounded():
    """One tree that all queries go through whole: memory follows the steps of a search, not what all queries visit."""
    r = np.random.default_rng(12)
    fps = r.integers(0, 1 << 63, (4000, 2)).astype(np.uint64)
    fps[2000:] = fps[:2000] ^ (np.uint64(1) << r.integers(0, 63, (2000, 2)).astype(np.uint64))
    trees = simhash.ShardTrees(np.zeros(4000, np.uint64), fps)
    tracemalloc.start()
    q, node = trees.search(np.zeros(4000, np.uint64), np.arange(4000), fps, simhash.RADIUS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
    got = np.sort(q * 4000 + node)
    want = np.concatenate([i * 4000 + np.flatnonzero(simhash.hamming(np.repeat(fps[i : i + 1], 4000, 0), fps) <= simhash.RADIUS) for i in range(4000)])
    assert len(want) >= 8000 and (got == want).all()


def test_simhash_of_skewed_fingerprints(spark):
    """Bits that most fingerprints share crowd some shards and trees; the links connect what brute force does, whole and in slices."""
    r = np.random.default_rng(13)
    bits = r.random((1500, 128)) < np.where(r.random(128) < 0.5, 0.93, 0.07)
    for i in range(1000, 1500):
        bits[i] = bits[r.integers(0, 1000)]
        bits[i, r.choice(128, r.integers(14, 21), replace=False)] ^= True
    fps = np.unique(np.packbits(bits, axis=1).view(np.uint64), axis=0)
    every = np.arange(len(fps))
    pairs = [(i, every[simhash.hamming(np.repeat(fps[i : i + 1], len(fps), 0), fps) <= 12]) for i in every]
    a, b = np.repeat(every, [len(x) for _, x in pairs]), np.concatenate([x for _, x in pairs])
    want = dict(zip(*(x.tolist() for x in simhash.forest(a[a != b], b[a != b]))))
    assert 50 < len(want) < len(fps)
    reps = spark.createDataFrame([(i, int(hi), int(lo)) for i, (lo, hi) in enumerate(fps.view(np.int64).tolist())], "id long, hi long, lo long")
    for limit in (simhash.SHARD_ROWS, 40):
        edges = simhash.near_edges(reps, 12, limit)
        assert {x.id: x.root for x in simhash.components(edges).collect()} == want


def test_runs_leave_no_pair_out():
    r = np.random.default_rng(14)
    a = r.integers(0, 1 << 63, (400, 2)).astype(np.uint64)
    for radius in (11, 12, simhash.RADIUS):
        b = a.copy()
        for i in range(400):
            for bit in r.choice(128, radius, replace=False):
                b[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        hit = np.zeros(400, bool)
        same = simhash.shards(a, radius, 1) == simhash.shards(b, radius, 1)
        for k, (others, flips) in enumerate(simhash.run_parts(radius)):
            hit |= same[:, k] & np.isin(simhash.joined_values(a, others) ^ simhash.joined_values(b, others), flips)
        assert hit.all()


def test_blocks_leave_no_pair_out():
    r = np.random.default_rng(2)
    a = r.integers(0, 1 << 63, (200, 2)).astype(np.uint64)
    b = a.copy()
    for i in range(200):
        for bit in r.choice(128, simhash.RADIUS, replace=False):
            b[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    for n in (10, 10_000, 10_000_000, 10_000_000_000):
        m = simhash.block_count(n, simhash.RADIUS)
        hit = np.zeros(200, bool)
        for first, width in simhash.blocks(m):
            hit |= np.bitwise_count(simhash.block_values(a, first, width) ^ simhash.block_values(b, first, width)) <= simhash.RADIUS // m
        assert hit.all()


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 102), (101, 102), (7, 7)], "a long, b long")
    assert {(r.id, r.root) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, 41)} | {(101, 100), (102, 100)}


def test_simhash_odd(spark, odd):
    out = simhash.dedup(odd)
    assert out.columns == odd.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter([1, 1, 3, 4, None, None, 5, 7, 9, 11])
    assert {(r.doc_id, r.n_docs) for r in simhash.kept(odd).collect()} == {(1, 2), (5, 2), (7, 2), (9, 2), (11, 1)}
    assert simhash.dedup(empty(spark)).count() == 0 and simhash.kept(empty(spark)).count() == 0


# 3


def junk(r):
    return r.choice([" | ".join(word(r) for _ in range(40)), " ".join(word(r) + "###" for _ in range(40)), " ".join([word(r)] * 60), prose(r, 40).upper() + "!!"])


def test_quality_keeps_good_and_drops_junk(spark):
    r = random.Random(5)
    good = [i % 5 > 0 for i in range(600)]
    texts = [". ".join(prose(r, r.randint(4, 12)).capitalize() for _ in range(8)) if g else junk(r) for g in good]
    docs = frame(spark, texts, ["a", "b", "c"])
    labels = spark.createDataFrame([(i, int(good[i]), 0) for i in range(0, 600, 2)], LABELS)
    kept = {x.doc_id for x in quality.keep_good(docs, labels).collect()}
    assert sum(i in kept for i in range(600) if good[i]) >= 0.99 * sum(good)
    assert sum(i in kept for i in range(600) if not good[i]) <= 0.05 * (600 - sum(good))
    assert {x.doc_id for x in quality.accepted(docs, labels).collect()} == kept


def test_quality_shrinks_sparse_sites(spark):
    r = random.Random(6)
    texts, sources = [], []
    for i in range(400):
        bad = i % 2 if i < 390 else 1
        texts.append(junk(r) if bad else ". ".join(prose(r, 8).capitalize() for _ in range(6)))
        sources.append("mixed" if i < 390 else f"tiny{i}")
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, (t, s) in enumerate(zip(texts, sources))], DOCS)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(390)], LABELS)
    rows = {x.doc_id: x for x in quality.scored(docs, labels)[0].collect()}
    alone = rows[395].host_rate
    assert 0.0 < alone < rows[0].host_rate + 1e-9  # one bad page doesn't make a host's rate zero


def test_quality_threshold_keeps_recall(spark):
    rows = lambda score, y: spark.createDataFrame([(float(s), 1, 1 - int(g)) for s, g in zip(score, y)], "score double, n int, bad int")
    assert quality.threshold(rows(range(6), [0, 0, 1, 0, 1, 1]), 1.0) == 1.5
    assert quality.threshold(rows(range(6), np.ones(6)), 0.9) == float("-inf")
    r = random.Random(24)
    for recall in (0.8, 0.95, 1.0):
        score = [r.choice(range(40)) / 4 for _ in range(300)]
        y = [int(r.random() < 1 / (1 + math.exp(5 - s))) for s in score]
        marks = sorted(set(score))
        errors = {}
        for k, cut in enumerate(marks):
            lost = sum(g and s < cut for s, g in zip(score, y))
            if lost <= (1 - recall) * sum(y):
                errors[cut] = lost + sum(not g and s >= cut for s, g in zip(score, y))
        best = min(errors, key=lambda c: (errors[c], c))
        want = float("-inf") if best == marks[0] else (best + marks[marks.index(best) - 1]) / 2
        assert quality.threshold(rows(score, y), recall) == want


def test_quality_rates_and_scores_against_brute_force(spark):
    """Host and path posteriors, the strength of their priors and the score, from the documents' own evidence."""
    r = random.Random(25)
    share = {"a/x": 0.1, "a/y": 0.5, "b/x": 0.9, "c": 0.6, "d/z": 0.3}
    rows = []
    for i in range(500):
        site = r.choice([*share] * 9 + ["e/q"]) if i % 50 else f"t{i}"
        text = junk(r) if r.random() < share.get(site, 0.5) else ". ".join(prose(r, 8).capitalize() for _ in range(6))
        rows.append((i, text, r.choice(["en", "fr"]), site, 0))
    labels = spark.createDataFrame([(i, int("." in t and "#" not in t), 0) for i, t, *_ in rows if i % 3], LABELS)
    out, cut = quality.scored(spark.createDataFrame(rows, DOCS), labels)
    got = {x.doc_id: x for x in out.collect()}
    place = {i: (s.split("/")[0], s.split("/")[1] if "/" in s else lang) for i, _, lang, s, _ in rows}
    p = {i: 1 / (1 + math.exp(-x.evidence)) for i, x in got.items()}
    groups = {k: defaultdict(list) for k in (1, 2)}
    for i, where in place.items():
        for k in (1, 2):
            groups[k][where[:k]].append(p[i])

    def strength(groups):
        n = [len(g) for g in groups]
        mean = sum(map(sum, groups)) / sum(n)
        within = mean * (1 - mean)
        between = (sum(sum(g) ** 2 / len(g) for g in groups) - sum(n) * mean**2 - (len(n) - 1) * within) / (sum(n) - sum(x * x for x in n) / sum(n))
        return min(max(within / max(between, 1e-9), 1.0), 10_000.0)

    kh, kp = strength(list(groups[1].values())), strength(list(groups[2].values()))
    assert kh < 10_000 and kp < 10_000  # sites tell something
    rate = (sum(p.values()) + 1) / (len(p) + 2)
    logit = lambda x: math.log(x / (1 - x))
    moved = 0
    for i, x in got.items():
        host, path = groups[1][place[i][:1]], groups[2][place[i]]
        host_rate = (sum(host) - p[i] + kh * rate) / (len(host) - 1 + kh)
        path_rate = (sum(path) - p[i] + kp * host_rate) / (len(path) - 1 + kp)
        assert math.isclose(x.host_rate, host_rate, rel_tol=1e-6) and math.isclose(x.path_rate, path_rate, rel_tol=1e-6)
        assert math.isclose(x.score, x.evidence + logit(path_rate) - logit(rate), rel_tol=1e-6, abs_tol=1e-6)
        moved += abs(path_rate - rate) > 0.1
    assert moved > 100
    docs = spark.createDataFrame(rows, DOCS)
    assert {x.doc_id for x in quality.accepted(docs, labels).collect()} == {i for i, x in got.items() if x.score >= cut}


def test_quality_odd(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (9, 0, 1), (5, 0, None), (None, 1, 1), (7, None, 0), (7, 7, 0), (1, 1, 0)], LABELS)
    out = quality.keep_good(odd, labels)
    assert out.columns == odd.columns
    assert {3, 4, None} <= {r.doc_id for r in out.collect()}
    assert quality.keep_good(odd, labels.limit(0)).count() == odd.count()
    assert quality.keep_good(empty(spark), labels).count() == 0


# 4


def brute_distance(item, text):
    best = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(best[j] + 1, new[-1] + 1, best[j - 1] + (c != d)))
        best = new
    return min(best)


def test_myers_is_edit_distance():
    r = random.Random(7)
    for _ in range(200):
        item = "".join(r.choice("abc ") for _ in range(r.randint(1, 90)))
        text = "".join(r.choice("abc ") for _ in range(r.randint(0, 60)))
        if r.random() < 0.5:
            text += item[: r.randint(0, len(item))]
        assert decontaminate.myers(item, text) == brute_distance(item, text)


def test_decontamination_against_brute_force(spark):
    r = random.Random(8)
    items = [prose(r, r.randint(8, 20)) for _ in range(12)]
    texts = []
    for i in range(80):
        t = prose(r, r.randint(5, 60))
        if i % 2:
            item = list(r.choice(items))
            for _ in range(r.randint(0, 9)):
                item[r.randrange(len(item))] = r.choice("xyz")
            t = t[: r.randint(0, len(t))] + " " + "".join(item).upper().replace(" ", ", ") + " " + t
        texts.append(t)
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    want = set()
    for (i, t), (n, item) in itertools.product(enumerate(texts), enumerate(items)):
        a, b = decontaminate.normalised(item), decontaminate.normalised(t)
        if (d := brute_distance(a, b)) <= decontaminate.budget(a):
            want.add((i, n, d))
    assert len(want) > 20
    for limit in (1 << 26, 400):
        got = decontaminate.matches(frame(spark, texts), bench, group_chars=limit).collect()
        assert {(x.doc_id, x.item_id, x.distance) for x in got} == want and len(got) == len(want)
    left = {x.doc_id for x in decontaminate.clean(frame(spark, texts), bench).collect()}
    assert left == set(range(80)) - {i for i, _, _ in want}


def test_decontamination_odd(spark, odd):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "?!"), (4, "one two three"), (4, "one two three"), (None, "two three")], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.matches(odd, bench).collect())
    assert got == Counter({(1, 4): 4, (2, 4): 2, (None, 4): 2, (1, None): 2, (2, None): 1, (None, None): 1})
    out = decontaminate.clean(odd, bench)
    assert out.columns == odd.columns and Counter(r.doc_id for r in out.collect()) == Counter([3, 4, None, None, 5, 6, 7, 8, 9, 10, 11])
    assert decontaminate.clean(odd, bench.limit(0)).count() == odd.count()
    assert decontaminate.clean(empty(spark), bench).count() == 0


def test_decontamination_takes_any_ids_and_whole_short_items(spark):
    docs = spark.createDataFrame([("a", "the heat is on"), ("b", "he said: THE END"), ("c", "x"), ("d", "日本語 テスト and more"), (None, "he")], "doc_id string, text string").withColumn("item_id", decontaminate.F.lit(1)).withColumn("distance", decontaminate.F.lit("x"))
    bench = spark.createDataFrame([(1, "he"), (2, "the end"), (3, "日本語"), (4, "x")], "item_id int, text string")
    got = {(x.doc_id, x.item_id, x.distance, x.budget) for x in decontaminate.matches(docs, bench).collect()}
    assert got == {("b", 1, 0, 0), (None, 1, 0, 0), ("b", 2, 0, 0), ("d", 3, 0, 0), ("c", 4, 0, 0)}
    assert decontaminate.matches(docs, bench.withColumn("item_id", decontaminate.F.lit("n"))).where("item_id = 'n'").count() == 5
    assert {x.doc_id for x in decontaminate.clean(docs, bench).collect()} == {"a", None}


def test_decontamination_words_are_those_of_a_loop():
    texts = ["Ab  c_d-é", "", None, "?!", "  x  ", "ÀÉ\n\tß1", "a\U0001f600b \U00020000"]
    codes, at = decontaminate.words(pa.array(texts))
    for k, t in enumerate(texts):
        want = "".join(c.lower()[0] if c.isalnum() else " " for c in t or "")
        assert codes[at[k] : at[k + 1]].tobytes().decode("utf-32-le").split(" ") == ["", *want.split(), ""][: len(want.split()) + 2]


def test_decontamination_scans_once(spark):
    bench = spark.createDataFrame([(i, f"{i} " + prose(random.Random(i), 20)) for i in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(7, "x " + bench.first().text)], "doc_id long, text string")
    found = decontaminate.matches(docs, bench, group_chars=300)
    assert len(decontaminate.indexed(bench, group_chars=300)) > 5
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1 and [x.item_id for x in found.collect()] == [0]


# 5


def test_candidates_against_brute_force():
    import re

    r = random.Random(9)
    texts = ["".join(r.choice("aB3 -_=/é\n.") for _ in range(r.randint(0, 300))) for _ in range(50)] + [""]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    a, b = secret_scan.candidates(data, off)
    want = []
    for o, t in zip(off, raw):
        for m in re.finditer(rb"[A-Za-z0-9+/_=\-.~]{8,}", t):
            s = m.group()
            digits, letters, upper = len(re.findall(rb"\d", s)), len(re.findall(rb"[A-Za-z]", s)), len(re.findall(rb"[A-Z]", s[1:]))
            if digits and letters or len(s) >= 20 and (0 < upper < letters or digits >= 16):
                want.append((o + m.start(), o + m.end()))
    assert [*zip(a, b)] == want


def test_frames_cover_the_whole_candidate():
    key = "A1" * 150
    data = np.frombuffer(f"token = {key} after".encode(), np.uint8)
    off = np.array([0, len(data)])
    x, mine, of = secret_scan.frames(data, off, np.array([8]), np.array([8 + len(key)]))
    assert mine[:, secret_scan.SIDE : secret_scan.SIDE + secret_scan.BODY].all() and (of == 0).all()
    assert bytes(x[0][: secret_scan.SIDE]).endswith(b"token = ") and bytes(x[-1]).rstrip(b"\0").endswith(b" after")


@pytest.fixture(scope="module")
def scanner():
    return secret_scan.Scanner(secret_scan.findings(5000))


def test_secret_network_on_held_out_findings(scanner):
    data, off, a, b, y = secret_scan._packed(secret_scan.findings(1500, seed=77))
    hit = scanner.probability(scanner.net.logits(data, off, a, b)) >= scanner.least
    assert hit[y == 1].mean() >= 0.97 and hit[y == 0].mean() <= 0.03


def test_secret_gradient():
    rows = secret_scan.findings(6, seed=3)
    data, off, a, b, y = secret_scan._packed(rows)
    x, mine, of = secret_scan.frames(data, off, a, b)
    net = secret_scan.Network(2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    g = net.gradient(x, mine, y[of])

    def loss():
        z = net.forward(x, mine)[0]
        return float(np.mean(np.logaddexp(0, z) - y[of] * z))

    r = np.random.default_rng(1)
    for name in ("o", "d", "k", "m", "kb", "e"):
        flat = net.p[name].reshape(-1)
        some = np.argsort(-np.abs(g[name].reshape(-1)))[: 3]
        for k in some:
            old = flat[k]
            flat[k] = old + 1e-5
            up = loss()
            flat[k] = old - 1e-5
            down = loss()
            flat[k] = old
            assert math.isclose((up - down) / 2e-5, g[name].reshape(-1)[k], rel_tol=2e-2, abs_tol=1e-6), (name, r)


def test_proposals_hold_every_named_value():
    cases = [('password = "P@ssw0rd!2024" x', "P@ssw0rd!2024"), ("pwd: a1!b", "a1!b"), ("db_password=hunter2", "hunter2"), ("passphrase: correct-horse-battery", "correct-horse-battery"), ("secret = 'two words é'", "two words é"), ("see qwertyuiopasdfghjklzxcvb now", "qwertyuiopasdfghjklzxcvb"), ('"api_key": "k"', "k")]
    raw = [t.encode() for t, _ in cases]
    off = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    a, b = secret_scan.proposals(data, off)
    spans = [(x - off[k], y - off[k]) for x, y in zip(a, b) for k in [np.searchsorted(off, x, "right") - 1]]
    doc = np.searchsorted(off, a, "right") - 1
    for k, (_, want) in enumerate(cases):
        assert [raw[k][x:y].decode() for (x, y), d in zip(spans, doc) if d == k] == [want]
    assert not len(secret_scan.proposals(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0])


def test_secret_threshold_counts_misses():
    rows = secret_scan.findings(1200, named=True)
    missed = [(t, a, a, y) if y and i % 7 == 0 else (t, a, b, y) for i, (t, a, b, y) in enumerate(rows)]
    scanner = secret_scan.Scanner(missed, recall=0.8, epochs=2)
    cut = [x for x in missed[len(rows) * 3 // 4 :] if x[3]]
    data, off, a, b, _ = secret_scan._packed([x for x in cut if x[2] > x[1]])
    assert (scanner.probability(scanner.net.logits(data, off, a, b)) >= scanner.least).sum() >= 0.8 * len(cut)


def test_secret_scan_odd(spark, odd, monkeypatch):
    monkeypatch.setattr(secret_scan, "FINDINGS", 1500)
    key = "9f8a3c5d7e1b2f4a6c8d0e9f8a3c5d7e1b2f4a6c"
    docs = odd.unionByName(spark.createDataFrame([(20, f'é ba token = "{key}" no'), (20, f'é ba token = "{key}" no')], "doc_id long, text string"), allowMissingColumns=True)
    got = secret_scan.scan(docs, 3000).collect()
    assert Counter((r.doc_id, r.begin, r.n_chars) for r in got)[(20, 14, 40)] == 2
    assert secret_scan.scan(empty(spark), 300).count() == 0


def test_secret_query_against_brute_force(spark):
    """Candidates by regular expressions, text by text, and the network position by position."""
    r = random.Random(26)
    made = [x for named in (False, True) for x in secret_scan.findings(40, seed=91, named=named)]
    texts = [t for t, *_ in made] + [f"{prose(r, 30)} " + " ".join(t for t, *_ in r.sample(made, 3)) for _ in range(6)] + ["é " * 30 + 'password = "hunter2"', ""]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    told = [secret_scan.trained(spark, 2000, named, secret_scan.RECALL) for named in (False, True)]

    def logit(p, raw, a, b):
        best = -math.inf
        count = max(0, -(-(b - a - secret_scan.BODY) // (secret_scan.BODY // 2))) + 1
        for k in range(count):
            start = min(a + k * (secret_scan.BODY // 2), max(b - secret_scan.BODY, a)) - secret_scan.SIDE
            at = range(start, start + secret_scan.WIDTH)
            mine = [a <= j < b for j in at]
            e = np.array([p["e"][raw[j] if 0 <= j < len(raw) else 0] + m * p["m"] for j, m in zip(at, mine)])
            body, side, mean = [], [], []
            for j in range(secret_scan.WIDTH - secret_scan.KERNEL + 1):
                c = np.maximum(sum(e[j + d] @ p["k"][d * secret_scan.DIM : (d + 1) * secret_scan.DIM] for d in range(secret_scan.KERNEL)) + p["kb"], 0)
                inside = mine[j + secret_scan.KERNEL // 2]
                (body if inside else side).append(c)
            zero = np.zeros(secret_scan.FILTERS)
            top = [np.max(x, 0) if x else zero for x in (body, side)]
            pool = np.concatenate([*top, np.sum(body, 0) / len(body) if body else zero])
            best = max(best, float(np.maximum(pool @ p["d"] + p["db"], 0) @ p["o"] + p["ob"][0]))
        return best

    want = {}
    for i, t in enumerate(texts):
        raw = t.encode()
        data, off = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
        for a, b in zip(*(x.tolist() for x in secret_scan.proposals(data, off))):
            s = raw[a:b]
            digits, letters, upper = (len(re.findall(x, y)) for x, y in ((rb"\d", s), (rb"[A-Za-z]", s), (rb"[A-Z]", s[1:])))
            key = re.fullmatch(rb"[A-Za-z0-9+/_=\-.~]{8,}", s) and (digits and letters or len(s) >= 20 and (0 < upper < letters or digits >= 16))
            p = told[0 if key else 1]
            slope, offset, least = p["cut"]
            sure = 1 / (1 + math.exp(-(slope * min(max(logit(p, raw, a, b), -60), 60) + offset)))
            if abs(sure - least) > 1e-5:
                want[f"d{i}", len(raw[:a].decode()), len(s.decode()), hashlib.sha256(s).hexdigest()] = sure, sure >= least
    got = {(x.doc_id, x.begin, x.n_chars, x.digest): x.probability for x in secret_scan.scan(docs, 2000).collect()}
    assert {k for k in got if k in want} == {k for k, (_, hit) in want.items() if hit} and len(got) > 30
    assert all(math.isclose(got[k], want[k][0], rel_tol=1e-3, abs_tol=1e-4) for k in got if k in want)
    assert any(k[0] == f"d{len(texts) - 2}" and k[1] == 72 for k in want)


def test_proposals_against_regular_expressions():
    r = random.Random(27)
    texts = [t for named in (False, True) for t, *_ in secret_scan.findings(150, seed=92, named=named)]
    texts += ["".join(r.choice(["key", "=", ": ", "pass", "word", '"', "'", "aB3", " ", "é", "-", "bearer ", "Token", "abcdefghijk", "_x", "\n"]) for _ in range(r.randint(0, 25))) for _ in range(300)]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    want = []
    for o, t in zip(off.tolist(), raw):
        for m in secret_scan._VALUE.finditer(t):
            x, y = m.span(m.lastindex)
            if m.lastindex >= 3:
                y = x + len(t[x:y].rstrip(b"\"',;)]}>")) or y
            want.append((o + x, o + y, o + m.start(), o + m.end()))
    assert secret_scan.named_values(data, off) == want and len(want) > 200
    a, b = secret_scan.runs(secret_scan._LONG[data], off)
    got = [(x, y) for x, y in zip(a.tolist(), b.tolist()) if y - x >= 20]
    assert got == [(o + m.start(), o + m.end()) for o, t in zip(off.tolist(), raw) for m in re.finditer(rb"[A-Za-z+/_=\-.~]{20,}", t)]


def test_fitted_networks_are_read_again(spark):
    calls = []
    make = lambda: calls.append(1) or {"x": np.arange(3)}
    for _ in range(2):
        assert fitted(spark, "test", "some key", make)["x"].tolist() == [0, 1, 2]
    assert len(calls) == 1 and fitted(spark, "test", "other key", make) and len(calls) == 2


# 6


def test_url_tokens(spark):
    urls = ["https://www.Cheap-Pills.example.com/en/12/x?ref=a&page=2#top", "", "no scheme/path", None]
    got = [r.t for r in spark.createDataFrame([(u,) for u in urls], "url string").select(url_rules.tokens(url_rules.F.col("url")).alias("t")).collect()]
    assert set(got[0]) == {"s:https", "h:www", "h:cheap", "h:pills", "h:example", "h:com", "p:en", "p:0", "p:x", "q:ref", "q:a", "q:page", "q:0"}
    assert got[1] == [] and set(got[2]) == {"h:no", "h:scheme", "p:path"} and got[3] is None


def test_url_rules_against_brute_force(spark):
    r = random.Random(10)
    rows = []
    for i in range(500):
        host = r.choice(["a-news", "b-shop", "win-casino", "c-mail", "win-prize"])
        bad = host == "win-casino" or host == "win-prize" and "promo" in (tail := r.choice(["promo", "info"])) or r.random() < 0.03
        tail = tail if host == "win-prize" else r.choice(["promo", "info", "x"])
        rows.append((f"http://{host}.org/{tail}/{i}", bool(bad)))
    urls = spark.createDataFrame(rows, "url string, bad boolean")
    sets = [(frozenset(x.t), x.bad) for x in urls.select(url_rules.tokens(url_rules.F.col("url")).alias("t"), "bad").collect()]
    items = {x for t, _ in sets for x in t}
    want, z = [], url_rules.STANDARD_ERRORS
    for k in range(1, 5):
        for c in map(frozenset, itertools.combinations(sorted(items), k)):
            both, n = sum(c <= t and b for t, b in sets), sum(c <= t for t, b in sets)
            if both and both >= 0.02 * len(sets) and both / n >= 0.9:
                p = both / n
                if (p + z * z / 2 / n - z * math.sqrt(p * (1 - p) / n + z * z / 4 / n / n)) / (1 + z * z / n) >= 0.5:
                    want.append((sorted(c), p, both / len(sets)))
    want = url_rules.pruned(want)
    got = url_rules.mined(urls, min_support=0.02)
    assert [(t, round(c, 9), round(s, 9)) for t, c, s in got] == [(t, round(c, 9), round(s, 9)) for t, c, s in want] and len(got) >= 2
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)] + [(900, None), (901, ""), (0, rows[0][0])], "page_id long, url string")
    hit = {x.page_id: (x.n_rules, x.confidence) for x in url_rules.matched(pages, got).collect()}
    brute = {i: [(t, c) for t, c, _ in want if set(t) <= s] for i, (s, _) in enumerate(sets)}
    assert hit == {i: (len(x), max(c for _, c in x)) for i, x in brute.items() if x}


def test_url_rules_of_any_size_against_brute_force(spark):
    r = random.Random(22)
    rows = []
    for i in range(500):
        own = [x for x in "abcdef" if r.random() < 0.87]
        twins = "&u&v" if r.random() < 0.5 else ""
        bad = len(own) == 6 or not own[2:] or twins and own[:1] == ["b"]
        rows.append((f"http://h.org/?{'&'.join(own)}{twins}", bool(bad)))
    urls = spark.createDataFrame(rows, "url string, bad boolean")
    sets = [(frozenset(x.t), x.bad) for x in urls.select(url_rules.tokens(url_rules.F.col("url")).alias("t"), "bad").collect()]
    items, found, z = sorted({x for t, _ in sets for x in t}), {}, url_rules.STANDARD_ERRORS
    for k in range(1, len(items) + 1):
        for c in map(frozenset, itertools.combinations(items, k)):
            both, n = sum(c <= t and b for t, b in sets), sum(c <= t for t, b in sets)
            if both >= 0.02 * len(sets) and both / n >= 0.9:
                p = both / n
                if (p + z * z / 2 / n - z * math.sqrt(p * (1 - p) / n + z * z / 4 / n / n)) / (1 + z * z / n) >= 0.5:
                    found[c] = p, both / len(sets)
    want = sorted((len(t), sorted(t), round(c, 9), round(s, 9)) for t, (c, s) in found.items() if not any(p < t and found[p][0] >= c for p in found))
    got = url_rules.mined(urls, min_support=0.02)
    assert [(len(t), t, round(c, 9), round(s, 9)) for t, c, s in got] == want and max(len(t) for t, _, _ in got) >= 6


def test_url_rules_odd(spark):
    pages = spark.createDataFrame([(1, None, "x"), (None, "http://casino.example.com/en/1", "x"), (2, "", None), (2, "http://ok.org/2", "y")], "page_id long, url string, token string")
    labels = spark.createDataFrame([(1, None, None), (None, 0, 0), (2, 1, 0), (2, 1, 0)], LABELS)
    assert url_rules.blocked(pages, labels).count() == 0
    assert url_rules.blocked(pages, labels.limit(0)).count() == 0 and url_rules.blocked(pages.limit(0), labels).count() == 0
    assert [(r.page_id, r.n_rules) for r in url_rules.matched(pages, [(["h:casino"], 1.0, 0.5)]).collect()] == [(None, 1)]


def test_blocked_pages_against_brute_force(spark):
    """Hosts whose documents the labels call bad; what goes with them is blocked on pages without a label too."""
    r = random.Random(32)
    hosts = ["a-news", "b-shop", "win-prize", "c-mail"]
    rows = [(i, f"http://{r.choice(hosts)}.org/en/{i}?x={r.choice('ab')}", "p") for i in range(400)]
    pages = spark.createDataFrame([*rows, (900, None, "p"), (901, "http://win.org/", "p"), (0, rows[0][1], "p")], "page_id long, url string, rule string")
    bad = lambda u: "win-prize" in u or "b-shop" in u and "x=b" in u
    labels = spark.createDataFrame([(i, int(not bad(u)), int(i % 2 and bad(u))) for i, u, _ in rows if i % 3] + [(None, 0, 1), (5000, 0, 0)], LABELS)
    taught = [(frozenset(x.t), bad(x.url)) for x in pages.where("page_id % 3 != 0 and page_id < 900").select("url", url_rules.tokens(url_rules.F.col("url")).alias("t")).collect()]
    found, z = {}, url_rules.STANDARD_ERRORS
    for k in range(1, 9):
        for c in map(frozenset, itertools.combinations(sorted({x for t, _ in taught for x in t}), k)):
            both, n = sum(c <= t and b for t, b in taught), sum(c <= t for t, b in taught)
            if both and both >= url_rules.MIN_SUPPORT * len(taught) and both / n >= url_rules.MIN_CONFIDENCE:
                p = both / n
                if (p + z * z / 2 / n - z * math.sqrt(p * (1 - p) / n + z * z / 4 / n / n)) / (1 + z * z / n) >= 0.5:
                    found[c] = p
    rules = {c: p for c, p in found.items() if not any(q < c and found[q] >= p for q in found)}
    own = {x.page_id: frozenset(x.t) for x in pages.where("url is not null").select("page_id", url_rules.tokens(url_rules.F.col("url")).alias("t")).collect()}
    want = {i: (sum(c <= t for c in rules), max((p for c, p in rules.items() if c <= t), default=0)) for i, t in own.items()}
    got = {x.page_id: (x.n_rules, x.confidence) for x in url_rules.blocked(pages, labels).collect()}
    assert got == {i: w for i, w in want.items() if w[0]} and 901 in got and {i for i in got if i < 900} == {i for i, u, _ in rows if bad(u)}
    assert url_rules.blocked(pages, labels.where("quality = 1 and toxic = 0")).count() == 0
    clean = labels.withColumn("quality", url_rules.F.lit(1)).withColumn("toxic", url_rules.F.lit(0))
    assert {x.page_id for x in url_rules.blocked(pages, clean, ("win",)).collect()} >= {i for i, u, _ in rows if "win-prize" in u}


# 7


def random_page(r):
    body = [prose(r, r.randint(12, 40)) + "." for _ in range(r.randint(1, 5))]
    nav = "".join(f"<li><a href='/x'>{word(r)}</a>" for _ in range(5))
    return f"<!DOCTYPE html><html><head><title>{word(r)}</title><script>if (a<b) '</p>'</script></head><body><nav><ul>{nav}</ul></nav><div class=\"ad\">{prose(r, 6)}</div><article>{''.join(f'<p>{html.escape(b)}' for b in body)}</article><footer>&copy; {word(r)}</footer></body></html>", "\n".join(body)


def test_sum_product_is_exact():
    r = np.random.default_rng(3)
    pages = [html_extract.Page("<div><p>a b c<b>d</b></p><a>e</a></div>x"), html_extract.Page("<ul><li>q</ul>"), html_extract.Page("")]
    forest = html_extract.Forest(pages)
    w, pair = r.normal(0, 0.5, html_extract.N_FEATURES), r.normal(0, 1, (4, 2, 2))
    p, both = html_extract.marginals(forest, w, pair)
    unary = forest.x @ w
    for a, b in zip(forest.at[:-1], forest.at[1:]):
        total, hits, joint = 0.0, np.zeros(b - a), np.zeros((b - a, 2, 2))
        for s in itertools.product((0, 1), repeat=b - a):
            e = sum(unary[a + k] for k in range(b - a) if s[k])
            for k in range(1, b - a):
                e += pair[forest.kind[a + k]][s[forest.parent[a + k] - a]][s[k]]
            e = math.exp(e)
            total += e
            hits += e * np.array(s)
            for k in range(1, b - a):
                joint[k, s[forest.parent[a + k] - a], s[k]] += e
        assert np.allclose(p[a:b], hits / total) and np.allclose(both[a + 1 : b], joint[1:] / total)


def test_html_parser_follows_browsers():
    page = html_extract.Page("<p>one<p>two<ul><li>a<li>b</ul><!-- <p>no --><br>x &amp; y<a title='>'>l</a><x")
    told = [(t, page.tag[p]) for t, p in zip(page.text, page.parent) if t]
    assert told == [("one", "p"), ("two", "p"), ("a", "li"), ("b", "li"), ("x & y", "html"), ("l", "a"), ("<x", "html")]


def test_html_extraction_learns(spark):
    r = random.Random(11)
    made = [random_page(r) for _ in range(120)]
    pages = spark.createDataFrame([(i, f"http://h.org/en/{i}", h) for i, (h, _) in enumerate(made)], "page_id long, url string, html string")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, (_, t) in enumerate(made) if i % 2], DOCS)
    got = {x.page_id: x.text for x in html_extract.extracted(pages, docs).collect()}
    assert sum(got[i] == t for i, (_, t) in enumerate(made)) >= 118


def test_html_odd(spark):
    pages = spark.createDataFrame([(1, "http://h/1", None, 1), (None, None, "", 2), (2, "http://h/2", "<p>" * 3000 + "deep", 3), (2, "http://h/2", "<p>" * 3000 + "deep", 3), (3, "x", "<" * 2000 + "'\"" * 500, 4)], "page_id long, url string, html string, text int")
    docs = spark.createDataFrame([(2, "deep", None, None, None), (1, None, None, None, None)], DOCS)
    got = html_extract.extracted(pages, docs).collect()
    assert Counter(r.page_id for r in got) == Counter([1, None, 2, 2, 3])
    assert all(r.text == "" and r.n_blocks == 0 for r in got if r.page_id in (1, None))
    assert html_extract.extracted(pages.limit(0), docs).count() == 0 and html_extract.extracted(pages, docs.limit(0)).count() == 5


# 8


def brute_best_fit(lengths, capacity):
    """Best-fit decreasing, piece by piece: the fullest bin that has room, the lowest among equals."""
    room, out = [], []
    for n in sorted(lengths, reverse=True):
        fits = [(x, i) for i, x in enumerate(room) if x >= n]
        if fits:
            x, i = min(fits)
        else:
            room.append(capacity)
            i = len(room) - 1
        out.append((n, i, capacity - room[i]))
        room[i] -= n
    return out


def test_plan_is_best_fit():
    r = random.Random(12)
    for capacity in (1, 7, 50, 100):
        for _ in range(40):
            lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 200))]
            slots = []
            for n, first, ranks, b, each, at in packing.plan(Counter(lengths), capacity):
                slots += [(n, b + k // each, at + k % each * n) for k in range(ranks)]
            want = brute_best_fit(lengths, capacity)
            assert Counter(n for n, _, _ in slots) == Counter(lengths)
            kinds = lambda rows: Counter(tuple(sorted(Counter(n for n, i, _ in rows if i == b).items())) for b in {i for _, i, _ in rows})
            assert kinds(slots) == kinds(want)


def check_bins(rows, counts, capacity):
    bins = defaultdict(list)
    for x in rows:
        bins[x.bin_id].append((x.bin_offset, x.n_tokens))
    for slots in bins.values():
        end = 0
        for at, n in sorted(slots):
            assert at == end
            end = at + n
        assert end <= capacity
    assert Counter({k: v for k, v in counts.items() if v}) == Counter({k: sum(x.n_tokens for x in rows if x.doc_id == k) for k in {x.doc_id for x in rows}})
    return len(bins)


def test_packing_against_brute_force(spark):
    r = random.Random(13)
    texts = [prose(r, r.choice([r.randint(0, 40), r.randint(40, 200), 64, 128])) for _ in range(300)]
    n = {i: len(t.split()) for i, t in enumerate(texts)}
    rows = packing.pack(frame(spark, texts), 64).collect()
    bins = check_bins(rows, n, 64)
    want = brute_best_fit([x % 64 for x in n.values() if x % 64], 64)
    assert bins == len({i for _, i, _ in want}) + sum(x // 64 for x in n.values())


def test_packing_odd(spark, odd):
    rows = packing.pack(odd, 2048).collect()
    assert check_bins(rows, {1: 6, 2: 3, None: 3, 7: 30000, 8: 30000, 9: 2, 10: 2, 11: 2}, 2048)
    assert packing.pack(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd, 0)


# 9


def test_windows_cover_every_word():
    words = toxicity.Words(pa.array(["", None, "a b", prose(random.Random(1), 24), prose(random.Random(2), 25), prose(random.Random(3), 500)]))
    first, length, text = words.windows()
    for k in range(6):
        seen = set()
        for a, n, t in zip(first, length, text):
            if t == k:
                seen |= set(range(a, a + n))
        assert seen == set(range(words.at[k], words.at[k + 1]))


def test_gru_gradient():
    r = np.random.default_rng(4)
    words = toxicity.Words(pa.array([prose(random.Random(k), 6) for k in range(5)]))
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    for k in ("v", "a", "uf", "ub"):
        net.p[k] *= 3
    y = np.array([1, 0, 1, 0, 0.0])
    first, n = words.at[:-1], 6
    toxicity_states = net.states

    def loss():
        gates = net.inputs(words) @ net.p["w"] + net.p["b"]
        z = net.pooled(toxicity_states(gates, words.codes[first[:, None] + np.arange(n)]))[3].astype(np.float64)
        return float(np.sum(np.logaddexp(0, z) - y * z))

    g = net.gradient(words, first, n, y, np.ones(5))
    for name in ("o", "v", "a", "ab", "uf", "ub", "w", "b", "word", "gram"):
        flat, grad = net.p[name].reshape(-1), g[name].reshape(-1)
        for k in np.argsort(-np.abs(grad))[:2]:
            old = flat[k]
            flat[k] = old + 3e-3
            up = loss()
            flat[k] = old - 3e-3
            down = loss()
            flat[k] = old
            assert math.isclose((up - down) / 6e-3, grad[k], rel_tol=0.05, abs_tol=2e-3), (name, r)


def test_toxicity_on_held_out_documents(spark):
    r = random.Random(14)
    bad = ["zgroll", "vrexhate", "qxinsult"]
    rows, y = [], []
    for i in range(700):
        words = prose(r, r.randint(20, 90)).split()
        y.append(int(i % 3 == 0))
        for _ in range(3 * y[-1]):
            words[r.randrange(len(words))] = r.choice(bad)
        rows.append(" ".join(words))
    labels = spark.createDataFrame([(i, 1, y[i]) for i in range(500)], LABELS)
    got = {x.doc_id for x in toxicity.toxic(frame(spark, rows), labels).collect()}
    held = range(500, 700)
    assert sum(i in got for i in held if y[i]) >= 0.95 * sum(y[i] for i in held)
    assert sum(i in got for i in held if not y[i]) <= 4


def test_toxicity_threshold_on_all_left_out_at_the_labels_mix(spark):
    r = random.Random(21)
    rows = [(i, round(r.gauss(2.0 if i % 9 == 0 else 0.0, 1.0), 2), int(i % 9 == 0)) for i in range(4000)]
    fitted = [i for i, _, y in rows if y and i % 4 or not y and i % 7 == 0]  # most toxic ones and few clean ones
    scored = spark.createDataFrame([(i, s) for i, s, _ in rows] + [(None, 9.0), (9000, 9.0)], "doc_id long, score double")
    known = toxicity.known_labels(spark.createDataFrame([(i, None, y) for i, _, y in rows], LABELS))
    left = [x for x in rows if x[0] not in set(fitted)]
    weight = [sum(y == k for _, _, y in rows) / sum(y == k for _, _, y in left) for k in (0, 1)]

    def f1(cut):
        hits = sum(weight[1] for _, s, y in left if s >= cut and y)
        return 2 * hits / (sum(weight[y] for _, s, y in left if s >= cut) + sum(y for *_, y in rows))

    marks = sorted({s for _, s, _ in left}, reverse=True)
    k = max(range(len(marks)), key=lambda k: f1(marks[k]))
    assert math.isclose(toxicity.threshold(scored, known, fitted), (marks[k] + marks[k + 1]) / 2, abs_tol=1e-9)


def test_toxicity_query_against_brute_force(spark):
    """Every window's score word by word, the worst one, and who reaches the threshold."""
    r = random.Random(28)
    bad = ["zgroll", "vrexhate", "qxinsult"]
    rows, y = [], []
    for i in range(200):
        words = prose(r, r.choice([r.randint(1, 23), 24, r.randint(25, 90)])).split()
        y.append(int(i % 4 == 0))
        for k in range(3 * y[-1]):
            words[(len(words) // 2 + k) % len(words)] = r.choice(bad)
        rows.append(" ".join(words))
    docs = frame(spark, rows)
    known = toxicity.known_labels(spark.createDataFrame([(i, 1, y[i]) for i in range(160)], LABELS))
    net, ids = toxicity.trained(docs, known)
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    h, sigmoid = toxicity.HIDDEN, lambda x: 1 / (1 + np.exp(-x))
    words = toxicity.Words(pa.array(rows))
    inputs = []
    for k, bucket in enumerate(words.bucket):
        grams = words.grams[words.gram_at[k] : words.gram_at[k + 1]]
        inputs.append(np.concatenate([p["word"][bucket], sum(p["gram"][g] for g in grams) / len(grams)]) @ p["w"] + p["b"])

    def read(codes, side, u):
        state, out = np.zeros(h), []
        for c in codes:
            x = [inputs[c][(2 * gate + side) * h : (2 * gate + side + 1) * h] for gate in range(3)]
            a = [state @ u[:, gate * h : (gate + 1) * h] for gate in range(3)]
            z, reset = sigmoid(x[0] + a[0]), sigmoid(x[1] + a[1])
            new = np.tanh(x[2] + reset * a[2])
            state = (1 - z) * new + z * state
            out.append(state)
        return out

    def window(codes):
        both = [np.concatenate(x) for x in zip(read(codes, 0, p["uf"]), read(codes[::-1], 1, p["ub"])[::-1])]
        s = np.exp([np.tanh(x @ p["a"] + p["ab"]) @ p["v"] for x in both])
        return float(sum(w * x for w, x in zip(s / s.sum(), both)) @ p["o"] + p["ob"][0])

    want = {}
    for i in range(len(rows)):
        codes = words.codes[words.at[i] : words.at[i + 1]]
        n, w = len(codes), toxicity.WINDOW
        scores = {k: window(codes[k : k + w]) for k in {min(k, max(n - w, 0)) for k in range(0, max(n - w, 0) + toxicity.STRIDE, toxicity.STRIDE)}}
        if n > w:
            near = {min(max(k + d, 0), n - w) for k, x in scores.items() if x > toxicity.REFINE for d in range(1 - toxicity.STRIDE, toxicity.STRIDE)}
            scores |= {k: window(codes[k : k + w]) for k in near}
        want[i] = max(scores.values()), scores
    own, score, n, start = net.worst(words)
    assert own.tolist() == list(range(200))
    for i in range(200):
        assert math.isclose(score[i], want[i][0], rel_tol=1e-3, abs_tol=1e-3) and math.isclose(want[i][1][int(start[i])], want[i][0], abs_tol=2e-3)
    scored = spark.createDataFrame([(i, float(score[i])) for i in range(200)], "doc_id long, score double")
    cut = toxicity.threshold(scored, known, ids)
    labels = spark.createDataFrame([(i, 1, y[i]) for i in range(160)], LABELS)
    got = {x.doc_id: x for x in toxicity.toxic(docs, labels).collect()}
    assert set(got) == {i for i in range(200) if score[i] >= cut} and len(got) > 20
    assert all(math.isclose(x.score, want[i][0], abs_tol=2e-3) and x.worst_word == start[i] and x.n_windows >= len(want[i][1]) for i, x in got.items())
    # toxic documents that no label told of
    assert sum(i in got for i in range(160, 200) if y[i]) >= 9 and sum(i in got for i in range(160, 200) if not y[i]) <= 1


def test_toxicity_odd(spark, odd):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, None, None), (None, 1, 1), (9, 1, 1), (7, 0, 0), (8, 1, 0), (11, 1, 0)], LABELS)
    assert {"doc_id", "score", "n_windows", "worst_word"} == set(toxicity.toxic(odd, labels).columns)
    got = toxicity.toxic(odd, labels).collect()
    assert {r.doc_id for r in got} <= {1, 2, None, 7, 8, 11}
    alike = Counter(r.doc_id for r in got)
    assert alike[1] in (0, 2) and (1 in alike) == (None in alike) == (2 in alike)  # repeated rows and one text are judged alike
    assert toxicity.toxic(odd, labels.limit(0)).count() == 0 and toxicity.toxic(empty(spark), labels).count() == 0


# 10


def brute_discounts(counts):
    """Chen and Goodman's discounts of counts 1, 2 and at least 3, written out."""
    n1, n2, n3, n4 = (sum(c == k for c in counts) for k in (1, 2, 3, 4))
    if n1 == 0 or n2 == 0:
        return [0.5, 0.75, 0.75] if n1 or n2 or n3 else [0.0, 0.0, 0.0]  # counts that are all larger need none
    y = n1 / (n1 + 2 * n2)
    three = 3 - 4 * y * n4 / n3 if n3 else 2 - 3 * y * n3 / n2
    return [min(max(x, 0.0), top) for x, top in ((1 - 2 * y * n2 / n1, 1.0), (2 - 3 * y * n3 / n2, 2.0), (three, 3.0))]


def brute_kneser_ney(texts):
    """P(word | context) of an interpolated modified Kneser-Ney bigram model, straight from its formulas."""
    pairs = Counter()
    for t in texts:
        words = t.split()
        if words:
            pairs.update(zip(["<s>", *words], [*words, "</s>"]))
    cont = Counter(b for _, b in pairs)

    def discount(counts):
        d = brute_discounts(list(counts))
        return lambda c: 0 if c == 0 else d[min(c, 3) - 1]

    d2, d1 = discount(pairs.values()), discount(cont.values())
    total = sum(cont.values())
    gamma = sum(d1(c) for c in cont.values()) / total

    def p(a, b):
        low = max(cont[b] - d1(cont[b]), 0) / total + gamma / (len(cont) + 1)
        after = {y: c for (x, y), c in pairs.items() if x == a}
        n = sum(after.values())
        return low if not n else max(pairs[a, b] - d2(pairs[a, b]), 0) / n + sum(d2(c) for c in after.values()) / n * low

    return p, cont


def test_kneser_ney_against_brute_force(spark):
    r = random.Random(15)
    vocabulary = [word(r) for _ in range(40)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 30))) for _ in range(150)]
    p, cont = brute_kneser_ney(texts)
    got = {x.doc_id: x for x in kneser_ney.perplexity(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        words = t.split()
        logs = [math.log(p(a, b)) for a, b in zip(["<s>", *words], [*words, "</s>"])] if words else []
        assert got[i].n_tokens == len(logs) and math.isclose(got[i].log_prob, sum(logs), rel_tol=1e-6, abs_tol=1e-9)
        assert got[i].perplexity is None if not logs else math.isclose(got[i].perplexity, math.exp(-sum(logs) / len(logs)), rel_tol=1e-6)
    for a in ("<s>", vocabulary[0]):
        assert math.isclose(sum(p(a, b) for b in cont), 1, rel_tol=0.05)


def test_kneser_ney_of_higher_order_against_brute_force(spark):
    r = random.Random(23)
    vocabulary = [word(r) for _ in range(12)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 30))) for _ in range(120)]
    texts += [f"{r.choice(vocabulary)} rare{k % 9} {r.choice(vocabulary)}" for k in range(14)]
    for order in (3, 4):
        grams = {order: Counter()}
        for t in texts:
            words = ["<s>"] * (order - 1) + t.split() + ["</s>"]
            if t.split():
                grams[order].update(tuple(words[i - order + 1 : i + 1]) for i in range(order - 1, len(words)))
        for k in range(order - 1, 0, -1):
            grams[k] = Counter(g[1:] for g in grams[k + 1])
        d = {k: brute_discounts(list(grams[k].values())) for k in grams}
        after = {k: defaultdict(list) for k in grams}
        for k, own in grams.items():
            for g, c in own.items():
                after[k][g[:-1]].append(c)

        def p(g):
            k, counts = len(g), after[len(g)][g[:-1]]
            low = p(g[1:]) if k > 1 else 1 / (len(grams[1]) + 1)
            if not counts:
                return low
            less = lambda c: d[k][min(c, 3) - 1]  # noqa: B023, E731
            c = grams[k][g]
            return (max(c - less(c), 0) if c else 0) / sum(counts) + sum(map(less, counts)) / sum(counts) * low

        # with 256 tokens for each shard most contexts are of frequent words and are divided
        for shard_tokens in (kneser_ney.SHARD_TOKENS, 256):
            told = kneser_ney.train(frame(spark, texts), order, shard_tokens)
            assert (told["hot"] > 5) == (shard_tokens == 256) and (told["shards"] > 5) == (shard_tokens == 256)
            got = {x.doc_id: x for x in kneser_ney.score(frame(spark, [*texts, "zz " + texts[3]]), told).collect()}
            for i, t in enumerate([*texts, "zz " + texts[3]]):
                words = ["<s>"] * (order - 1) + t.split() + ["</s>"]
                logs = [math.log(p(tuple(words[j - order + 1 : j + 1]))) for j in range(order - 1, len(words))] if t.split() else []
                assert got[i].n_tokens == len(logs) and math.isclose(got[i].log_prob, sum(logs), rel_tol=1e-6, abs_tol=1e-9)
    assert kneser_ney.ORDER >= 3


def test_kneser_ney_files_hold_what_was_saved(tmp_path):
    r = np.random.default_rng(12)
    for n in (0, 1, 7, 5000):
        keys = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) << np.uint64(1))
        counts = r.integers(1, 40, len(keys))
        stats = [r.integers(0, 3, len(keys)) for _ in range(4)]
        at = str(tmp_path / str(n))
        kneser_ney.save_table(at, keys)
        kneser_ney.save_counts(at, counts)
        kneser_ney.save_stats(at, stats)
        files = kneser_ney.Files(str(tmp_path))
        asked = np.concatenate([keys[::-1], keys ^ np.uint64(1 << 45)])
        assert (files.counts(str(n), asked) == np.concatenate([counts[::-1], 0 * counts])).all()
        assert (files.stats(str(n), asked, 4) == np.concatenate([np.stack(stats, 1)[::-1], np.zeros((len(keys), 4))])).all()
    rows = [np.sort(r.integers(0, 1 << 40, 300).astype(np.uint64)), r.integers(0, 9, 300), r.integers(0, 1 << 50, 300)]
    assert all((a.astype(np.int64) == b.astype(np.int64)).all() for a, b in zip(rows, kneser_ney.unpacked(kneser_ney.packed(rows), 3)))
    for bits in (3, 40):  # packed into one integer, and not
        columns, total = kneser_ney.distinct([np.array([2, 1, 2, 1]), np.array([0, 5, 0, 4])], np.array([1, 2, 3, 4]), bits)
        assert [c.tolist() for c in columns] == [[1, 1, 2], [4, 5, 0]] and total.tolist() == [4, 2, 4]


def test_kneser_ney_scores_unseen_words(spark):
    told = kneser_ney.train(frame(spark, ["a b c", "a b d", "a c"]))
    got = {x.doc_id: x for x in kneser_ney.score(frame(spark, ["a b c", "x y z"]), told).collect()}
    assert got[0].perplexity < got[1].perplexity < float("inf")


def test_kneser_ney_odd(spark, odd):
    rows = kneser_ney.perplexity(odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd.collect())
    assert all((r.perplexity is None) == (r.n_tokens == 0) for r in rows)
    assert kneser_ney.perplexity(empty(spark)).count() == 0


def test_tokens_against_a_regular_expression():
    import re

    texts = ["Ab c_d", "", "É ê!x", None, "a" * 400_000 + " b", "x\ty\nz", "ÀB àb"]
    hashes, at = hashed_tokens(pa.array(texts))
    names = {}
    for k, t in enumerate(texts):
        want = re.findall(r"[A-Za-z0-9_\u0080-￿]+", t or "")
        own = hashes[at[k] : at[k + 1]].tolist()
        assert len(own) == len(want)
        for w, h in zip(want, own):
            assert names.setdefault(w.lower(), h) == h
    assert len(set(names.values())) == len(names)
