"""The pipeline and the registered queries, on a small set of tables, against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lamina.llm import decontaminate, packing, queries, simhash
from tests.llm.test_operators import DOCS, LABELS, brute_best_fit, brute_distance, check_bins, edited, junk, prose


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(21)
    items = [prose(r, r.randint(12, 20)) for _ in range(5)]
    sentence = lambda: ". ".join(prose(r, r.randint(5, 12)).capitalize() for _ in range(r.randint(6, 12)))
    texts, good = [], []
    for i in range(260):
        kind = i % 13
        if kind == 0:
            texts.append(junk(r))
        elif kind == 1 and i > 13:
            texts.append(texts[i - 11].replace(" ", "  ", 1))
        elif kind == 2 and i > 13:
            texts.append(edited(r, texts[i - 8], 1))
        elif kind == 3:
            texts.append(sentence() + " " + r.choice(items).upper() + ". " + sentence())
        else:
            texts.append(sentence())
        good.append(kind > 0)
    good = [g and texts[i] != "" for i, g in enumerate(good)]
    at = str(tmp_path_factory.mktemp("tables"))
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    save([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], DOCS, "documents")
    save([(i, int(g), int(i % 6 == 0)) for i, g in enumerate(good) if i % 13 < 2 or i % 2], LABELS, "labels")
    save([*enumerate(items)], "item_id long, text string", "benchmark")
    save([(i, f"http://h{i % 4}.org/en/{i}", f"<nav><a>{prose(r, 1)}</a></nav><article><p>{t}</article>") for i, t in enumerate(texts[:60])], "page_id long, url string, html string", "pages")
    return at, texts, items


def brute_groups(texts, ids):
    """ids that stay: the least of each group that near pairs connect."""
    fps = simhash.fingerprints(pa.array([texts[i] for i in ids]))
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in range(len(ids)):
        d = simhash.hamming(np.repeat(fps[x : x + 1], len(ids), 0), fps)
        for y in np.flatnonzero(d <= simhash.RADIUS):
            a, b = find(ids[x]), find(ids[int(y)])
            root[max(a, b)] = min(a, b)
    return [i for i in ids if find(i) == i]


def test_pipeline_against_brute_force(spark, tables):
    at, texts, items = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, at)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == [i for i in range(260) if i % 13]
    first = {}
    for i in ids:
        first.setdefault(" ".join(texts[i].split()), i)
    ids = brute_groups(texts, sorted(first.values()))
    clean = lambda i: all(brute_distance(decontaminate.normalised(x), decontaminate.normalised(texts[i])) > decontaminate.budget(decontaminate.normalised(x)) for x in items)
    ids = [i for i in ids if clean(i)]
    assert 100 < len(ids) < 210
    rows = corpus_pipeline.run(spark, at).collect()
    n = {i: len(texts[i].split()) for i in ids}
    assert check_bins(rows, n, packing.CAPACITY) == len({b for _, b, _ in brute_best_fit(n.values(), packing.CAPACITY)})


def test_stages_are_the_registered_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact dedup", "near dedup", "decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_queries_cover_their_whole_tables(spark, tables):
    at, texts, items = tables
    got = {name: q(spark, at).collect() for name, q in queries.QUERIES.items()}
    copies = defaultdict(list)
    for i, t in enumerate(texts):
        copies[" ".join(t.split())].append(i)
    assert {(r.doc_id, r.n_copies) for r in got["op1_exact_dedup"]} == {(min(x), len(x)) for x in copies.values()}
    assert sorted(r.doc_id for r in got["op2_simhash"]) == brute_groups(texts, list(range(len(texts)))) and sum(r.n_docs for r in got["op2_simhash"]) == len(texts)
    assert {r.doc_id for r in got["op3_quality"]} == {i for i in range(260) if i % 13}
    want = {(i, k) for i, t in enumerate(texts) for k, x in enumerate(items) if decontaminate.normalised(x) in decontaminate.normalised(t)}
    assert want <= {(r.doc_id, r.item_id) for r in got["op4_decontamination"]}
    assert len(got["op7_html"]) == 60 and len(got["op10_lm_score"]) == len(texts)
    assert Counter(r.n_tokens for r in got["op10_lm_score"])[1] == 0
    check_bins(got["op8_packing"], {i: len(t.split()) for i, t in enumerate(texts)}, packing.CAPACITY)
    # toxic or not has nothing to do with these texts: the best F1 takes most of them, each once
    toxic = [r.doc_id for r in got["op9_toxicity"]]
    assert len(toxic) == len(set(toxic)) and set(toxic) <= set(range(260)) and sum(i % 6 == 0 for i in toxic) > 0
    words = {i: len(t.split()) for i, t in enumerate(texts)}
    assert {r.doc_id for r in got["op10_lm_score"]} == set(words)
    assert {r.page_id: r.text for r in got["op7_html"]} and sum(" ".join(r.text.split()) == " ".join(texts[r.page_id].split()) for r in got["op7_html"]) >= 54
    assert got["op6_url_rules"] == []  # four hosts that the labels call bad alike
    # what carries no key and no key-like name has no finding
    assert got["op5_secrets"] == []


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, ties and clashing names go through all stages; empty tables too."""
    r = random.Random(33)
    long = prose(r, 9000)
    rows = [(1, "one two three"), (1, "one two three"), (2, "one  two three"), (3, None), (4, None), (None, "one two three"), (None, None), (5, ""), (6, ""), (7, long), (8, long), (9, "!!!"), (10, prose(r, 30))]
    clash = "content string, gone_id long, score double, slot int, n long, id long, hi long"
    docs = spark.createDataFrame([(i, t, None, None, None, *[None] * 7) for i, t in rows], f"{DOCS}, {clash}")
    at = str(tmp_path)
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (9, 0, 0), (None, None, None), (7, 1, None)], LABELS).write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "two")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    out = corpus_pipeline.run(spark, at).collect()
    # "two" is an item, whose rows go; of the copies the least id stays; null and empty texts have no tokens
    assert {x.doc_id for x in out} - {9} == {7, 10} and sum(x.n_tokens for x in out if x.doc_id == 7) == 9000
    check_bins(out, {i: sum(x.n_tokens for x in out if x.doc_id == i) for i in {x.doc_id for x in out}}, packing.CAPACITY)
    empty = f"{at}/empty"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{empty}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
