"""Quality classifier with hierarchical empirical Bayes.

A logistic classifier over layout statistics gives each document's own
evidence. Grouped aggregation over all documents gives each host and each path
level of it a posterior rate of good documents; sparse sites shrink toward
their host, sparse hosts toward the global rate. A document's odds combine its
evidence with the odds of its site.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, best_cut, checkpointed, hashed_tokens, in_batches, small_batches, text_bytes, without_ids

#: Labelled documents that the classifier is fitted on, about at most; everything else sees all documents.
MAX_LABELLED = 50_000
#: The part of the good labelled documents that the threshold must keep.
KEEP_RECALL = 0.995
N_FEATURES = 12
#: Texts that are measured at once, which bounds a worker's memory.
SLICE = 500

_CLASS = np.zeros((256, 7), bool)
_CLASS[:, 0] = [48 <= b <= 57 for b in range(256)]
_CLASS[:, 1] = [chr(b) in " \t\r\n\f\v" for b in range(256)]
_CLASS[:, 2] = [b == 124 for b in range(256)]
_CLASS[:, 3] = [chr(b) in "#$%&*~^=<>{}[]\\@" for b in range(256)]
_CLASS[:, 4] = [chr(b) in "!?" for b in range(256)]
_CLASS[:, 5] = [chr(b) in ".,;:'\"()-" for b in range(256)]
_CLASS[:, 6] = [b == 10 for b in range(256)]


def layout(texts: pa.Array) -> np.ndarray:
    """A row of N_FEATURES numbers for each text: shares of kinds of characters, repetition, lengths."""
    data, off = text_bytes(texts)
    size = np.diff(off).astype(np.float64)
    raw = np.frombuffer(texts.fill_null("").buffers()[2] or b"", np.uint8)
    n = len(texts)
    out = np.zeros((n, N_FEATURES))

    def per_text(hits: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(hits, dtype=np.int64)])
        return np.diff(sums[off])

    for k in range(7):
        out[:, k] = per_text(_CLASS[:, k][data]) / np.maximum(size, 1)
    if len(data):
        base = int(np.frombuffer(texts.fill_null("").buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset])
        shown = raw[base : base + len(data)]
        out[:, 7] = per_text((shown >= 65) & (shown <= 90)) / np.maximum(size, 1)
    tokens, at = hashed_tokens(texts)
    count = np.diff(at)
    again = np.zeros(len(tokens), np.int64)
    if len(tokens) > 1:
        again[1:] = tokens[1:] == tokens[:-1]
        inner = at[(at > 0) & (at < len(tokens))]
        again[inner] = 0
    out[:, 8] = np.diff(np.concatenate([[0], np.cumsum(again)])[at]) / np.maximum(count, 1)
    out[:, 9] = np.log1p(size)
    out[:, 10] = np.log1p(size / np.maximum(count, 1))
    out[:, 11] = [len(np.unique(tokens[a:b])) / (b - a) if b > a else 0 for a, b in zip(at[:-1], at[1:])]
    return out


class Logistic:
    """L2-regularised logistic regression on standardised features and their squares, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 12):
        self.mean = x.mean(0) if len(x) else np.zeros(N_FEATURES)
        self.std = (x.std(0) if len(x) else np.ones(N_FEATURES)) + 1e-6
        z = self.design(x)
        self.w = np.zeros(2 * N_FEATURES + 1)
        if len(set(y)) < 2:  # nothing to tell apart: the prior alone
            self.w[0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1)) if len(y) else 0.0
            return
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            grad = z.T @ (y - p) - l2 * np.r_[0, self.w[1:]]
            hess = (z * (p * (1 - p))[:, None]).T @ z + l2 * np.eye(z.shape[1])
            self.w += np.linalg.solve(hess, grad)

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -8, 8)
        return np.c_[np.ones(len(z)), z, z * z - 1] if len(z) else np.zeros((0, 2 * N_FEATURES + 1))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.design(x) @ self.w, -30, 30)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, host, path and the layout of every document with a doc_id and a text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = F.coalesce(F.col("source"), F.lit(""))
    host = F.regexp_extract(F.regexp_replace(source, r"^[A-Za-z]+://", ""), r"^[^/]*", 0)
    rest = F.regexp_extract(source, r"^(?:[A-Za-z]+://)?[^/]*/([^/?#]+)", 1)
    path = F.when(rest != "", rest).otherwise(F.coalesce(F.col("lang"), F.lit("")))
    cols = docs.where("doc_id is not null and text is not null").select("doc_id", host.alias("host"), path.alias("path"), "text")

    def over(batch):
        x = np.concatenate([layout(batch.column(3).slice(k, SLICE)) for k in range(0, batch.num_rows, SLICE)])
        flat = pa.array(x.ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES), flat)
        return pa.record_batch([batch.column(0), batch.column(1), batch.column(2), lists], ["doc_id", "host", "path", "x"])

    return cols.mapInArrow(in_batches(over), f"doc_id {kind}, host string, path string, x array<double>")


def beta_strength(rates: DataFrame, n: str, good: str) -> float:
    """By the method of moments, the number of observations that a group's prior is worth: the ratio of the spread within groups to that between them."""
    r = rates.agg(
        F.sum(good).alias("g"), F.sum(n).alias("n"), F.count("*").alias("k"), F.sum(F.col(n) * F.col(n)).alias("nn"), F.sum(F.col(good) * F.col(good) / F.col(n)).alias("ss")
    ).first()
    if not r.k or r.k < 2 or not r.n:
        return 10.0
    mean = r.g / r.n
    within = max(mean * (1 - mean), 1e-9)
    between = (r.ss - r.n * mean * mean - (r.k - 1) * within) / max(r.n - r.nn / r.n, 1e-9)
    return float(np.clip(within / max(between, 1e-9), 1.0, 10_000.0))


def scored(docs: DataFrame, labels: DataFrame, recall: float = KEEP_RECALL, max_labelled: int = MAX_LABELLED) -> tuple[DataFrame, float]:
    """Every document's doc_id, evidence, host_rate, path_rate and score (log odds of good), and the threshold.

    The host is that of source, and the path its first level; a source without
    a path has its documents' language for one. A document's own evidence is
    left out of the rates of its host and path. Documents without a doc_id or
    text aren't scored. Of several rows with one doc_id each is scored. Null
    sources and languages are sites named "". Empty texts are measured like
    any other, very long ones whole; documents with one score are accepted or
    rejected together. Labels other than 0 and 1 are ignored; of contradicting
    labels the smaller counts. Other columns are ignored, whatever their
    names. Without labels of both kinds no document is told from another and
    the threshold keeps all. All labelled documents that the classifier wasn't
    fitted on set the threshold, or all if those are of one kind.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = checkpointed(measured(small_batches(docs)))
    taught = rows.join(known, "doc_id").select("doc_id", "x", "quality")
    n = taught.count()
    sampled = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, max_labelled / max(n, 1)) * (1 << 30))
    fit = sampled & (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) < 3)
    some = taught.where(fit).toPandas().sort_values("doc_id", ignore_index=True)
    x = np.array([*some["x"]]).reshape(len(some), N_FEATURES)
    model = Logistic(x, some["quality"].to_numpy(float) if len(some) else np.zeros(0))

    def evidence(batch):
        flat = batch.column(3).flatten().to_numpy(zero_copy_only=False)
        z = model.logit(flat.reshape(-1, N_FEATURES))
        return pa.record_batch([*batch.columns[:3], pa.array(z)], ["doc_id", "host", "path", "evidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    told = rows.mapInArrow(in_batches(evidence), f"doc_id {kind}, host string, path string, evidence double")
    p = 1 / (1 + F.exp(-F.col("evidence")))
    paths = checkpointed(told.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum(p).alias("good")))
    hosts = checkpointed(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good")))
    total = hosts.agg(F.sum("host_good").alias("good"), F.sum("host_n").alias("n")).first()
    rate = (total.good + 1) / (total.n + 2) if total.n else 0.5
    kh, kp = beta_strength(hosts, "host_n", "host_good"), beta_strength(paths, "n", "good")
    sites = paths.join(hosts, "host")
    if sites.count() * 128 <= BROADCAST_BYTES:
        sites = F.broadcast(sites)
    out = told.join(sites, ["host", "path"]).withColumn("host_rate", (F.col("host_good") - p + kh * rate) / (F.col("host_n") - 1 + kh))
    out = out.withColumn("path_rate", (F.col("good") - p + kp * F.col("host_rate")) / (F.col("n") - 1 + kp))
    odds = F.log(F.col("path_rate") / (1 - F.col("path_rate"))) - float(np.log(rate / (1 - rate)))
    out = out.select("doc_id", "evidence", "host_rate", "path_rate", (F.col("evidence") + odds).alias("score"))
    back = checkpointed(out.join(known, "doc_id").select("score", F.lit(1).alias("n"), (1 - F.col("quality")).alias("bad"), fit.alias("fit")))
    kinds = {(r.bad, r.fit) for r in back.select("bad", "fit").distinct().collect()}
    if {b for b, _ in kinds} != {0, 1}:
        return out, float("-inf")
    held = back if {b for b, f in kinds if not f} != {0, 1} else back.where("not fit")
    return out, threshold(held.select("score", "n", "bad"), recall)


def threshold(held: DataFrame, recall: float) -> float:
    """The cut with the fewest errors among those that keep this part of the good of rows (score, n, bad), the lowest of equals; in the middle of its gap."""

    def worth(n, bad, every, all_bad):
        lost = every - all_bad - (n - bad)
        return np.where(lost <= (1 - recall) * (every - all_bad), -(lost + bad), -np.inf)

    score, low = best_cut(held, worth)
    return float("-inf") if low is None else (score + low) / 2


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts: doc_id, evidence, host_rate, path_rate, score."""
    rows, cut = scored(docs, labels)
    return rows.where(F.col("score") >= cut)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs less those that the classifier rejects; what can't be scored (null doc_id or text) stays.

    Rows that share a doc_id go together: they stay if any of them is accepted.
    Columns pass through whatever their names.
    """
    rows, cut = scored(docs, labels)
    gone = rows.groupBy("doc_id").agg(F.max("score").alias("score")).where(F.col("score") < cut).select("doc_id")
    return without_ids(docs, checkpointed(gone))
