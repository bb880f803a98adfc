"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input joins an embedding of the word and the mean embedding of its
character trigrams. The network reads overlapping windows of words in both
directions, attention pools its states, and a document's score is that of its
worst window. Training and scoring are numpy; the network is fitted on a
bounded sample of labelled documents and scores every window of every text.
All labelled documents left out of the fit set the threshold, at the labels'
class mix.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import best_cut, checkpointed, fitted, small_batches, span_hashes, text_bytes, token_spans

WINDOW, STRIDE = 24, 12
WORDS, GRAMS = 1 << 14, 1 << 13
DIM, HIDDEN, ATTEND = 8, 8, 8
#: Labelled documents that are sampled for fitting, at most, half of them toxic if there are enough; it takes those that aren't held.
MAX_LABELLED = 3000
EPOCHS = 14
#: Windows of one training step.
STEP = 64
#: Log odds from which on a window's neighbourhood is scored word by word.
REFINE = -3.0
#: Windows that are scored at once.
CHUNK = 4096


class Words:
    """The distinct words of some texts, what the network reads of them, and the texts as numbers of words."""

    def __init__(self, texts: pa.Array):
        data, off = text_bytes(texts)
        starts, ends, self.at = token_spans(data, off)
        names, first, self.codes = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        self.bucket = (names % np.uint64(WORDS)).astype(np.int64)
        self.grams, self.gram_at = trigrams(data, starts[first], ends[first])

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First token, length and text of every window; a text's last window ends where it does."""
        n = np.diff(self.at)
        count = np.where(n > 0, np.maximum(-(-(n - WINDOW) // STRIDE), 0) + 1, 0)
        text = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        start = np.minimum(k * STRIDE, np.maximum(n[text] - WINDOW, 0))
        return self.at[:-1][text] + start, np.minimum(n[text], WINDOW), text


def trigrams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the byte trigrams of the words, with a space at either end, and where each word's begin."""
    n = ends - starts
    at = np.concatenate([[0], np.cumsum(n)])
    pos = np.arange(at[-1]) - np.repeat(at[:-1] - starts, n)
    mid = data[pos].astype(np.int64)
    before, after = np.empty_like(mid), np.empty_like(mid)
    before[1:], after[:-1] = mid[:-1], mid[1:]
    if len(mid):
        before[at[:-1]], after[at[1:] - 1] = 32, 32
    return ((before * 257 + mid) * 257 + after) * 2654435761 % (1 << 32) >> 19, at


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Columns of the gates: update, reset and new state, each forward then backward."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *shape, s=0.2: r.normal(0, s, shape).astype(np.float32)
        self.p = {
            "word": f(WORDS, DIM, s=0.1), "gram": f(GRAMS, DIM, s=0.1), "w": f(2 * DIM, 6 * HIDDEN, s=0.4), "b": np.zeros(6 * HIDDEN, np.float32),
            "uf": f(HIDDEN, 3 * HIDDEN), "ub": f(HIDDEN, 3 * HIDDEN), "a": f(2 * HIDDEN, ATTEND), "ab": np.zeros(ATTEND, np.float32), "v": f(ATTEND), "o": f(2 * HIDDEN), "ob": np.full(1, -1.0, np.float32),
        }

    def recurrent(self) -> np.ndarray:
        u = np.zeros((2 * HIDDEN, 6 * HIDDEN), np.float32)
        for gate in range(3):
            own = slice(gate * HIDDEN, (gate + 1) * HIDDEN)
            u[:HIDDEN, 2 * gate * HIDDEN : (2 * gate + 1) * HIDDEN] = self.p["uf"][:, own]
            u[HIDDEN:, (2 * gate + 1) * HIDDEN : (2 * gate + 2) * HIDDEN] = self.p["ub"][:, own]
        return u

    def inputs(self, words: Words) -> np.ndarray:
        """What the gates get from each distinct word."""
        p = self.p
        e = np.empty((len(words.bucket), 2 * DIM), np.float32)
        e[:, :DIM] = p["word"][words.bucket]
        if len(e):
            n = np.diff(words.gram_at)[:, None]
            e[:, DIM:] = np.add.reduceat(p["gram"][words.grams], words.gram_at[:-1], axis=0) / n
        return e

    def states(self, gates: np.ndarray, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
        """The states (step, window, forward and backward) of windows of one length; codes name their words."""
        steps, n = codes.shape[1], len(codes)
        back = np.zeros(6 * HIDDEN, bool)
        for gate in range(3):
            back[(2 * gate + 1) * HIDDEN : (2 * gate + 2) * HIDDEN] = True
        forward, backward = np.ascontiguousarray(gates[:, ~back]), np.ascontiguousarray(gates[:, back])
        u = self.recurrent()
        out = np.empty((steps, n, 2 * HIDDEN), np.float32)
        h = np.zeros((n, 2 * HIDDEN), np.float32)
        x = np.empty((n, 6 * HIDDEN), np.float32)
        k, w = HIDDEN, 2 * HIDDEN
        for t in range(steps):
            f, b = forward[codes[:, t]], backward[codes[:, steps - 1 - t]]
            for gate in range(3):
                x[:, gate * w : gate * w + k] = f[:, gate * k : gate * k + k]
                x[:, gate * w + k : gate * w + w] = b[:, gate * k : gate * k + k]
            a = h @ u
            zr = _sigmoid(x[:, : 2 * w] + a[:, : 2 * w])
            z, r = zr[:, :w], zr[:, w:]
            new = np.tanh(x[:, 2 * w :] + r * a[:, 2 * w :])
            if keep is not None:
                keep.append((h, z, r, new, a[:, 2 * w :]))
            h = new + z * (h - new)
            out[t, :, :k], out[steps - 1 - t, :, k:] = h[:, :k], h[:, k:]
        return out

    def pooled(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        p = self.p
        u = np.tanh(states @ p["a"] + p["ab"])
        s = np.exp(u @ p["v"])
        s /= s.sum(0)
        c = np.einsum("tn,tnk->nk", s, states)
        return u, s, c, c @ p["o"] + p["ob"][0]

    def score(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The log odds of every window, its text, and its first token's number in the text."""
        first, length, text = words.windows()
        gates = self.inputs(words) @ self.p["w"] + self.p["b"]
        out = np.empty(len(first), np.float32)
        for n in np.unique(length):
            own = np.flatnonzero(length == n)
            for k in range(0, len(own), CHUNK):
                some = own[k : k + CHUNK]
                out[some] = self.pooled(self.states(gates, words.codes[first[some, None] + np.arange(n)]))[3]
        return out, text, first - words.at[text]

    def worst(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The texts that have words, the log odds of each one's worst window, how many windows were scored, and the worst one's first token.

        Around windows of more than REFINE all positions are scored, so that
        a passage of a window's length or less is whole in one of them.
        """
        score, text, start = self.score(words)
        n = np.diff(words.at)
        some = np.flatnonzero((score > REFINE) & (n[text] > WINDOW))
        at = start[some, None] + np.arange(1 - STRIDE, STRIDE)
        at = np.clip(at, 0, (n[text[some]] - WINDOW)[:, None])
        both = np.unique(np.stack([np.repeat(text[some], at.shape[1]), at.ravel()], 1), axis=0)
        if len(both):
            gates = self.inputs(words) @ self.p["w"] + self.p["b"]
            first = words.at[both[:, 0]] + both[:, 1]
            more = np.concatenate([self.pooled(self.states(gates, words.codes[first[k : k + CHUNK, None] + np.arange(WINDOW)]))[3] for k in range(0, len(first), CHUNK)])
            score, text, start = np.append(score, more), np.append(text, both[:, 0]), np.append(start, both[:, 1])
        worst = _worst(score, text, len(n))
        own = np.flatnonzero(worst >= 0)
        return own, score[worst[own]], np.bincount(text, minlength=len(n))[own], start[worst[own]]

    def gradient(self, words: Words, first: np.ndarray, n: int, y: np.ndarray, weight: np.ndarray) -> dict:
        """The gradient of the weighted log loss on windows of n words."""
        p, k, w = self.p, HIDDEN, 2 * HIDDEN
        codes = words.codes[first[:, None] + np.arange(n)]
        used, local = np.unique(codes, return_inverse=True)
        local = local.reshape(codes.shape)
        sub = Words.__new__(Words)
        sub.bucket = words.bucket[used]
        sizes = np.diff(words.gram_at)[used]
        sub.gram_at = np.concatenate([[0], np.cumsum(sizes)])
        sub.grams = words.grams[np.arange(sub.gram_at[-1]) + np.repeat(words.gram_at[used] - sub.gram_at[:-1], sizes)]
        e = self.inputs(sub)
        gates = e @ p["w"] + p["b"]
        keep: list = []
        states = self.states(gates, local, keep)
        u, s, c, logit = self.pooled(states)
        d = ((_sigmoid(logit) - y) * weight).astype(np.float32)
        g = {"o": c.T @ d, "ob": d.sum(keepdims=True)}
        dc = d[:, None] * p["o"]
        ds = np.einsum("tnk,nk->tn", states, dc)
        ds = s * (ds - (s * ds).sum(0))
        du = ds[:, :, None] * p["v"] * (1 - u * u)
        g["v"] = np.einsum("tn,tna->a", ds, u)
        g["ab"], g["a"] = du.sum((0, 1)), np.einsum("tnk,tna->ka", states, du)
        dstates = s[:, :, None] * dc + du @ p["a"].T
        recurrent = self.recurrent()
        dgates = np.zeros_like(gates)
        dh = np.zeros_like(keep[0][0])
        drec = np.zeros_like(recurrent)
        for t in reversed(range(n)):
            h, z, r, new, m = keep[t]
            dh[:, :k] += dstates[t, :, :k]
            dh[:, k:] += dstates[n - 1 - t, :, k:]
            dn = dh * (1 - z) * (1 - new * new)
            dz = dh * (h - new) * z * (1 - z)
            dr = dn * m * r * (1 - r)
            da = np.concatenate([dz, dr, dn * r], 1)
            dx = np.concatenate([dz, dr, dn], 1)
            drec += h.T @ da
            dh = dh * z + da @ recurrent.T
            for gate in range(3):
                np.add.at(dgates[:, gate * w : gate * w + k], local[:, t], dx[:, gate * w : gate * w + k])
                np.add.at(dgates[:, gate * w + k : gate * w + w], local[:, n - 1 - t], dx[:, gate * w + k : gate * w + w])
        g["uf"] = np.concatenate([drec[:k, gate * w : gate * w + k] for gate in range(3)], 1)
        g["ub"] = np.concatenate([drec[k:, gate * w + k : gate * w + w] for gate in range(3)], 1)
        g["w"], g["b"] = e.T @ dgates, dgates.sum(0)
        de = dgates @ p["w"].T
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], sub.bucket, de[:, :DIM])
        np.add.at(g["gram"], sub.grams, np.repeat(de[:, DIM:] / sizes[:, None], sizes, axis=0))
        return g


class Adam:
    def __init__(self, p: dict, rate: float = 0.01):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}

    def step(self, g: dict) -> None:
        self.t += 1
        for k, x in self.p.items():
            self.m[k] += 0.1 * (g[k] - self.m[k])
            self.v[k] += 0.001 * (g[k] * g[k] - self.v[k])
            x -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def _suspects(words: Words, toxic: np.ndarray) -> np.ndarray:
    """For each distinct word, how much likelier its trigrams and itself are in toxic documents, by counts of documents."""
    text = np.repeat(np.arange(len(toxic)), np.diff(words.at))
    out = np.zeros(len(words.bucket))
    pairs = np.unique(text * len(words.bucket) + words.codes)
    doc, word = pairs // len(words.bucket), pairs % len(words.bucket)
    bad = np.bincount(words.bucket[word], toxic[doc], WORDS)
    good = np.bincount(words.bucket[word], 1 - toxic[doc], WORDS)
    rate = max(toxic.mean(), 1e-6)
    odds = np.log((bad + rate) / (good + 1 - rate) * (1 - rate) / rate)
    out += np.maximum(odds[words.bucket], 0)
    # a gram's documents: each document counts a gram once
    sizes = np.diff(words.gram_at)[word]
    at = words.gram_at[:-1][word]
    grams = words.grams[np.arange(sizes.sum()) + np.repeat(at - (np.cumsum(sizes) - sizes), sizes)]
    once = np.unique(np.repeat(doc, sizes) * GRAMS + grams)
    bad = np.bincount(once % GRAMS, toxic[once // GRAMS], GRAMS)
    good = np.bincount(once % GRAMS, 1 - toxic[once // GRAMS], GRAMS)
    odds = np.maximum(np.log((bad + rate) / (good + 1 - rate) * (1 - rate) / rate), 0)
    return out + np.maximum.reduceat(odds[words.grams], words.gram_at[:-1]) if len(out) else out


def _worst(score: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """The number of each text's window with the highest score, -1 if it has none."""
    out = np.full(n, -1)
    order = np.lexsort((score, text))
    out[text[order]] = order
    return out


def fit(texts: list[str], toxic: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> Network | None:
    """A network fitted on the texts, None without texts of both kinds; None's texts are empty.

    A toxic document teaches by its worst window: first the one with the most
    suspect words, then the network's own choice. A clean one teaches by its
    worst window and one at random.
    """
    net = Network(seed)
    words = Words(pa.array(texts, pa.string()))
    first, length, text = words.windows()
    y = np.asarray(toxic, float)
    if len(first) == 0 or len(set(y)) < 2:
        return None
    r = np.random.default_rng(seed)
    adam = Adam(net.p)
    suspect = np.concatenate([[0.0], np.cumsum(_suspects(words, y)[words.codes])])
    score = suspect[first + length] - suspect[first]
    balance = np.where(y > 0, (1 - y.mean()) / y.mean(), 1.0) ** 0.5
    for epoch in range(epochs):
        worst = _worst(score, text, len(y))
        chosen = [worst[worst >= 0]]
        clean = np.flatnonzero(y[text] == 0)
        if len(clean):
            chosen.append(r.choice(clean, min(len(clean), len(y))))
        some = r.permutation(np.concatenate(chosen))
        adam.rate = 0.01 * (1 - 0.7 * epoch / epochs)
        for n in np.unique(length[some]):
            own = some[length[some] == n]
            for k in range(0, len(own), STEP):
                b = own[k : k + STEP]
                adam.step(net.gradient(words, first[b], int(n), y[text[b]], balance[text[b]] / len(b) * min(1, len(b) / 16)))
        if epoch >= 3 and epoch + 1 < epochs:
            score = net.score(words)[0]
    return net


def best_f1(held: DataFrame) -> float:
    """The score with the best F1 over all rows (score, toxic, weight), in the middle of its gap; rows of one score go together."""
    rows = held.select("score", F.col("weight").alias("n"), (F.col("weight") * F.col("toxic")).alias("bad"))
    score, low = best_cut(rows, lambda n, bad, every, all_bad: 2 * bad / (n + all_bad))
    return (score + low) / 2 if low is not None else score - 1e-6


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, held) of the labelled documents; those that are held, a quarter by a hash, are never fitted on."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return known.withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 3)


def trained(docs: DataFrame, known: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[Network | None, list]:
    """fit on what isn't held of a sample of labelled documents, bounded by max_labelled; and the doc_ids that it was fitted on."""
    by = [F.xxhash64("doc_id"), F.col("doc_id")]
    bad = known.where("toxic = 1").orderBy(*by).limit(max_labelled // 2)
    good = known.where("toxic = 0").orderBy(*by).limit(max_labelled - max_labelled // 2)
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(bad.unionAll(good).where("not held")), "doc_id").toPandas()
    rows = rows.sort_values(["doc_id", "text"], ignore_index=True)
    order = np.random.default_rng(3).permutation(len(rows))
    texts, y = [*rows["text"].iloc[order]], rows["toxic"].to_numpy()[order]
    ids = rows["doc_id"].unique().tolist()
    if len(set(y.tolist())) < 2 or not len(Words(pa.array(texts, pa.string())).codes):
        return None, ids
    key = hashlib.sha256(repr((WINDOW, STRIDE, WORDS, GRAMS, DIM, HIDDEN, ATTEND, EPOCHS, STEP, y.tolist())).encode())
    for t in texts:
        key.update(f"{len(t)} {t}".encode())
    net = Network()
    net.p = fitted(docs.sparkSession, "toxicity", key.hexdigest(), lambda: fit(texts, y).p)
    return net, ids


def threshold(scored: DataFrame, known: DataFrame, fitted: list) -> float:
    """The score with the best F1 on all labelled documents that the network wasn't fitted on, weighted to the class mix of all labelled ones.

    If those aren't of both kinds, all labelled documents set it.
    """
    spark = scored.sparkSession
    ids = spark.createDataFrame([(x,) for x in fitted], scored.select("doc_id").schema).withColumn("fitted", F.lit(True))
    rows = scored.where("doc_id is not null").select("doc_id", "score").join(known.select("doc_id", "toxic"), "doc_id").join(F.broadcast(ids), "doc_id", "left")
    rows = checkpointed(rows.select("score", "toxic", F.coalesce("fitted", F.lit(False)).alias("fitted")))
    n = {(r.toxic, r.fitted): r["count"] for r in rows.groupBy("toxic", "fitted").count().collect()}
    every = [n.get((k, False), 0) + n.get((k, True), 0) for k in (0, 1)]
    out = [n.get((k, False), 0) for k in (0, 1)]
    if not all(every):
        return float("inf")
    if not all(out):
        return best_f1(rows.withColumn("weight", F.lit(1.0)))
    weight = F.when(F.col("toxic") == 1, every[1] / out[1]).otherwise(every[0] / out[0])
    return best_f1(rows.where("not fitted").withColumn("weight", weight))


def toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, n_windows, worst_word) of each document whose worst window reaches the threshold.

    score is the worst window's log odds; worst_word is the number of its
    first word in the text, n_windows how many were scored. Null texts and
    texts without words are never toxic; every window of a text is scored,
    however long it is; repeated rows are each reported, and rows of one score
    are toxic or not together. Contradicting labels count as toxic. Without
    labels of both kinds nothing is toxic. doc_ids are of any type, other
    columns are ignored, whatever their names.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, score double, n_windows bigint, worst_word bigint"
    known = checkpointed(known_labels(labels))
    net, fitted = trained(docs, known)
    if net is None:
        return docs.sparkSession.createDataFrame([], schema)
    shared = docs.sparkSession.sparkContext.broadcast(net.p)

    def over(batches):
        model = Network.__new__(Network)
        model.p = shared.value
        for batch in batches:
            for part in range(0, batch.num_rows, 1000):
                some = batch.slice(part, 1000)
                own, score, windows, start = model.worst(Words(some.column(1)))
                if len(own):
                    yield pa.record_batch([some.column(0).take(pa.array(own)), pa.array(score.astype(float)), pa.array(windows), pa.array(start)], ["doc_id", "score", "n_windows", "worst_word"])

    # every text is scored once; the scores are kept, as the threshold needs those of all labelled documents
    scored = checkpointed(small_batches(docs).where("text is not null").select("doc_id", "text").mapInArrow(over, schema))
    return scored.where(F.col("score") >= threshold(scored, known, fitted))
