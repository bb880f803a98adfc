"""Secret scans by a character convolutional network.

Every run of characters that keys are made of is a candidate if it mixes
letters and digits or is long, and so is whatever is given to a key-like name,
of any characters and length; the network reads the whole candidate and the
characters around it. It is trained in numpy on labelled findings: formats of
real secrets and of what looks like them, each in contexts of either kind. Its
outputs are calibrated on held-out findings, and the threshold is the highest
that keeps a required part of the held-out secrets.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import _LOWER, fitted, raw_bytes, small_batches

BODY, SIDE = 64, 32
WIDTH = BODY + 2 * SIDE
DIM, FILTERS, KERNEL, DENSE = 12, 32, 7, 24
#: Labelled findings that are generated for training.
FINDINGS = 8000
#: The part of the held-out secrets that the threshold must find.
RECALL = 0.995
EPOCHS = 10
MIN_CHARS = 8
CHUNK = 2048

_KEY = np.zeros(256, bool)
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-.~":
    _KEY[_c] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True


def candidates(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the candidates begin and end: runs of MIN_CHARS key characters or more with a digit and a letter, or 20 or more with both cases inside or digits only."""
    key = _KEY[data]
    first, last = key.copy(), key.copy()
    first[1:] &= ~key[:-1]
    last[:-1] &= ~key[1:]
    edge = off[(off > 0) & (off < len(data))]
    first[edge] = key[edge]
    last[edge - 1] = key[edge - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = b - a >= MIN_CHARS
    a, b = a[long], b[long]
    if not len(a):
        return a, b

    def inside(mask: np.ndarray, begin: np.ndarray) -> np.ndarray:
        hits = np.flatnonzero(mask[data])
        return np.searchsorted(hits, b) - np.searchsorted(hits, begin)

    digits, letters, inner = inside(_DIGIT, a), inside(_LETTER, a), inside(_UPPER, a + 1)
    size = b - a
    some = (digits > 0) & (letters > 0) | (size >= 20) & ((inner > 0) & (inner < letters) | (digits >= 16))
    return a[some], b[some]


#: What a key's name ends in, and how a value is given to it.
_VALUE = re.compile(
    rb"""(?i:token|secret|passw(?:or)?d|passphrase|passcode|pass|pwd|pin|credentials?|bearer|auth|(?:api|access|private|secret|auth|encryption|signing)[ _-]?key|key)(?:[_-]\w{1,16}|s)?["']?"""
    rb"""(?:[ \t]*(?::=|=>|=|:)[ \t]*|[ \t]+(?:is[ \t]+)?(?=["']))(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"'][^\s]*))"""
    rb"""|(?i:bearer)[ \t]+([^\s"']+)"""
)
#: How every key-like name begins.
_BEGINS = np.zeros(1 << 24, bool)
_FIRST = np.zeros(256, bool)
for _c in (b"tok", b"sec", b"pas", b"pwd", b"pin", b"cre", b"bea", b"aut", b"api", b"acc", b"pri", b"enc", b"sig", b"key"):
    _BEGINS[int.from_bytes(_c, "little")] = True
    _FIRST[[_c[0], _c[0] - 32]] = True
_LONG = _KEY & ~_DIGIT


def runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of a mask over the texts' bytes begin and end."""
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    edge = off[(off > 0) & (off < len(mask))]
    first[edge] = mask[edge]
    last[edge - 1] = mask[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def named_values(data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Begin and end of each value that is given to a key-like name, and of both together."""
    some = np.flatnonzero(_FIRST[data[:-2]]) if len(data) > 2 else np.zeros(0, np.int64)
    low = _LOWER[data]
    some = some[_BEGINS[low[some] | low[some + 1].astype(np.int64) << 8 | low[some + 2].astype(np.int64) << 16]]
    out, doc = [], np.searchsorted(off, some, "right") - 1
    cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else []
    for i, j in zip(cuts, [*cuts[1:], len(doc)]):
        o = int(off[doc[i]])
        text, end = data[o : off[doc[i] + 1]].tobytes(), 0
        for at in (some[i:j] - o).tolist():
            if at >= end and (m := _VALUE.match(text, at)):
                end = m.end()
                x, y = m.span(m.lastindex)
                if m.lastindex >= 3:
                    y = x + len(text[x:y].rstrip(b"\"',;)]}>")) or y
                out.append((o + x, o + y, o + at, o + end))
    return out


def proposals(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The candidates, runs of 20 or more key characters without digits, and every value given to a key-like name, whatever its characters and length.

    A quoted value is whole with its spaces. A value takes the place of a
    run that is hardly more than its name and itself.
    """
    a, b = candidates(data, off)
    x, y = runs(_LONG[data], off)
    long = y - x >= 20
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    long &= letters[y] > letters[x]
    spans = {*zip(a.tolist(), b.tolist()), *zip(x[long].tolist(), y[long].tolist())}
    found = named_values(data, off)
    values, named = [f[:2] for f in found], [f[2:] for f in found]
    out: list[tuple[int, int]] = []
    for x, y in sorted(spans):
        if out and x < out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], y)
        else:
            out.append((x, y))
    ends = np.array([y for _, y in named], np.int64)
    rest = []
    for x, y in out:
        k = int(np.searchsorted(ends, x, "right"))
        # a run that is a named value and little else is that value; one that holds more stays beside it
        if k == len(ends) or values[k][0] >= y or x < named[k][0] - MIN_CHARS or y > ends[k]:
            rest.append((x, y))
    out = sorted({*rest, *values})
    a, b = (np.array([s[k] for s in out], np.int64) for k in (0, 1))
    return a, b


def keys(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of these spans are candidates by themselves."""
    sums = lambda mask: np.concatenate([[0], np.cumsum(mask[data])])
    key, digit, letter, upper = map(sums, (_KEY, _DIGIT, _LETTER, _UPPER))
    size, digits, letters = b - a, digit[b] - digit[a], letter[b] - letter[a]
    inner = upper[b] - upper[np.minimum(a + 1, b)]
    some = (digits > 0) & (letters > 0) | (size >= 20) & ((inner > 0) & (inner < letters) | (digits >= 16))
    return some & (size >= MIN_CHARS) & (key[b] - key[a] == size)


def frames(data: np.ndarray, off: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frames of WIDTH characters that cover the candidates, which of their characters belong to them, and each frame's candidate.

    A frame has BODY characters of the candidate with SIDE before and after;
    a longer candidate has overlapping frames. Outside the text is 0.
    """
    count = np.maximum(0, -(-(b - a - BODY) // (BODY // 2))) + 1
    of = np.repeat(np.arange(len(a)), count)
    k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(a[of] + k * (BODY // 2), np.maximum(b[of] - BODY, a[of])) - SIDE
    at = start[:, None] + np.arange(WIDTH)
    doc = np.searchsorted(off, a[of], "right") - 1
    # nothing after the body's end is missing: context follows a short candidate at once
    within = (at >= off[doc][:, None]) & (at < off[doc + 1][:, None])
    out = np.where(within, data[np.clip(at, 0, max(len(data) - 1, 0))], 0)
    mine = (at >= a[of][:, None]) & (at < b[of][:, None])
    return out, mine, of


class Network:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        f = lambda *shape, s: r.normal(0, s, shape).astype(np.float32)
        self.p = {"e": f(256, DIM, s=0.3), "m": f(DIM, s=0.3), "k": f(KERNEL * DIM, FILTERS, s=0.15), "kb": np.zeros(FILTERS, np.float32), "d": f(3 * FILTERS, DENSE, s=0.15), "db": np.zeros(DENSE, np.float32), "o": f(DENSE, s=0.3), "ob": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, mine: np.ndarray):
        p = self.p
        e = p["e"][x] + mine[:, :, None] * p["m"]
        n = len(x)
        columns = np.lib.stride_tricks.sliding_window_view(e, KERNEL, axis=1).transpose(0, 1, 3, 2).reshape(n, WIDTH - KERNEL + 1, KERNEL * DIM)
        c = np.maximum(columns @ p["k"] + p["kb"], 0)
        half = KERNEL // 2
        inside = mine[:, half : half + c.shape[1]]
        body = np.where(inside[:, :, None], c, -1)
        side = np.where(inside[:, :, None], -1, c)
        arg = body.argmax(1), side.argmax(1)
        top = [np.maximum(np.take_along_axis(c, k[:, None], 1)[:, 0], 0) for k in arg]
        mean = (c * inside[:, :, None]).sum(1) / np.maximum(inside.sum(1), 1)[:, None]
        pool = np.concatenate([*top, mean], 1)
        hidden = np.maximum(pool @ p["d"] + p["db"], 0)
        return hidden @ p["o"] + p["ob"][0], (e, columns, c, inside, arg, pool, hidden)

    def gradient(self, x: np.ndarray, mine: np.ndarray, y: np.ndarray) -> dict:
        p = self.p
        logit, (e, columns, c, inside, arg, pool, hidden) = self.forward(x, mine)
        d = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(np.float32)
        g = {"o": hidden.T @ d, "ob": d.sum(keepdims=True)}
        dh = d[:, None] * p["o"] * (hidden > 0)
        g["d"], g["db"] = pool.T @ dh, dh.sum(0)
        dp = dh @ p["d"].T
        dc = inside[:, :, None] * (dp[:, 2 * FILTERS :] / np.maximum(inside.sum(1), 1)[:, None])[:, None]
        rows = np.arange(len(x))[:, None]
        for k in range(2):
            np.add.at(dc, (rows, arg[k], np.arange(FILTERS)[None]), dp[:, k * FILTERS : (k + 1) * FILTERS])
        dc *= c > 0
        g["kb"] = dc.sum((0, 1))
        g["k"] = columns.reshape(-1, KERNEL * DIM).T @ dc.reshape(-1, FILTERS)
        dcol = (dc @ p["k"].T).reshape(len(x), -1, KERNEL, DIM)
        de = np.zeros_like(e)
        for k in range(KERNEL):
            de[:, k : k + dcol.shape[1]] += dcol[:, :, k]
        g["m"] = (de * mine[:, :, None]).sum((0, 1))
        g["e"] = np.zeros_like(p["e"])
        np.add.at(g["e"], x, de)
        return g

    def logits(self, data: np.ndarray, off: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The highest log odds of each candidate's frames."""
        out = np.full(len(a), -np.inf)
        for k in range(0, len(a), CHUNK):
            x, mine, of = frames(data, off, a[k : k + CHUNK], b[k : k + CHUNK])
            for j in range(0, len(x), CHUNK):
                np.maximum.at(out, k + of[j : j + CHUNK], self.forward(x[j : j + CHUNK], mine[j : j + CHUNK])[0])
        return out


_NAMES = "token secret password passwd api_key apikey access_key auth_token client_secret private_key credentials bearer pwd".split()
_PLAIN = "commit sha revision checksum md5 etag id uuid order invoice file image version build page ref session_count sku isbn host url mail phone at to see from".split()
_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_SYLLABLES = "the and ing tion er re on an en ed es or ti at is st le la de des que ou ment aux los ciones un el con ich ein der und ung heit che sch lich ra do na mi to é è ê ç ión ñ í ó ä ö ü ß zu ge".split()


_FILLERS = "required none null true false optional missing invalid expired here below yes no changed reset field value name unknown string default os.environ config.get".split()


def _labelled(text: str, left: str, body: str, y: int) -> list[tuple[str, int, int, int]]:
    data = np.frombuffer(text.encode(), np.uint8)
    a, b = proposals(data, np.array([0, len(data)]))
    at = len(left.encode())
    own = np.flatnonzero((a <= at) & (b >= at + len(body.encode()))) if y else np.flatnonzero((a <= at) & (b > at))
    if len(own):
        return [(text, int(a[own[-1]]), int(b[own[-1]]), y)]
    return [(text, at, at, y)] if y else []


def findings(n: int, seed: int = 11, named: bool = False) -> list[tuple[str, int, int, int]]:
    """n labelled findings, of known formats or of named values of any characters: a text, where its candidate begins and ends, and whether it is a secret. A secret that no candidate covers has an empty one."""
    r = np.random.default_rng(seed)
    pick = lambda of: of[r.integers(len(of))]
    some = lambda of, k: "".join(of[j] for j in r.integers(0, len(of), k))
    hexa = lambda k: some("0123456789abcdef", k)
    word = lambda: some(_SYLLABLES, int(r.integers(1, 5)))

    def prose(k: int) -> str:
        return " ".join(w.capitalize() if r.random() < 0.1 else w for w in (word() for _ in range(k)))

    def secret() -> str:
        return pick([
            lambda: hexa(int(pick([32, 40, 40, 64]))), lambda: "AKIA" + some(_ALNUM[:26] + _ALNUM[52:], 16), lambda: "ghp_" + some(_ALNUM, 36), lambda: "sk_live_" + some(_ALNUM, 24),
            lambda: "xoxb-" + some("0123456789", 11) + "-" + some(_ALNUM, 24), lambda: "eyJ" + some(_ALNUM, 33) + "." + some(_ALNUM + "_-", 60) + "." + some(_ALNUM + "_-", 43), lambda: some(_ALNUM + "+/", 40), lambda: "AIza" + some(_ALNUM + "_-", 35), lambda: some(_ALNUM, int(r.integers(12, 33))) + pick(["1", "7x", "9Q"]),
        ])()

    def other() -> str:
        return pick([
            lambda: word() + "." + some("0123456789", 2), lambda: "mail" + some("0123456789", 1) + ".example.com", lambda: "-".join(hexa(k) for k in (8, 4, 4, 4, 12)), lambda: word() + "-" + some("0123456789", 4) + ".html", lambda: "v" + ".".join(some("0123456789", 1) for _ in range(3)) + "-" + word(),
            lambda: "20" + some("0123456789", 2) + "-0" + some("123456789", 1) + "-1" + some("0123456789", 1) + "T10.30Z", lambda: word() + word() + some("0123456789", 3), lambda: "/".join([word(), word(), some("0123456789", 4)]), lambda: hexa(int(pick([32, 40, 64]))), lambda: some("0123456789", 20),
            lambda: word().capitalize() + word().capitalize() + word().capitalize() + "Handler" + word(), lambda: "+" + some("0123456789", 2) + "-" + some("0123456789", 9) + "x" + some("0123456789", 2), lambda: word().upper() + "_" + word().upper() + "_" + some("0123456789", 2),
        ])()

    def password() -> str:
        """Secrets of any characters and length, told by their name."""
        symbol = lambda: some("!@#$%^&*?", 1)
        return pick([
            lambda: word().capitalize() + symbol() + some(_ALNUM, int(r.integers(2, 8))) + symbol() + some("0123456789", int(r.integers(1, 5))), lambda: some(_ALNUM + "!@#$%^&*?", int(r.integers(5, 20))), lambda: some(_ALNUM[26:], int(r.integers(3, 6))) + some("0123456789", int(r.integers(1, 3))),
            lambda: some(_ALNUM[26:52], int(r.integers(12, 40))), lambda: some(_ALNUM[:52], int(r.integers(12, 40))), lambda: "-".join(word() for _ in range(int(r.integers(3, 6)))), lambda: "P@ssw0rd" + symbol() + some("0123456789", 4),
        ])()

    def filler() -> str:
        """What stands after a key-like name and is no secret."""
        return pick([lambda: pick(_FILLERS), lambda: "${" + word().upper() + "}", lambda: "<" + word() + ">", lambda: "*" * int(r.integers(3, 12))])()

    def lengthy() -> str:
        """Long letter-only runs that are no secrets."""
        return pick([lambda: "/".join(word() for _ in range(6)), lambda: "_".join(word() for _ in range(6)), lambda: "-".join(word() for _ in range(6)), lambda: some(_SYLLABLES, 11), lambda: pick("-=._~") * 20 + word(), lambda: "www." + word() + word() + word() + word() + ".example.com/" + word()])()

    out = []
    while len(out) < n:
        y = int(r.random() < 0.5)
        if named:
            own = y or r.random() < 0.6
            body = password() if y else filler() if own else lengthy()
            name = pick(_NAMES) if own else pick(_PLAIN)
            quote = pick(['"', '"', "'", ""])
            sign = pick([" = ", ": ", " := ", '": ', "="]) if own else pick([" ", ": ", " ("])
            name = name.upper() if r.random() < 0.15 else name
            left = prose(int(r.integers(0, 8))) + pick([" ", "\n", " | ", "### "]) + name + sign + quote
            text = left + body + quote + pick(["", " ", "\n", "; " if quote else " "]) + prose(int(r.integers(0, 8)))
            out += _labelled(text, left, body, y)
            continue
        body = secret() if y else other()
        bare = all(c in "0123456789abcdef-" for c in body)
        if y:
            name = pick(_NAMES) if r.random() < 0.9 or bare else word()
            sign, quote = pick([" = ", "=", ": ", " := ", '": ', " "]) if not bare else pick([" = ", "=", ": ", '": ']), pick(['"', '"', "'", ""])
            if bare and sign == " ":
                sign = "="
        else:
            name = pick(_PLAIN) if bare or r.random() < 0.5 else word()
            sign, quote = pick([" ", " ", ": ", " = ", " ("]), pick(["", "", "", '"'])
        if sign == "=" and not quote:
            quote = '"'  # the sign is a key character
        name = name.upper() if r.random() < 0.15 else name
        body = body.upper() if r.random() < 0.08 else body
        left = prose(int(r.integers(0, 8))) + pick([" ", "\n", " | ", "### "]) + name + sign + quote
        right = quote + pick(["", " ", "\n", ".### ", "!! ", " | ", "; ", ", "]) + prose(int(r.integers(0, 8)))
        text = left + body + right
        out += _labelled(text, left, body, y)
    return out


def _packed(rows: list[tuple[str, int, int, int]]):
    raw = [t.encode() for t, *_ in rows]
    off = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    a, b, y = (np.array([row[k] for row in rows]) for k in (1, 2, 3))
    return data, off, a + off[:-1], b + off[:-1], y


class Scanner:
    """A trained network, its calibration (slope, offset), and the least probability of a finding."""

    def __init__(self, rows: list[tuple[str, int, int, int]], recall: float = RECALL, epochs: int = EPOCHS, seed: int = 5):
        self.net = Network(seed)
        cut = len(rows) * 3 // 4
        data, off, a, b, y = _packed([row for row in rows[:cut] if row[2] > row[1]])
        x, mine, of = frames(data, off, a, b)
        r = np.random.default_rng(seed)
        p = self.net.p
        m, v, t = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for k in range(0, len(order), 64):
                some = order[k : k + 64]
                t += 1
                for name, g in self.net.gradient(x[some], mine[some], y[of[some]]).items():
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.999 * v[name] + 0.001 * g * g
                    p[name] -= 0.003 * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)
        found = [row for row in rows[cut:] if row[2] > row[1]]
        missed = len(rows) - cut - len(found)
        data, off, a, b, y = _packed(found)
        logit = self.net.logits(data, off, a, b)
        self.slope, self.offset = platt(logit, y)
        sure = self.probability(logit)
        # a secret without a candidate is a miss; if they alone are too many, every other one must be found
        every = np.quantile(np.concatenate([np.zeros(missed), sure[y == 1]]), 1 - recall, method="lower")
        self.least = float(every or sure[y == 1].min())

    @classmethod
    def of(cls, told: dict[str, np.ndarray]) -> "Scanner":
        """The scanner that these arrays tell."""
        own = cls.__new__(cls)
        own.net = Network.__new__(Network)
        own.net.p = {k: x for k, x in told.items() if k != "cut"}
        own.slope, own.offset, own.least = told["cut"].tolist()
        return own

    def told(self) -> dict[str, np.ndarray]:
        return self.net.p | {"cut": np.array([self.slope, self.offset, self.least])}

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * np.clip(logit, -60, 60) + self.offset)))


def platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset with which the log odds fit the labels, by Newton steps on smoothed labels."""
    z = np.c_[np.clip(logit, -60, 60), np.ones(len(logit))]
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    w = np.array([0.5, 0.0])
    for _ in range(30):
        q = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + 1e-6 * np.eye(2), z.T @ (target - q) - 1e-6 * w)
        w = w + np.clip(step, -1, 1)
    return float(max(w[0], 1e-3)), float(w[1])


def trained(spark: SparkSession, n_findings: int, named: bool, recall: float) -> dict[str, np.ndarray]:
    """A scanner of generated findings; what was trained once with the same settings is read."""
    key = repr((n_findings, named, recall, EPOCHS, BODY, SIDE, DIM, FILTERS, KERNEL, DENSE, MIN_CHARS, findings(50, named=named)))
    return fitted(spark, "secrets", key, lambda: Scanner(findings(n_findings, named=named), recall).told())


def scan(docs: DataFrame, n_findings: int = FINDINGS, recall: float = RECALL) -> DataFrame:
    """(doc_id, begin, n_chars, digest, probability) of each candidate that the network takes for a secret.

    begin counts characters; digest is the candidate's SHA-256, so that the
    report doesn't repeat the secret. Null and empty texts have no findings,
    texts are read whole, however long, repeated rows and candidates are each
    reported, and what reaches the threshold exactly is a finding. doc_ids are
    of any type, other columns are ignored, whatever their names.
    """
    # keys of known formats and other named values are told by different signs and have a network and a threshold each
    told = [trained(docs.sparkSession, n_findings, named, recall) for named in (False, True)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(told)

    def over(batches):
        both = [Scanner.of(x) for x in shared.value]
        for whole in batches:
            for part in range(0, whole.num_rows, 1000):
                batch = whole.slice(part, 1000)
                data, off = raw_bytes(batch.column(1))
                a, b = proposals(data, off)
                sure, found, key = np.zeros(len(a)), np.zeros(len(a), bool), keys(data, a, b)
                for own, some in zip(both, (np.flatnonzero(key), np.flatnonzero(~key))):
                    if len(some):
                        sure[some] = own.probability(own.net.logits(data, off, a[some], b[some]))
                        found[some] = sure[some] >= own.least
                hit = np.flatnonzero(found)
                if len(hit):
                    doc = np.searchsorted(off, a[hit], "right") - 1
                    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    begin, size = chars[a[hit]] - chars[off[doc]], chars[b[hit]] - chars[a[hit]]
                    digest = [hashlib.sha256(data[x:y].tobytes()).hexdigest() for x, y in zip(a[hit], b[hit])]
                    yield pa.record_batch([batch.column(0).take(pa.array(doc)), pa.array(begin, pa.int64()), pa.array(size, pa.int64()), pa.array(digest), pa.array(sure[hit])], ["doc_id", "begin", "n_chars", "digest", "probability"])

    return small_batches(docs).where("text is not null").select("doc_id", "text").mapInArrow(over, f"doc_id {kind}, begin bigint, n_chars bigint, digest string, probability double")
