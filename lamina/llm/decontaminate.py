"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of k edits is split into k + 1 pieces; any passage
within k edits of it holds one piece unchanged. All pieces are looked for in
one scan of the documents: their beginnings and ends are keys of a sorted
table in the shared folder, against which a worker holds every window of its
texts at once. Myers' bit-parallel edit distance verifies the text around each
hit. Items are indexed in groups of bounded size, all of which a worker maps
into memory, so nothing is broadcast or collected.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, raw_bytes, saved, scratch, small_batches, without_ids

#: Edits allowed for each character of an item.
ERROR_RATE = 0.06
#: Characters of the items in one group of the index, about.
GROUP_CHARS = 64 << 20
#: Texts that are searched at once, which bounds a worker's memory.
SLICE = 500

_KNOWN = 0x20000
_LOWER = np.array([ord(chr(c).lower()[0]) for c in range(_KNOWN)], np.uint32)
_ALNUM = np.array([chr(c).isalnum() for c in _LOWER.tolist()])
_P = np.uint64(0x9E3779B97F4A7C15)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' characters in lower case, every run of other than letters and digits one space, and one before and after each text; and where each text begins."""
    data, off = raw_bytes(texts)
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]
    low = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    if len(low) and low.max() >= _KNOWN:
        far = low >= _KNOWN
        low = np.where(far, low, _LOWER[np.where(far, 0, low)])
        word = np.where(far, low < 0x40000, _ALNUM[np.where(far, 0, low)])
    else:
        low = _LOWER[low]
        word = _ALNUM[low]
    start = word.copy()
    start[1:] &= ~word[:-1]
    edge = first[:-1][(first[:-1] > 0) & (first[:-1] < len(word))]
    start[edge] = word[edge]
    # a text has its words' characters, a space before each word, and one at its end
    before = np.concatenate([[0], np.cumsum(word + start.astype(np.int64))])
    at = before[first] + np.arange(len(first))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.full(at[-1], 32, np.uint32)
    out[before[1:][word] - 1 + text[word]] = low[word]
    return out, at


def _string(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le")


def normalised(text: str) -> str:
    """Lower case, every run of other than letters and digits one space, none at the ends."""
    return _string(words(pa.array([text], pa.string()))[0]).strip(" ")


def budget(item: str, rate: float = ERROR_RATE) -> int:
    return int(len(item) * rate)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of about the same length: where each begins, and itself."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def myers(item: str, text: str, bits: dict[str, int] | None = None) -> int:
    """The least edit distance between item and any passage of text."""
    m = len(item)
    if not m:
        return 0
    if bits is None:
        bits = masks(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = bits.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = ph << 1 & full  # a passage may begin anywhere: no carry enters
        pv = (mh << 1 & full) | ~(xv | ph) & full
        mv = ph & xv
    return best


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def window_keys(codes: np.ndarray) -> np.ndarray:
    """A key of the eight characters from each position on, eight bits for each; past the end is 0."""
    low = np.zeros(len(codes) + 8, np.uint8)
    low[: len(codes)] = codes ^ codes >> np.uint32(8)
    return np.ndarray((len(codes),), "<u8", buffer=low, strides=(1,)).copy()


def _mask(size: int) -> np.uint64:
    return np.uint64((1 << 8 * size) - 1)


class Index:
    """The pieces of some items, under the keys of their first characters.

    Arrays: item (its number), at (where it begins in the item), size, head
    and tail (keys of its first and last characters), sorted by class (how
    many characters the head has) and head; and the items' characters.
    """

    def __init__(self, arrays: dict[str, np.ndarray], ids: pa.Array):
        self.a, self.ids = arrays, ids
        self.classes = []
        sizes = np.minimum(arrays["size"], 8)
        for size in np.unique(sizes).tolist():
            low, high = np.searchsorted(sizes, [size, size + 1])
            heads = arrays["head"][low:high]
            bits = np.uint64(min(26, max(12, len(heads).bit_length() + 6)))
            some = np.zeros(1 << int(bits), bool)
            some[heads * _P >> np.uint64(64) - bits] = True
            self.classes.append((size, int(low), heads, bits, some))
        self.masks: dict[int, dict[str, int]] = {}

    @staticmethod
    def arrays(items: list[str], rate: float) -> dict[str, np.ndarray]:
        rows = []
        for n, item in enumerate(items):
            k = budget(item, rate)
            # an item without a budget must be there as whole words
            for at, piece in pieces(item, k) if k else [(-1, f" {item} ")]:
                codes = np.array([ord(c) for c in piece], np.uint32)
                keys = window_keys(codes)
                size = min(len(piece), 8)
                rows.append((n, at, len(piece), int(keys[0] & _mask(size)), int(keys[len(piece) - size] & _mask(size))))
        rows.sort(key=lambda r: (min(r[2], 8), r[3]))
        kinds = (("item", np.int32), ("at", np.int32), ("size", np.int32), ("head", np.uint64), ("tail", np.uint64))
        out = {name: np.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds)}
        out["chars"] = np.frombuffer("".join(items).encode("utf-32-le"), np.uint32)
        out["first"] = np.concatenate([[0], np.cumsum([len(t) for t in items])]).astype(np.int64)
        out["budget"] = np.array([budget(t, rate) for t in items], np.int32)
        return out

    def item(self, n: int) -> str:
        return _string(self.a["chars"][self.a["first"][n] : self.a["first"][n + 1]])

    def hits(self, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows (text, item, where the item would begin in it) of the pieces that the texts hold; each row once."""
        out = []
        for size, low, heads, bits, some in self.classes:
            own = keys if size == 8 else keys & _mask(size)
            pos = np.flatnonzero(some[own * _P >> np.uint64(64) - bits])
            left, right = np.searchsorted(heads, own[pos]), np.searchsorted(heads, own[pos], "right")
            n = right - left
            pos = np.repeat(pos, n)
            piece = low + np.arange(len(pos)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(left, n)
            length = self.a["size"][piece]
            text = np.searchsorted(at, pos, "right") - 1
            end = pos + length
            fits = np.flatnonzero(end <= at[text + 1])
            last = keys[end[fits] - size] & _mask(size)
            fits = fits[last == self.a["tail"][piece[fits]]]
            out.append(np.stack([text[fits], self.a["item"][piece[fits]], pos[fits] - self.a["at"][piece[fits]] - at[text[fits]]], 1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)

    def found(self, codes: np.ndarray, keys: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, least distance, budget) of each text and item with a passage within the item's budget."""
        rows = self.hits(keys, at)
        new = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])) if len(rows) else np.zeros(0, np.int64)
        out = []
        for a, b in zip(new, np.append(new[1:], len(rows))):
            t, n = int(rows[a, 0]), int(rows[a, 1])
            item, k = self.item(n), int(self.a["budget"][n])
            text = _string(codes[at[t] + 1 : at[t + 1] - 1])
            begins = (rows[a:b, 2] - 1).tolist()
            if not k:
                best = 0 if any(f" {text} ".startswith(f" {item} ", x) for x in begins) else 1
            else:
                best = k + 1
                bits = self.masks.setdefault(n, masks(item))
                for low, high in _runs(begins, 2 * k + 1):
                    best = min(best, 0 if low >= 0 and text.startswith(item, low) else myers(item, text[max(0, low - k) : high + len(item) + k], bits))
                    if not best:
                        break
            if best <= k:
                out.append((t, n, best, k))
        return out


def _runs(begins: list[int], gap: int):
    """Ranges of begins that lie within gap of each other."""
    low = high = begins[0]
    for b in begins[1:]:
        if b - high > gap:
            yield low, high
            low = b
        high = b
    yield low, high


def indexed(benchmark: DataFrame, rate: float = ERROR_RATE, group_chars: int = GROUP_CHARS) -> list[str]:
    """Writes the index of the items, a folder for each group of about group_chars characters, to the shared folder; returns the folders."""
    items = benchmark.where("text is not null").select("item_id", "text")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    path = scratch(benchmark.sparkSession, "benchmark")

    def write(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        texts = [normalised(t) for t in table.column(1).to_pylist()]
        own = [k for k, t in enumerate(texts) if t]
        if not own:
            return
        at = f"{path}/{uuid.uuid4().hex}"
        for name, array in Index.arrays([texts[k] for k in own], rate).items():
            saved(f"{at}/{name}.npy", array)
        ids = table.select([0]).combine_chunks().take(pa.array(own))
        with pa.OSFile(f"{at}/ids.arrow", "wb") as f, pa.ipc.new_file(f, ids.schema) as w:
            w.write_table(ids)
        yield pa.record_batch([pa.array([at])], ["at"])

    groups = max(1, -(-int(size) // group_chars))
    return sorted(r.at for r in items.repartition(groups, F.xxhash64("text", "item_id")).mapInArrow(write, "at string").collect())


def opened(folder: str) -> Index:
    arrays = {name: np.load(f"{folder}/{name}.npy", mmap_mode="r") for name in ("item", "at", "size", "head", "tail", "chars", "first", "budget")}
    with pa.memory_map(f"{folder}/ids.arrow") as f:
        ids = pa.ipc.open_file(f).read_all().column(0).combine_chunks()
    return Index(arrays, ids)


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, group_chars: int = GROUP_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, budget): each item that a document holds within the budget, with the least distance.

    Null texts and items, and items without letters or digits, match nothing;
    repeated items and documents are reported for each. An item whose budget
    is 0, as it is short, is found as whole words only; the others also if the
    passage begins or ends inside a word. A document's whole text is searched,
    however long. doc_id and item_id are of any type; other columns of either
    table are ignored. An empty table on either side gives an empty result.
    """
    kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((docs, "doc_id"), (benchmark, "item_id")))
    folders = indexed(benchmark, rate, group_chars)

    def over(batches):
        groups = [opened(x) for x in folders]
        for whole in batches:
            for part in range(0, whole.num_rows, SLICE):
                batch = whole.slice(part, SLICE)
                codes, at = words(batch.column(1))
                keys = window_keys(codes)
                for group in groups:
                    if rows := group.found(codes, keys, at):
                        text, item, distance, most = (pa.array(x, pa.int32()) for x in zip(*rows))
                        yield pa.record_batch([batch.column(0).take(text), group.ids.take(item), distance, most], ["doc_id", "item_id", "distance", "budget"])

    cols = small_batches(docs).where("text is not null").select("doc_id", "text")
    return cols.mapInArrow(over, f"doc_id {kind}, item_id {item_kind}, distance int, budget int")


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The rows of docs less those that hold a benchmark item; null texts and doc_ids stay, rows that share a doc_id go together.

    Other columns pass through whatever their names.
    """
    gone = checkpointed(matches(docs, benchmark, rate).where("doc_id is not null").select("doc_id").distinct())
    return without_ids(docs, gone)
