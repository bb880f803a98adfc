"""The framed byte stream: text lines and exact-length payloads, one frame a batch.

A frame is sequential, so a file is read by one task; files are read in parallel.
"""

from __future__ import annotations

import io
import re
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import HistoryError
from ..shared import small_arrow_batches

#: Events that encode_frames puts into a frame at most, and rows that read_frames passes on at a time.
FRAME_EVENTS = 10_000
_WHO = "struct<name:string,email:string,source:string>"
SCHEMA = f"file string, batch long, status string, detail string, author {_WHO}, committer {_WHO}, process struct<name:string,version:string,params:string,correlation_id:string>, ts_nanos long, message binary, ord long, path array<string>, payload binary"
_DIGITS = re.compile(rb"[0-9]+")


def _fields(line: bytes, name: str, n: int) -> list[bytes]:
    parts = line.split(b"\t")
    if parts[0] != name.encode() or len(parts) != n + 1:
        raise HistoryError("EMALFORMED", f"expected {name} line")
    return parts[1:]


def _number(raw: bytes, what: str) -> int:
    if not _DIGITS.fullmatch(raw):
        raise HistoryError("EMALFORMED", f"invalid {what}")
    return int(raw)


def _line(f: BinaryIO) -> bytes:
    line = f.readline()
    if not line.endswith(b"\n"):
        raise HistoryError("EPROTOCOL", "unexpected end of input")
    return line[:-1]


def _exact(f: BinaryIO, n: int) -> bytes:
    data = f.read(n)
    if len(data) != n:
        raise HistoryError("EPROTOCOL", "unexpected end of input")
    return data


def parse_frame(f: BinaryIO, first: bytes) -> dict:
    """One frame, of which the first line is already read: header fields and events (path, payload or None)."""
    head = first.split(b"\t")
    if head[0] != b"BATCH":
        raise HistoryError("EPROTOCOL", "expected BATCH line")
    if len(head) != 3:
        raise HistoryError("EMALFORMED", "expected BATCH line")
    if head[1] != b"1":
        raise HistoryError("EPROTOCOL", "unsupported protocol version")
    n = _number(head[2], "event_count")
    if not n:
        raise HistoryError("EMALFORMED", "event_count must be greater than zero")
    text = lambda parts: [p.decode("utf-8", "surrogateescape") for p in parts]
    out: dict = {}
    for who in ("author", "committer"):
        out[who] = dict(zip(("name", "email", "source"), text(_fields(_line(f), who.upper(), 3))))
    out["process"] = dict(zip(("name", "version", "params", "correlation_id"), text(_fields(_line(f), "PROCESS", 4))))
    (stamp,) = _fields(_line(f), "TIMESTAMP", 1)
    if not re.fullmatch(rb"-?[0-9]+", stamp) or not -(2**63) <= int(stamp) < 2**63:
        raise HistoryError("EMALFORMED", "invalid timestamp")
    out["ts_nanos"] = int(stamp)
    (size,) = _fields(_line(f), "MESSAGE", 1)
    out["message"] = _exact(f, _number(size, "message length"))
    if _exact(f, 1) != b"\n":
        raise HistoryError("EMALFORMED", "message isn't followed by a new line")
    events = []
    for _ in range(n):
        depth, size = _fields(_line(f), "EVENT", 2)
        depth, size = _number(depth, "path depth"), _number(size, "payload length")
        if not depth:
            raise HistoryError("EMALFORMED", "path depth must be greater than zero")
        path = text([_line(f) for _ in range(depth)])
        payload = _exact(f, size)
        if size and _exact(f, 1) != b"\n":
            raise HistoryError("EMALFORMED", "payload isn't followed by a new line")
        events.append((path, payload if size else None))
    if _line(f) != b"END":
        raise HistoryError("EMALFORMED", "expected END line")
    out["events"] = events
    return out


def write_frame(events: list[tuple[list[str], bytes | None]], author: dict, committer: dict, process: dict, ts_nanos: int, message: bytes) -> bytes:
    out = [f"BATCH\t1\t{len(events)}\n".encode()]
    for who, p in (("AUTHOR", author), ("COMMITTER", committer)):
        out.append(f"{who}\t{p['name']}\t{p['email']}\t{p['source']}\n".encode())
    out.append(("PROCESS\t" + "\t".join(process[k] for k in ("name", "version", "params", "correlation_id")) + "\n").encode())
    out += [f"TIMESTAMP\t{ts_nanos}\nMESSAGE\t{len(message)}\n".encode(), message, b"\n"]
    for path, payload in events:
        out.append(f"EVENT\t{len(path)}\t{len(payload or b'')}\n".encode())
        out += [c.encode("utf-8", "surrogateescape") + b"\n" for c in path]
        if payload:
            out += [payload, b"\n"]
    return b"".join([*out, b"END\n"])


def frames_of(source: bytes | BinaryIO):
    """The frames of a stream, each as soon as it is whole, blank lines between them skipped; after the first bad frame comes its error and nothing more."""
    f = io.BytesIO(source) if isinstance(source, bytes) else source
    while True:
        line = f.readline()
        if not line:
            return
        if line in (b"\n", b"\r\n"):
            continue
        try:
            yield parse_frame(f, line.rstrip(b"\n"))
        except HistoryError as e:
            yield e
            return


def response(result: HistoryError | str) -> bytes:
    """What the writer of a frame is told: its commit's hash, or the error."""
    if isinstance(result, str):
        return f"OK\t{result}\n".encode()
    detail = result.detail.encode()
    return f"ERR\t{result.symbol}\t{len(detail)}\n".encode() + detail + b"\n"


def read_frames(files: DataFrame) -> DataFrame:
    """A row for each event of files (path, content); a bad frame is one row with its error's symbol as status.

    A frame's message is in the row of its first event (ord 0) only: it may be
    as long as the frame, and a copy in each row would grow with its square.
    """
    names = ["file", "batch", "status", "detail", "author", "committer", "process", "ts_nanos", "message", "ord", "path", "payload"]
    table = lambda rows: pd.DataFrame(rows, columns=names).astype({"ts_nanos": "Int64", "ord": "Int64"})

    def over(batches):
        for pdf in batches:
            rows: list[tuple] = []
            for name, content in zip(pdf["path"], pdf["content"]):
                for k, frame in enumerate(frames_of(bytes(content))):
                    if isinstance(frame, HistoryError):
                        rows.append((name, k, frame.symbol, frame.detail, *[None] * 8))
                        continue
                    head = [frame[x] for x in ("author", "committer", "process", "ts_nanos")]
                    for i, (path, payload) in enumerate(frame["events"]):
                        rows.append((name, k, "OK", None, *head, None if i else frame["message"], i, path, payload))
                        if len(rows) == FRAME_EVENTS:
                            yield table(rows)
                            rows = []
            if rows:
                yield table(rows)

    return small_arrow_batches(files.select("path", "content")).mapInPandas(over, SCHEMA)


def scan_frames(spark: SparkSession, glob: str) -> DataFrame:
    return read_frames(spark.read.format("binaryFile").load(glob))


def encode_frames(events: DataFrame, by: str) -> DataFrame:
    """(path, content) with the frames of each group of events (ord, path, payload) in the order of ord; a message has its frame's ords.

    A group is cut into a file for every FRAME_EVENTS values of ord, so that
    a long group is neither one task's nor one value.
    """

    def frame(key, pdf):
        pdf = pdf.sort_values("ord")
        rows = [(list(p), None if x is None else bytes(x)) for p, x in zip(pdf["path"], pdf["payload"])]
        who = {"name": "frames", "email": "frames@example.org", "source": "events"}
        message = ('{"seqs":"' + ",".join(map(str, pdf["ord"])) + '"}').encode()
        data = write_frame(rows, who, who, {"name": "frames", "version": "1", "params": "-", "correlation_id": "-"}, int(key[0]) * 10**9, message)
        return pd.DataFrame({"path": [f"frame-{key[0]}-{key[1]}"], "content": [data]})

    part = F.floor(F.col("ord") / FRAME_EVENTS).cast("long").alias("part")
    return events.select(by, part, "ord", "path", F.col("payload").cast("binary").alias("payload")).groupBy(by, "part").applyInPandas(frame, "path string, content binary")
