"""A thin command line: python -m lamina.cli [--store DIR] COMMAND ..."""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import CODES, HistoryError
from .repo import Meta, Repo
from .shared import checkpointed
from .sources.frames import frames_of, response
from .streaming.changes import EVENT, changes, drain, stop, watch

USAGE = """usage: lamina [--store DIR] COMMAND
  init | info | fsck
  commit-batch                         frames from standard input
  watch [--follow] FOLDER              change events from JSON files
  log [--oneline] [--paths] [-n N] [-- PATH]
  show REVISION[:PATH]
  diff [REVISION [REVISION]]
  ls-tree HASH
  cat-object -t|-s|-p HASH
  list-objects [--type=T]... [--reachable] [--format=F]
"""


def _rows(df: DataFrame, *columns: str) -> None:
    for r in df.select(*columns).toLocalIterator():
        print("\t".join("/".join(x) if isinstance(x, list) else str(x) for x in r))


def commit_frames(repo: Repo, source, out) -> None:
    """Commits each frame as it comes and answers it before the next is read; the first bad one ends the stream."""

    def answer(result: HistoryError | str) -> None:
        out.write(response(result))
        out.flush()

    for frame in frames_of(source):
        try:
            if isinstance(frame, HistoryError):
                raise frame
            events = [(k, path, payload) for k, (path, payload) in enumerate(frame["events"])]
            rows = repo.spark.createDataFrame(events, "ord long, path array<string>, payload binary")
            own = repo.commit(rows, Meta(frame["ts_nanos"], frame["message"], frame["author"], frame["committer"], frame["process"]))
        except HistoryError as e:
            answer(e)
            raise
        answer(own)


def watched(spark: SparkSession, store: str, rest: list[str]) -> None:
    """Commits the change events that lie, or with --follow arrive, as JSON files in a folder; each line is an event with its seq."""
    follow = "--follow" in rest
    (folder,) = [x for x in rest if x != "--follow"]
    with Repo(spark, store, writable=True) as repo:
        events = spark.readStream.schema(f"seq long, {EVENT}").json(folder)
        query = watch(repo, changes(events), f"{store}/stream", follow="1 second" if follow else None)
        try:
            query.awaitTermination()
            drain(repo)
        except KeyboardInterrupt:
            stop(query, repo)


def run(spark: SparkSession, argv: list[str], stdin=None, stdout=None) -> None:
    store = "."
    if argv[:1] == ["--store"] and len(argv) > 1:
        store, argv = argv[1], argv[2:]
    if not argv:
        raise HistoryError("EINVAL", USAGE)
    command, rest = argv[0], argv[1:]
    if command == "init":
        Repo.init(spark, store)
    elif command == "commit-batch":
        with Repo(spark, store, writable=True) as repo:
            commit_frames(repo, stdin or sys.stdin.buffer, stdout or sys.stdout.buffer)
    elif command == "watch" and len([x for x in rest if x != "--follow"]) == 1:
        watched(spark, store, rest)
    elif command == "info":
        try:
            print(json.dumps(Repo(spark, store).info(), indent=1))
        except HistoryError as e:
            if e.symbol != "ENOT_FOUND":
                raise
            print(json.dumps({"path": store, "initialized": False}, indent=1))
    elif command == "fsck":
        repo = Repo(spark, store)
        if not repo.head():
            print("fsck: no commits")
            return
        found = checkpointed(repo.fsck())
        _rows(found, "problem", "hash")
        print(f"fsck: {repo.reachable().count()} reachable, {found.where(F.col('problem') == 'dangling').count()} dangling")
        if bad := found.where(F.col("problem") != "dangling").head():
            raise HistoryError("ECORRUPT", f"{bad.problem} {bad.hash}")
    elif command == "log":
        path = None
        if "--" in rest:
            k = rest.index("--")
            tail = rest[k + 1 : k + 2]
            if not tail or not tail[0]:
                raise HistoryError("EINVAL", "empty path")
            path, rest = tail[0].split("/"), rest[:k]
        n = rest[rest.index("-n") + 1] if "-n" in rest else "0"
        _log(Repo(spark, store), path, int(n) if n.isdigit() else 0, "--paths" in rest, "--oneline" in rest)
    elif command == "show" and len(rest) == 1:
        revision, sign, path = rest[0].partition(":")
        repo = Repo(spark, store)
        if sign:
            out = repo.show_path(revision, path.split("/") if path else [])
            if isinstance(out, bytes):
                (stdout or sys.stdout.buffer).write(out)
            else:
                _rows(out, "type", "hash", "path")
        else:
            fields, changes = repo.show(revision)
            print(f"commit {fields['hash']}\nparent {fields['parent'] or '-'}\ntree {fields['root']}\n\n{bytes(fields['message']).decode(errors='replace')}\n\nchanges:")
            _rows(changes, "status", "path")
    elif command == "diff" and len(rest) <= 2:
        _rows(Repo(spark, store).diff(*rest), "status", "path")
    elif command == "ls-tree" and len(rest) == 1:
        _rows(Repo(spark, store).list_tree(rest[0]), "type", "hash", "path")
    elif command == "cat-object" and len(rest) == 2 and rest[0] in ("-t", "-s", "-p"):
        kind, size, payload = Repo(spark, store).cat(rest[1])
        if rest[0] == "-p":
            (stdout or sys.stdout.buffer).write(pretty(kind, payload))
        else:
            print(kind if rest[0] == "-t" else size)
    elif command == "list-objects":
        types = [x[7:] for x in rest if x.startswith("--type=")]
        template = next((x[9:] for x in rest if x.startswith("--format=")), "%H %T %S")
        _rows(Repo(spark, store).objects(types, "--reachable" in rest, template), "line")
    else:
        raise HistoryError("EINVAL", USAGE)


def pretty(kind: str, payload: bytes) -> bytes:
    from .functions.codec import TYPES, read_tree

    if kind == "tree":
        return b"".join(f"{TYPES[k]} {h.hex()}\t{name}\n".encode("utf-8", "surrogateescape") for k, h, name in read_tree(payload))
    return payload if payload.endswith(b"\n") and kind == "blob" else payload + b"\n"


def _log(repo: Repo, path: list[str] | None, n: int, paths: bool, oneline: bool) -> None:
    rows = repo.log(path, n)
    if paths and not oneline:
        # the changes of all commits shown come with one query, commit by commit
        told = repo.log(path, 0, paths=True).where("status is not null").join(rows.select("seq"), "seq", "left_semi")
        changes = told.select("seq", "status", "path").orderBy(F.desc("seq"), "path").toLocalIterator()
        ahead = next(changes, None)
    for r in rows.toLocalIterator():
        text = bytes(r.message).decode(errors="replace")
        note = f" ({r.annotation})" if r.annotation else ""
        if oneline:
            print(f"{r.hash[:12]} {text}" + (f" [{r.n_changed} changed]" if paths else "") + note)
            continue
        who = lambda p: f"{p.name} <{p.email}> {r.ts_nanos}"  # noqa: B023, E731
        print(f"commit {r.hash}{note}\nparent {r.parent or '-'}\nauthor {who(r.author)}\ncommitter {who(r.committer)}\n\n    {text}\n")
        while paths and ahead and ahead.seq == r.seq:
            print(f"{ahead.status}\t{'/'.join(ahead.path)}")
            ahead = next(changes, None)


def main() -> int:
    spark = SparkSession.builder.appName("lamina").getOrCreate()
    try:
        run(spark, sys.argv[1:])
    except HistoryError as e:
        print(f"lamina: {e.symbol}: {e.detail}", file=sys.stderr)
        return CODES[e.symbol]
    return 0


if __name__ == "__main__":
    sys.exit(main())
