import io
import json

import pytest

from lamina.errors import HistoryError
from lamina.functions.codec import compress, envelope
from lamina.sources import frames, loose
from lamina.sources.tables import cluster_scan, collection

WHO = {"name": "a", "email": "b", "source": "c"}
PROCESS = {"name": "p", "version": "1", "params": "", "correlation_id": ""}


def frame(*events, message=b"hi"):
    return frames.write_frame(list(events), WHO, WHO, PROCESS, 5, message)


def test_frames_round_trip():
    events = [(["db", "users", '"bob"'], b'{"_id":"bob"}'), (["db", "x"], None), (["y"], b"\n\tEND\n\x00")]
    data = b"\n" + frame(*events) + b"\n\n" + frame(events[0], message=b"")
    got = list(frames.frames_of(data))
    assert [f["events"] for f in got] == [events, events[:1]] and got[0]["ts_nanos"] == 5 and got[1]["message"] == b""


@pytest.mark.parametrize(
    "data, answer",
    [
        (b"BATCH\t1\t0\n", b"ERR\tEMALFORMED\t37\nevent_count must be greater than zero\n"),
        (b"NOPE\n", b"ERR\tEPROTOCOL\t19\nexpected BATCH line\n"),
        (b"BATCH\t2\t1\n", b"ERR\tEPROTOCOL"),
        (frame((["a"], b"x"))[:-6], b"ERR\tEPROTOCOL"),
        (frame((["a"], b"x")).replace(b"EVENT\t1", b"EVENT\t0"), b"ERR\tEMALFORMED"),
        (frame((["a"], b"x")).replace(b"BATCH\t1\t1", b"BATCH\t1\t-1"), b"ERR\tEMALFORMED"),
        (frame((["a"], b"x")).replace(b"END", b"FIN"), b"ERR\tEMALFORMED"),
    ],
)
def test_bad_frames(data, answer):
    good = frame((["a"], b"x"))
    cut = b"" if data.endswith(b"a\n") else good
    got = list(frames.frames_of(good + data + cut))
    assert len(got) == 2 and isinstance(got[1], HistoryError) and frames.response(got[1]).startswith(answer)
    assert frames.response("ab") == b"OK\tab\n"


def test_frame_files_are_read_in_parallel(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.bin").write_bytes(frame((["d", str(k)], b"p"), (["d", "gone"], None)))
    (tmp_path / "bad.bin").write_bytes(b"NOPE\n")
    rows = frames.scan_frames(spark, str(tmp_path)).collect()
    assert sorted((r.path[1], r.payload and bytes(r.payload)) for r in rows if r.status == "OK") == sorted([("0", b"p"), ("1", b"p"), ("2", b"p")] + [("gone", None)] * 3, key=lambda x: x)
    assert [(r.status, r.detail) for r in rows if r.status != "OK"] == [("EPROTOCOL", "expected BATCH line")]


def test_collections(spark):
    t = spark.createDataFrame([(1, 'a"b', None, True), (2, "é", 1.5, None)], "k long, s string, d double, b boolean")
    got = {r.path[2]: json.loads(r.payload) for r in collection(t, "db", "c", "k").collect()}
    assert got == {'{"$numberLong":"1"}': {"_id": {"$numberLong": "1"}, "b": True, "d": None, "s": 'a"b'}, '{"$numberLong":"2"}': {"_id": {"$numberLong": "2"}, "b": None, "d": {"$numberDouble": "1.50"}, "s": "é"}}
    cluster = {"db": {"c": ("k", t)}, "admin": {"x": ("k", t)}}
    assert {r.path[0] for r in cluster_scan(cluster, ["admin"]).collect()} == {"db"}
    assert {r.path[0] for r in cluster_scan(cluster, ["admin"], scope="admin").collect()} == {"admin"}


def test_loose_objects(spark, tmp_path):
    from lamina.functions.blake3 import blake3

    body = envelope(1, b"dangling")
    h = blake3(body).hex()
    rows = spark.createDataFrame([(h, "blob", b"dangling"), (h, "blob", b"dangling")], "hash string, type string, payload binary")
    assert loose.write_objects(rows, str(tmp_path)) == 1 and loose.write_objects(rows, str(tmp_path)) == 0
    bad = tmp_path / "objects" / "00"
    bad.mkdir()
    (bad / ("0" * 62)).write_bytes(compress(envelope(1, b"other")))
    (bad / "readme").write_bytes(b"x")
    got = {r.hash: r for r in loose.read_objects(spark, str(tmp_path)).collect()}
    assert len(got) == 2 and bytes(got[h].payload) == b"dangling" and got[h].stored_size > 0 and "hash mismatch" in got["0" * 64].problem


def test_frames_need_whole_payloads():
    with pytest.raises(HistoryError, match="EPROTOCOL"):
        frames.parse_frame(io.BytesIO(b""), b"BATCH\t1\t1")


def test_frames_stay_bounded_and_name_their_message_once(spark):
    n = frames.FRAME_EVENTS
    events = spark.range(n - 3, 2 * n + 7).selectExpr("1L day", "id ord", "array('d', string(id)) path", "if(id % 5 = 0, null, string(id)) payload")
    files = frames.encode_frames(events, "day")
    rows = frames.read_frames(files).collect()
    assert files.count() == 3 and {r.status for r in rows} == {"OK"}
    assert sorted((int(r.path[1]), r.payload and bytes(r.payload).decode()) for r in rows) == [(k, str(k) if k % 5 else None) for k in range(n - 3, 2 * n + 7)]
    messages = [r for r in rows if r.message is not None]
    assert len(messages) == 3 and {r.ord for r in messages} == {0}  # a copy for each event grows with the square
    assert sorted(len(json.loads(bytes(r.message))["seqs"].split(",")) for r in messages) == [3, 7, n]
