import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamina.config import Config, parse
from lamina.errors import CODES, SYMBOLS, HistoryError
from lamina.functions import codec
from lamina.functions.blake3 import blake3, blake3_many
from lamina.functions.canonical import canonical_json, document_id


@pytest.mark.parametrize("n", [0, 1, 127, 128, 255, 16384, 2**32 - 1, 2**64 - 1])
def test_leb128_round_trip(n):
    raw = codec.leb128(n)
    assert codec.read_leb128(raw) == (n, len(raw))


def test_leb128_overlong():
    for raw in (b"\x80" * 11, b"\x80", b"\xff" * 9 + b"\x02"):
        with pytest.raises(HistoryError, match="ECORRUPT"):
            codec.read_leb128(raw)


def test_hex():
    assert codec.from_hex(bytes(range(32)).hex()) == bytes(range(32))
    for bad in ("ABC", "AB" * 32, "0" * 63, "0" * 65):
        with pytest.raises(HistoryError, match="EHASH"):
            codec.from_hex(bad)


def test_tree_payload():
    raw = codec.tree_payload([(1, b"z" * 32, "z"), (2, b"a" * 32, "a"), (1, b"b" * 32, "a.b")])
    assert [n for _, _, n in codec.read_tree(raw)] == ["a", "a.b", "z"]
    assert codec.read_tree(b"") == []
    with pytest.raises(HistoryError, match="EINVAL"):
        codec.tree_payload([(1, b"z" * 32, "z")] * 2)
    for bad in (raw[:-1], raw[36:] + raw[:36], b"\x09" + raw[1:]):
        with pytest.raises(HistoryError, match="ECORRUPT"):
            codec.read_tree(bad)


def test_commit_payload():
    who = {"name": "n", "email": "e", "source": "s"}
    process = {"name": "p", "version": "1", "params": "", "correlation_id": "c"}
    raw = codec.commit_payload("a" * 64, "b" * 64, who, who, process, -5, b"one\n\ntwo")
    told = codec.read_commit(raw)
    assert told["root"] == "a" * 64 and told["parent"] == "b" * 64 and told["message"] == b"one\n\ntwo" and told["author"] == who | {"ts_nanos": -5} and told["process"] == process
    assert codec.read_commit(codec.commit_payload("a" * 64, None, who, who, process, 0, b""))["parent"] is None
    for bad in (raw[5:], raw.replace(b"author", b"writer"), raw.split(b"\n\n")[0]):
        with pytest.raises(HistoryError):
            codec.read_commit(bad)


def test_envelopes_and_compression():
    raw = codec.envelope(1, b"x" * 300)
    assert raw[:3] == b"\x01\xac\x02" and codec.open_envelope(raw) == (1, b"x" * 300)
    assert codec.decompress(codec.compress(raw)) == raw
    for bad in (raw[:-1], raw + b"y", b"\x07" + raw[1:], b""):
        with pytest.raises(HistoryError, match="ECORRUPT"):
            codec.open_envelope(bad)
    with pytest.raises(HistoryError, match="ECORRUPT"):
        codec.decompress(b"not compressed")


def test_blake3_vectors():
    assert blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3(b"abc").hex() == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"


def test_blake3_batches_agree_with_single_messages():
    r = random.Random(1)
    messages = [r.randbytes(n) for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 3072, 3073, 5000, 7168, 8192, 31744)]
    assert blake3_many(messages) == [blake3(m) for m in messages]
    assert len(set(blake3_many(messages))) == len(messages)


def test_sha2_digest():
    assert codec.digest(b"x") == hashlib.sha256(b"x").digest() and codec.digest(b"x", "blake3-256") == blake3(b"x")


def test_canonical_json():
    assert canonical_json('{"z":1,"a":{"b":2,"a":1},"m":[{"y":2,"x":1}]}') == '{"a":{"a":1,"b":2},"m":[{"x":1,"y":2}],"z":1}'
    assert canonical_json(' [ 1.0 , 1e5, 1.50 , "a \\" b" , true, null ] ') == '[1.0,1e5,1.50,"a \\" b",true,null]'
    assert canonical_json('{"b":1,"a":2,"b":0}') == '{"a":2,"b":1,"b":0}'
    assert canonical_json('{"\\n":1,"m":2,"o":3}') == '{"m":2,"\\n":1,"o":3}'  # the escape sorts as the letter n
    assert canonical_json("{}") == "{}" and canonical_json("[]") == "[]" and canonical_json("loose") == "loose"
    for bad in ("", "{", "[1,]", '{"a"}', '{"a":1,}', "{1:2}", "[1] 2", '"\\x"', '"open', "[" * 600 + "]" * 600):
        with pytest.raises(HistoryError, match="EMALFORMED"):
            canonical_json(bad)


def test_document_id():
    assert document_id('{"z":"last","_id":"alice","a":{"_id":2}}') == '"alice"'
    assert document_id('{"_id": {"$oid": "69ee1fb36acc97dcf62258d5"}}') == '{"$oid":"69ee1fb36acc97dcf62258d5"}'
    with pytest.raises(HistoryError, match="EADAPTER"):
        document_id('{"a":{"_id":1}}')


values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text(max_size=4), v, max_size=4), max_leaves=12)


@settings(max_examples=100, deadline=None)
@given(values, st.integers(0, 2))
def test_canonical_json_keeps_meaning(value, indent):
    import json

    once = canonical_json(json.dumps(value, indent=indent or None))
    assert json.loads(once) == value and canonical_json(once) == once


def test_config():
    text = Config().text()
    assert parse(text) == Config() and parse("# note\n\n" + text + "worker_threads = 3\n").worker_threads == 3
    for bad in (text + "other = 1\n", text.replace("worker_threads = 0\n", ""), text + "worker_threads = -1\n", text + "compression = none\n", text + "junk\n", text + "format_version = 2\n", text + "require_pre_post_images = yes\n"):
        with pytest.raises(HistoryError, match="ECONFIG"):
            parse(bad)
    with pytest.raises(HistoryError, match="EHASH"):
        parse(text + "hash_algorithm = md5\n")


def test_error_codes():
    assert len(SYMBOLS) == len(CODES) == 20 and HistoryError("ECORRUPT", "x").code == 7


def _lengths(batches):
    import pandas as pd

    for x in batches:
        yield pd.DataFrame({"n": [len(x)]})


def test_stored_size_takes_texts_in_small_batches(spark, tmp_path):
    from lamina.functions.codec import compress, envelope
    from lamina.plans.catalogue import QUERIES

    texts = ["", "é" * 5, *("".join(chr(97 + (k * j * j) % 26) for j in range(k)) for k in range(1, 400, 7)), None]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.stored for r in QUERIES["stored_size"](spark, str(tmp_path)).collect()}
    assert got == {k: None if t is None else len(compress(envelope(1, t.encode()))) for k, t in enumerate(texts)}
    long = spark.range(0, 400, 1, 1).selectExpr("repeat('x', 100000) text")
    assert max(r.n for r in long.mapInPandas(_lengths, "n long").collect()) < 100
