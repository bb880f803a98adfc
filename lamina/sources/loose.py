"""A directory of loose compressed objects: objects/<2 hex>/<62 hex>, each a compressed envelope."""

from __future__ import annotations

import os
import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import HistoryError
from ..functions.codec import TYPES, compress, decompress, digest, envelope, open_envelope

_KINDS = {name: kind for kind, name in TYPES.items()}


def write_objects(objects: DataFrame, directory: str, level: int = 3) -> int:
    """Writes objects (hash, type, payload) from the executors to a folder that they share; those that are there stay. Returns how many were new."""

    def over(batches):
        for pdf in batches:
            new = 0
            for h, kind, payload in zip(pdf["hash"], pdf["type"], pdf["payload"]):
                path = f"{directory}/objects/{h[:2]}/{h[2:]}"
                if os.path.exists(path):
                    continue
                os.makedirs(os.path.dirname(path), exist_ok=True)
                tmp = f"{path}.{uuid.uuid4().hex}"
                with open(tmp, "wb") as f:
                    f.write(compress(envelope(_KINDS[kind], bytes(payload)), level))
                os.replace(tmp, path)
                new += 1
            yield pd.DataFrame({"n": [new]})

    return objects.dropDuplicates(["hash"]).select("hash", "type", "payload").mapInPandas(over, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n


def read_objects(spark: SparkSession, directory: str, algorithm: str = "blake3-256") -> DataFrame:
    """hash, type, size, payload, stored_size and problem (null: none) of every loose object; other files are passed over."""

    def over(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                name = "".join(path.rsplit("/", 2)[1:])
                if not re.fullmatch(r"[0-9a-f]{64}", name):
                    continue
                raw = bytes(content)
                try:
                    body = decompress(raw)
                    if digest(body, algorithm).hex() != name:
                        raise HistoryError("ECORRUPT", "hash mismatch")
                    kind, payload = open_envelope(body)
                    rows.append((name, TYPES[kind], len(payload), payload, len(raw), None))
                except HistoryError as e:
                    rows.append((name, None, None, None, len(raw), str(e)))
            yield pd.DataFrame(rows, columns=["hash", "type", "size", "payload", "stored_size", "problem"]).astype({"size": "Int64"})

    files = spark.read.format("binaryFile").load(f"{directory}/objects/*/*")
    return files.select("path", "content").mapInPandas(over, "hash string, type string, size long, payload binary, stored_size long, problem string")
