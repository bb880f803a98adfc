"""Content addresses as columns. sha2-256 is made of built-in functions; blake3-256 is an Arrow function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from .blake3 import blake3_many
from .codec import compressor


def leb_hex(n: Column) -> Column:
    """n as LEB128, in hexadecimal, for n below 2**35."""
    byte = lambda v: F.lpad(F.hex(v), 2, "0")
    low = lambda k: byte(F.shiftright(n, 7 * k).bitwiseAND(127).bitwiseOR(128))
    top = lambda k: byte(F.shiftright(n, 7 * k))
    out = F.concat(*(low(k) for k in range(4)), top(4))
    for k in (3, 2, 1, 0):
        out = F.when(n < 1 << 7 * (k + 1), F.concat(*(low(j) for j in range(k)), top(k))).otherwise(out)
    return F.lower(out)


def envelope_hex(kind: str, payload_hex: Column) -> Column:
    """The envelope's hexadecimal digits: type, length, payload."""
    return F.concat(F.lit(kind), leb_hex((F.length(payload_hex) / 2).cast("long")), payload_hex)


def object_hash(kind: str, payload_hex: Column, algorithm: str = "sha2-256") -> Column:
    """The hash of an object, as 64 lower-case digits."""
    raw = F.unhex(envelope_hex(kind, payload_hex))
    return F.sha2(raw, 256) if algorithm == "sha2-256" else blake3_hex(raw)


def blob_hash(payload: Column, algorithm: str = "sha2-256") -> Column:
    return object_hash("01", F.hex(payload), algorithm)


@F.pandas_udf(StringType())
def blake3_hex(raw: pd.Series) -> pd.Series:
    known = raw.notna()
    out = pd.Series([None] * len(raw), index=raw.index, dtype=object)
    out[known] = [h.hex() for h in blake3_many([bytes(x) for x in raw[known]])]
    return out


@F.pandas_udf(LongType())
def zstd_size(raw: pd.Series) -> pd.Series:
    """The length of what compress makes of each value; the bytes don't go back, and the compressor's tables are made once a batch."""
    one = compressor()
    return raw.map(lambda x: None if x is None else len(one.compress(x))).astype("Int64")
