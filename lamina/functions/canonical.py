"""Canonical JSON text: keys sorted, white space gone, arrays in order, numbers and strings spelled as they were.

Keys are ordered by the UTF-8 bytes of their decoded text, in which a simple
escape stands for the character after its backslash and \\uXXXX for itself.
Equal keys stay in the order in which they came.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..errors import HistoryError

_TOKEN = re.compile(r'[ \t\r\n]*(?:("(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9A-Fa-f]{4})*")|([{}\[\],:])|([^\s{}\[\],:"]+))')
_SIMPLE = re.compile(r"\\([^u])")
_DEEPEST = 500


def canonical_json(text: str) -> str:
    """Raises EMALFORMED for what isn't one JSON value, or one nested more than 500 deep; an atom may be any run of other characters."""
    tokens = []
    at = 0
    body = text.rstrip(" \t\r\n")
    while at < len(body):
        m = _TOKEN.match(body, at)
        if not m:
            raise HistoryError("EMALFORMED", f"invalid JSON at {at}")
        tokens.append((m.lastindex, m.group(m.lastindex)))
        at = m.end()
    tokens.append((0, ""))
    out, k = _value(tokens, 0, 0)
    if tokens[k][0]:
        raise HistoryError("EMALFORMED", "text after the JSON value")
    return out


def _value(tokens: list[tuple[int, str]], k: int, depth: int) -> tuple[str, int]:
    kind, t = tokens[k]
    if kind in (1, 3):
        return t, k + 1
    if depth > _DEEPEST:
        raise HistoryError("EMALFORMED", "JSON is nested too deeply")
    if t == "[":
        items = []
        k += 1
        while tokens[k][1] != "]" or tokens[k][0] != 2:
            if items:
                k = _expect(tokens, k, ",")
            item, k = _value(tokens, k, depth + 1)
            items.append(item)
        return "[" + ",".join(items) + "]", k + 1
    if t == "{":
        pairs = []
        k += 1
        while tokens[k][1] != "}" or tokens[k][0] != 2:
            if pairs:
                k = _expect(tokens, k, ",")
            if tokens[k][0] != 1:
                raise HistoryError("EMALFORMED", "a name is missing in a JSON object")
            name = tokens[k][1]
            item, k = _value(tokens, _expect(tokens, k + 1, ":"), depth + 1)
            pairs.append((_SIMPLE.sub(r"\1", name[1:-1]).encode("utf-8", "surrogatepass"), f"{name}:{item}"))
        pairs.sort(key=lambda p: p[0])
        return "{" + ",".join(p[1] for p in pairs) + "}", k + 1
    raise HistoryError("EMALFORMED", "a JSON value is missing")


def _expect(tokens: list[tuple[int, str]], k: int, sign: str) -> int:
    if tokens[k] != (2, sign):
        raise HistoryError("EMALFORMED", f"{sign} is missing in JSON")
    return k + 1


def document_id(text: str) -> str:
    """The canonical text of a document's _id; a string keeps its quotes."""
    body = canonical_json(text)
    tokens = [(m.lastindex, m.group(m.lastindex)) for m in _TOKEN.finditer(body)] + [(0, "")]
    k = 1
    while tokens[k][0] == 1:
        item, after = _value(tokens, k + 2, 1)
        if tokens[k][1] == '"_id"':
            return item
        k = after + 1
    raise HistoryError("EADAPTER", "a document has no _id")


@F.pandas_udf(StringType())
def canonical(text: pd.Series) -> pd.Series:
    """canonical_json of each text; null for nulls, an error for malformed texts."""
    return text.map(lambda t: None if t is None else canonical_json(t))


@F.pandas_udf(StringType())
def canonical_id(text: pd.Series) -> pd.Series:
    """document_id of each document."""
    return text.map(lambda t: None if t is None else document_id(t))


def string_id(key: Column) -> Column:
    return F.concat(F.lit('"'), key, F.lit('"'))


def long_id(key: Column) -> Column:
    return F.concat(F.lit('{"$numberLong":"'), key.cast("string"), F.lit('"}'))


def int_id(key: Column) -> Column:
    return F.concat(F.lit('{"$numberInt":"'), key.cast("string"), F.lit('"}'))


def row_document(fields: dict[str, Column]) -> Column:
    """A row as canonical text: the names in order, each with the extended JSON of its column, which callers give as text."""
    parts = []
    for name in sorted(fields, key=lambda n: n.encode()):
        parts += [F.lit(("," if parts else "{") + f'"{name}":'), fields[name]]
    return F.concat(*parts, F.lit("}"))
