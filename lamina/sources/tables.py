"""Tables as collections of documents, one at a time, a database's or a cluster's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import int_id, long_id, row_document, string_id


def _quoted(c: Column) -> Column:
    """A string as JSON: the JVM's own serialiser escapes it."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def value(name: str, kind: T.DataType) -> Column:
    """A column as canonical extended JSON; doubles have two decimals, so that their text doesn't depend on the engine."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        out = _quoted(c)
    elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
        out = int_id(c)
    elif isinstance(kind, T.LongType):
        out = long_id(c)
    elif isinstance(kind, T.BooleanType):
        out = c.cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = F.concat(F.lit('{"$numberDouble":"'), c.cast("decimal(18,2)").cast("string"), F.lit('"}'))
    elif isinstance(kind, T.DecimalType):
        out = F.concat(F.lit('{"$numberDecimal":"'), c.cast("string"), F.lit('"}'))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        out = F.concat(F.lit('{"$date":{"$numberLong":"'), F.unix_millis(c.cast("timestamp")).cast("string"), F.lit('"}}'))
    elif isinstance(kind, T.BinaryType):
        out = F.concat(F.lit('{"$binary":{"base64":"'), F.base64(c), F.lit('","subType":"00"}}'))
    else:
        out = F.to_json(c)
    return F.when(c.isNull(), "null").otherwise(out)


def collection(rows: DataFrame, db: str, coll: str, key: str) -> DataFrame:
    """(path, payload) of a table's rows: path is database, collection, canonical _id. The key becomes _id."""
    kinds = {f.name: f.dataType for f in rows.schema}
    fields = {"_id" if n == key else n: value(n, k) for n, k in kinds.items()}
    return rows.select(F.array(F.lit(db), F.lit(coll), fields["_id"]).alias("path"), row_document(fields).alias("payload"))


def database_scan(tables: dict[str, tuple[str, DataFrame]], db: str) -> DataFrame:
    """All collections (name -> key, rows) of a database."""
    return reduce(DataFrame.unionByName, (collection(rows, db, name, key) for name, (key, rows) in sorted(tables.items())))


def cluster_scan(cluster: dict[str, dict[str, tuple[str, DataFrame]]], excluded: list[str], scope: str | None = None) -> DataFrame:
    """All databases but the excluded ones; a scope is one database, whether excluded or not."""
    chosen = [scope] if scope else sorted(d for d in cluster if d not in excluded)
    return reduce(DataFrame.unionByName, (database_scan(cluster[d], d) for d in chosen if cluster.get(d)))
