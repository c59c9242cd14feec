"""Explicit schemas of change records; nothing is inferred from JSON. Every column may be null."""

from __future__ import annotations

from pyspark.sql import types as T

_STRINGS = T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


FILES = _struct(total=T.LongType(), meaningful=T.LongType(), rawMeaningful=T.LongType(), testOnly=T.BooleanType(), added=_STRINGS, removed=_STRINGS, renamed=_STRINGS, modified=_STRINGS)
ENTRY = _struct(
    sha=T.StringType(),
    date=T.StringType(),
    day=T.StringType(),
    month=T.StringType(),
    kind=T.StringType(),
    author=T.StringType(),
    category=T.StringType(),
    areas=_STRINGS,
    significance=T.StringType(),
    title=T.StringType(),
    summary=T.StringType(),
    ai=_struct(model=T.StringType(), v=T.IntegerType(), title=T.StringType(), summary=T.StringType(), audience=T.StringType()),
    eli5=_struct(text=T.StringType()),
    facts=_STRINGS,
    noise=T.BooleanType(),
    stats=_struct(additions=T.LongType(), deletions=T.LongType()),
    files=FILES,
)
COUNTS = T.MapType(T.StringType(), T.LongType())
MANIFEST = _struct(version=T.IntegerType(), repo=T.StringType(), generatedAt=T.StringType(), headSha=T.StringType(), layout=T.StringType(), counts=COUNTS)
DOCUMENT = T.StructType([*MANIFEST.fields, T.StructField("entries", T.ArrayType(ENTRY), True)])
SHARD = T.StructType([T.StructField("day", T.StringType(), True), T.StructField("entries", T.ArrayType(ENTRY), True)])
LISTING = _struct(path=T.StringType(), bytes=T.DoubleType())
STATUS = _struct(headSha=T.StringType(), generatedAt=T.StringType())
CLONES = T.ArrayType(_struct(timestamp=T.StringType(), count=T.LongType(), uniques=T.LongType()))
TRAFFIC = _struct(count=T.LongType(), uniques=T.LongType(), clones=CLONES, fetchedAt=T.StringType())
