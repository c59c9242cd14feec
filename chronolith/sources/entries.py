"""Entries of any shape: the columns of the schema, and ``more``, a variant of whatever else an entry has.

``more`` holds fields that the schema does not know, also those inside known structs, and values of known fields that
do not fit their type. An entry put together again has every field that it came with; a typed value goes before one of ``more``.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ENTRY

MORE = "more"
#: Entries as they are loaded.
OPEN_ENTRY = T.StructType([*ENTRY.fields, T.StructField(MORE, T.VariantType(), True)])
_FIELDS = "map<string,variant>"
#: What a variant calls a value that fits a scalar column as it is; others would be converted, and so not come back alike.
_KINDS = {T.StringType: "STRING", T.BooleanType: "BOOLEAN"}


def _held(fields: T.StructType, typed) -> Column:
    """Names of the fields that have a typed value."""
    return F.array_compact(F.array(*[F.when(typed(f.name).isNotNull(), F.lit(f.name)) for f in fields]))


def _rest(entry: Column, path: str, held: Column) -> Column:
    """The other fields of the object at ``path`` as a map; null if it is no object."""
    return F.map_filter(F.try_variant_get(entry, path, _FIELDS), lambda name, _: ~F.array_contains(held, name))


def opened(rows: DataFrame, column: str, *keep: str) -> DataFrame:
    """Entries kept as variants in ``column``, in typed columns and ``more``."""
    entry = F.col(column)

    def read(f: T.StructField) -> Column:
        value = F.try_variant_get(entry, f"$.{f.name}", f.dataType.simpleString())
        kind = F.schema_of_variant(F.try_variant_get(entry, f"$.{f.name}", "variant"))
        return F.when(kind == _KINDS[type(f.dataType)], value) if type(f.dataType) in _KINDS else value

    nested = [f for f in ENTRY if isinstance(f.dataType, T.StructType)]
    # One projection after the other, so that what is used more than once is made once.
    typed = rows.select(*keep, entry, *[read(f).alias(f"_{f.name}") for f in ENTRY])
    held = typed.withColumns({"_held": _held(ENTRY, lambda n: F.col(f"_{n}")), **{f"_held_{f.name}": _held(f.dataType, lambda n, f=f: F.col(f"_{f.name}")[n]) for f in nested}})
    # A struct that does not fit as a whole stays among the outer fields, as it is.
    inner = {f"_rest_{f.name}": F.when(F.col(f"_{f.name}").isNotNull(), _rest(entry, f"$.{f.name}", F.col(f"_held_{f.name}"))) for f in nested}
    rest = held.withColumns({"_rest": _rest(entry, "$", F.col("_held")), **inner})
    inside = F.array_compact(F.array(*[F.when(F.size(f"_rest_{f.name}") > 0, F.struct(F.lit(f.name).alias("name"), F.call_function("to_variant_object", F.col(f"_rest_{f.name}")).alias("v"))) for f in nested]))
    whole = rest.withColumn("_rest", F.map_concat("_rest", F.map_from_entries(inside)))
    more = F.when(F.size("_rest") > 0, F.call_function("to_variant_object", F.col("_rest")))
    return whole.select(*keep, *[F.col(f"_{f.name}").alias(f.name) for f in ENTRY], more.alias(MORE))


def with_more(entries: DataFrame, *keep: str) -> DataFrame:
    """The columns of entries in order, with an empty ``more`` where there is none."""
    more = F.col(MORE) if MORE in entries.columns else F.lit(None).cast("variant").alias(MORE)
    return entries.select(*keep, *ENTRY.names, more)


def as_text(entries: DataFrame) -> DataFrame:
    """``more`` as JSON text, whose keys are sorted, so that it can be compared, hashed and ordered."""
    return entries.withColumn(MORE, F.to_json(MORE))


def as_variant(entries: DataFrame) -> DataFrame:
    return entries.withColumn(MORE, F.try_parse_json(MORE))


def row_text() -> Column:
    """All that an entry holds, as one text to compare by; ``more`` may be text or variant."""
    return F.to_json(F.struct(*ENTRY.names, MORE))


def whole(typed: str, more: str | None) -> str:
    """The JSON text of an entry from that of its typed columns and that of ``more``."""
    entry = json.loads(typed)
    if more:
        for name, value in json.loads(more).items():
            own = entry.get(name)
            entry[name] = {**value, **own} if isinstance(own, dict) and isinstance(value, dict) else value if own is None else own
    return json.dumps(entry, ensure_ascii=False)
