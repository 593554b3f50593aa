"""Typed JSON in and out: 64-bit integers as text, bytes as base64."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import to_bool
from ..schema import ID, NUMERIC, SPARK_TYPES, Field

SAFE_INTEGER = 2**53 - 1
_WIDE = {"int64", "uint64"}


def _lossy(column: str, name: str) -> Column:
    """Whether a member of a JSON object is a bare number beyond SAFE_INTEGER, which senders may have rounded already."""
    v = F.try_parse_json(F.col(column))
    path = "$['" + name.replace("'", "\\'") + "']"
    bare = F.schema_of_variant(F.try_variant_get(v, path, "variant")) != "STRING"
    return F.coalesce(bare & (F.abs(F.try_variant_get(v, path, "double")) > SAFE_INTEGER), F.lit(False))


def coerce(text: Column, kind: str, *, lenient: bool = False) -> Column:
    """A JSON scalar (as text) in the type of a field.

    Casts raise on what is no value of the type. Lenient ones follow loose rules first:
    the empty text is 0 and true is 1 for numbers; unknown words are false for booleans.
    """
    if kind == "bool":
        return F.when(text.isNotNull(), to_bool(text))
    if kind == "bytes":
        return F.to_binary(text, F.lit("base64"))
    if kind in NUMERIC and lenient:
        text = F.when(F.trim(text) == "", F.lit("0")).when(text == "true", F.lit("1")).when(text == "false", F.lit("0")).otherwise(text)
    out = text.cast(SPARK_TYPES[kind])
    if kind in ("float", "double"):
        out = F.when(F.isnan(out) | (F.abs(out) == float("inf")), F.raise_error(F.lit("a number must be finite"))).otherwise(out)
    if kind in ("uint32", "uint64"):
        out = F.when(out < 0, F.raise_error(F.lit("an unsigned number is negative"))).otherwise(out)
    return out


def parse(rows: DataFrame, column: str, fields: Sequence[Field], *, lenient: bool = False) -> DataFrame:
    """Records from a column of JSON objects; unknown keys are dropped, absent ones are null.

    Wide integers beyond SAFE_INTEGER are refused unless they come as text.
    """
    schema = ", ".join(f"`{f.name}` string" for f in [Field(1, ID, "int64"), *fields])
    wide = [f.name for f in (Field(1, ID, "int64"), *fields) if f.type in _WIDE]
    lossy = F.array_compact(F.array(*[F.when(_lossy(column, n), F.lit(n)) for n in wide]))
    parsed = rows.select(F.from_json(column, schema).alias("r"), lossy.alias("lossy"))
    safe = F.when(F.size("lossy") > 0, F.raise_error(F.concat(F.lit("send as text: "), F.array_join("lossy", ", "))))
    cols = [coerce(F.col(f"r.`{f.name}`"), f.type, lenient=lenient).alias(f.name) for f in fields]
    return parsed.select(F.coalesce(safe.cast("long"), F.col(f"r.{ID}").cast("long")).alias(ID), *cols)


def unknown_keys(column: str, fields: Sequence[Field]) -> Column:
    """Keys of a JSON object that are no field: strict mode refuses rows that have some."""
    return F.array_except(F.json_object_keys(F.col(column)), F.array(*[F.lit(x) for x in (ID, *(f.name for f in fields))]))


def render(records: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """JSON text of each record; absent fields are left out."""
    cols = [F.col(ID).cast("string").alias(ID)]
    for f in fields:
        c = F.col(f.name)
        cols.append((F.base64(c) if f.type == "bytes" else c.cast("string") if f.type in ("int64", "uint64") else c).alias(f.name))
    return records.select(F.to_json(F.struct(*cols)).alias("json"))
