"""Collection schemas: numbered, typed fields and the rules they obey."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The type names of the schema language.
SPARK_TYPES: dict[str, T.DataType] = {
    "bool": T.BooleanType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "uint32": T.LongType(),
    "uint64": T.DecimalType(20, 0),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "bytes": T.BinaryType(),
}
NUMERIC = {"int32", "int64", "uint32", "uint64", "float", "double"}
#: Types that are stored alike, so that old bytes could be read as the new type.
FAMILY = {"bool": 0, "int32": 0, "int64": 0, "uint32": 0, "uint64": 0, "double": 1, "float": 2, "string": 3, "bytes": 3}
ID = "_id"


class SchemaError(ValueError):
    """A field or schema that breaks a rule."""


@dataclass(frozen=True)
class Field:
    """A field is its number; name and flags may change. bucket_width is the width of range buckets."""

    no: int
    name: str
    type: str
    index: bool = False
    blind: bool = False
    required: bool = False
    bucket_width: float | None = None
    disk: bool = False

    @property
    def indexed(self) -> bool:
        return self.index or self.blind or self.bucket_width is not None

    @property
    def column(self) -> str:
        """The stored column: named by number, so that a rename touches no data."""
        return f"f{self.no}"


def checked(fields: Iterable[Field], reserved: Iterable[int] = ()) -> list[Field]:
    """The fields, if they obey the rules; else SchemaError."""
    fields, reserved = list(fields), set(reserved)
    numbers: set[int] = set()
    names: set[str] = set()
    for f in fields:
        if f.no == 1 or f.name == ID:
            raise SchemaError(f"{f.name}: number 1 and the name {ID} are the record's id")
        if f.no < 1:
            raise SchemaError(f"{f.name}: field numbers are positive")
        if f.no in reserved:
            raise SchemaError(f"{f.name}: number {f.no} belonged to a dropped field")
        if f.type not in SPARK_TYPES:
            raise SchemaError(f"{f.name}: unknown type {f.type!r}")
        if f.type == "bytes" and (f.index or f.blind):
            raise SchemaError(f"{f.name}: bytes cannot be indexed")
        if f.bucket_width is not None and (f.type not in NUMERIC or not f.bucket_width > 0):
            raise SchemaError(f"{f.name}: range buckets need a number and a width above 0")
        if f.disk and not f.indexed:
            raise SchemaError(f"{f.name}: a disk index needs an index")
        if f.no in numbers or f.name in names:
            raise SchemaError(f"{f.name}: number or name used twice")
        numbers.add(f.no)
        names.add(f.name)
    return fields


def struct(fields: Iterable[Field]) -> T.StructType:
    """Logical record type, id first; the number travels in the metadata."""
    out = [T.StructField(ID, T.LongType(), False, {"no": 1})]
    return T.StructType(out + [T.StructField(f.name, SPARK_TYPES[f.type], True, {"no": f.no}) for f in fields])


def stored(fields: Iterable[Field]) -> T.StructType:
    """Payload type in the log: columns named by number."""
    return T.StructType([T.StructField(f.column, SPARK_TYPES[f.type], True) for f in fields])


def logical(payload: DataFrame, fields: Iterable[Field]) -> DataFrame:
    """Stored columns under their present names; a number that the data lack is null, a dropped one is not read."""
    have = set(payload.columns)
    return payload.select(ID, *[(F.col(f.column) if f.column in have else F.lit(None)).cast(SPARK_TYPES[f.type]).alias(f.name) for f in fields])


def to_json(fields: Iterable[Field]) -> list[dict]:
    return [asdict(f) for f in fields]


def from_json(rows: Iterable[dict]) -> list[Field]:
    return [Field(**r) for r in rows]


def renamed(field: Field, name: str) -> Field:
    return replace(field, name=name)
