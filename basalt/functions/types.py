"""The closed set of column types, literals checked against them, and fixed-length strings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.errors import SchemaError

LENGTH = "string_length"


@dataclass(frozen=True)
class ColumnType:
    """BOOL, INT, FLOAT, or STRING of a fixed length (blank-padded or cut to it)."""

    kind: str
    length: int | None = None

    def __post_init__(self) -> None:
        if self.kind not in ("BOOL", "INT", "FLOAT", "STRING"):
            raise SchemaError(f"no type {self.kind}")
        if self.kind == "STRING" and (self.length or 0) < 1:
            raise SchemaError("a string needs a length of at least 1")

    @property
    def size(self) -> int:
        """Bytes of a value in a fixed-width record."""
        return {"BOOL": 1, "INT": 4, "FLOAT": 4}.get(self.kind) or self.length

    def spark(self) -> T.DataType:
        return {"BOOL": T.BooleanType(), "INT": T.IntegerType(), "FLOAT": T.FloatType(), "STRING": T.StringType()}[self.kind]


BOOL, INT, FLOAT = ColumnType("BOOL"), ColumnType("INT"), ColumnType("FLOAT")


def string(length: int) -> ColumnType:
    return ColumnType("STRING", length)


def fixed(column: Column, length: int) -> Column:
    """A string cut or blank-padded to a length."""
    return F.rpad(F.substring(column, 1, length), length, " ")


def schema(**columns: ColumnType) -> T.StructType:
    """An ordered schema; string lengths travel in the fields' metadata."""
    return T.StructType([T.StructField(n, t.spark(), True, {LENGTH: t.length} if t.length else {}) for n, t in columns.items()])


def record_bytes(fields: T.StructType, default_string: int = 20) -> int:
    """Bytes of a fixed-width record; strings without a length count as default_string."""
    total = 0
    for f in fields:
        if isinstance(f.dataType, T.BooleanType):
            total += 1
        elif isinstance(f.dataType, T.StringType):
            total += f.metadata.get(LENGTH, default_string)
        else:
            total += 4
    return total


def family(kind: T.DataType) -> str:
    """BOOL, INT, FLOAT or STRING; other types stand for themselves."""
    if isinstance(kind, T.BooleanType):
        return "BOOL"
    if isinstance(kind, T.IntegralType):
        return "INT"
    if isinstance(kind, T.FractionalType):
        return "FLOAT"
    if isinstance(kind, T.StringType):
        return "STRING"
    return kind.simpleString()


def literal(value: object, field: T.StructField) -> Column:
    """The value as a literal of the field's type; null and values of another type are refused."""
    own = family(field.dataType)
    fits = {"BOOL": (bool,), "INT": (int,), "FLOAT": (float, int), "STRING": (str,)}.get(own)
    if value is None:
        raise SchemaError("there is no null")
    if fits is None or not isinstance(value, fits) or isinstance(value, bool) and own != "BOOL":
        raise SchemaError(f"{value!r} is no {own}")
    if own == "STRING" and (n := field.metadata.get(LENGTH)):
        value = value[:n].ljust(n)
    if own == "INT" and isinstance(value, int):
        return F.lit(value)
    return F.lit(float(value) if own == "FLOAT" else value)


def verify(rows: list[tuple], fields: T.StructType) -> list[tuple]:
    """Rows with as many values as fields, each of its field's type; strings of a length are fixed to it."""
    out = []
    for row in rows:
        if len(row) != len(fields):
            raise SchemaError(f"{len(row)} values for {len(fields)} columns")
        own = []
        for v, f in zip(row, fields, strict=True):
            literal(v, f)
            n = f.metadata.get(LENGTH)
            own.append(v[:n].ljust(n) if n else float(v) if family(f.dataType) == "FLOAT" else v)
        out.append(tuple(own))
    return out
