"""Delimited text in and out, with explicit schemas only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.functions.types import LENGTH, fixed

#: Strings of the text converter are cut to so many characters.
TEXT_LENGTH = 128


def read_text(spark: SparkSession, path: str, fields: T.StructType, sep: str = ",", mode: str = "FAILFAST") -> DataFrame:
    """Rows of delimited text. Strings are trimmed; those of a length are fixed to it. Blank lines don't count.

    A value that its column can't hold is an error, or null with mode PERMISSIVE; a row never shifts.
    """
    raw = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
    rows = spark.read.schema(raw).options(sep=sep, mode=mode, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).csv(path)
    out = []
    for f in fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = fixed(F.trim(c), f.metadata[LENGTH]) if LENGTH in f.metadata else F.trim(c)
        out.append(c.alias(f.name, metadata=f.metadata))
    return rows.select(out)


def text_schema(n: int, types: list[str] | None = None) -> T.StructType:
    """n columns c0, c1, ... of 'int' (unless told) or 'string'."""
    kinds = {"int": T.IntegerType(), "string": T.StringType()}
    return T.StructType([T.StructField(f"c{i}", kinds[(types or ["int"] * n)[i]], True) for i in range(n)])


def string_rule(column, length: int = TEXT_LENGTH):
    """A text field as the converter keeps it: trimmed and cut."""
    return F.substring(F.trim(column), 1, length)


def convert(spark: SparkSession, text_path: str, out_path: str, n: int, types: list[str] | None = None, sep: str = ",", mode: str = "FAILFAST") -> None:
    """Delimited text to parquet; a last line without a line end counts."""
    fields = text_schema(n, types)
    rows = read_text(spark, text_path, fields, sep, mode)
    rows.select([string_rule(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in fields]).write.mode("errorifexists").parquet(out_path)


def print_rows(df: DataFrame, path: str) -> None:
    """All rows as tab-separated text."""
    df.write.option("sep", "\t").csv(path)
