"""Edits as functions from a table's state to its next one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.errors import SchemaError
from basalt.functions.types import family, literal, verify
from basalt.operators.query import quoted


def insert(df: DataFrame, rows: DataFrame | list[tuple], unique: tuple[str, ...] = ()) -> DataFrame:
    """df and more rows. Values are checked against df's schema, and keys of `unique` columns before anything is written."""
    new = rows if isinstance(rows, DataFrame) else df.sparkSession.createDataFrame(verify(rows, df.schema), df.schema)
    if [(f.name, family(f.dataType)) for f in new.schema] != [(f.name, family(f.dataType)) for f in df.schema]:
        raise SchemaError("the new rows have another schema")
    for c in unique:
        require_new_keys(df, new, c)
    return df.unionByName(new.select([quoted(f.name).cast(f.dataType).alias(f.name) for f in df.schema]))


def require_new_keys(df: DataFrame, new: DataFrame, column: str) -> None:
    """Refuses keys that the new rows hold twice or that df holds already, in one job."""
    keys = new.groupBy(quoted(column).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    held = df.select(quoted(column).alias("held"))
    if keys.where("n > 1").select("k").unionByName(keys.join(held, F.col("k") == F.col("held"), "left_semi").select("k")).limit(1).count():
        raise SchemaError(f"{column} has duplicate keys")


def delete_where(df: DataFrame, column: str, value: object) -> DataFrame:
    """df without the rows whose column equals the value."""
    return df.where(~F.coalesce(quoted(column) == literal(value, df.schema[column]), F.lit(False)))


def update_where(df: DataFrame, set_column: str, set_value: object, column: str, value: object) -> DataFrame:
    """df with set_column = set_value where column equals the value."""
    hit = quoted(column) == literal(value, df.schema[column])
    new = F.when(hit, literal(set_value, df.schema[set_column]).cast(df.schema[set_column].dataType)).otherwise(quoted(set_column))
    return df.select([new.alias(c, metadata=df.schema[c].metadata) if c == set_column else quoted(c) for c in df.columns])


def update_record(df: DataFrame, key_column: str, key: object, values: dict[str, object]) -> DataFrame:
    """df with all given columns of the record with this key set at once; the key itself may be among them."""
    hit = quoted(key_column) == literal(key, df.schema[key_column])
    for c in values:
        if c not in df.columns:
            raise SchemaError(f"no column {c}")
    new = {c: F.when(hit, literal(v, df.schema[c]).cast(df.schema[c].dataType)).otherwise(quoted(c)).alias(c, metadata=df.schema[c].metadata) for c, v in values.items()}
    return df.select([new.get(c, quoted(c)) for c in df.columns])


class Batch:
    """Edits that are applied in order and written once: all or none."""

    def __init__(self) -> None:
        self.edits: list[Callable[[DataFrame], DataFrame]] = []

    def insert(self, rows: DataFrame | list[tuple], unique: tuple[str, ...] = ()) -> Batch:
        self.edits.append(lambda df: insert(df, rows, unique))
        return self

    def delete_where(self, column: str, value: object) -> Batch:
        self.edits.append(lambda df: delete_where(df, column, value))
        return self

    def update_where(self, set_column: str, set_value: object, column: str, value: object) -> Batch:
        self.edits.append(lambda df: update_where(df, set_column, set_value, column, value))
        return self

    def update_record(self, key_column: str, key: object, values: dict[str, object]) -> Batch:
        self.edits.append(lambda df: update_record(df, key_column, key, values))
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        for edit in self.edits:
            df = edit(df)
        return df
