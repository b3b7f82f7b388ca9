"""What a unique index is for, on sorted layouts: lookups, ranges, key order, and the leaves of a bulk load."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.errors import SchemaError
from basalt.functions.predicates import compare
from basalt.functions.types import literal
from basalt.operators.query import quoted
from basalt.sources.scratch import cut


def require_unique(df: DataFrame, key: str) -> None:
    if df.groupBy(quoted(key)).count().where("count > 1").limit(1).count():
        raise SchemaError(f"{key} has duplicate keys")


def sorted_layout(df: DataFrame, key: str) -> DataFrame:
    """Files by key range and sorted within, so that the parquet statistics prune lookups and ranges."""
    return df.repartitionByRange(quoted(key)).sortWithinPartitions(quoted(key))


def _field(df: DataFrame, column: str) -> T.StructField:
    if column not in df.columns:
        raise SchemaError(f"no column {column}")
    return df.schema[column]


def lookup(df: DataFrame, column: str, key: object) -> DataFrame:
    return df.where(quoted(column) == literal(key, _field(df, column)))


def contains(df: DataFrame, column: str, key: object) -> DataFrame:
    """One row: found."""
    return lookup(df, column, key).agg((F.count(F.lit(1)) > 0).alias("found"))


def range_scan(df: DataFrame, column: str, op: str, key: object, ordered: bool = False) -> DataFrame:
    """Rows whose key compares so; in key order if asked."""
    found = df.where(compare(quoted(column), op, literal(key, _field(df, column))))
    return found.orderBy(quoted(column)) if ordered else found


def sorted_scan(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(quoted(column))


def sorted_scan_from(df: DataFrame, column: str, start: object) -> DataFrame:
    return range_scan(df, column, ">=", start, ordered=True)


def ranked(df: DataFrame, key: str) -> DataFrame:
    """df with `rank`, 1 for the least key (nulls first); rows of equal keys rank in any order.

    A global sort deals rows to ranges; within a key rows are ordered by their hash, so the range partitioner can split a key that many rows share.
    The sorted rows are held once, so a row's rank is its place in its partition and the rows of the partitions before, one number for each partition.
    """
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    own = F.col(f"c{names.index(key)}")
    placed = cut(plain.orderBy(own, F.xxhash64(*plain.columns))).withColumn("row", F.monotonically_increasing_id())
    part, nth = F.shiftright("row", 33), F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    joined = placed.join(F.broadcast(sizes.select("part", before.alias("before"))), part == F.col("part"))
    return joined.select(*plain.columns, (F.col("before") + nth + 1).alias("rank")).toDF(*names, "rank")


def bulk_load_layout(df: DataFrame, key: str, order: int, fill: float) -> DataFrame:
    """key, leaf, slot: where each key stands when a tree of this order is loaded in key order, leaves filled to a share."""
    per_leaf = math.ceil(2 * order * fill)
    at = F.col("rank") - 1
    return ranked(df.select(quoted(key)), key).select(quoted(key), F.floor(at / per_leaf).alias("leaf"), (at % per_leaf).alias("slot"))
