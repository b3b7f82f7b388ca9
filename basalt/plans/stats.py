"""Table statistics as DataFrames: fixed-width histograms, filter masks, and size estimates.

A histogram is a table of buckets (bucket, low, high, count, distinct) of one column. It is one aggregation over the column for its range and
one for its buckets; only the two bounds of the range reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.errors import QueryError
from basalt.functions.hashing import string_number
from basalt.functions.predicates import Op
from basalt.functions.types import family, record_bytes
from basalt.operators.query import quoted

BUCKETS = 10
PAGE_BYTES = 4096
#: Ranges narrower than this, and values closer than this to the top, belong to the last bucket.
TINY = 1e-5


def number(column: Column, kind: T.DataType) -> Column:
    """What a histogram takes for a value: 0 or 1 of a boolean, a string's hash, a number itself."""
    own = family(kind)
    if own == "STRING":
        return string_number(column).cast("double")
    if own in ("BOOL", "INT", "FLOAT"):
        return column.cast("double")
    raise QueryError(f"no histogram of {own}")


def bucket_of(value: Column, low: float, high: float, buckets: int) -> Column:
    width = (high - low) / buckets
    if width < TINY:
        return F.lit(buckets - 1)
    return F.when(F.abs(value - F.lit(high)) < TINY, buckets - 1).otherwise(F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(buckets - 1))).cast("int")


def histogram(df: DataFrame, column: str, buckets: int = BUCKETS) -> DataFrame:
    """bucket, low, high, count, distinct: a row for each bucket. An empty column has no buckets."""
    value = number(quoted(column), df.schema[column].dataType)
    values = df.select(value.alias("v")).where("v is not null")
    low, high = values.agg(F.min("v"), F.max("v")).first()
    spark = df.sparkSession
    if low is None:
        return spark.createDataFrame([], "bucket int, low double, high double, count bigint, distinct bigint")
    width = (high - low) / buckets
    counted = values.groupBy(bucket_of(F.col("v"), low, high, buckets).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("d"))
    all_ = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    joined = all_.join(counted, F.col("bucket") == F.col("b"), "left")
    edge = lambda i: F.lit(low) + i * F.lit(width)
    return joined.select("bucket", edge(F.col("bucket")).alias("low"), edge(F.col("bucket") + 1).alias("high"), F.coalesce("n", F.lit(0)).alias("count"), F.coalesce("d", F.lit(0)).alias("distinct"))


def with_mask(hist: DataFrame, op: Op | str, value: float, is_string: bool = False) -> DataFrame:
    """hist and `mask`: the share of each bucket's rows that the comparison keeps."""
    op = Op.of(op)
    first = hist.agg(F.min("low"), F.max("high"), F.count(F.lit(1))).first()
    if first[0] is None:
        return hist.withColumn("mask", F.lit(None).cast("double"))
    low, high, buckets = first
    width = (high - low) / buckets
    flat = width < TINY
    top = buckets - 1
    if flat:
        at = top if abs(value - low) < TINY else -1 if value < low else buckets
    else:
        at = top if abs(value - high) < TINY else int((value - low) // width) if low <= value < high else -1 if value < low else buckets
    bucket = F.col("bucket")
    share = F.when(F.col("distinct") > 0, 1 / F.col("distinct")).otherwise(0.0)
    equal = F.when(bucket == at, share).otherwise(0.0)
    above = F.when(bucket > at, 1.0).when(bucket == at, F.lit(0.0) if flat else (F.col("high") - F.lit(value)) / F.lit(width)).otherwise(0.0)
    below = F.when(bucket < at, 1.0).when(bucket == at, F.lit(0.0) if flat else (F.lit(value) - F.col("low")) / F.lit(width)).otherwise(0.0)
    if is_string and op not in (Op.EQUALS, Op.NOT_EQUALS, Op.LIKE):
        mask = F.lit(1.0)  # hashes have no order
    else:
        mask = {
            Op.EQUALS: equal,
            Op.LIKE: equal,
            Op.NOT_EQUALS: 1 - equal,
            Op.GREATER_THAN: above,
            Op.LESS_THAN: below,
            Op.GREATER_THAN_EQUALS: F.greatest(above, equal),
            Op.LESS_THAN_EQUALS: F.greatest(below, equal),
        }[op]
    return hist.withColumn("mask", mask)


def reduction_factor(hist: DataFrame, op: Op | str, value: float, is_string: bool = False) -> DataFrame:
    """One row: the share of distinct values that the comparison keeps."""
    return with_mask(hist, op, value, is_string).agg((F.sum(F.col("mask") * F.col("distinct")) / F.sum("distinct")).alias("reduction_factor"))


def after_predicate(hist: DataFrame, op: Op | str, value: float, is_string: bool = False) -> DataFrame:
    """The histogram after the comparison."""
    m = with_mask(hist, op, value, is_string)
    return m.select("bucket", "low", "high", *[F.round(F.col("mask") * F.col(c)).cast("bigint").alias(c) for c in ("count", "distinct")])


def after_reduction(hist: DataFrame, factor: float) -> DataFrame:
    """The histogram after an independent predicate that keeps a share of all rows."""
    return hist.select("bucket", "low", "high", *[F.round(F.col(c) * factor).cast("bigint").alias(c) for c in ("count", "distinct")])


def records_per_page(bytes_: int, page: int = PAGE_BYTES) -> int:
    """Records and a bit for each in a page, down to a multiple of 8."""
    return 8 * page // (1 + 8 * bytes_) // 8 * 8


def table_stats(df: DataFrame, default_string: int = 20) -> DataFrame:
    """One row: num_rows, record_bytes, records_per_page, num_pages."""
    size = record_bytes(df.schema, default_string)
    per = records_per_page(size)
    rows = F.count(F.lit(1))
    return df.agg(rows.alias("num_rows"), F.lit(size).alias("record_bytes"), F.lit(per).alias("records_per_page"), F.ceil(rows / per).alias("num_pages"))


def has_histogram(field: T.StructField) -> bool:
    return family(field.dataType) in ("BOOL", "INT", "FLOAT", "STRING")


def table_histograms(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """column, bucket, low, high, count, distinct: the histograms of all columns that have one.

    One aggregation finds all ranges, of which one row reaches the driver, and one fills all buckets: (column, value) is counted first, so
    a value that most rows share is one row after the map-side sums. An empty table has no buckets.
    """
    spark = df.sparkSession
    fields = [(i, f) for i, f in enumerate(df.schema) if has_histogram(f)]
    empty = spark.createDataFrame([], "column string, bucket int, low double, high double, count bigint, distinct bigint")
    if not fields:
        return empty
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    values = plain.select([number(F.col(f"c{i}"), f.dataType).alias(f"v{i}") for i, f in fields])
    ends = values.agg(*[F.min(f"v{i}").alias(f"low{i}") for i, _ in fields], *[F.max(f"v{i}").alias(f"high{i}") for i, _ in fields]).first()
    found = [(i, f.name, ends[f"low{i}"], ends[f"high{i}"]) for i, f in fields if ends[f"low{i}"] is not None]
    if not found:
        return empty
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), bucket_of(F.col(f"v{i}"), low, high, buckets).alias("b"), F.col(f"v{i}").alias("v")) for k, (i, _, low, high) in enumerate(found)])
    told = values.select(F.explode(pairs).alias("p")).select("p.*").where("v is not null")
    counted = told.groupBy("k", "b", "v").agg(F.count(F.lit(1)).alias("n")).groupBy("k", "b").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"))
    heads = spark.createDataFrame([(k, name, low, (high - low) / buckets, b) for k, (_, name, low, high) in enumerate(found) for b in range(buckets)], "hk int, column string, first double, width double, bucket int")
    both = heads.join(counted, (F.col("hk") == F.col("k")) & (F.col("bucket") == F.col("b")), "left")
    edge = lambda i: F.col("first") + i * F.col("width")
    return both.select("column", "bucket", edge(F.col("bucket")).alias("low"), edge(F.col("bucket") + 1).alias("high"), F.coalesce("n", F.lit(0)).alias("count"), F.coalesce("d", F.lit(0)).alias("distinct"))


def stats_after_predicate(histograms: DataFrame, column: str, op: Op | str, value: float, is_string: bool = False) -> DataFrame:
    """All histograms after a comparison on one column: its own by the mask, the others by its reduction factor, as of independent columns."""
    own = with_mask(histograms.where(F.col("column") == column).drop("column"), op, value, is_string)
    factor = own.agg((F.sum(F.col("mask") * F.col("distinct")) / F.sum("distinct")).alias("factor"))
    masked = own.select(F.lit(column).alias("column"), "bucket", "low", "high", "count", "distinct", "mask")
    others = histograms.where(F.col("column") != column).join(F.broadcast(factor), F.lit(True)).withColumnRenamed("factor", "mask")
    return masked.unionByName(others).select("column", "bucket", "low", "high", *[F.round(F.col("mask") * F.col(c)).cast("bigint").alias(c) for c in ("count", "distinct")])


def stats_after_join(left: DataFrame, left_column: str, right: DataFrame, right_column: str) -> tuple[DataFrame, DataFrame]:
    """(histograms of both sides' columns after an equi-join, one row with estimated_rows), from the sides' histograms.

    Of a side with d distinct keys a share of (d + 1) over the larger side's (d + 1) keeps its place; rows are the product over the larger number of keys + 1.
    """
    keys = lambda h, c, n: h.where(F.col("column") == c).agg(F.sum("distinct").alias(f"{n}_distinct"), F.sum("count").alias(f"{n}_rows"))
    both = keys(left, left_column, "left").join(keys(right, right_column, "right"), F.lit(True))
    most = F.greatest("left_distinct", "right_distinct") + 1
    estimate = both.select("left_rows", "right_rows", F.floor(F.col("left_rows") * F.col("right_rows") / most).alias("estimated_rows"))
    shares = both.select(*[((F.col(f"{n}_distinct") + 1) / most).alias(n) for n in ("left", "right")])

    def scaled(h: DataFrame, side: str) -> DataFrame:
        of = h.join(F.broadcast(shares), F.lit(True))
        return of.select(F.lit(side).alias("side"), "column", "bucket", "low", "high", *[F.round(F.col(c) * F.col(side)).cast("bigint").alias(c) for c in ("count", "distinct")])

    return scaled(left, "left").unionByName(scaled(right, "right")), estimate


def join_estimate(left: DataFrame, left_column: str, right: DataFrame, right_column: str) -> DataFrame:
    """One row: left_rows, right_rows, estimated_rows = left * right / (most distinct keys + 1)."""
    side = lambda df, c, p: df.agg(F.count(F.lit(1)).alias(f"{p}_rows"), F.count_distinct(quoted(c)).alias(f"{p}_distinct")).withColumn(f"{p}_one", F.lit(1))
    both = side(left, left_column, "left").join(side(right, right_column, "right"), F.col("left_one") == F.col("right_one"))
    return both.select("left_rows", "right_rows", F.floor(F.col("left_rows") * F.col("right_rows") / (F.greatest("left_distinct", "right_distinct") + 1)).alias("estimated_rows"))


def join_cost(left: DataFrame, right: DataFrame, memory_pages: int = 5, default_string: int = 20) -> DataFrame:
    """One row: pages of both sides and what both nested loops would read of them, as a report; joins themselves are the optimizer's choice."""
    side = lambda df, p: table_stats(df, default_string).select(F.col("num_rows").alias(f"{p}_rows"), F.col("num_pages").alias(f"{p}_pages"), F.lit(1).alias(f"{p}_one"))
    both = side(left, "left").join(side(right, "right"), F.col("left_one") == F.col("right_one"))
    simple = F.col("left_rows") * F.col("right_pages") + F.col("left_pages")
    block = F.ceil(F.col("left_pages") / (memory_pages - 2)) * F.col("right_pages") + F.col("left_pages")
    return both.select("left_pages", "right_pages", simple.alias("simple_cost"), block.alias("block_cost"))
