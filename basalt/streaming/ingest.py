"""Text files that arrive in a folder, appended to a parquet table as they come."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from basalt.functions.types import LENGTH, fixed


def append_text(spark: SparkSession, folder: str, table: str, checkpoint: str, fields: T.StructType, sep: str = ",", once: bool = True) -> StreamingQuery:
    """Each file is taken once, whatever fails and restarts; strings are trimmed, and fixed to their length. once: end when all are in."""
    raw = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
    rows = spark.readStream.schema(raw).options(sep=sep, mode="FAILFAST", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).csv(folder)
    for f in fields:
        if isinstance(f.dataType, T.StringType):
            c = F.trim(F.col(f.name))
            rows = rows.withColumn(f.name, fixed(c, f.metadata[LENGTH]) if LENGTH in f.metadata else c)
    writer = rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
