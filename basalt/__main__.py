"""python -m basalt convert IN OUT N [TYPES] [SEP] | print TABLE: delimited text to parquet, and a table as tab-separated lines."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from basalt.sources import text


def main(args: list[str]) -> int:
    if len(args) >= 4 and args[0] == "convert":
        kinds = args[4].split(",") if len(args) > 4 else None
        spark = SparkSession.builder.getOrCreate()
        text.convert(spark, args[1], args[2], int(args[3]), kinds, args[5] if len(args) > 5 else ",")
        return 0
    if len(args) == 2 and args[0] == "print":
        rows = SparkSession.builder.getOrCreate().read.parquet(args[1])
        lines = rows.select(F.concat_ws("\t", *[F.col(f"`{c}`").cast("string") for c in rows.columns]))
        for (line,) in lines.toLocalIterator():  # one partition at a time
            print(line)
        return 0
    print(__doc__)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
