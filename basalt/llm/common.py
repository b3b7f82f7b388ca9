"""Shared pieces of the training-data operators: column picking, lineage cuts, Arrow access."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words in every contract: blank, and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the named columns, under the operator's own names: pick(df, doc_id="id", text="body").

    Columns are found by exact name, the first one where a name repeats, so extra columns never
    clash with what an operator adds (whatever their names or case).
    """
    names = df.columns
    missing = [c for c in wanted.values() if c not in names]
    if missing:
        raise ValueError(f"no column {missing} among {names}")
    small_batches(df.sparkSession)
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"c{names.index(src)}").alias(dst) for dst, src in wanted.items()])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. One's own is set only where the session names none."""
    sc = spark.sparkContext
    if held := sc._jsc.sc().getCheckpointDir().isDefined() and sc._jsc.sc().getCheckpointDir().get():
        return held
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="basalt-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows in a batch that goes to Python: texts are long, and the JVM and the worker hold a batch or two each.
BATCH_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows in an Arrow batch from Spark's default. A figure of one's own stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)


def cut(df: DataFrame) -> DataFrame:
    """df computed once and held in the shared checkpoint folder, which outlives any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def exchanges_let_go(spark: SparkSession) -> Iterator[None]:
    """Queries made in here delete the files of their exchanges when they end, not when the driver's garbage happens to be collected. The session's own setting comes back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: What a Python worker holds between the tasks of one operator. Other operators' tasks drop it.
HELD: dict[str, tuple[int, object]] = {}


def tidy(keep: bool = False) -> None:
    """Gives a Python worker's free memory back to the system, since idle workers stay. keep: but for HELD."""
    if not keep:
        HELD.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def crc32_mod(id_col: Column, n: int) -> Column:
    """crc32(id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1024, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, so that a worker holds few results at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
        tidy(keep)


def as_binary(column: pa.Array) -> pa.Array:
    """A text column of an Arrow batch as UTF-8 bytes; null becomes empty."""
    if pa.types.is_null(column.type):
        return pa.array([b""] * len(column), pa.binary())
    return pc.fill_null(column.cast(pa.binary()), b"")


def as_texts(column: pa.Array) -> list[str]:
    if pa.types.is_null(column.type):
        return [""] * len(column)
    return pc.fill_null(column, "").to_pylist()


def text_bytes(df: DataFrame, text: str) -> int:
    """How many bytes of text df holds, counted: files are compressed, so their size says little."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0])
