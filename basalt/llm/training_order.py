"""Training-order materialisation: every sequence gets a global slot, and shards hold the slots in order.

Documents' token ids are cut into sequences of `length` ids. Sequences are numbered densely, and a keyed Feistel
permutation over the least even number of bits that holds their number, walked on until it lands below it, maps numbers to slots:
a bijection that needs no table, can be inverted, and is the same at every rerun. Slots are dealt to partitions by range, and each partition
holds whole shards of `per_shard` records in their order.

`write_shards` makes a file of fixed stride of each shard, on any store that Spark writes to: a record is 4 bytes for the number of ids, the ids, zero-filled, and a line end.
Record r of shard s is slot s * per_shard + r, at byte r * stride of its file, whose name follows from s; `ShardReader` seeks there, `read_shards` reads all files on the
executors. Shards are held compressed, a row for each, until files and index are written; exchanges are let go before. `write_records` keeps records as a compressed table
instead, of which a reader that starts at a slot skips the row groups before it.

The only aggregate that is gathered is the number of sequences; offsets of the dense numbers come from buckets of documents
by the hash of their id and ids, of about `BUCKET_ROWS` rows each. Ids travel compressed.

Defined results: a document without ids (null or empty) has one sequence of none; repeated rows have sequences of their own; rows of one id
are ordered by their ids' digest; null document ids are kept; an empty table gives no shards; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.llm.common import as_binary, cut, exchanges_let_go, new_path, pick, sliced, table
from basalt.llm.exchange import mixed

LENGTH = 1024
PER_SHARD = 2048
ROUNDS = 6
BUCKET_ROWS = 5_000


class Feistel:
    """A keyed permutation of 0 ... n - 1."""

    def __init__(self, n: int, key: int, rounds: int = ROUNDS) -> None:
        self.n = n
        self.half = np.uint64(max(1, -(-max(1, n - 1).bit_length() // 2)))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = [mixed(np.array([key & (1 << 64) - 1], np.uint64), np.array([r + 1], np.uint64))[0] for r in range(rounds)]

    def _pass(self, x: np.ndarray, keys: list[np.uint64]) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in keys:
            left, right = right, left ^ (mixed(right, k) & self.mask)
        return right << self.half | left  # halves change places, so that the same passes with keys reversed undo it

    def _walk(self, x: np.ndarray, keys: list[np.uint64]) -> np.ndarray:
        x = self._pass(x.astype(np.uint64), keys)
        out = np.flatnonzero(x >= self.n)
        while len(out):
            x[out] = self._pass(x[out], keys)
            out = out[x[out] >= self.n]
        return x.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, self.keys)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, self.keys[::-1])


def squeezed(df: DataFrame) -> DataFrame:
    """id, n (bytes of ids), h (their digest), ids compressed. df: id, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=1)
        for batch in sliced(batches, 512):
            data = as_binary(batch.column("ids")).to_pylist()
            digests = np.array([xxhash.xxh3_64_intdigest(d) for d in data], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(d) for d in data], pa.int64()), pa.array(digests), pa.array([coder.compress(d) for d in data], pa.binary())], names=["id", "n", "h", "ids"])

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, n bigint, h bigint, ids binary")


def numbered(df: DataFrame, length: int, width: int) -> tuple[DataFrame, int]:
    """df (id, ids) with ids compressed and first: the number of each row's first sequence; and how many sequences there are."""
    count = lambda n: F.greatest(F.ceil(n / (length * width)), F.lit(1))
    rows, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(count(F.coalesce(F.octet_length("ids"), F.lit(0)))), F.lit(0))).first()
    keyed = squeezed(df).withColumn("bucket", F.pmod(F.xxhash64("id", "h"), F.lit(max(1, -(-rows // BUCKET_ROWS))))).withColumn("parts", count(F.col("n")))
    order = Window.partitionBy("bucket").orderBy("h", F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy(F.col("bucket").alias("b")).agg(F.sum("parts").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each bucket
    placed = keyed.withColumn("own", F.coalesce(F.sum("parts").over(order), F.lit(0)))
    return placed.join(sums.select("b", before.alias("before")), F.col("bucket") == F.col("b")).select("id", "ids", (F.col("before") + F.col("own")).alias("first")), int(total)


def dealt_by_slot(records: DataFrame, total: int, per_shard: int) -> tuple[DataFrame, int]:
    """records (with slot) in partitions of whole shards, by slot; and how many shards a partition has."""
    count = -(-total // per_shard)
    wanted = max(1, min(count, max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), count // 16)))
    each = max(1, -(-count // wanted))
    return records.repartitionById(max(1, -(-count // each)), F.floor(F.col("slot") / (per_shard * each)).cast("int")).sortWithinPartitions("slot"), each


def slotted(df: DataFrame, id_col: str, ids_col: str, width: int, key: int = 0, length: int = LENGTH) -> tuple[DataFrame, int]:
    """id, part, slot, n_tokens, tokens: df's sequences, wherever they are; and how many there are. ids_col: little-endian ids of `width` bytes."""
    source, total = numbered(pick(df, id=id_col, ids=ids_col), length, width)
    kind = source.schema["id"].dataType.simpleString()
    order = Feistel(max(1, total), key)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdDecompressor()
        for batch in sliced(batches, 512):
            of, parts, numbers, records = [], [], [], []
            for i, (data, first) in enumerate(zip(batch.column("ids").to_pylist(), batch.column("first").to_pylist(), strict=True)):
                data = coder.decompress(data)
                for p in range(max(1, -(-len(data) // (length * width)))):
                    of.append(i)
                    parts.append(p)
                    numbers.append(first + p)
                    records.append(data[p * length * width : (p + 1) * length * width])
            slots = order.slots(np.array(numbers, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(of, pa.int64())), pa.array(parts, pa.int32()), pa.array(slots, pa.int64()), pa.array(records, pa.binary())], names=["id", "part", "slot", "tokens"])

    made = source.mapInArrow(cut_up, f"id {kind}, part int, slot bigint, tokens binary")
    return made.select("id", "part", "slot", (F.octet_length("tokens") / width).cast("bigint").alias("n_tokens"), "tokens"), total


def sequences(df: DataFrame, id_col: str, ids_col: str, width: int, key: int = 0, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """id, part, slot, shard, n_tokens, tokens: df's sequences in training order. ids_col: little-endian ids of `width` bytes."""
    made, total = slotted(df, id_col, ids_col, width, key, length)
    dealt, _ = dealt_by_slot(made, total, per_shard)
    return dealt.select("id", "part", "slot", F.floor(F.col("slot") / per_shard).alias("shard"), "n_tokens", "tokens")


def write_records(made: DataFrame, path: str) -> None:
    """Sequences as a compressed table in the order of their slots."""
    made.write.option("compression", "zstd").mode("errorifexists").parquet(path)


def read_records(spark: SparkSession, path: str, from_slot: int = 0) -> DataFrame:
    """The records from a slot on; row groups before it are skipped by their statistics."""
    held = spark.read.parquet(path)
    return held.where(F.col("slot") >= from_slot) if from_slot else held


def _put(spark: SparkSession, path: str, content: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(content.encode()))
    out.close()


def packed(dealt: DataFrame, size: int, per_shard: int) -> DataFrame:
    """shard, the ids and parts of its records, and the records as its file holds them, compressed: a row for each shard. dealt: by dealt_by_slot; size: bytes of a record's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=5)
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                own = batch.slice(0, per_shard - sum(x.num_rows for x in held))
                batch = batch.slice(own.num_rows)
                held.append(own)
                if sum(x.num_rows for x in held) == per_shard:
                    yield whole(held, coder)
                    held = []
        if held:
            yield whole(held, coder)

    def whole(held: list[pa.RecordBatch], coder: zstandard.ZstdCompressor) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        first = t["slot"][0].as_py()
        if first % per_shard or not np.array_equal(t["slot"].to_numpy(), np.arange(first, first + t.num_rows)):
            raise ValueError(f"slots from {first} on are not a shard: each must be there once")
        lines = [n.to_bytes(4, "little") + ids.ljust(size, b"\0") for n, ids in zip(t["n_tokens"].to_pylist(), t["tokens"].to_pylist(), strict=True)]
        if any(len(x) != 4 + size for x in lines):
            raise ValueError(f"a sequence has more than {size} bytes of ids")
        lists = [pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t[c].combine_chunks()) for c in ("id", "part")]
        return pa.RecordBatch.from_arrays([pa.array([first // per_shard], pa.int64()), *lists, pa.array([coder.compress(b"\n".join(lines))], pa.binary())], names=["shard", "ids", "parts", "records"])

    kind = dealt.schema["id"].dataType.simpleString()
    return dealt.select("id", "part", "slot", "n_tokens", "tokens").mapInArrow(run, f"shard bigint, ids array<{kind}>, parts array<int>, records binary")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder = zstandard.ZstdDecompressor()
    for batch in sliced(batches, 1):
        yield pa.RecordBatch.from_arrays([pa.array([coder.decompress(x) for x in batch.column("records").to_pylist()], pa.binary())], names=["records"])


def write_shards(made: DataFrame, path: str, width: int, length: int = LENGTH, per_shard: int = PER_SHARD, total: int | None = None) -> None:
    """A file of fixed stride for each shard of sequences, under path/records, what record holds which part of which document in path/index, and the
    figures that a reader needs in path/meta.json, written last. Spark's committer makes each of the two whole or not at all.
    made: slotted's or sequences' rows, computed once; total: how many there are, without which made is computed once more to count them."""
    spark = made.sparkSession
    total = made.count() if total is None else total
    with exchanges_let_go(spark):
        dealt, each = dealt_by_slot(made, total, per_shard)
        held = cut(packed(dealt, length * width, per_shard))
    index = held.select("shard", F.posexplode(F.arrays_zip("ids", "parts")).alias("record", "of"))
    index.select((F.col("shard") * per_shard + F.col("record")).alias("slot"), F.col("of.ids").alias("id"), F.col("of.parts").alias("part")).write.mode("errorifexists").parquet(f"{path}/index")
    shards = held.select("records").mapInArrow(unpacked, "records binary").select(F.col("records").cast("string"))
    shards.write.option("lineSep", "\n").option("maxRecordsPerFile", 1).mode("errorifexists").text(f"{path}/records")
    _put(spark, f"{path}/meta.json", json.dumps({"total": total, "width": width, "length": length, "per_shard": per_shard, "shards_each": each, "stride": 5 + length * width}))


class ShardReader:
    """Reads slots in their order from any slot on: one seek in each shard's file, nothing before it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.conf, self.path = spark._jvm, spark._jsc.hadoopConfiguration(), path
        self.meta = json.loads(self._bytes(f"{path}/meta.json", 0, None))

    def _bytes(self, path: str, start: int, size: int | None) -> bytes:
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        stream = at.getFileSystem(self.conf).open(at)
        try:
            stream.seek(start)
            tool = self.jvm.org.apache.commons.io.IOUtils
            return bytes(tool.toByteArray(stream) if size is None else tool.toByteArray(stream, size))
        finally:
            stream.close()

    def place(self, slot: int) -> tuple[str, int]:
        """The file of a slot's shard and the byte at which its record begins."""
        shard, record = divmod(slot, self.meta["per_shard"])
        part, nth = divmod(shard, self.meta["shards_each"])
        at = self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/records/part-{part:05d}-*-c{nth:03d}.txt")
        (found,) = at.getFileSystem(self.conf).globStatus(at)
        return found.getPath().toString(), record * self.meta["stride"]

    def read(self, slot: int, records: int) -> Iterator[tuple[int, bytes]]:
        """(slot, ids) of so many records, as many as there are."""
        stride, width = self.meta["stride"], self.meta["width"]
        end = min(slot + records, self.meta["total"])
        while slot < end:
            path, start = self.place(slot)
            n = min(end - slot, self.meta["per_shard"] - slot % self.meta["per_shard"])
            data = self._bytes(path, start, n * stride)
            for r in range(n):
                own = data[r * stride : (r + 1) * stride]
                yield slot + r, own[4 : 4 + int.from_bytes(own[:4], "little") * width]
            slot += n


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """slot, shard, byte_offset, n_tokens, tokens of all records, from the shards' files, each read whole by a task."""
    meta = ShardReader(spark, path).meta
    total, width, per_shard, each, stride = (meta[k] for k in ("total", "width", "per_shard", "shards_each", "stride"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            (name,), (data,) = batch.column("path").to_pylist(), batch.column("content").to_pylist()
            part, nth = map(int, re.search(r"part-(\d+)-[^/]*-c(\d+)\.txt$", name).groups())
            shard = part * each + nth
            n = max(0, min(per_shard, total - shard * per_shard))
            if len(data) != n * stride:
                raise ValueError(f"{name} has {len(data)} bytes, its {n} records have {n * stride}")
            starts = np.arange(n, dtype=np.int64) * stride
            counts = [int.from_bytes(data[s : s + 4], "little") for s in starts.tolist()]
            tokens = [data[s + 4 : s + 4 + c * width] for s, c in zip(starts.tolist(), counts, strict=True)]
            slots = np.arange(n, dtype=np.int64) + shard * per_shard
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(np.full(n, shard, np.int64)), pa.array(starts), pa.array(counts, pa.int64()), pa.array(tokens, pa.binary())], names=["slot", "shard", "byte_offset", "n_tokens", "tokens"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.txt").load(f"{path}/records").select("path", "content")
    if (there := len(files._jdf.inputFiles())) < (count := -(-total // per_shard)):
        raise ValueError(f"{path}/records has {there} of {count} shards")
    return files.mapInArrow(run, "slot bigint, shard bigint, byte_offset bigint, n_tokens bigint, tokens binary")


def op4_training_order(spark, sf_dir: str) -> DataFrame:
    """Every whole text's bytes, as ids of a byte vocabulary, in shards of fixed stride in the shared folder, each record read back from its byte there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("ids"))
    path = new_path(spark, "shards")
    made, total = slotted(docs, "doc_id", "ids", width=1, key=20240607)
    write_shards(made, path, width=1, total=total)
    back = read_shards(spark, path).select("slot", "shard", "byte_offset", "n_tokens", F.unhex(F.sha2("tokens", 256)).alias("digest"))
    index = spark.read.parquet(f"{path}/index")
    return back.join(index, "slot").select(F.col("id").alias("doc_id"), "part", "slot", "shard", "byte_offset", "n_tokens", F.lower(F.hex("digest")).alias("tokens_sha256"))
