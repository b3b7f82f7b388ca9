import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.llm import training_order as to


@pytest.mark.parametrize("n", [1, 2, 3, 100, 1000, 4097])
def test_permutation(n):
    order = to.Feistel(n, key=99)
    slots = order.slots(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n)) and order.numbers(slots).tolist() == list(range(n))
    if n > 50:
        assert not np.array_equal(slots, to.Feistel(n, key=98).slots(np.arange(n)))
        assert abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.4


def rows():
    return [(i, b"" if i % 11 == 0 else bytes(range(i % 250)) * (i % 5 + 1)) for i in range(200)] + [(7, b"again"), (7, b"again"), (None, b"no id"), (8, None), (9, b"z" * 30_000)]


def brute(width, length):
    out = []
    for i, data in rows():
        data = data or b""
        step = width * length
        out += [(i, p, data[p * step : (p + 1) * step]) for p in range(max(1, -(-len(data) // step)))]
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket", [20_000, 10])
def test_records_come_back(spark, tmp_path, monkeypatch, bucket):
    monkeypatch.setattr(to, "BUCKET_ROWS", bucket)
    df = spark.createDataFrame([(*r, 1) for r in rows()], "doc_id bigint, ids binary, slot int").repartition(3)
    made = to.sequences(df, "doc_id", "ids", width=1, key=5, length=64, per_shard=50)
    to.write_records(made, str(tmp_path / "records"))
    back = to.read_records(spark, str(tmp_path / "records")).collect()
    assert sorted(((r.id, r.part, bytes(r.tokens)) for r in back), key=str) == brute(1, 64)
    assert sorted(r.slot for r in back) == list(range(len(back)))
    assert all(r.shard == r.slot // 50 and r.n_tokens == len(r.tokens) for r in back)
    later = to.read_records(spark, str(tmp_path / "records"), from_slot=77)
    assert sorted(r.slot for r in later.collect()) == list(range(77, len(back)))
    assert "GreaterThanOrEqual(slot,77)" in later._jdf.queryExecution().executedPlan().toString()
    again = to.sequences(df.repartition(5), "doc_id", "ids", width=1, key=5, length=64, per_shard=50).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, back), key=str)


def test_shards_of_fixed_stride_are_read_from_a_byte(spark, tmp_path):
    df = spark.createDataFrame(rows(), "doc_id bigint, ids binary").repartition(3)
    made = to.sequences(df, "doc_id", "ids", width=2, key=5, length=32, per_shard=50)
    path = str(tmp_path / "shards")
    to.write_shards(made, path, width=2, length=32, per_shard=50)
    want = {r.slot: bytes(r.tokens)[: r.n_tokens * 2] for r in made.collect()}
    reader = to.ShardReader(spark, path)
    files = {reader.place(s)[0] for s in range(0, len(want), 50)}
    assert len(files) == -(-len(want) // 50) > 5
    assert dict(reader.read(0, 10**6)) == want
    place, start = reader.place(120)
    assert start == 20 * 69
    file = place.removeprefix("file:")
    with open(file, "r+b") as f:  # what stands before the byte is never looked at
        f.write(b"\xff" * start)
    (tmp_path / "shards/records" / ("." + file.rsplit("/", 1)[1] + ".crc")).unlink()
    assert dict(reader.read(120, 75)) == {s: want[s] for s in range(120, 195)}
    held = {(r.slot, r.id, r.part) for r in spark.read.parquet(path + "/index").collect()}
    assert held == {(r.slot, r.id, r.part) for r in made.collect()}


def test_wider_ids(spark):
    ids = np.arange(300, dtype="<u4")
    df = spark.createDataFrame([(1, bytearray(ids.tobytes()))], "doc_id int, ids binary")
    back = to.sequences(df, "doc_id", "ids", width=4, length=128).orderBy("part").collect()
    assert np.array_equal(np.concatenate([np.frombuffer(bytes(r.tokens), "<u4") for r in back]), ids)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id int, ids binary")
    assert to.sequences(df, "doc_id", "ids", width=1).count() == 0


def test_one_id_of_many_rows_is_dealt_to_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(to, "BUCKET_ROWS", 20)
    df = spark.createDataFrame([(None, str(i).encode() * 9) for i in range(400)], "id bigint, ids binary")
    numbered, total = to.numbered(df, 4, 1)
    firsts = sorted(r.first for r in numbered.collect())
    assert total == sum(-(-len(str(i) * 9) // 4) for i in range(400)) and len(set(firsts)) == 400
    assert to.squeezed(df).select(F.pmod(F.xxhash64("id", "h"), F.lit(20))).distinct().count() > 10


def test_query(spark):
    """Slots are a permutation, and each record is its part of its document's bytes."""
    got = {(r.doc_id, r.part): r for r in to.op4_training_order(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert sorted(r.slot for r in got.values()) == list(range(len(got)))
    want = 0
    for d in docs:
        data = (d.text or "").encode()
        for p in range(max(1, -(-len(data) // 1024))):
            own, r = data[p * 1024 : (p + 1) * 1024], got[d.doc_id, p]
            assert (r.n_tokens, r.tokens_sha256, r.shard, r.byte_offset) == (len(own), hashlib.sha256(own).hexdigest(), r.slot // 2048, r.slot % 2048 * 1029)
            want += 1
    assert want == len(got)


def test_query_reads_the_files_of_fixed_stride_that_it_writes(spark, monkeypatch):
    paths = []
    made_path = to.new_path
    monkeypatch.setattr(to, "new_path", lambda *a: paths.append(made_path(*a)) or paths[-1])
    got = {r.slot: r for r in to.op4_training_order(spark, "/root/testdata/sf0.01").collect()}
    reader = to.ShardReader(spark, paths[0])
    assert reader.meta["total"] == len(got) > 2048 and reader.meta["stride"] == 1029
    for slot, ids in reader.read(0, 10**6):
        assert (got[slot].n_tokens, got[slot].tokens_sha256) == (len(ids), hashlib.sha256(ids).hexdigest())
    assert all(reader.place(s)[1] == got[s].byte_offset for s in (0, 5, 2047, 2048, len(got) - 1))


def test_shards_are_read_on_the_executors(spark, tmp_path):
    """Also from a table whose rows lie anywhere; it is computed once."""
    df = spark.createDataFrame(rows(), "doc_id bigint, ids binary").repartition(3)
    made, total = to.slotted(df, "doc_id", "ids", width=1, key=5, length=64)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    path = str(tmp_path / "shards")
    to.write_shards(made.mapInArrow(count, made.schema), path, width=1, length=64, per_shard=50, total=total)
    assert seen.value == total
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    back = to.read_shards(spark, path).join(spark.read.parquet(path + "/index"), "slot").collect()
    assert sorted(((r.id, r.part, bytes(r.tokens)) for r in back), key=str) == brute(1, 64)
    assert sorted((r.slot, r.shard, r.byte_offset) for r in back) == [(s, s // 50, s % 50 * 69) for s in range(total)]
    lost = to.ShardReader(spark, path).place(120)[0].removeprefix("file:")
    with open(lost, "r+b") as f:
        f.truncate(69)
    (tmp_path / "shards/records" / ("." + lost.rsplit("/", 1)[1] + ".crc")).unlink()
    with pytest.raises(Exception, match="has 69 bytes"):
        to.read_shards(spark, path).collect()
    (tmp_path / "shards/records" / lost.rsplit("/", 1)[1]).unlink()
    with pytest.raises(ValueError, match="shards"):
        to.read_shards(spark, path)
    with pytest.raises(Exception, match="each must be there once"):
        to.write_shards(made.where("slot <> 60"), str(tmp_path / "gap"), width=1, length=64, per_shard=50, total=total)


def test_shards_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id string, ids binary")
    made, total = to.slotted(df, "doc_id", "ids", width=1)
    to.write_shards(made, str(tmp_path / "shards"), width=1, total=total)
    assert to.read_shards(spark, str(tmp_path / "shards")).count() == 0 == spark.read.parquet(str(tmp_path / "shards/index")).count()
