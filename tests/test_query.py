"""Fixtures with known answers, plan shapes, and refusals."""

import random

import pytest
from pyspark.sql import functions as F

from basalt.errors import QueryError, SchemaError
from basalt.functions import types as t
from basalt.operators import index
from basalt.operators.query import Query

ALL = t.schema(bool=t.BOOL, int=t.INT, string=t.string(5), float=t.FLOAT)


def frame(spark, rows, fields=ALL):
    return spark.createDataFrame(t.verify(rows, fields), fields)


def values(n, group=None):
    return [(False, i % group if group else i, "test", 0.0) for i in range(n)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_project_and_select(spark):
    q = Query(frame(spark, values(10)), "T")
    assert sorted(r[0] for r in q.project(["int"]).frame().collect()) == list(range(10))
    assert [r[1] for r in q.select("int", "=", 9).frame().collect()] == [9]
    assert q.project(["T.int"]).frame().columns == ["T.int"]


def test_group_count_with_and_without_key(spark):
    q = Query(frame(spark, values(100, 10)), "T").group_by("T.int").count()
    assert sorted(map(tuple, q.project(["T.int"]).frame().collect())) == [(i, 10) for i in range(10)]
    assert [r[0] for r in q.frame().collect()] == [10] * 10


def test_group_alone_keeps_rows_together(spark):
    rows = Query(frame(spark, values(100, 10)), "T").group_by("int").project(["int"]).frame().collect()
    seen, last = set(), None
    for (v,) in rows:
        assert v == last or v not in seen
        seen.add(v)
        last = v
    assert len(rows) == 100


@pytest.mark.parametrize("strategy", [None, "nested_loop", "broadcast", "merge", "hash"])
def test_constant_self_join(spark, strategy):
    df = frame(spark, [(True, 1, "abcde", 1.2)] * 100)
    joined = Query(df, "l").join(df, "l.int", "r.int", strategy, name="r").frame()
    assert joined.count() == 10_000 and len(joined.columns) == 8 and joined.distinct().count() == 1


def test_join_with_empty_side(spark):
    left = frame(spark, values(100))
    right = spark.createDataFrame([], t.schema(int=t.INT))
    assert Query(left, "l").join(right, "l.int", "r.int", name="r").frame().count() == 0


def test_shuffled_merge_join_is_ordered_by_sort(spark):
    rows = [(True, 1 + i % 4, f"{i % 4:05d}", float(i % 4)) for i in range(576)]
    random.Random(42).shuffle(rows)
    df = frame(spark, rows)
    q = Query(df, "l").join(df, "l.int", "r.int", "merge", name="r").sort("l.int")
    out = [r[0] for r in q.project(["l.int"]).frame().collect()]
    assert len(out) == 82_944 and out == sorted(out)


@pytest.mark.parametrize(("strategy", "node"), [("nested_loop", "CartesianProduct"), ("broadcast", "BroadcastHashJoin"), ("merge", "SortMergeJoin"), ("hash", "ShuffledHashJoin")])
def test_strategy_reaches_the_plan(spark, strategy, node):
    df = spark.range(10).toDF("int")
    assert node in plan(Query(df, "l").join(df, "l.int", "r.int", strategy, name="r").frame())


def test_large_sides_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr("basalt.operators.query.BROADCAST_BYTES", 1)
    df = spark.range(10).toDF("int")
    assert "SortMergeJoin" in plan(Query(df, "l").join(df, "l.int", "r.int", "broadcast", name="r").frame())


def test_filters_and_columns_reach_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    customer = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    df = Query(orders, "o").join(customer, "o.o_custkey", "c.c_custkey", name="c").select("o_totalprice", ">", 1e5).project(["o_orderkey", "c_name"]).frame()
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,100000.0)" in text and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in text


def test_further_edge_is_a_filter(spark):
    df = frame(spark, values(10))
    q = Query(df, "l").join(df, "l.int", "r.int", name="r").join(df, "l.float", "r.float", name="r")
    assert q.frame().count() == 10


def test_self_join_by_aliases(spark):
    df = frame(spark, values(1000))
    assert Query(df, "t1").join(df, "t1.int", "t2.int", name="t2").frame().count() == 1000


def test_aggregates_over_no_rows_give_no_row(spark):
    q = Query(frame(spark, values(10)), "T").select("int", "<", 0)
    assert q.count().frame().count() == 0
    assert q.count().sum("int").average("int").frame().columns == ["countAgg", "sumAgg", "averageAgg"]


def test_sums_do_not_saturate(spark):
    q = Query(frame(spark, [(True, 2**31 - 1, "a", 1.5)] * 4), "T")
    assert q.sum("int").average("float").frame().first() == (4 * (2**31 - 1), 1.5)


def test_sort(spark):
    rows = values(864)
    random.Random(42).shuffle(rows)
    assert [r[1] for r in Query(frame(spark, rows), "T").sort("int").frame().collect()] == list(range(864))
    assert Query(frame(spark, []), "T").sort("int").frame().collect() == []


def test_like_is_containment(spark):
    df = spark.createDataFrame([("a%c",), ("abc",), ("xa%cx",)], "s string")
    assert sorted(r[0] for r in Query(df, "T").select("s", "like", "a%c").frame().collect()) == ["a%c", "xa%cx"]


def test_fixed_strings_match_padded(spark):
    q = Query(frame(spark, values(3)), "T")
    assert q.select("string", "=", "test").frame().count() == 3
    assert q.select("string", "<", "tesu").frame().count() == 3


def test_refusals(spark):
    df = frame(spark, values(10))
    q = Query(df, "T")
    both = Query(df, "a").join(df, "a.int", "b.int", name="b")
    for bad in (
        lambda: q.project([]),
        lambda: q.project(["int"]).project(["int"]),
        lambda: q.project(["none"]).frame(),
        lambda: both.select("int", "=", 1).frame(),
        lambda: both.project(["int"]).frame(),
        lambda: q.sum("string").frame(),
        lambda: q.average("bool").frame(),
        lambda: q.group_by("int").count().project(["float"]).frame(),
        lambda: q.count().project(["int"]).frame(),
        lambda: q.group_by("int").group_by("float"),
        lambda: Query(df, "a").join(df, "a.int", "b.string", name="b").frame(),
        lambda: Query(df, "a").join(df, "a.int", "b.int", "quick", name="b").frame(),
    ):
        with pytest.raises(QueryError):
            bad()
    for value in (None, "9", True, 1.5):
        with pytest.raises(SchemaError):
            q.select("int", "=", value).frame()


def test_ranks_of_any_keys(spark):
    df = spark.createDataFrame([(i * 7 % 1000,) for i in range(1000)], "k int").repartition(7)
    assert sorted(map(tuple, index.ranked(df, "k").collect())) == [(i, i + 1) for i in range(1000)]
    words = df.select(F.format_string("w%05d", "k").alias("k"))
    assert index.ranked(words, "k").where("k != format_string('w%05d', cast(rank - 1 as int))").count() == 0
    assert index.ranked(df.where("k < 0"), "k").count() == 0


def test_ranks_of_a_key_that_half_of_all_rows_share(spark, uncoalesced):
    df = spark.createDataFrame([(None if i % 100 == 0 else 5 if i % 2 else i, i) for i in range(1000)], "rank int, row int").repartition(5)
    got = index.ranked(df, "rank").toDF("k", "row", "rank")
    rows = got.orderBy("rank").collect()
    assert [r.rank for r in rows] == list(range(1, 1001)) and sorted(r.row for r in rows) == list(range(1000))
    assert [r.k for r in rows] == sorted((r.k for r in rows), key=lambda k: (k is not None, k or 0))
    parts = index.cut(df.orderBy("rank", F.xxhash64("rank", "row"))).where("rank = 5").select(F.spark_partition_id()).distinct().count()
    assert parts > 1  # the key is dealt to several tasks


def test_sort_of_groups_without_aggregates(spark):
    df = spark.createDataFrame([(i % 3, i * 7 % 10, i) for i in range(30)], "g int, v int, n int")
    rows = [tuple(r) for r in Query(df, "t").group_by("g").sort("v", "n").frame().collect()]
    assert rows == sorted(rows)


def test_bulk_load_and_orders(spark):
    df = spark.createDataFrame([(i,) for i in range(100)], "k int")
    leaves = index.bulk_load_layout(df, "k", order=2, fill=0.75).groupBy("leaf").count().collect()
    assert sorted(map(tuple, leaves)) == [*((i, 3) for i in range(33)), (33, 1)]


def test_type_rules():
    with pytest.raises(SchemaError):
        t.string(0)
    with pytest.raises(SchemaError):
        t.verify([(True, 1)], ALL)
    assert t.verify([(True, 1, "abcdefg", 1)], ALL) == [(True, 1, "abcde", 1.0)]
    assert t.record_bytes(ALL) == 14
