"""Histograms, masks, estimates and lock conflicts with known values."""

import pytest

from basalt.plans import locks, stats


def ints(spark, n):
    return spark.createDataFrame([(i,) for i in range(n)], "v int")


def column(df, name):
    return [r[name] for r in df.orderBy("bucket").collect()]


def test_counts(spark):
    h = stats.histogram(ints(spark, 101), "v")
    assert column(h, "count") == [10] * 9 + [11] == column(h, "distinct")
    flat = stats.histogram(spark.createDataFrame([(0,)] * 101, "v int"), "v")
    assert column(flat, "count") == [0] * 9 + [101] and column(flat, "distinct") == [0] * 9 + [1]
    assert stats.histogram(ints(spark, 0), "v").count() == 0


@pytest.mark.parametrize(
    ("n", "op", "value", "mask"),
    [
        (100, "=", 5, [0.1] + [0] * 9),
        (100, "<>", 5, [0.9] + [1] * 9),
        (100, "=", 99, [0] * 9 + [0.1]),
        (100, "=", 100, [0] * 10),
        (100, "=", -1, [0] * 10),
        (100, "<>", -1, [1] * 10),
        (101, ">", 9, [0.1] + [1] * 9),
        (101, ">", 10, [0] + [1] * 9),
        (101, ">", -1, [1] * 10),
        (101, ">", 101, [0] * 10),
        (101, "<", 9, [0.9] + [0] * 9),
        (101, "<", 10, [1] + [0] * 9),
        (101, "<", 101, [1] * 10),
        (101, "<", -1, [0] * 10),
        (101, "<=", 10, [1, 0.1] + [0] * 8),
        (101, ">=", 9, [0.1] + [1] * 9),
    ],
)
def test_masks(spark, n, op, value, mask):
    got = column(stats.with_mask(stats.histogram(ints(spark, n), "v"), op, value), "mask")
    assert got == pytest.approx(mask, abs=1e-5)


def test_strings_and_booleans(spark):
    df = spark.createDataFrame([("abcde", True), ("zzz", False), ("", True)], "s string, b boolean")
    assert sum(column(stats.histogram(df, "s"), "distinct")) == 3
    assert column(stats.histogram(df, "b"), "count") == [1] + [0] * 8 + [2]
    assert column(stats.with_mask(stats.histogram(df, "s"), "<", 0.0, is_string=True), "mask") == [1.0] * 10
    from basalt.functions.hashing import string_number

    assert df.select(string_number(df.s)).first()[0] == 92599395


def test_reductions(spark):
    h = stats.histogram(ints(spark, 101), "v")
    assert stats.reduction_factor(h, ">", 9).first()[0] == pytest.approx((1 + 91) / 101)
    assert column(stats.after_predicate(h, ">", 9), "count") == [1] + [10] * 8 + [11]
    assert column(stats.after_reduction(h, 0.5), "count") == [5] * 9 + [6]
    assert column(h, "count") == [10] * 9 + [11]


def test_pages_and_costs(spark):
    assert stats.records_per_page(14) == 288 and stats.records_per_page(4) == 992
    assert stats.join_estimate(ints(spark, 100), "v", ints(spark, 50), "v").first() == (100, 50, 49)


def test_all_histograms_at_once(spark):
    df = spark.createDataFrame([(i, i % 2 == 0, f"s{i % 7}", None) for i in range(101)], "v int, b boolean, s string, n int")
    got = stats.table_histograms(df)
    assert {r[0] for r in got.select("column").distinct().collect()} == {"v", "b", "s"}
    for c in ("v", "b", "s"):
        one = stats.histogram(df, c)
        own = got.where(f"column = '{c}'").drop("column")
        rounded = lambda rows: sorted(tuple(round(v, 6) for v in r) for r in rows.collect())
        assert rounded(own) == rounded(one)
    assert stats.table_histograms(df.where("v < 0")).count() == 0


def test_statistics_after_predicate_and_join(spark):
    df = spark.createDataFrame([(i, i % 10) for i in range(100)], "x int, y int")
    h = stats.table_histograms(df)
    after = stats.stats_after_predicate(h, "x", "<", 49.5)
    assert sum(r["count"] for r in after.where("column = 'x'").collect()) == 50
    assert [r["count"] for r in after.where("column = 'y'").orderBy("bucket").collect()] == [5] * 10
    sides, estimate = stats.stats_after_join(h, "x", stats.table_histograms(ints(spark, 49)), "v")
    assert estimate.first() == (100, 49, 48)
    assert sides.where("side = 'right'").agg({"count": "sum"}).first()[0] == sum(round(n * 50 / 101) for n in [5] * 9 + [4])
    assert sides.where("side = 'left'").exceptAll(h.selectExpr("'left' AS side", "*")).count() == 0


def test_lock_requests_that_wait(spark):
    rows = [("t", "a", "S", 1), ("t", "b", "S", 2), ("t", "c", "X", 3), ("t", "a", "IS", 4), ("u", "a", "X", 5), ("u", "a", "X", 6), (None, "a", "X", 7)]
    got = locks.waits_for(spark.createDataFrame(rows, "r string, who string, mode string, at int"), "r", "who", "mode", "at")
    assert sorted(map(tuple, got.collect())) == [("t", "a", "c", 1), ("t", "c", "a", 1), ("t", "c", "b", 1)]
    assert locks.conflict_matrix(spark).where("conflict").count() == 9
