import math
import re

import pytest
from pyspark.sql import functions as F

from basalt.llm import mixing


def brute_targets(sizes):
    """Reshare the excess over twice a source's size by weight, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    want = 1.5 * sum(sizes.values())
    full: set = set()
    while True:
        rest = want - sum(2 * sizes[s] for s in full)
        over = sum(weight[s] for s in names if s not in full)
        target = {s: 2 * sizes[s] if s in full else rest * weight[s] / over for s in names}
        more = {s for s in names if s not in full and target[s] > 2 * sizes[s]}
        if not more:
            return target
        full |= more


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string")


def many():
    out = []
    for i in range(1500):
        source = "hot" if i % 3 == 0 else [None, "b", "ab", "é", "zz", "one"][i % 6]
        out.append((i, None if i % 97 == 0 else "w " * (1 + i * 7 % 60) if i % 5 else "same words here", source, "clash"))
    return out + [(7, "again again", "b", "x"), (7, "again again", "b", "x")]


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_query(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", broadcast)
    rows = many()
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op6_mix_sources(spark, str(tmp_path)).collect()
    again = mixing.op6_mix_sources(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes: dict = {}
    source = {}
    for i, text, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size(text)
        source[i] = s
    target = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 5, s


def test_targets_of_many_sources_are_filled_in_no_single_task(spark):
    """300 sources, of which many fill up in several rounds; ranks go on over the partitions of the sort."""
    sizes: dict = {f"{'é' if i % 7 == 0 else 'host'}{i}": 3 ** (i % 13) + i for i in range(300)} | {None: 5, "": 0}
    counts = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, size bigint, n bigint").repartition(5)
    made = mixing.source_targets(counts)
    got = {r.source: r.target for r in made.collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that the sort has several partitions
    try:
        ranks = mixing.ranked_sources(counts.select("source")).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.part for r in ranks}) > 1
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    assert [(r.source, r["rank"]) for r in sorted(ranks, key=lambda r: r["rank"])] == [(s, i) for i, s in enumerate(order)]


def test_all_sources_full_or_none(spark):
    counts = spark.createDataFrame([("a", 10, 1), ("b", 20, 2)], "source string, size bigint, n bigint")
    assert {r.source: r.target for r in mixing.source_targets(counts, share=2.0).collect()} == {"a": 20.0, "b": 80.0}
    assert {r.source: r.target for r in mixing.source_targets(counts, (1.0, 3.0), share=1.0).collect()} == {"a": 12.5, "b": 37.5}
    assert mixing.source_targets(counts.limit(0)).count() == 0


def test_rates_solve_the_dual(spark):
    rows = [("a", n, 1 + n % 3) for n in range(1, 40)]
    counts = spark.createDataFrame(rows, "source string, size bigint, n bigint")
    total, docs = sum(s * n for _, s, n in rows), sum(n for *_, n in rows)
    for share in (0.05, 0.6, 1.0, 1.4, 1.99):
        targets = spark.createDataFrame([("a", total, docs, share * total)], "source string, source_size bigint, rows bigint, target double")
        r = mixing.tilts(counts, targets).first()
        got = sum(s * n * min(2, math.exp(min(r.l * s / r["mean"], 9))) for _, s, n in rows)
        assert got == pytest.approx(share * total, rel=1e-6)


def test_hot_cells_are_salted(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(3).cast("bigint").alias("size"))
    df = df.unionByName(spark.createDataFrame([(10**6, "t", 5000)], "doc_id bigint, source string, size bigint"))
    out = mixing.with_copies(df, "doc_id", "source", F.col("c2"), cell_rows=100)
    taken = {r["source"]: r for r in out.groupBy(F.col("row.c1").alias("source")).agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect()}
    assert abs(taken["s"].taken - taken["s"].target) <= 3


def test_mix_repeats_rows_and_keeps_columns(spark):
    df = documents(spark, many())
    out = mixing.mix(df)
    assert out.columns == df.columns and out.count() > df.where("text is not null").count()
    assert out.groupBy("doc_id", "text").count().where("count > 2 and doc_id != 7").count() == 0


def test_empty_and_wordless(spark):
    assert mixing.mix(documents(spark, []).limit(0)).count() == 0
    df = documents(spark, [(1, None, "a", ""), (2, " ", None, "")])
    made = mixing.with_copies(df, "doc_id", "source", mixing.word_count(F.col("c1"))).collect()
    assert [(r.size, r.target, r.copies) for r in made] == [(0, 0.0, 0)] * 2
