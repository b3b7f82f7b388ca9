"""The engine's queries over the star schema, each with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions.hashing import string_number
from basalt.functions.types import fixed
from basalt.operators import dml, index
from basalt.operators.query import Query
from basalt.plans import locks, stats
from basalt.sources import text
from basalt.sources.catalog import Catalog
from basalt.sources.scratch import new_path

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(spark: SparkSession, sf_dir: str, name: str, alias: str | None = None) -> Query:
    return Query(table(spark, sf_dir, name), alias or name, lambda n: table(spark, sf_dir, n))


def register(name: str, sql: str | None, run: Run) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE[name] = sql


def plain(df: DataFrame) -> DataFrame:
    """Columns under their own names, without their tables'."""
    return df.toDF(*[c.rpartition(".")[2] for c in df.columns])


def two_places(df: DataFrame, *columns: str) -> DataFrame:
    return df.select([F.round(c, 2).alias(c) if c in columns else F.col(c) for c in df.columns])


# Scans, projections, filters

register("seq_scan", "SELECT * FROM nation", lambda s, d: plain(query(s, d, "nation").frame()))
register("project_columns", "SELECT c_name, c_mktsegment FROM customer", lambda s, d: query(s, d, "customer").project(["c_name", "c_mktsegment"]).frame())
for _name, _op in {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    register(f"filter_{_name}_int", f"SELECT p_partkey, p_size FROM part WHERE p_size {_op} 25", lambda s, d, op=_op: query(s, d, "part").select("p_size", op, 25).project(["p_partkey", "p_size"]).frame())
register("filter_string_eq", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'", lambda s, d: query(s, d, "customer").select("c_mktsegment", "=", "BUILDING").project(["c_custkey", "c_name"]).frame())
register("filter_string_lt", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority < '3'", lambda s, d: query(s, d, "orders").select("o_orderpriority", "<", "3").project(["o_orderkey", "o_orderpriority"]).frame())
register("filter_float_gt", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000", lambda s, d: query(s, d, "orders").select("o_totalprice", ">", 150000.0).project(["o_orderkey", "o_totalprice"]).frame())
register(
    "filter_padded_string",
    "SELECT p_partkey, rpad(substr(p_brand, 1, 10), 10, ' ') AS brand FROM part WHERE rpad(substr(p_brand, 1, 10), 10, ' ') = 'Brand#13  '",
    lambda s, d: table(s, d, "part").select("p_partkey", fixed(F.col("p_brand"), 10).alias("brand")).where(F.col("brand") == "Brand#13".ljust(10)),
)
register(
    "filter_conjunction",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_discount < 0.05 AND l_returnflag <> 'N'",
    lambda s, d: query(s, d, "lineitem").select("l_quantity", ">=", 10.0).select("l_discount", "<", 0.05).select("l_returnflag", "<>", "N").project(["l_orderkey", "l_linenumber"]).frame(),
)
register("like_contains", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'widget')", lambda s, d: query(s, d, "part").select("p_name", "like", "widget").project(["p_partkey", "p_name"]).frame())

# Index and order

register("index_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 42", lambda s, d: index.lookup(table(s, d, "orders"), "o_orderkey", 42).select("o_orderkey", "o_custkey", "o_totalprice"))
register("index_contains", "SELECT count(*) > 0 AS found FROM orders WHERE o_orderkey = 42", lambda s, d: index.contains(table(s, d, "orders"), "o_orderkey", 42))
for _name, _op in {"lt": "<", "le": "<=", "ge": ">=", "gt": ">"}.items():
    register(f"index_range_{_name}", f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey {_op} 500", lambda s, d, op=_op: index.range_scan(table(s, d, "orders"), "o_orderkey", op, 500, ordered=True).select("o_orderkey", "o_totalprice"))
register("sorted_scan_rank", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rank FROM orders", lambda s, d: index.ranked(table(s, d, "orders").select("o_orderkey"), "o_orderkey"))
register("sorted_scan_from", "SELECT c_custkey, c_name FROM customer WHERE c_custkey >= 100", lambda s, d: index.sorted_scan_from(table(s, d, "customer"), "c_custkey", 100).select("c_custkey", "c_name"))
register("sort_external", "SELECT p_partkey, p_retailprice FROM part", lambda s, d: query(s, d, "part").project(["p_partkey", "p_retailprice"]).sort("p_retailprice", "p_partkey").frame())
register(
    "index_bulkload_layout",
    "SELECT o_orderkey, ((r - 1) // 75)::BIGINT AS leaf, ((r - 1) % 75)::BIGINT AS slot FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders)",
    lambda s, d: index.bulk_load_layout(table(s, d, "orders"), "o_orderkey", order=50, fill=0.75).select("o_orderkey", F.col("leaf").cast("bigint").alias("leaf"), F.col("slot").cast("bigint").alias("slot")),
)

# Joins

register("join_two_way", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", lambda s, d: query(s, d, "orders").join("customer", "o_custkey", "c_custkey").project(["o_orderkey", "c_name"]).frame())
register(
    "join_three_way",
    "SELECT l_orderkey, l_linenumber, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey",
    lambda s, d: query(s, d, "lineitem").join("orders", "l_orderkey", "o_orderkey").join("customer", "o_custkey", "c_custkey").project(["l_orderkey", "l_linenumber", "c_name"]).frame(),
)
register(
    "join_four_way",
    "SELECT l_orderkey, l_linenumber, c_name, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    lambda s, d: query(s, d, "lineitem").join("orders", "l_orderkey", "o_orderkey").join("customer", "o_custkey", "c_custkey").join("nation", "c_nationkey", "n_nationkey").project(["l_orderkey", "l_linenumber", "c_name", "n_name"]).frame(),
)
register(
    "join_self_alias",
    "SELECT n1.n_name AS first_name, n2.n_name AS second_name FROM nation n1 JOIN nation n2 ON n1.n_regionkey = n2.n_regionkey",
    lambda s, d: query(s, d, "nation", "n1").join(table(s, d, "nation"), "n1.n_regionkey", "n2.n_regionkey", name="n2").project(["n1.n_name", "n2.n_name"]).frame().toDF("first_name", "second_name"),
)
for _name, _strategy in {"nested_loop": "nested_loop", "broadcast": "broadcast", "sort_merge": "merge", "hash": "hash"}.items():
    register(f"join_{_name}", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey", lambda s, d, st=_strategy: query(s, d, "supplier").join("nation", "s_nationkey", "n_nationkey", st).project(["s_suppkey", "n_name"]).frame())
register(
    "join_pushdown_filters",
    "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000 AND c_mktsegment = 'BUILDING'",
    lambda s, d: query(s, d, "orders").join("customer", "o_custkey", "c_custkey").select("o_totalprice", ">", 200000.0).select("c_mktsegment", "=", "BUILDING").project(["o_orderkey", "c_name"]).frame(),
)
register("join_empty", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey < 0", lambda s, d: query(s, d, "orders").join("customer", "o_custkey", "c_custkey").select("c_custkey", "<", 0).project(["o_orderkey", "c_name"]).frame())

# Aggregates

register("agg_global_count", 'SELECT count(*) AS "countAgg" FROM lineitem', lambda s, d: query(s, d, "lineitem").count().frame())
register("agg_global_sum_int", 'SELECT sum(p_size)::BIGINT AS "sumAgg" FROM part', lambda s, d: query(s, d, "part").sum("p_size").frame())
register("agg_global_sum_float", 'SELECT round(sum(o_totalprice), 2) AS "sumAgg" FROM orders', lambda s, d: two_places(query(s, d, "orders").sum("o_totalprice").frame(), "sumAgg"))
register("agg_global_avg_int", 'SELECT round(avg(p_size), 2) AS "averageAgg" FROM part', lambda s, d: two_places(query(s, d, "part").average("p_size").frame(), "averageAgg"))
register("agg_global_avg_float", 'SELECT round(avg(c_acctbal), 2) AS "averageAgg" FROM customer', lambda s, d: two_places(query(s, d, "customer").average("c_acctbal").frame(), "averageAgg"))
register("agg_global_empty", 'SELECT count(*) AS "countAgg" FROM part WHERE p_size < 0 HAVING count(*) > 0', lambda s, d: query(s, d, "part").select("p_size", "<", 0).count().frame())
register("group_count", 'SELECT c_mktsegment, count(*) AS "countAgg" FROM customer GROUP BY c_mktsegment', lambda s, d: query(s, d, "customer").group_by("c_mktsegment").count().project(["c_mktsegment"]).frame())
register("group_sum", 'SELECT p_brand, sum(p_size)::BIGINT AS "sumAgg" FROM part GROUP BY p_brand', lambda s, d: query(s, d, "part").group_by("p_brand").sum("p_size").project(["p_brand"]).frame())
register("group_avg", 'SELECT l_returnflag, round(avg(l_quantity), 2) AS "averageAgg" FROM lineitem GROUP BY l_returnflag', lambda s, d: two_places(query(s, d, "lineitem").group_by("l_returnflag").average("l_quantity").project(["l_returnflag"]).frame(), "averageAgg"))
register(
    "group_all_aggs",
    'SELECT l_returnflag, count(*) AS "countAgg", round(sum(l_extendedprice), 2) AS "sumAgg", round(avg(l_quantity), 2) AS "averageAgg" FROM lineitem GROUP BY l_returnflag',
    lambda s, d: two_places(query(s, d, "lineitem").group_by("l_returnflag").count().sum("l_extendedprice").average("l_quantity").project(["l_returnflag"]).frame(), "sumAgg", "averageAgg"),
)
register("group_count_no_key", 'SELECT count(*) AS "countAgg" FROM orders GROUP BY o_orderstatus', lambda s, d: query(s, d, "orders").group_by("o_orderstatus").count().frame())
register("group_cluster", "SELECT * FROM supplier", lambda s, d: plain(query(s, d, "supplier").group_by("s_nationkey").frame()))


def join_group_agg(s: SparkSession, d: str) -> DataFrame:
    """The flagship: a join, a filter, a group, and all three aggregates."""
    q = query(s, d, "orders").join("customer", "o_custkey", "c_custkey").select("o_totalprice", ">", 150000.0)
    return two_places(q.group_by("c_mktsegment").count().sum("o_totalprice").average("o_totalprice").project(["c_mktsegment"]).frame(), "sumAgg", "averageAgg")


register(
    "join_group_agg",
    'SELECT c_mktsegment, count(*) AS "countAgg", round(sum(o_totalprice), 2) AS "sumAgg", round(avg(o_totalprice), 2) AS "averageAgg" FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 150000 GROUP BY c_mktsegment',
    join_group_agg,
)

# Statistics

BUCKET_SQL = """
    v AS (SELECT {value}::DOUBLE AS v FROM {table}), m AS (SELECT min(v) AS mn, max(v) AS mx FROM v),
    b AS (SELECT CASE WHEN (mx - mn) / 10 < 1e-5 THEN 9 WHEN abs(v - mx) < 1e-5 THEN 9 ELSE least(floor((v - mn) / ((mx - mn) / 10)), 9) END::INT AS b, v FROM v, m),
    h AS (SELECT r.i::INT AS bucket, mn + r.i * ((mx - mn) / 10) AS low, mn + (r.i + 1) * ((mx - mn) / 10) AS high,
          coalesce(c.n, 0)::BIGINT AS count, coalesce(c.d, 0)::BIGINT AS "distinct"
          FROM range(10) r(i) LEFT JOIN (SELECT b, count(*) AS n, count(DISTINCT v) AS d FROM b GROUP BY b) c ON c.b = r.i, m)"""


def bucket_sql(table_: str, value: str, then: str) -> str:
    return f"WITH {BUCKET_SQL.format(table=table_, value=value)} {then}"


def rounded(hist: DataFrame) -> DataFrame:
    return hist.select("bucket", *[F.round(c, 4).alias(c) for c in ("low", "high")], "count", "distinct")


ROUNDED = 'SELECT bucket, round(low, 4) AS low, round(high, 4) AS high, count, "distinct" FROM h'
register("histogram_int", bucket_sql("part", "p_size", ROUNDED), lambda s, d: rounded(stats.histogram(table(s, d, "part"), "p_size")))
register("histogram_float", bucket_sql("orders", "o_totalprice", ROUNDED), lambda s, d: rounded(stats.histogram(table(s, d, "orders"), "o_totalprice")))
register("histogram_constant", bucket_sql("part", "7", ROUNDED), lambda s, d: rounded(stats.histogram(table(s, d, "part").select(F.lit(7).alias("seven")), "seven")))
_HASH = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_brand, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (h * 31 + c) & 4294967295)"
_SIGNED = f"(CASE WHEN {_HASH} >= 2147483648 THEN {_HASH} - 4294967296 ELSE {_HASH} END)"
register("string_hash", f"SELECT DISTINCT p_brand, {_SIGNED}::BIGINT AS hash FROM part", lambda s, d: table(s, d, "part").select("p_brand").distinct().select("p_brand", string_number(F.col("p_brand")).alias("hash")))
register("histogram_string", bucket_sql("part", _SIGNED, ROUNDED), lambda s, d: rounded(stats.histogram(table(s, d, "part"), "p_brand")))

_AT = "(CASE WHEN abs(25 - mx) < 1e-5 THEN 9 ELSE floor((25 - mn) / ((mx - mn) / 10)) END)"
_EQ = f'(CASE WHEN bucket = {_AT} AND "distinct" > 0 THEN 1.0::DOUBLE / "distinct" ELSE 0 END)'
_GT = f"(CASE WHEN bucket > {_AT} THEN 1.0::DOUBLE WHEN bucket = {_AT} THEN (high - 25) / ((mx - mn) / 10) ELSE 0 END)"
_LT = f"(CASE WHEN bucket < {_AT} THEN 1.0::DOUBLE WHEN bucket = {_AT} THEN (25 - low) / ((mx - mn) / 10) ELSE 0 END)"
_MASKS = {"eq": ("=", _EQ), "ne": ("<>", f"(1 - {_EQ})"), "gt": (">", _GT), "lt": ("<", _LT), "ge": (">=", f"greatest({_GT}, {_EQ})"), "le": ("<=", f"greatest({_LT}, {_EQ})")}
for _name, (_op, _sql) in _MASKS.items():
    register(
        f"hist_mask_{_name}",
        bucket_sql("part", "p_size", f"SELECT bucket, round({_sql}, 6)::DOUBLE AS mask FROM h, m"),
        lambda s, d, op=_op: stats.with_mask(stats.histogram(table(s, d, "part"), "p_size"), op, 25.0).select("bucket", F.round("mask", 6).alias("mask")),
    )
register(
    "reduction_factor",
    bucket_sql("part", "p_size", f'SELECT round(sum({_GT} * "distinct") / sum("distinct"), 6) AS reduction_factor FROM h, m'),
    lambda s, d: stats.reduction_factor(stats.histogram(table(s, d, "part"), "p_size"), ">", 25.0).select(F.round("reduction_factor", 6).alias("reduction_factor")),
)
register(
    "hist_after_predicate",
    bucket_sql("part", "p_size", f'SELECT bucket, round({_GT} * count)::BIGINT AS count, round({_GT} * "distinct")::BIGINT AS "distinct" FROM h, m'),
    lambda s, d: stats.after_predicate(stats.histogram(table(s, d, "part"), "p_size"), ">", 25.0).select("bucket", "count", "distinct"),
)
_PART = ("p_partkey", "p_size", "p_retailprice")


def each_column(columns: tuple[str, ...], table_: str, then: str) -> str:
    """SQL over h, the histograms of all columns."""
    parts = [f"(WITH {BUCKET_SQL.format(table=table_, value=c)} SELECT '{c}' AS \"column\", * FROM h)" for c in columns]
    return f"WITH a AS ({' UNION ALL '.join(parts)}) {then}"


def all_histograms(s: SparkSession, d: str) -> DataFrame:
    return stats.table_histograms(table(s, d, "part").select(*_PART))


register("table_histograms", each_column(_PART, "part", 'SELECT "column", bucket, round(low, 4) AS low, round(high, 4) AS high, count, "distinct" FROM a'), lambda s, d: all_histograms(s, d).select("column", "bucket", *[F.round(c, 4).alias(c) for c in ("low", "high")], "count", "distinct"))
_SIZE_MASK = "(CASE WHEN low >= 25 THEN 1.0::DOUBLE WHEN high <= 25 THEN 0 ELSE (high - 25) / (high - low) END)"
register(
    "stats_after_predicate",
    each_column(
        _PART,
        "part",
        f"""SELECT "column", bucket, round(m * count)::BIGINT AS count, round(m * "distinct")::BIGINT AS "distinct" FROM
        (SELECT *, CASE WHEN "column" = 'p_size' THEN {_SIZE_MASK} ELSE (SELECT sum({_SIZE_MASK} * "distinct") / sum("distinct") FROM a WHERE "column" = 'p_size') END AS m FROM a)""",
    ),
    lambda s, d: stats.stats_after_predicate(all_histograms(s, d), "p_size", ">", 25.0).select("column", "bucket", "count", "distinct"),
)
_SIDES = "l AS (SELECT 'left' AS side, \"column\", bucket, count, \"distinct\" FROM lh), r AS (SELECT 'right' AS side, \"column\", bucket, count, \"distinct\" FROM rh), k AS (SELECT (SELECT sum(\"distinct\") FROM l WHERE \"column\" = 'o_custkey') + 1 AS ld, (SELECT sum(\"distinct\") FROM r WHERE \"column\" = 'c_custkey') + 1 AS rd)"
register(
    "stats_after_join",
    f"""WITH lh AS (FROM ({each_column(("o_orderkey", "o_custkey"), "orders", "SELECT * FROM a")})), rh AS (FROM ({each_column(("c_custkey", "c_acctbal"), "customer", "SELECT * FROM a")})), {_SIDES}
    SELECT side, "column", bucket, round(count * (CASE side WHEN 'left' THEN ld ELSE rd END / greatest(ld, rd)))::BIGINT AS count, round("distinct" * (CASE side WHEN 'left' THEN ld ELSE rd END / greatest(ld, rd)))::BIGINT AS "distinct"
    FROM (FROM l UNION ALL FROM r), k""",
    lambda s, d: stats.stats_after_join(stats.table_histograms(table(s, d, "orders").select("o_orderkey", "o_custkey")), "o_custkey", stats.table_histograms(table(s, d, "customer").select("c_custkey", "c_acctbal")), "c_custkey")[0].select("side", "column", "bucket", "count", "distinct"),
)
register("ranked_hot_key", "SELECT l_returnflag, count(*) AS n, min(r) AS first, max(r) AS last FROM (SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag) AS r FROM lineitem) GROUP BY l_returnflag", lambda s, d: index.ranked(table(s, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber"), "l_returnflag").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"), F.max("rank").alias("last")))
register(
    "table_stats",
    "SELECT count(*) AS num_rows, 56 AS record_bytes, 72 AS records_per_page, ceil(count(*) / 72)::BIGINT AS num_pages FROM orders",
    lambda s, d: stats.table_stats(table(s, d, "orders")),
)
register(
    "join_estimate",
    "SELECT (SELECT count(*) FROM orders) AS left_rows, (SELECT count(*) FROM customer) AS right_rows, floor((SELECT count(*) FROM orders) * (SELECT count(*) FROM customer) / (greatest((SELECT count(DISTINCT o_custkey) FROM orders), (SELECT count(DISTINCT c_custkey) FROM customer)) + 1))::BIGINT AS estimated_rows",
    lambda s, d: stats.join_estimate(table(s, d, "orders"), "o_custkey", table(s, d, "customer"), "c_custkey"),
)
register(
    "join_cost",
    "WITH p AS (SELECT (SELECT count(*) FROM orders) AS lr, ceil((SELECT count(*) FROM orders) / 72)::BIGINT AS lp, ceil((SELECT count(*) FROM customer) / 72)::BIGINT AS rp) SELECT lp AS left_pages, rp AS right_pages, (lr * rp + lp)::BIGINT AS simple_cost, (ceil(lp / 3) * rp + lp)::BIGINT AS block_cost FROM p",
    lambda s, d: stats.join_cost(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority", F.lit(1).alias("o_date")), table(s, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_name", "c_mktsegment", F.lit(1).alias("c_one"))),
)

# Edits and ingest

_NATION = "n_nationkey, n_name, n_regionkey"
register("insert_post", f"SELECT {_NATION} FROM nation UNION ALL VALUES (100, 'ATLANTIS', 1), (101, 'MU', 2)", lambda s, d: dml.insert(table(s, d, "nation"), [(100, "ATLANTIS", 1), (101, "MU", 2)], unique=("n_nationkey",)))
register("delete_post", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'", lambda s, d: dml.delete_where(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "F"))
register("update_where_post", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSING' ELSE c_mktsegment END AS c_mktsegment FROM customer", lambda s, d: dml.update_where(table(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "HOUSING", "c_mktsegment", "BUILDING"))
register(
    "atomic_batch_post",
    f"SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 1 THEN 4 ELSE n_regionkey END AS n_regionkey FROM (SELECT {_NATION} FROM nation WHERE n_nationkey <> 3 UNION ALL VALUES (100, 'ATLANTIS', 1))",
    lambda s, d: dml.Batch().delete_where("n_nationkey", 3).insert([(100, "ATLANTIS", 1)]).update_where("n_regionkey", 4, "n_regionkey", 1).apply(table(s, d, "nation")),
)
register(
    "update_record_post",
    "SELECT o_orderkey, CASE WHEN o_orderkey = 7 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey = 7 THEN 1.5 ELSE o_totalprice END AS o_totalprice FROM orders",
    lambda s, d: dml.update_record(table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey", 7, {"o_orderstatus": "X", "o_totalprice": 1.5}),
)


def indexed_table_edits(s: SparkSession, d: str) -> DataFrame:
    """A table with a unique index, edited in four versions, then read by its index."""
    db = Catalog(s, new_path(s, "edited"))
    db.create("c", table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal"), indices=("c_custkey",))
    with db.begin() as t:
        t.insert("c", [(10_000_001, "New", 1.0), (10_000_002, "Newer", 2.0)])
        t.delete_where("c", "c_custkey", 5)
        t.update_record("c", "c_custkey", 6, {"c_name": "Six", "c_acctbal": 6.0})
        t.update_where("c", "c_name", "Last", "c_custkey", 10_000_002)
    return index.range_scan(db.table("c"), "c_custkey", ">=", 3, ordered=True)


register(
    "indexed_table_edits",
    "SELECT c_custkey, CASE WHEN c_custkey = 6 THEN 'Six' ELSE c_name END AS c_name, CASE WHEN c_custkey = 6 THEN 6 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey >= 3 AND c_custkey <> 5 UNION ALL VALUES (10000001, 'New', 1), (10000002, 'Last', 2)",
    indexed_table_edits,
)


def ingested(s: SparkSession, rows: DataFrame, sep: str) -> DataFrame:
    """rows after a way through a delimited text file."""
    path = new_path(s, "text")
    rows.write.options(sep=sep, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return text.read_text(s, path, rows.schema, sep)


register(
    "csv_ingest_string_rules",
    "SELECT event_id, substr(trim('  ' || props || '  '), 1, 128) AS props FROM events",
    lambda s, d: ingested(s, table(s, d, "events").select("event_id", F.concat(F.lit("  "), "props", F.lit("  ")).alias("props")), "\t").select("event_id", text.string_rule(F.col("props")).alias("props")),
)
register("csv_ingest_types", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part", lambda s, d: ingested(s, table(s, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), ","))
register(
    "csv_ingest_join",
    "SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
    lambda s, d: Query(ingested(s, table(s, d, "customer").select("c_name", "c_nationkey"), ","), "c").join(ingested(s, table(s, d, "nation").select("n_nationkey", "n_name"), ","), "c_nationkey", "n_nationkey", name="n").project(["c_name", "n_name"]).frame(),
)


def converted(s: SparkSession, d: str) -> DataFrame:
    """Integers from a text file by the converter, and what it wrote."""
    at, out = new_path(s, "text"), new_path(s, "converted")
    table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").write.option("sep", "|").csv(at)
    text.convert(s, at, out, 3, sep="|")
    return s.read.parquet(out)


register("text_convert", "SELECT l_orderkey::INT AS c0, l_partkey::INT AS c1, l_linenumber AS c2 FROM lineitem", converted)
register(
    "lock_conflict_matrix",
    "SELECT a.m AS held, b.m AS asked, (a.m || b.m) IN ('SX', 'SIX', 'XS', 'XX', 'XIS', 'XIX', 'ISX', 'IXS', 'IXX') AS conflict FROM (VALUES ('S'), ('X'), ('IS'), ('IX')) a(m), (VALUES ('S'), ('X'), ('IS'), ('IX')) b(m)",
    lambda s, d: locks.conflict_matrix(s),
)
register(
    "lock_waits",
    """WITH r AS (SELECT event_type AS res, user_id % 20 AS who, ['S', 'X', 'IS', 'IX'][event_id % 4 + 1] AS m, event_id AS "at" FROM events),
    s AS (SELECT res, who, m, min("at") AS f, max("at") AS l FROM r GROUP BY ALL)
    SELECT a.res AS resource, a.who AS waiter, b.who AS blocker, count(DISTINCT a.m) AS modes FROM s a JOIN s b ON a.res = b.res AND a.who <> b.who AND a.l > b.f
    AND (a.m || b.m) IN ('SX', 'SIX', 'XS', 'XX', 'XIS', 'XIX', 'ISX', 'IXS', 'IXX') GROUP BY ALL""",
    lambda s, d: locks.waits_for(table(s, d, "events").select("event_type", F.pmod("user_id", F.lit(20)).alias("who"), F.expr("element_at(array('S', 'X', 'IS', 'IX'), cast(pmod(event_id, 4) as int) + 1)").alias("mode"), "event_id"), "event_type", "who", "mode", "event_id"),
)
