"""Catalog, transactions, edits, ingest, and streams."""

import pytest
from pyspark.sql import types as T

from basalt.errors import CatalogError, SchemaError
from basalt.functions import types as t
from basalt.operators import dml, index
from basalt.sources import text
from basalt.sources.catalog import Catalog, parse_catalog
from basalt.streaming.ingest import append_text

PAIR = t.schema(id=t.INT, name=t.string(6))


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "db"))


def test_tables_outlive_their_catalog(spark, catalog):
    catalog.create("T", [(1, "one"), (2, "two")], PAIR)
    again = Catalog(spark, catalog.path)
    assert again.tables() == ["T"] and sorted(r[1] for r in again.table("T").collect()) == ["one   ", "two   "]
    with pytest.raises(CatalogError):
        again.create("T", [], PAIR)
    again.drop("T")
    assert not catalog.exists("T")
    with pytest.raises(CatalogError):
        catalog.table("T")


def test_indices(catalog):
    catalog.create("T", [(i, "x") for i in range(50)], PAIR, indices=("id",))
    with catalog.begin() as x:
        assert x.lookup("T", "id", 7).count() == 1
        assert x.contains("T", "id", 99).first()[0] is False
        assert [r[0] for r in x.sorted_scan_from("T", "id", 45).collect()] == [45, 46, 47, 48, 49]
        assert [r[0] for r in x.sorted_scan("T", "id").collect()] == list(range(50))
    for bad in (("none",), ("id", "id")):
        with pytest.raises(SchemaError):
            catalog.create("U", [(1, "a")], PAIR, indices=bad)
    with pytest.raises(SchemaError):
        catalog.create("U", [(1, "a"), (1, "b")], PAIR, indices=("id",))


def test_indices_are_kept_through_edits(spark, catalog, uncoalesced):
    catalog.create("T", spark.range(4000).selectExpr("cast(id as int) AS id", "repeat('x', 6) AS name"), indices=("id",))
    again = Catalog(spark, catalog.path)
    assert again.indices("T") == ("id",) == (again.primary_key("T"),)
    with again.begin() as x:
        for bad in ([(5, "twice")], [(9000, "a"), (9000, "b")]):
            with pytest.raises(SchemaError):
                x.insert("T", bad)
        with pytest.raises(SchemaError):
            x.update_where("T", "id", 7, "id", 8)
        with pytest.raises(SchemaError):
            x.update_record("T", "id", 8, {"id": 7, "name": "y"})
        with pytest.raises(SchemaError):
            x.run_batch("T", dml.Batch().insert([(5, "twice")]))
        assert again.version("T") == 1
        x.insert("T", [(9000, "new")])
        x.update_record("T", "id", 7, {"id": 9001, "name": "moved"})
        x.delete_where("T", "id", 3)
        x.run_batch("T", dml.Batch().delete_where("id", 4).insert([(3, "back")]).update_record("id", 3, {"name": "again"}))
        assert again.version("T") == 5 and x.count("T") == 4000 and x.lookup("T", "id", 9001).first().name == "moved"
    files = again.table("T").selectExpr("input_file_name() AS f", "id").groupBy("f").agg({"id": "min"}).collect()
    spans = again.table("T").selectExpr("input_file_name() AS f", "id").groupBy("f").agg({"id": "max"}).collect()
    low, high = dict(map(tuple, files)), dict(map(tuple, spans))
    order = sorted(low, key=low.get)
    assert len(order) > 1 and all(high[a] < low[b] for a, b in zip(order, order[1:]))  # the last version's files are ranges


def test_of_two_writers_the_later_fails(catalog):
    catalog.create("T", [(1, "one")], PAIR)
    base = catalog.version("T")
    catalog.write("T", dml.insert(catalog.table("T"), [(2, "two")]), base)
    with pytest.raises(CatalogError):
        catalog.write("T", dml.insert(catalog.table("T"), [(3, "three")]), base)
    assert catalog.table("T").count() == 2 and catalog.table("T", 1).count() == 1
    catalog._claim("T/_claims/v3")  # a writer that died
    with pytest.raises(CatalogError), catalog.begin() as x:
        x.insert("T", [(3, "three")])
    catalog.release("T")
    with catalog.begin() as x:
        x.insert("T", [(3, "three")])
        assert x.count("T") == 3


def test_histograms_are_kept_with_a_version(catalog):
    catalog.create("T", [(i, "x") for i in range(100)], PAIR)
    with catalog.begin() as x:
        assert x.histograms("T").where("column = 'id'").agg({"count": "sum"}).first()[0] == 100
        kept = catalog.analyze("T")
        assert kept.inputFiles() == catalog.analyze("T").inputFiles()
        x.insert("T", [(100, "x")])
        assert x.histograms("T").where("column = 'id'").agg({"count": "sum"}).first()[0] == 101
        x.alias("T", "t2")
        assert x.histograms("t2").count() == 20


def test_lookups_by_name_and_number(spark, catalog):
    catalog.create("T", [(1, "one")], PAIR)
    catalog.add("U", spark.range(3), key="id")
    assert catalog.table_name(catalog.table_id("U")) == "U" and catalog.primary_key("U") == "id" and catalog.primary_key("T") is None
    assert catalog.schema("U").names == ["id"]
    for bad in (lambda: catalog.table_id("V"), lambda: catalog.table_name(1), lambda: catalog.primary_key("V"), lambda: catalog.schema("V"), lambda: catalog.table("T", 9)):
        with pytest.raises(CatalogError):
            bad()


def test_aliases_and_temporary_tables(catalog):
    catalog.create("T", [(1, "one")], PAIR)
    with catalog.begin() as x:
        assert x.query_as("T", "a").frame().columns == ["a.id", "a.name"]
        x.alias("a", "b")
        assert x.query("b").count().frame().first()[0] == 1
        with pytest.raises(CatalogError):
            x.alias("T", "a")
        name = x.create_temporary(x.table("T"))
        assert x.query(name).frame().count() == 1
        x.drop_temporary(name)
        with pytest.raises(CatalogError):
            x.table(name)
        assert x.qualified_schema("T").names == ["T.id", "T.name"]
    with pytest.raises(CatalogError):
        x.table("T")


def test_edits(catalog):
    catalog.create("T", [(1, "one"), (2, "two")], PAIR)
    with catalog.begin() as x:
        x.insert("T", [(3, "three")], unique=("id",))
        with pytest.raises(SchemaError):
            x.insert("T", [(3, "again")], unique=("id",))
        assert x.count("T") == 3
        x.update_where("T", "name", "uno", "id", 1)
        x.delete_where("T", "name", "two")
        assert sorted((r[0], r[1].strip()) for r in x.table("T").collect()) == [(1, "uno"), (3, "three")]
        with pytest.raises(SchemaError):
            x.insert("T", [("4", "four")])


def test_batches_apply_all_or_nothing(catalog):
    catalog.create("T", [], PAIR)
    with catalog.begin() as x:
        for start in (0, 100):
            batch = dml.Batch()
            batch.insert([(start + i, "r") for i in range(100)], unique=("id",))
            x.run_batch("T", batch)
        assert x.count("T") == 200
        with pytest.raises(SchemaError):
            x.run_batch("T", dml.Batch().delete_where("id", 1).insert([(2, "dup")], unique=("id",)))
        assert x.count("T") == 200


def test_nulls_are_no_match(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "id int, s string")
    assert dml.delete_where(df, "s", "a").count() == 1
    assert dml.update_where(df, "id", 9, "s", "a").where("id = 1").count() == 1


def test_text(spark, tmp_path):
    (tmp_path / "in.csv").write_text("1, abc \n\n2,defghijk\r\n3,x")
    got = text.read_text(spark, str(tmp_path / "in.csv"), PAIR).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "abc   "), (2, "defghi"), (3, "x     ")]
    (tmp_path / "bad.csv").write_text("1,2\nx,3\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        text.read_text(spark, str(tmp_path / "bad.csv"), text.text_schema(2)).collect()
    got = text.read_text(spark, str(tmp_path / "bad.csv"), text.text_schema(2), mode="PERMISSIVE").collect()
    assert sorted(map(tuple, got), key=str) == [(1, 2), (None, 3)]


@pytest.mark.parametrize("n", [0, 1, 511, 513, 1025])
def test_convert_round_trip(spark, tmp_path, n):
    rows = [(i, i * i % 97) for i in range(n)]
    (tmp_path / "in.txt").write_text("\n".join(f"{a}\t{b}" for a, b in rows))
    text.convert(spark, str(tmp_path / "in.txt"), str(tmp_path / "out"), 2, sep="\t")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == rows


def test_convert_cuts_strings_and_prints(spark, tmp_path):
    (tmp_path / "in.txt").write_text("a" * 200 + ",5\n")
    text.convert(spark, str(tmp_path / "in.txt"), str(tmp_path / "out"), 2, ["string", "int"])
    df = spark.read.parquet(str(tmp_path / "out"))
    assert df.first() == ("a" * 128, 5)
    text.print_rows(df, str(tmp_path / "printed"))
    assert spark.read.text(str(tmp_path / "printed")).first()[0] == "a" * 128 + "\t5"


def test_catalog_file(spark, tmp_path):
    tables = parse_catalog(["users (id int pk, name string)", "", "t(a int)"])
    assert tables["users"][1] == "id" and tables["users"][0].names == ["id", "name"] and tables["t"][1] is None
    for bad in ("users id int", "u (id float)", "u (id int key)"):
        with pytest.raises(CatalogError):
            parse_catalog([bad])
    spark.createDataFrame([(1, "x")], T.StructType(tables["users"][0])).write.parquet(str(tmp_path / "users.parquet"))
    c = Catalog(spark, str(tmp_path))
    assert c.load_catalog(["users (id int pk, name string)"]) == {"users": "id"} and c.table("users").count() == 1 and c.primary_key("users") == "id"


def test_stream_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("1,one\n2,two\n")
    at = lambda: append_text(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), PAIR).awaitTermination()
    at()
    at()
    (tmp_path / "in/b.csv").write_text("3,three\n")
    at()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(1, "one   "), (2, "two   "), (3, "three ")]


def test_sorted_layout_prunes(spark, tmp_path):
    index.sorted_layout(spark.range(1000).toDF("k"), "k").write.parquet(str(tmp_path / "t"))
    df = index.range_scan(spark.read.parquet(str(tmp_path / "t")), "k", ">=", 990)
    assert df.count() == 10 and "GreaterThanOrEqual(k,990)" in df._jdf.queryExecution().executedPlan().toString()


def test_command_line(spark, tmp_path, capsys):
    from basalt.__main__ import main

    (tmp_path / "in.txt").write_text("1|one\n2| two\n")
    assert main(["convert", str(tmp_path / "in.txt"), str(tmp_path / "out"), "2", "int,string", "|"]) == 0
    assert main(["print", str(tmp_path / "out")]) == 0
    assert sorted(capsys.readouterr().out.splitlines()) == ["1\tone", "2\ttwo"]
    assert main(["parse"]) == 2
