"""A directory of parquet tables, transactions over it, and catalog files."""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from basalt.errors import CatalogError, SchemaError
from basalt.functions.types import verify
from basalt.operators import dml, index
from basalt.operators.query import Query
from basalt.plans import stats as statistics


def parse_catalog(lines: Iterable[str]) -> dict[str, tuple[T.StructType, str | None]]:
    """name -> (schema, primary key) from lines such as `users (id int pk, name string)`."""
    kinds = {"int": T.IntegerType(), "string": T.StringType()}
    out = {}
    for line in filter(None, map(str.strip, lines)):
        m = re.fullmatch(r"(\w+)\s*\((.*)\)", line)
        if not m:
            raise CatalogError(f"can't read {line!r}")
        fields, key = [], None
        for part in m[2].split(","):
            words = part.split()
            if len(words) not in (2, 3) or words[1].lower() not in kinds or len(words) == 3 and words[2] != "pk":
                raise CatalogError(f"can't read {part.strip()!r}")
            fields.append(T.StructField(words[0], kinds[words[1].lower()], True))
            key = words[0] if len(words) == 3 else key
        out[m[1]] = T.StructType(fields), key
    return out


class Catalog:
    """Tables are folders of versions; the last complete version counts, so a failed write changes nothing.

    A table's indexed columns are kept beside its versions: every version has unique keys in them, and its files are ordered by the first.
    Of two writers that start from one version, the later one fails.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.given: dict[str, DataFrame] = {}
        self.keys: dict[str, str | None] = {}

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _versions(self, name: str) -> list[int]:
        fs, at = self._fs(f"{self.path}/{name}")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        done = [int(n[1:]) for n in names if re.fullmatch(r"v\d+", n)]
        return sorted(v for v in done if fs.exists(self._fs(f"{self.path}/{name}/v{v}/_SUCCESS")[1]))

    def _file(self, name: str) -> bool:
        fs, at = self._fs(f"{self.path}/{name}.parquet")
        return fs.exists(at)

    def exists(self, name: str) -> bool:
        return name in self.given or self._file(name) or bool(self._versions(name))

    def tables(self) -> list[str]:
        fs, at = self._fs(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted({*self.given, *(n.removesuffix(".parquet") for n in names if self.exists(n.removesuffix(".parquet")))})

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """The table as of its last version, or of an earlier one."""
        if name in self.given:
            return self.given[name]
        if v := self._versions(name):
            if version is not None and version not in v:
                raise CatalogError(f"no version {version} of {name}")
            return self.spark.read.parquet(f"{self.path}/{name}/v{version or v[-1]}")
        if self._file(name):
            return self.spark.read.parquet(f"{self.path}/{name}.parquet")
        raise CatalogError(f"no table {name}")

    def version(self, name: str) -> int:
        """The number of the table's last version; 0 where it has none."""
        return (self._versions(name) or [0])[-1]

    def schema(self, name: str) -> T.StructType:
        return self.table(name).schema

    def primary_key(self, name: str) -> str | None:
        """The key that a catalog file names for the table, or its first indexed column."""
        if not self.exists(name):
            raise CatalogError(f"no table {name}")
        return self.keys.get(name) or (self.indices(name) or (None,))[0]

    def table_id(self, name: str) -> int:
        """A number that the name alone decides, so every catalog over the folder has the same."""
        if not self.exists(name):
            raise CatalogError(f"no table {name}")
        return zlib.crc32(name.encode())

    def table_name(self, number: int) -> str:
        for name in self.tables():
            if zlib.crc32(name.encode()) == number:
                return name
        raise CatalogError(f"no table {number}")

    def indices(self, name: str) -> tuple[str, ...]:
        """The table's indexed columns."""
        fs, at = self._fs(f"{self.path}/{name}/indices.json")
        if not fs.exists(at):
            return ()
        return tuple(json.loads("".join(r.value for r in self.spark.read.text(str(at)).collect())))

    def add(self, name: str, df: DataFrame, key: str | None = None) -> None:
        """A table that lives elsewhere; adding a name again replaces it."""
        self.given[name], self.keys[name] = df, key

    def create(self, name: str, rows: DataFrame | list[tuple], fields: T.StructType | None = None, indices: tuple[str, ...] = ()) -> DataFrame:
        """A new table; `indices` have unique keys from now on, and the first of them orders its files, so that lookups and ranges on it skip most of them."""
        if self.exists(name):
            raise CatalogError(f"{name} exists already")
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(verify(rows, fields), fields)
        if len(set(indices)) != len(indices) or set(indices) - set(df.columns):
            raise SchemaError(f"bad index columns {indices}")
        for c in indices:
            index.require_unique(df, c)
        if indices:
            self._put(f"{name}/indices.json", json.dumps(indices))
        return self.write(name, df, base=0, unique=())

    def write(self, name: str, rows: DataFrame, base: int | None = None, unique: tuple[str, ...] | None = None) -> DataFrame:
        """The version after `base` (the last one). unique: indexed columns whose keys may have become equal, all of them unless told."""
        base = self.version(name) if base is None else base
        columns = self.indices(name)
        for c in columns if unique is None else unique:
            index.require_unique(rows, c)
        claim = f"{name}/_claims/v{base + 1}"
        self._claim(claim)
        try:
            laid = index.sorted_layout(rows, columns[0]) if columns else rows
            laid.write.mode("errorifexists").parquet(f"{self.path}/{name}/v{base + 1}")
        except Exception:
            for left in (f"{name}/v{base + 1}", claim):
                fs, at = self._fs(f"{self.path}/{left}")
                fs.delete(at, True)
            raise
        return self.table(name)

    def _claim(self, claim: str) -> None:
        """Of all writers of a version one makes its mark; the mark of a writer that died is taken away by `release`."""
        try:
            self._put(claim, "", again=False)
        except Py4JJavaError as e:
            raise CatalogError(f"{claim} is another writer's") from e

    def _put(self, path: str, content: str, again: bool = True) -> None:
        fs, at = self._fs(f"{self.path}/{path}")
        out = fs.create(at, again)
        out.write(bytearray(content.encode()))
        out.close()

    def release(self, name: str) -> None:
        """Takes away what a writer that died has left of the table's next version."""
        for left in (f"{name}/v{self.version(name) + 1}", f"{name}/_claims/v{self.version(name) + 1}"):
            fs, at = self._fs(f"{self.path}/{left}")
            fs.delete(at, True)

    def analyze(self, name: str, buckets: int = statistics.BUCKETS) -> DataFrame:
        """Histograms of all columns, computed in two passes over the table and kept with its version."""
        path = f"{self.path}/{name}/_stats/v{self.version(name)}-{buckets}"
        fs, at = self._fs(f"{path}/_SUCCESS")
        if not fs.exists(at):
            statistics.table_histograms(self.table(name), buckets).coalesce(1).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def drop(self, name: str) -> None:
        if not self.exists(name):
            raise CatalogError(f"no table {name}")
        self.keys.pop(name, None)
        if self.given.pop(name, None) is None:
            for path in (f"{self.path}/{name}", f"{self.path}/{name}.parquet"):
                fs, at = self._fs(path)
                fs.delete(at, True)

    def drop_all(self) -> None:
        for name in self.tables():
            self.drop(name)

    def register(self, name: str) -> None:
        """The table as a temporary view for SQL."""
        self.table(name).createOrReplaceTempView(name)

    def load_catalog(self, lines: Iterable[str]) -> dict[str, str | None]:
        """Tables of a catalog file, each in name.parquet; their primary keys."""
        keys = {}
        for name, (fields, key) in parse_catalog(lines).items():
            self.add(name, self.spark.read.schema(fields).parquet(f"{self.path}/{name}.parquet"), key)
            keys[name] = key
        return keys

    def begin(self) -> Transaction:
        return Transaction(self)


class Transaction:
    """A scope for aliases and temporary tables; `with catalog.begin() as t: t.query("orders")...`."""

    def __init__(self, catalog: Catalog) -> None:
        self.catalog, self.active = catalog, True
        self.aliases: dict[str, str] = {}
        self.temporary: dict[str, DataFrame] = {}

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, *_) -> None:
        self.end()

    def end(self) -> None:
        if not self.active:
            raise CatalogError("the transaction has ended")
        self.temporary.clear()
        self.aliases.clear()
        self.active = False

    def table(self, name: str) -> DataFrame:
        if not self.active:
            raise CatalogError("the transaction has ended")
        seen = set()
        while name in self.aliases and name not in seen:
            seen.add(name)
            name = self.aliases[name]
        return self.temporary[name] if name in self.temporary else self.catalog.table(name)

    def create_temporary(self, df: DataFrame, name: str | None = None) -> str:
        name = name or f"temp_{uuid.uuid4().hex}"
        if name in self.temporary or self.catalog.exists(name):
            raise CatalogError(f"{name} exists already")
        self.temporary[name] = df
        return name

    def drop_temporary(self, name: str) -> None:
        if self.temporary.pop(name, None) is None:
            raise CatalogError(f"no temporary table {name}")

    def query(self, name: str) -> Query:
        return Query(self.table(name), name, self.table)

    def query_as(self, name: str, alias: str) -> Query:
        self.alias(name, alias)
        return self.query(alias)

    def alias(self, name: str, alias: str) -> None:
        """A second name for the rest of the transaction."""
        self.table(name)
        if alias in self.aliases or alias in self.temporary or self.catalog.exists(alias):
            raise CatalogError(f"{alias} exists already")
        self.aliases[alias] = name

    def qualified_schema(self, name: str) -> T.StructType:
        return T.StructType([T.StructField(f"{name}.{f.name}", f.dataType, f.nullable, f.metadata) for f in self.table(name).schema])

    def sorted_scan(self, name: str, column: str) -> DataFrame:
        return index.sorted_scan(self.table(name), column)

    def sorted_scan_from(self, name: str, column: str, start: object) -> DataFrame:
        return index.sorted_scan_from(self.table(name), column, start)

    def lookup(self, name: str, column: str, key: object) -> DataFrame:
        return index.lookup(self.table(name), column, key)

    def contains(self, name: str, column: str, key: object) -> DataFrame:
        return index.contains(self.table(name), column, key)

    def count(self, name: str) -> int:
        return self.table(name).count()

    def stats(self, name: str) -> DataFrame:
        return statistics.table_stats(self.table(name))

    def histograms(self, name: str, buckets: int = statistics.BUCKETS) -> DataFrame:
        """Histograms of all columns: kept ones of a table of the catalog, else computed."""
        own = name not in self.temporary and name not in self.aliases and name not in self.catalog.given and self.catalog.version(name)
        return self.catalog.analyze(name, buckets) if own else statistics.table_histograms(self.table(name), buckets)

    def _edit(self, name: str, edit: Callable[[DataFrame], DataFrame], unique: tuple[str, ...]) -> DataFrame:
        """The table's next version; unique: indexed columns whose keys the edit may have made equal."""
        base = self.catalog.version(name)
        return self.catalog.write(name, edit(self.table(name)), base, unique)

    def insert(self, name: str, rows: DataFrame | list[tuple], unique: tuple[str, ...] = ()) -> DataFrame:
        """Keys of `unique` and of the table's indexed columns are checked against what it holds."""
        return self._edit(name, lambda df: dml.insert(df, rows, tuple(dict.fromkeys([*unique, *self.catalog.indices(name)]))), ())

    def delete_where(self, name: str, column: str, value: object) -> DataFrame:
        return self._edit(name, lambda df: dml.delete_where(df, column, value), ())

    def update_where(self, name: str, set_column: str, set_value: object, column: str, value: object) -> DataFrame:
        return self._edit(name, lambda df: dml.update_where(df, set_column, set_value, column, value), tuple(c for c in self.catalog.indices(name) if c == set_column))

    def update_record(self, name: str, key_column: str, key: object, values: dict[str, object]) -> DataFrame:
        return self._edit(name, lambda df: dml.update_record(df, key_column, key, values), tuple(c for c in self.catalog.indices(name) if c in values))

    def run_batch(self, name: str, batch: dml.Batch) -> DataFrame:
        """All edits of a batch in one write, or none."""
        return self._edit(name, batch.apply, self.catalog.indices(name))
