"""A fluent query: one table, inner equi-joins, a conjunction of comparisons, grouping, aggregates, projection.

A query is a value: each call returns a new one, and `frame()` gives a lazy DataFrame. Predicates stand above the joins and
projections last; pushing them down, pruning columns and ordering joins is the optimizer's work.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.errors import QueryError
from basalt.functions.predicates import Op, compare
from basalt.functions.types import family, literal

#: A side is broadcast, and sides are joined by nested loops, up to these sizes (the optimizer's figure) only.
BROADCAST_BYTES, NESTED_BYTES = 64 << 20, 8 << 20
STRATEGIES = {"nested_loop": "shuffle_replicate_nl", "broadcast": "broadcast", "merge": "merge", "hash": "shuffle_hash"}


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def resolve(columns: list[str], name: str) -> str:
    """The one column with this name, or with this name after its table's."""
    if name in columns:
        return name
    found = [c for c in columns if c.partition(".")[2] == name]
    if len(found) > 1:
        raise QueryError(f"column {name} specified twice without disambiguation")
    if not found:
        raise QueryError(f"no column {name} found")
    return found[0]


def size_of(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def hinted(left: DataFrame, right: DataFrame, strategy: str | None) -> DataFrame:
    """right with the strategy's hint; strategies that a large side would break give way to merging."""
    if strategy is None:
        return right
    if strategy not in STRATEGIES:
        raise QueryError(f"no join strategy {strategy}")
    if strategy == "broadcast" and size_of(right) > BROADCAST_BYTES or strategy == "nested_loop" and max(size_of(left), size_of(right)) > NESTED_BYTES:
        strategy = "merge"
    return right.hint(STRATEGIES[strategy])


@dataclass(frozen=True)
class Query:
    base: DataFrame
    name: str
    lookup: Callable[[str], DataFrame] | None = None
    joins: tuple = ()
    predicates: tuple = ()
    columns: tuple[str, ...] | None = None
    group: str | None = None
    aggregates: dict[str, str | None] = field(default_factory=dict)
    order: tuple[str, ...] = ()

    def select(self, column: str, op: Op | str, value: object) -> Query:
        """Rows whose column compares so with a literal; repeated calls are a conjunction."""
        return replace(self, predicates=(*self.predicates, (column, Op.of(op), value)))

    def join(self, table: str | DataFrame, left: str, right: str, strategy: str | None = None, name: str | None = None) -> Query:
        """An inner join on left = right, where left names a column so far and right one of the new table."""
        df = self.lookup(table) if isinstance(table, str) and self.lookup else table
        if isinstance(df, str):
            raise QueryError(f"no table {table}")
        own = name or (table if isinstance(table, str) else None)
        if own is None:
            raise QueryError("a joined DataFrame needs a name")
        return replace(self, joins=(*self.joins, (df, own, left, right, strategy)))

    def project(self, columns: list[str]) -> Query:
        """Named columns in this order, called as written."""
        if self.columns is not None:
            raise QueryError("a query projects once")
        if not columns:
            raise QueryError("nothing to project")
        return replace(self, columns=tuple(columns))

    def group_by(self, column: str) -> Query:
        if self.group is not None:
            raise QueryError("a query groups by one column")
        return replace(self, group=column)

    def count(self) -> Query:
        return replace(self, aggregates={**self.aggregates, "countAgg": None})

    def sum(self, column: str) -> Query:
        return replace(self, aggregates={**self.aggregates, "sumAgg": column})

    def average(self, column: str) -> Query:
        return replace(self, aggregates={**self.aggregates, "averageAgg": column})

    def sort(self, *columns: str) -> Query:
        """The result in ascending order of columns; rows of a group without aggregates stay together, in that order within it."""
        return replace(self, order=columns)

    def _joined(self) -> DataFrame:
        named = lambda df, n: df.select([quoted(f.name).alias(f"{n}.{f.name}", metadata=f.metadata) for f in df.schema])
        names = {self.name}
        df = named(self.base, self.name)
        for other, name, left, right, strategy in self.joins:
            if name in names:  # a further edge between tables that are joined already is a filter
                a, b = resolve(df.columns, left), resolve(df.columns, right)
                self._same_type(df.schema[a], df.schema[b])
                df = df.where(quoted(a) == quoted(b))
                continue
            names.add(name)
            new = named(other, name)
            a, b = resolve(df.columns, left), resolve(new.columns, right)
            self._same_type(df.schema[a], new.schema[b])
            df = df.join(hinted(df, new, strategy), quoted(a) == quoted(b), "inner")
        return df

    @staticmethod
    def _same_type(a: T.StructField, b: T.StructField) -> None:
        if family(a.dataType) != family(b.dataType):
            raise QueryError(f"{a.name} and {b.name} differ in type")

    def _filtered(self) -> DataFrame:
        df = self._joined()
        for name, op, value in self.predicates:
            own = df.schema[resolve(df.columns, name)]
            df = df.where(compare(quoted(own.name), op, literal(value, own), family(own.dataType) == "STRING"))
        return df

    def _aggregated(self, df: DataFrame) -> DataFrame:
        made = []
        for out in ("countAgg", "sumAgg", "averageAgg"):
            if out not in self.aggregates:
                continue
            if out == "countAgg":
                made.append(F.count(F.lit(1)).alias(out))
                continue
            own = df.schema[resolve(df.columns, self.aggregates[out])]
            if family(own.dataType) not in ("INT", "FLOAT"):
                raise QueryError(f"{own.name} has no {out[:-3]}")
            wide = "bigint" if family(own.dataType) == "INT" else "double"
            made.append((F.sum(quoted(own.name).cast(wide)) if out == "sumAgg" else F.avg(quoted(own.name))).alias(out))
        if self.group is None:
            if self.columns:
                raise QueryError("columns beside aggregates need a group")
            # Over no rows there is no row, so the group is a constant.
            return df.groupBy(F.lit(1).alias("one")).agg(*made).drop("one")
        key = resolve(df.columns, self.group)
        if any(resolve(df.columns, c) != key for c in self.columns or ()):
            raise QueryError("a grouped query projects its group's column only")
        grouped = df.groupBy(quoted(key)).agg(*made)
        keys = [quoted(key).alias(c) for c in self.columns] if self.columns else []
        return grouped.select(*keys, *[quoted(c) for c in grouped.columns if c != key])

    def frame(self) -> DataFrame:
        df = self._filtered()
        if self.aggregates:
            df = self._aggregated(df)
        else:
            if self.group is not None:  # groups stand together
                key = resolve(df.columns, self.group)
                if any(resolve(df.columns, c) != key for c in self.columns or ()):
                    raise QueryError("a grouped query projects its group's column only")
                inner = [quoted(resolve(df.columns, c)) for c in self.order]
                # Groups come in the group's order where rows are sorted, else wherever their key is dealt to.
                df = df.orderBy(quoted(key), *inner) if inner else df.repartition(quoted(key)).sortWithinPartitions(quoted(key))
            elif self.order:
                df = df.orderBy(*[quoted(resolve(df.columns, c)) for c in self.order])
            if self.columns:
                df = df.select([quoted(resolve(df.columns, c)).alias(c) for c in self.columns])
            return df
        return df.orderBy(*[quoted(resolve(df.columns, c)) for c in self.order]) if self.order else df

    def explain(self) -> None:
        self.frame().explain("formatted")
