"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine >= t are at a squared distance d of at most 2 - 2t. A rotation (the principal axes of a bounded
sample) keeps distances; its axes are dealt to blocks of few axes each, and the budget d is shared among blocks in proportion to their variance.
In at least one block a near pair is within the block's share, so the union over blocks of the pairs within their shares holds every near pair.

Each block is a range join. Where the sample says that grids of one radius per cell on some axes of every block leave less to compare than
all pairs, every block has its own grid, and a vector meets its own and the next cells; the number of axes in a block is the one that leaves least. Where vectors are spread so evenly
that no grids do, they meet in tiles. Within a task each block is joined by range again: sorted by the block's first axis, a vector meets the band within the
block's radius of it, and pairs of the band within the block's share are candidates. The union of all blocks' candidates is verified exactly in double precision.

Equal vectors are one class, so copies cost nothing. A cell, however full, is dealt to tiles of about `TILE_ROWS` classes, and a
task sees two tiles. Only link counts and a spanning forest leave a task. The result doesn't depend on the rotation or the sample.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id, link with
nothing; vectors of different lengths don't link; repeated rows are copies, each with its row, and a row's component is that of its vector;
ties at the threshold link; empty tables give empty tables; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import cut, pick, table, tidy
from basalt.llm.components import connected_components, join_labels

#: Axes of a block where vectors meet in tiles, and those that are tried for grids; axes of a grid at most.
AXES, GRIDDED, GRID_AXES = 8, (2, 4, 8, 16), 3
#: Grids are laid where they leave less than this share of all pairs.
WORTH = 0.5
SAMPLE_ROWS = 4096
TILE_ROWS = 4096
SLACK = 1e-9


def distinct_vectors(df: DataFrame) -> DataFrame:
    """id, key (null: links with nothing), vector (floats where they hold it, else doubles), dim. df: id, vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            keys, vectors, dims = [], [], []
            for known, own in zip(batch.column("id").is_valid().to_pylist(), column, strict=True):
                values = own.values if own.is_valid and known else None
                raw = None
                if values is not None and len(values) and not values.null_count:
                    raw = values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                    raw = raw if np.isfinite(raw).all() and raw.any() else None
                keys.append(None if raw is None else xxhash.xxh3_128_digest(raw.tobytes()))
                dims.append(None if raw is None else len(raw))
                if raw is not None:
                    with np.errstate(over="ignore"):
                        short = raw.astype(np.float32)
                    raw = short if np.array_equal(short, raw) else raw
                vectors.append(None if raw is None else raw.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary()), pa.array(dims, pa.int32())], names=["id", "key", "vector", "dim"])

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, key binary, vector binary, dim int")


def units_of(vectors: list[bytes], dim: int) -> np.ndarray:
    """Rows of length one, in doubles."""
    raw = np.empty((len(vectors), dim))
    for i, v in enumerate(vectors):
        raw[i] = np.frombuffer(v, np.float32 if len(v) == 4 * dim else np.float64)
    raw /= np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]


class Plan:
    """Rotation, blocks, budgets and grids for vectors of one length."""

    def __init__(self, sample: np.ndarray, budget: float, axes: int = AXES) -> None:
        dim = sample.shape[1]
        values, turn = np.linalg.eigh(np.cov(sample.T).reshape(dim, dim)) if len(sample) > 1 else (np.ones(dim), np.eye(dim))
        self.turn = np.ascontiguousarray(turn[:, ::-1])
        self.spread = np.maximum(values[::-1], 1e-12)
        self.budget = budget + SLACK
        self._blocks(axes)
        self.grids: list[list[int]] = []  # of each block, where all have one
        if len(sample) > 1:
            turned = self.rotated(sample)
            tried = []
            for size in GRIDDED:
                self._blocks(size)
                for n in range(1, min(GRID_AXES, size) + 1):
                    grids = [own[:n].tolist() for own in self.blocks]
                    tried.append((sum(self._left(turned, b, g) for b, g in enumerate(grids)), size, grids))
            left, size, grids = min(tried, key=lambda t: t[0])
            self._blocks(size if left < WORTH else axes)
            self.grids = grids if left < WORTH else []

    def _blocks(self, axes: int) -> None:
        """Axes are dealt around, so that each block begins with one that spreads widely."""
        dim = len(self.spread)
        n = max(1, dim // axes)
        self.blocks = [np.arange(b, dim, n) for b in range(n)]
        energy = np.array([self.spread[b].sum() for b in self.blocks])
        self.shares = self.budget * energy / energy.sum()

    def _left(self, turned: np.ndarray, block: int, grid: list[int]) -> float:
        """The share of pairs that a grid leaves to compare, from neighbours in the sample's order."""
        cells = self._cells(turned, block, grid)
        return float(np.mean([np.mean((np.abs(cells[k:] - cells[:-k]) <= 1).all(axis=1)) for k in range(1, min(17, len(cells)))]))

    def _cells(self, turned: np.ndarray, block: int, grid: list[int]) -> np.ndarray:
        return np.floor(turned[:, grid] / (np.sqrt(self.shares[block]) * (1 + 1e-9))).astype(np.int64)

    def rotated(self, units: np.ndarray) -> np.ndarray:
        """A row's numbers don't depend on the rows around it."""
        return np.einsum("ij,jk->ik", units, self.turn)

    def cells(self, units: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        """(unit, cells of each vector as (n, axes), offsets of the later neighbours): a unit for each block's grid, or one without cells."""
        if not self.grids:
            yield 0, np.zeros((len(units), 0), np.int64), []
            return
        turned = self.rotated(units)
        for b, grid in enumerate(self.grids):
            yield b, self._cells(turned, b, grid), [np.array(o, np.int64) for o in product((-1, 0, 1), repeat=len(grid)) if o > (0,) * len(grid)]

    def candidates(self, block: int, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs within the block's share, by bands along its first axis. a, b: rotated rows."""
        own, share = self.blocks[block], self.shares[block]
        order, other = np.argsort(a[:, own[0]]), np.argsort(b[:, own[0]])
        x, y = a[order][:, own], b[other][:, own]
        radius = np.sqrt(share) + 1e-6
        sizes = lambda m: (m * m).sum(axis=1, keepdims=True)
        ones = lambda m: np.ones((len(m), 1))
        left = np.hstack([-2 * x, sizes(x), ones(x)]).astype(np.float32)
        right = np.ascontiguousarray(np.hstack([y, ones(y), sizes(y)]).astype(np.float32).T)
        for s in range(0, len(x), 512):
            part = left[s : s + 512]
            low, high = np.searchsorted(y[:, 0], [x[s, 0] - radius, x[s : s + 512, 0][-1] + radius])
            i, j = np.nonzero(part @ right[:, low:high] <= np.float32(share + 1e-5))
            yield order[s + i], other[low + j]

    def near(self, unit: int, left: np.ndarray, right: np.ndarray, same: bool, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs of near vectors that this unit is the first to find."""
        a = self.rotated(left)
        b = a if same else self.rotated(right)
        found = [np.zeros(0, np.int64)]
        for block in [unit] if self.grids else range(len(self.blocks)):
            for i, j in self.candidates(block, a, b):
                if same:
                    i, j = i[i < j], j[i < j]
                found.append(i * len(right) + j)
        keys = np.unique(np.concatenate(found))
        for s in range(0, len(keys), 1 << 16):
            p, q = np.divmod(keys[s : s + (1 << 16)], len(right))
            keep = np.einsum("ij,ij->i", left[p], right[q]) >= cosine
            p, q = p[keep], q[keep]
            if self.grids and len(p):
                gap = (a[p] - b[q]) ** 2
                within = lambda k: gap[:, self.blocks[k]].sum(axis=1) <= self.shares[k]  # noqa: B023, E731
                first = within(unit)
                for k in range(unit):
                    first &= ~within(k)
                p, q = p[first], q[first]
            if len(p):
                yield p, q


def near_links(classes: DataFrame, cosine: float, axes: int = AXES, tile_rows: int = TILE_ROWS) -> DataFrame:
    """a, b, n: n (with b null) is a part of the links of class a; with b, an edge of a spanning forest. classes: key, vector, dim, copies."""
    plans: dict[int, Plan] = {}
    sample = classes.orderBy("key").limit(SAMPLE_ROWS).select("vector", "dim").toArrow()
    dims = np.array(sample.column("dim").to_pylist(), np.int64)
    for d in set(dims.tolist()):
        plans[d] = Plan(units_of([v for v, k in zip(sample.column("vector").to_pylist(), dims, strict=True) if k == d], d), 2 - 2 * cosine, axes)
    plan_of = lambda d: plans.get(d) or Plan(np.zeros((0, d)), 2 - 2 * cosine, axes)  # noqa: E731  a length that the sample lacks

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                part = batch.take(pa.array(rows))
                units = units_of(part.column("vector").to_pylist(), d)
                for u, at, offsets in plan_of(d).cells(units):
                    for guest, shift in [(False, 0), *((True, o) for o in offsets)]:
                        names = [f"{d}:{u}:" + ",".join(map(str, c)) for c in (at + shift).tolist()]
                        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([guest] * len(rows)), part.column("key"), part.column("vector"), part.column("copies")], names=["cell", "guest", "key", "vector", "copies"])

    placed = classes.select("key", "vector", "dim", "copies").mapInArrow(place, "cell string, guest boolean, key binary, vector binary, copies bigint")
    tiles = lambda of: F.greatest(F.ceil(F.sum(F.when(of, 1).otherwise(0)) / tile_rows), F.max(F.when(of, 1).otherwise(0))).cast("int")
    sizes = placed.groupBy("cell").agg(tiles(~F.col("guest")).alias("homes"), tiles(F.col("guest")).alias("guests")).where("homes > 0").withColumnRenamed("cell", "k")
    own = placed.join(sizes, F.col("cell") == F.col("k")).withColumn("tile", F.pmod(F.xxhash64("key"), F.when(F.col("guest"), F.col("guests")).otherwise(F.col("homes"))).cast("int"))
    task = lambda i, j, kind, side: F.struct(i.alias("i"), j.alias("j"), F.lit(kind).alias("kind"), F.lit(side).alias("side"))
    upto = lambda a, n: F.when(n > a, F.sequence(a, n - 1)).otherwise(F.array().cast("array<int>"))
    t = F.col("tile")
    home = F.concat(
        F.transform(upto(t, F.col("homes")), lambda j: task(t, j, "home", 0)),
        F.transform(upto(F.lit(0), t), lambda i: task(i, t, "home", 1)),
        F.transform(upto(F.lit(0), F.col("guests")), lambda j: task(t, j, "guest", 0)),
    )
    guest = F.transform(upto(F.lit(0), F.col("homes")), lambda i: task(i, t, "guest", 1))
    dealt = own.select("cell", "key", "vector", "copies", F.explode(F.when(F.col("guest"), guest).otherwise(home)).alias("t"))
    dealt = dealt.select(F.concat_ws("/", "cell", "t.kind", "t.i", "t.j").alias("task"), F.col("t.side").alias("side"), "key", "vector", "copies")

    def compare(rows: pa.Table) -> pa.Table:
        name = rows.column("task")[0].as_py()
        cell, kind, i, j = name.split("/")
        dim, unit = map(int, cell.split(":")[:2])
        side = rows.column("side").to_numpy()
        keys = rows.column("key").to_pylist()
        copies = rows.column("copies").to_numpy()
        units = units_of(rows.column("vector").to_pylist(), dim)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = kind == "home" and i == j
        if same:
            right = left
        label = np.arange(len(keys))
        links = np.zeros(len(keys), np.int64)
        for p, q in plan_of(dim).near(unit, units[left], units[right], same, cosine):
            p, q = left[p], right[q]
            links += np.bincount(p, weights=copies[q], minlength=len(keys)).astype(np.int64) + np.bincount(q, weights=copies[p], minlength=len(keys)).astype(np.int64)
            join_labels(label, p, q)
        has, moved = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(keys)))
        take = lambda at: [keys[x] for x in at]
        tidy()
        return pa.table({"a": pa.array(take(has) + take(moved), pa.binary()), "b": pa.array([None] * len(has) + take(label[moved]), pa.binary()), "n": pa.array([*links[has].tolist(), *[None] * len(moved)], pa.int64())})

    return dealt.groupBy("task").applyInArrow(compare, "a binary, b binary, n bigint")


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, axes: int = AXES) -> DataFrame:
    """id, n_links, component_id, kept: one row for each row of df."""
    rows = distinct_vectors(pick(df, id=id_col, vector=vector_col))
    keyed = cut(rows)
    valid = keyed.where("key is not null")
    classes = cut(valid.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"), F.first("dim").alias("dim")))
    found = cut(near_links(classes, cosine, axes))
    links = found.where("n is not null").groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("n"))
    nodes = connected_components(found.where("b is not null").select("a", "b"))
    least = classes.join(nodes, F.col("key") == F.col("node"), "left").select("key", "least", "copies", F.coalesce("component", "key").alias("component"))
    first = least.groupBy(F.col("component").alias("c")).agg(F.min("least").alias("component_id"))
    known = least.join(first, F.col("component") == F.col("c")).join(links, F.col("key") == F.col("k"), "left").select(F.col("key").alias("known"), "component_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    out = keyed.select("id", "key").join(known, F.col("key") == F.col("known"), "left")
    component = F.coalesce("component_id", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op7_near_vectors(spark, sf_dir: str) -> DataFrame:
    """All rows of embeddings, linked at cosine 0.9."""
    found = near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")
