"""Quality classifier: a linear support vector machine on naive Bayes features, by dual coordinate descent.

Features say which byte n-grams a text holds and which repeating word n-grams (hashed to `BITS` bits), each scaled by its log-count ratio
between the classes; a text's features have length one. The hinge-loss model is fitted by dual coordinate
descent, and a logistic curve, fitted on labelled rows that the model has not seen, turns margins into scores.

Executors make the features of at most `fit_rows` labelled rows, those with the smallest hash of their id, and the driver fits
the model on these lists of at most 2^BITS numbers, so its cost is the same at every size; the scoring pass is row by row over all whole texts, with one broadcast
vector of 2^BITS numbers.

Defined results: null and empty texts have no features and get the score of the model's offset; without labels all
scores are 0.5, with labels of one class all are that class; repeated rows get equal scores; a doc_id labelled twice counts
with its smallest label, and of several texts of a labelled id one is learned; null labels are ignored; a score of just 0.5 is predicted 1; empty tables give empty tables; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import as_binary, crc32_mod, pick, sliced, table, tidy

BITS = 18
ORDERS = (2, 3, 4)
FIT_ROWS = 4000
#: Of word n-grams up to this order, those that repeat at once count by how often in a row they do, in powers of two.
BACK = 3
ROUNDS = 15
COST = 1.0


class Features:
    """Indices of a text's n-grams, each once."""

    def __init__(self, bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> None:
        self.size, self.shift, self.orders = 1 << bits, 32 - bits, orders
        self.seen = np.zeros(self.size, bool)

    def of(self, data: bytes) -> np.ndarray:
        raw = np.frombuffer(data, np.uint8).astype(np.uint32)
        seen = self.seen
        found = []
        for n in self.orders:
            if len(raw) < n:
                break
            code = np.full(len(raw) - n + 1, n, np.uint32)
            for k in range(n):
                code *= np.uint32(257)
                code += raw[k : len(raw) - n + 1 + k]
            code *= np.uint32(2654435761)  # Fibonacci hashing
            found.append(code >> np.uint32(self.shift))
        words = data.lower().split()
        if len(words) > 1:
            ids = np.fromiter(map({}.setdefault, words, range(len(words))), np.uint32, len(words))
            for back in range(1, min(BACK, len(words) - 1) + 1):
                alike = ids[back:] == ids[:-back]
                if alike.any():
                    run = np.diff(np.flatnonzero(np.concatenate(([False], alike, [False])) != np.concatenate(([False], [False], alike))))[::2].max()
                    found.append((np.arange(1, int(run).bit_length() + 1, dtype=np.uint32) * np.uint32(64) + np.uint32(back)) * np.uint32(2246822519) >> np.uint32(self.shift))
        if not found:
            return np.zeros(0, np.int32)
        for f in found:
            seen[f] = True
        at = np.flatnonzero(seen).astype(np.int32)
        seen[at] = False
        return at


@dataclass
class Model:
    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def score(self, at: np.ndarray, scale: np.ndarray) -> float:
        norm = np.sqrt(scale[at].sum()) if len(at) else 0.0
        margin = self.offset + (self.weights[at].sum() / norm if norm else 0.0)
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    """Of each feature, the log of its smoothed share in class 1 over that in class 0."""
    counts = np.ones((2, size))
    for at, y in zip(rows, labels, strict=True):
        counts[int(y)][at] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, size: int, cost: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of min |w|^2 / 2 + sum cost * hinge; the last weight is the offset, whose feature is always 1."""
    w = np.zeros(size + 1)
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(7)
    norms = np.array([float(v @ v) + 1 for v in values])
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            slack = signs[i] * (float(w[rows[i]] @ values[i]) + w[-1]) - 1
            new = min(max(alpha[i] - slack / norms[i], 0.0), cost[i])
            step = (new - alpha[i]) * signs[i]
            if step:
                w[rows[i]] += step * values[i]
                w[-1] += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


def logistic_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability of class 1 by Newton's method, with smoothed targets."""
    ones, zeros = labels.sum(), len(labels) - labels.sum()
    goal = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    at = np.array([1.0, 0.0])
    loss = lambda b: float(np.sum(np.logaddexp(0, x @ b) - goal * (x @ b)) + 1e-3 * b @ b)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 2e-3 * np.eye(2), x.T @ (goal - p) - 2e-3 * at)
        scale = 1.0
        while scale > 1e-6 and loss(at + scale * step) > loss(at):
            scale /= 2
        at = at + scale * step
        if np.abs(scale * step).max() < 1e-9:
            break
    return max(float(at[0]), 1e-6), float(at[1])


def fit(rows: list[np.ndarray], labels: list[int], size: int = 1 << BITS) -> tuple[Model, np.ndarray]:
    """The model of rows of feature indices, and what each feature adds to a text's squared length."""
    y = np.array(labels, dtype=np.int64)
    if len(set(labels)) < 2:
        sure = 0.0 if not labels else 40.0 if labels[0] else -40.0
        return Model(np.zeros(size, np.float32), 0.0, 1.0, sure), np.zeros(size, np.float32)

    def train(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ratios = log_count_ratios([rows[i] for i in part], y[part], size)
        values = []
        for i in part:
            v = ratios[rows[i]]
            values.append((v / (np.linalg.norm(v) or 1.0)).astype(np.float32))
        cost = np.full(len(part), COST)
        return ratios, dual_coordinate_descent([rows[i] for i in part], values, np.where(y[part] == 1, 1.0, -1.0), size, cost)

    def margins(ratios: np.ndarray, w: np.ndarray, part: np.ndarray) -> np.ndarray:
        out = []
        for i in part:
            v = ratios[rows[i]]
            out.append(w[-1] + float(w[rows[i]] @ v) / (np.linalg.norm(v) or 1.0))
        return np.array(out)

    part = np.arange(len(rows))
    unseen, seen_y = part[part % 4 == 0], set(y[part % 4 != 0].tolist())
    if len(unseen) >= 20 and len(seen_y) == 2:
        slope, shift = logistic_curve(margins(*train(part[part % 4 != 0]), unseen), y[unseen])
    else:
        slope, shift = 4.0, 0.0
    ratios, w = train(part)
    return Model((w[:-1] * ratios).astype(np.float32), float(w[-1]), slope, shift), (ratios**2).astype(np.float32)


def sample_of_labels(labels: DataFrame, fit_rows: int, keep: Column) -> DataFrame:
    """At most fit_rows of the rows (id, label) that `keep` allows, the smallest by hash."""
    one = labels.where("label is not null and id is not null").groupBy("id").agg(F.min("label").alias("label"))
    return one.where(keep).orderBy(F.xxhash64("id"), "id").limit(fit_rows)


def quality_scores(docs: DataFrame, labels: DataFrame, fit_docs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """row (the document's row as a struct of c0, c1, ...), held_out, score. Labels are learned only from ids whose crc32 mod 3 is not 1."""
    names = docs.columns
    chosen = sample_of_labels(pick(labels, id=label_id, label=label_col), fit_rows, crc32_mod(F.col("id"), 3) != 1)
    known = pick(docs if fit_docs is None else fit_docs, id=id_col, text=text_col)
    picked = known.join(F.broadcast(chosen.withColumnRenamed("id", "k")), F.col("id") == F.col("k"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features()
        for batch in sliced(batches, 512):
            texts = as_binary(batch.column("text")).to_pylist()
            hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(hashes), pa.array([make.of(t) for t in texts], pa.list_(pa.int32()))], names=["id", "label", "h", "at"])

    kind = picked.schema["id"].dataType.simpleString()
    made = picked.select("id", F.col("label").cast("int").alias("label"), "text").mapInArrow(features, f"id {kind}, label int, h bigint, at array<int>")
    order = F.crc32(F.col("id").cast("string").cast("binary")).alias("order")
    rows = made.groupBy("id").agg(F.min("label").alias("label"), F.min_by("at", "h").alias("at")).select(order, "label", "at").toArrow().sort_by("order")  # of rows of one id, one
    found = [own.values.to_numpy(zero_copy_only=False) for own in rows.column("at")]
    model, scale = fit(found, rows.column("label").to_pylist())
    del rows, found
    tidy()
    held = docs.sparkSession.sparkContext.broadcast((model, scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, lengths = held.value
        make = Features()
        for batch in sliced(batches, 512):
            found = [own.score(make.of(t), lengths) for t in as_binary(batch.column("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.float64())], names=["row", "score"])

    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = F.col(f"c{names.index(text_col)}")
    source = plain.select(F.struct(*plain.columns).alias("row"), text.alias("text"))
    scored = source.mapInArrow(run, f"row {source.schema['row'].dataType.simpleString()}, score double")
    return scored.select("row", (crc32_mod(F.col(f"row.c{names.index(id_col)}"), 3) == 1).alias("held_out"), "score")


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents scored as labels.quality marks it."""
    docs = table(spark, sf_dir, "documents")
    narrow = pick(docs, doc_id="doc_id", text="text")
    ids = narrow.select(F.col("doc_id"), F.col("text"))
    scored = quality_scores(ids, table(spark, sf_dir, "labels"))
    return scored.select(F.col("row.c0").alias("doc_id"), "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
