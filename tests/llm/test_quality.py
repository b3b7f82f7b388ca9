import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.llm import quality

RNG = random.Random(9)
WORDS = ["".join(RNG.choice("aeioulnrst") for _ in range(RNG.randint(2, 7))) for _ in range(300)]


def good():
    return " ".join(RNG.choice(WORDS) for _ in range(RNG.randint(5, 60))).capitalize() + "."


def junk():
    return RNG.choice([lambda: " ".join(w + "***" for w in RNG.choices(WORDS, k=30)), lambda: (RNG.choice(WORDS) + " ") * 30, lambda: " ".join(RNG.choices(WORDS, k=20)).upper() + "!!"])()


def rows(n):
    return [(i, good() if i % 4 else junk()) for i in range(n)]


@pytest.fixture(scope="module")
def corpus():
    return rows(700)


def test_query_on_held_out_rows(spark, tmp_path, corpus):
    docs = [*corpus, (5000, None), (5001, ""), (5002, "a" * 100_000), *corpus[:3]]
    spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("score", F.lit("clash")).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i % 4 > 0), 0) for i, _ in corpus] + [(3, None, 0), (10**7, 1, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = quality.op9_quality_classifier(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    hits = []
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.held_out and r.doc_id < 5000:
            hits.append(r.predicted == int(r.doc_id % 4 > 0))
    assert len(hits) > 150 and np.mean(hits) > 0.97
    same = {}
    for r in got:
        assert same.setdefault(r.doc_id, r.score) == r.score


def test_labels_are_learned_from_the_fold_only(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i, _ in corpus], "doc_id bigint, quality int")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r.row.c0, r.score) for r in quality.quality_scores(docs, x).collect()) for x in (labels, turned))
    assert a == b


@pytest.mark.parametrize(("labels", "score"), [([], 0.5), ([(1, 1)], 1.0), ([(1, 0), (3, 0)], 0.0)])
def test_too_few_classes(spark, labels, score):
    docs = spark.createDataFrame([(1, "a b"), (3, None)], "doc_id bigint, text string")
    got = quality.quality_scores(docs, spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()
    assert [r.score for r in got] == pytest.approx([score] * 2)
    assert quality.quality_scores(docs.limit(0), spark.createDataFrame(labels, "doc_id bigint, quality int")).count() == 0


def test_descent_meets_its_optimality_conditions():
    rng = np.random.default_rng(1)
    at = [np.sort(rng.choice(30, 6, replace=False)) for _ in range(80)]
    values = [rng.normal(size=6) for _ in at]
    signs = np.where([v[a < 15].sum() > 0 for a, v in zip(at, values, strict=True)], 1.0, -1.0)
    w = quality.dual_coordinate_descent(at, values, signs, 30, np.ones(80), rounds=2000)
    x = np.zeros((80, 31))
    for i, (a, v) in enumerate(zip(at, values, strict=True)):
        x[i, a] = v
    x[:, 30] = 1
    loss = lambda u: u @ u / 2 + np.maximum(0, 1 - signs * (x @ u)).sum()
    assert all(loss(w) <= loss(w + rng.normal(size=31) * s) + 1e-6 for s in (1e-3, 1e-2, 0.1) for _ in range(200))


def naive_features(data):
    """Indicators, byte by byte and word by word."""
    out = set()
    for n in (2, 3, 4):
        for k in range(len(data) - n + 1):
            code = n
            for b in data[k : k + n]:
                code = (code * 257 + b) % 2**32
            out.add(code * 2654435761 % 2**32 >> 14)
    words = data.lower().split()
    for back in range(1, 4):
        best = run = 0
        for k in range(back, len(words)):
            run = run + 1 if words[k] == words[k - back] else 0
            best = max(best, run)
        out |= {(e * 64 + back) * 2246822519 % 2**32 >> 14 for e in range(1, best.bit_length() + 1)}
    return sorted(out)


def naive_scores(train, labels, asked):
    """The model restated with dense matrices: ratios, a kernel, coordinate descent on it, and the curve of the module."""
    rows, names = [naive_features(t) for t in train], sorted({f for t in train for f in naive_features(t)})
    place = {f: i for i, f in enumerate(names)}
    y = np.array(labels)

    def dense(lists):
        x = np.zeros((len(lists), len(names)))
        for i, own in enumerate(lists):
            x[i, [place[f] for f in own if f in place]] = 1
        return x

    def machine(part, others):
        x = dense([rows[i] for i in part])
        counts = np.array([[1 + x[y[part] == c].sum(axis=0)] for c in (0, 1)])[:, 0]
        total = counts.sum(axis=1) + (2**18 - len(names))  # features that no text has count once, too
        ratio = np.log(counts[1] / total[1]) - np.log(counts[0] / total[0])
        scaled = [m * ratio / np.maximum(np.linalg.norm(m * ratio, axis=1, keepdims=True), 1e-300) for m in (x, *map(dense, others))]
        kernel = scaled[0] @ scaled[0].T + 1
        sign, alpha, rng = np.where(y[part] == 1, 1.0, -1.0), np.zeros(len(part)), np.random.default_rng(7)
        for _ in range(quality.ROUNDS):
            moved = 0.0
            for i in rng.permutation(len(part)):
                new = min(max(alpha[i] - (sign[i] * (kernel[i] @ (alpha * sign)) - 1) / kernel[i, i], 0.0), 1.0)
                moved, alpha[i] = max(moved, abs(new - alpha[i])), new
            if moved < 1e-4:
                break
        return [(s @ scaled[0].T + 1) @ (alpha * sign) for s in scaled[1:]]

    part = np.arange(len(rows))
    (unseen,) = machine(part[part % 4 != 0], [[rows[i] for i in part[part % 4 == 0]]])
    slope, shift = quality.logistic_curve(unseen, y[part % 4 == 0])
    (margins,) = machine(part, [[naive_features(t) for t in asked]])
    return 1 / (1 + np.exp(-(slope * margins + shift)))


def test_scores_are_those_of_an_independent_model(spark):
    corpus = rows(160)
    docs = spark.createDataFrame(corpus, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i, _ in corpus], "doc_id bigint, quality int")
    got = {r.row.c0: r.score for r in quality.quality_scores(docs, labels).collect()}
    order = sorted((zlib.crc32(str(i).encode()), i) for i, _ in corpus if zlib.crc32(str(i).encode()) % 3 != 1)
    text = {i: t.encode() for i, t in corpus}
    want = naive_scores([text[i] for _, i in order], [int(i % 4 > 0) for _, i in order], list(text.values()))
    assert np.allclose([got[i] for i in text], want, atol=2e-3)


def test_a_labelled_id_of_many_rows_is_learned_once(spark, monkeypatch):
    seen = []
    whole = quality.fit
    monkeypatch.setattr(quality, "fit", lambda rows, labels: seen.append(len(rows)) or whole(rows, labels))
    docs = spark.createDataFrame([(i % 5, f"text {i} of many") for i in range(500)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id bigint, quality int")
    assert quality.quality_scores(docs, labels).count() == 500 and seen[0] <= 5


def test_features_are_indicators():
    f = quality.Features()
    assert len(f.of(b"")) == 0 and len(f.of(b"a")) == 0
    assert np.array_equal(f.of(b"abab" * 10), f.of(b"abab" * 10)) and len(set(f.of(b"the cat"))) == len(f.of(b"the cat"))
    assert len(np.setdiff1d(f.of(b"zz zz zz zz"), f.of(b"zz zy zz"))) > 0
