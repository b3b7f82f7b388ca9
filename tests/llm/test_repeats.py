import hashlib
import random
from pathlib import Path

import numpy as np
import pytest

from basalt.llm import repeats
from basalt.llm.run_index import RunIndex

RNG = random.Random(6)


def brute(rows, least=50):
    seen: dict = {}
    for i, t in rows:
        data = (t or "").encode()
        for s in range(len(data) - least + 1):
            if i is not None:
                w = data[s : s + least]
                seen[w] = min(seen.get(w, i), i)
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - least + 1):
            if i is not None and seen[data[s : s + least]] < i:
                gone[s : s + least] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()) if len(data) else 0
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((i, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def noise(n, letters="abcdefghij é"):
    return "".join(RNG.choice(letters) for _ in range(n))


def corpus():
    passages = [noise(n) for n in (49, 50, 51, 80, 400, 3000)]
    out = [None, "", "x" * 49, "x" * 50, "x" * 51, "x" * 5000, "ab" * 300, noise(60_000)]
    for _ in range(60):
        parts = [noise(RNG.randint(0, 120)) for _ in range(3)] + [p[RNG.randint(0, 20) :] if RNG.random() < 0.3 else p for p in RNG.sample(passages, 2)]
        RNG.shuffle(parts)
        out.append("".join(parts))
    base = noise(2000)
    for _ in range(25):
        at = RNG.randrange(2000)
        out.append(base[:at] + noise(RNG.randint(0, 3)) + base[at + RNG.randint(0, 2) :])
    out += [passages[4] + noise(40) for _ in range(40)]
    return out + out[10:20]


@pytest.mark.parametrize(("hot", "block", "small"), [(50_000, 2 << 20, True), (3, 5000, False)])
def test_same_as_brute_force(spark, tmp_path, monkeypatch, hot, block, small):
    monkeypatch.setattr(repeats, "HOT_ROWS", hot)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    if not small:
        monkeypatch.setattr(repeats, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(repeats, "BUCKET_ROWS", 50)
    texts = corpus()
    ids = list(range(len(texts)))
    RNG.shuffle(ids)
    rows = [*zip(ids, texts, strict=True), (None, texts[30]), (ids[12], texts[12]), (ids[15], texts[40])]
    spark.createDataFrame([(*r, "k") for r in rows], "doc_id bigint, text string, KEY string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, repeats.op10_remove_repeats(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize(("hot", "small"), [(50_000, True), (3, False)])
def test_unlike_texts_of_one_id_lose_their_own_repeats(spark, tmp_path, monkeypatch, hot, small):
    monkeypatch.setattr(repeats, "HOT_ROWS", hot)
    if not small:
        monkeypatch.setattr(repeats, "BROADCAST_BYTES", 0)
    first, other = noise(300), noise(200)
    rows = [(1, first), (2, other), (7, noise(100) + first + noise(100)), (7, noise(400) + other + noise(50)), (7, noise(600)), (7, first), (9, noise(80) + first[:120])]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, repeats.op10_remove_repeats(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows)


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert repeats.remove_repeats(df).count() == 0
    one = repeats.remove_repeats(spark.createDataFrame([(1, "a" * 200)], "doc_id bigint, text string")).first()
    assert (one.n_bytes, one.removed, bytes(one.kept)) == (200, [], b"a" * 200)


def indexed(texts, ages, depth):
    sizes = np.array([len(t) for t in texts], np.int64)
    return RunIndex(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes, np.array(ages), depth)


@pytest.mark.parametrize(("letters", "depth"), [("ab", 8), ("abc", 5), ("ab", 12), ("a", 4), ("\0a", 6)])
def test_index_finds_the_oldest_owner_of_every_match(letters, depth):
    for _ in range(10):
        texts = list(dict.fromkeys(noise(RNG.randint(1, 40), letters).encode() for _ in range(RNG.randint(1, 25))))
        ages = [RNG.randrange(50) for _ in texts]
        index = indexed(texts, ages, depth)
        asked = [noise(RNG.randint(1, 50), letters + "z").encode() for _ in range(12)] + texts
        sizes = np.array([len(t) for t in asked])
        oldest = index.oldest_matches(np.frombuffer(b"".join(asked), np.uint8), np.cumsum(sizes) - sizes, sizes, 99).tolist()
        want = [min((a for s, a in zip(texts, ages, strict=True) if len(t) - k >= depth and t[k : k + depth] in s), default=99) for t in asked for k in range(len(t))]
        assert oldest == want


def test_samples_are_the_oldest_rows_of_their_runs():
    texts = [noise(40, "ab").encode() for _ in range(20)]
    index = indexed(texts, list(range(20)), 6)
    flat, matches = b"".join(texts), {t[k : k + 6] for t in texts for k in range(35)}
    assert {flat[p : p + 6] for p in index.sampled.tolist()} == matches and len(index.sampled) == len(matches)
    assert all(a == min(i for i, t in enumerate(texts) if flat[p : p + 6] in t) == p // 40 for p, a in zip(index.sampled.tolist(), index.oldest.tolist(), strict=True))


def test_runs_of_repetitive_strings_are_few():
    base = noise(60, "abcdefgh").encode()
    texts = [base[:30] + bytes([65 + i]) + base[30:] for i in range(26)]
    index = indexed(texts, list(range(26)), 10)
    assert len(index.keys) == len({t[k : k + 10] for t in texts for k in range(52)}) < 26 * 52 / 3


def test_repeats_are_found_by_the_index_alone(spark, tmp_path, monkeypatch):
    """Of texts that are no copies as a whole, no repeat is found where the index finds nothing."""
    passage = noise(400)
    rows = [(i, noise(200) + passage[i : 300 + i] + noise(100)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    ask = lambda: repeats.remove_repeats(df).selectExpr("sum(aggregate(removed, 0, (a, r) -> a + r.end - r.start)) AS n").first().n
    assert ask() == sum(r[2] for r in brute(rows))
    monkeypatch.setattr(repeats, "repeats_of", blind)
    assert ask() == 0


def test_exchanges_stay_small_and_go(spark, monkeypatch):
    """Pieces travel packed, those of hot anchors aside, and no exchange outlives the step that made it (before: 10 times the text, of which 8 stayed)."""
    monkeypatch.setattr(repeats, "HOT_ROWS", 200)
    line = noise(150)
    bases = [noise(4000) for _ in range(100)]
    rows = [(3 * i + k, b[:2000] + noise(60) * (k > 0) + b[2000:] + noise(30) + line) for i, b in enumerate(bases) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    env, store = spark._jvm.org.apache.spark.SparkEnv, spark.sparkContext._jsc.sc().statusStore()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return store.executorSummary("driver").totalShuffleWrite()

    def left():
        dirs = env.get().blockManager().diskBlockManager().localDirsString()
        return sum(p.stat().st_size for d in dirs for p in Path(d).rglob("shuffle_*.data"))

    there, before = left(), written()
    found = repeats.remove_repeats(df)
    made, text = written() - before, sum(len(t.encode()) for _, t in rows)
    assert left() - there < 0.01 * text
    assert made < 8 * text
    got = sorted((r.id, r.n_bytes, sum(x.end - x.start for x in r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in found.collect())
    assert got == sorted(brute(rows))


def blind(held, rows, *_):
    return np.zeros((3, 0), np.int64)


def test_every_window_has_an_owner():
    data = np.frombuffer(noise(3000, "ab").encode(), np.uint8)
    ends = np.array([1000, 1030, 3000])
    found = repeats.Anchors(data, ends, 50)
    windows = np.flatnonzero(found.low)
    inside = [s for a, b in zip([0, 1000, 1030], ends, strict=True) for s in range(a, b - 49)]
    assert windows.tolist() == inside
    places = found.places[found.owners(windows)]
    assert ((places >= windows) & (places + repeats.GRAM <= windows + 50)).all()
