import random
import re
from itertools import combinations

import pytest

from basalt.llm import shingle_join

RNG = random.Random(2)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(1, 5))) for _ in range(400)]


def shingles(text, words):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)]) if w else frozenset()


def brute(rows, words, percent):
    sets = [shingles(t, words) if i is not None else frozenset() for i, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b]:
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                label[find(a)] = find(b)
    least: dict = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(shingles(t, words)), least.get(find(k))) for k, (i, t) in enumerate(rows)), key=str)


def edited(words, edits):
    words = list(words)
    for _ in range(edits):
        at = RNG.randrange(len(words))
        words[at : at + RNG.choice([0, 1])] = [RNG.choice(WORDS)] * RNG.choice([0, 1])
    return " ".join(words)


def corpus():
    out = [None, "", "  \t", "one", "One", "one two three", "one two three four", "a\x1cb c d e"]
    for _ in range(12):
        base = RNG.choices(WORDS, k=RNG.randint(8, 120))
        out += [edited(base, RNG.choice([0, 1, 2, 4, 8])) for _ in range(RNG.randint(1, 9))]
    hot = RNG.choices(WORDS, k=90)
    out += [edited(hot, RNG.randint(0, 5)) for _ in range(60)]
    common = " ".join(RNG.choices(WORDS, k=30))
    out += [common + " " + " ".join(RNG.choices(WORDS, k=RNG.randint(0, 12))) for _ in range(25)]
    return out


@pytest.mark.parametrize(("words", "percent", "tile"), [(4, 85, 1024), (5, 80, 7), (1, 50, 16)])
def test_same_as_all_pairs(spark, monkeypatch, words, percent, tile):
    monkeypatch.setattr(shingle_join.class_links, "__defaults__", (tile,))
    monkeypatch.setattr(shingle_join, "BROADCAST_IDS", 0 if tile == 7 else 10**6)
    texts = corpus()
    ids = list(range(len(texts)))
    RNG.shuffle(ids)
    rows = [*zip(ids, texts, strict=True), (None, texts[20]), (ids[9], texts[9]), (ids[9], texts[30])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(map(tuple, shingle_join.shingle_components(df, words=words, percent=percent).collect()), key=str)
    want = brute(rows, words, percent)
    assert [g for g in got if g[0] is not None] == [w for w in want if w[0] is not None]
    assert [g[2] for g in got if g[0] is None] == [None]


def steps(spark, texts, tile, words=4, percent=85):
    """Candidates and opened ones of the join, and its links."""
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    rows = shingle_join.classes_that_may_link(docs, words, percent)
    sets = shingle_join.cut(shingle_join.sets_of(docs, rows.where("may").groupBy("key").agg({"id": "min"}).toDF("key", "id"), words))
    placed = shingle_join.grouped_sets(sets, percent, tile)
    homes = shingle_join.cut(shingle_join.compared_groups(placed, sets, percent))
    asked = shingle_join.asked_groups(placed, homes)
    opened = shingle_join.cut(shingle_join.opened_groups(asked, homes, sets, percent, tile))
    return placed, homes, asked.count(), opened.count(), shingle_join.open_groups(opened, placed, sets, percent, tile).count()


def test_groups_open_and_stay_closed(spark):
    """Neighbouring families share a rare passage, which makes candidates, but too few tokens to link."""
    texts, rare = [], [" ".join(RNG.choices(WORDS, k=9)) for _ in range(31)]
    for k in range(30):
        base = RNG.choices(WORDS, k=160)
        texts += [edited(base, 1) for _ in range(5)] + [f"{' '.join(base)} {rare[k]}", f"{' '.join(base)} {rare[k + 1]}"]
    _, _, asked, opened, links = steps(spark, texts, 1024)
    assert 0 < links and 0 < opened < asked
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted(map(tuple, shingle_join.shingle_components(df).collect()), key=str)
    assert got == brute(list(enumerate(texts)), 4, 85)


def test_tiles_of_a_large_group_of_near_copies_are_not_asked(spark):
    base = RNG.choices(WORDS, k=300)
    texts = list(dict.fromkeys(edited(base, RNG.randint(0, 3)) for _ in range(150)))
    placed, homes, asked, _, _ = steps(spark, texts, 10)
    groups, classes = homes.where("key is null").count(), homes.where("key is not null").count()
    assert groups > 5 and asked < classes  # not the square of the tiles
    assert placed.where("guest").count() > 0


def test_threshold_is_met_exactly(spark):
    base = [f"w{i}" for i in range(40)]
    a, b = " ".join(base), " ".join([*base[:37], "x", "y", "z"])
    for percent in (84, 85):
        common, union = 34, 40
        df = spark.createDataFrame([(1, a), (2, b)], "doc_id bigint, text string")
        linked = [r.component_id for r in shingle_join.shingle_components(df, words=4, percent=percent).orderBy("id").collect()] == [1, 1]
        assert linked == (100 * common >= percent * union)


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert shingle_join.shingle_components(df).count() == 0
    df = spark.createDataFrame([(1, "a b", "k", 3)], "doc_id bigint, text string, key string, N int")
    assert shingle_join.shingle_components(df).collect() == [(1, 1, 1)]
