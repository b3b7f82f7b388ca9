import random

import pytest
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from basalt.llm import secret_scan
from tests.llm.test_shingles import brute as same_groups

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
RNG = random.Random(12)
WORDS = ["".join(RNG.choice("aeioulnrst") for _ in range(RNG.randint(2, 7))) for _ in range(300)]


def documents():
    out = []
    for i in range(240):
        text = " ".join(RNG.choices(WORDS, k=RNG.randint(20, 60)))
        if i % 6 == 0:
            text = " ".join(w + "***" for w in text.split())
        if i % 10 == 1:
            text += " token=abcdef0123456789abcd end"
        out.append((i, text, "en", f"s{i % 4}" if i % 3 else "hot", len(text)))
    for k in range(30):
        i, text, *rest = out[1 + k * 2]
        words = text.split()
        words[k % len(words)] = "changed"
        out.append((1000 + k, " ".join(words), *rest))
    return out + [out[5], (2000, None, "en", None, None), (2001, "", None, "s1", 0), (None, "no id at all here", "en", "s1", 17)]


@pytest.fixture
def sf_dir(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], int("***" not in (r[1] or "")), 0) for r in rows if r[0] is not None and r[0] < 1000], "doc_id bigint, quality int, toxic int").distinct().write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    seen = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append(docs.collect())
    raw, good, single, clean, mixed, coded = seen
    # Quality: junk goes, clean documents stay.
    assert {r.doc_id for r in raw if r.doc_id is not None and r.text and "***" not in r.text} <= {r.doc_id for r in good}
    assert not [r for r in good if "***" in (r.text or "")]
    # One of each group stays, the one with the least id.
    want = {c for i, _, c in same_groups([(r.doc_id, r.text) for r in good], 5, 80) if c is not None}
    assert sorted(r.doc_id for r in single if r.doc_id is not None) == sorted(want)
    assert sum(r.doc_id is None for r in single) == sum(r.doc_id is None for r in good)
    # Secrets are gone, all else is as it was.
    redacted = {}
    for r in single:
        spans = [{"start": s, "end": e} for s, e, _ in secret_scan.find_secrets(r.text or "")]
        redacted[r.doc_id] = secret_scan.redact(r.text, spans) if spans else r.text
    assert {r.doc_id: r.text for r in clean} == redacted and len(clean) == len(single)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in clean)
    # The mix takes whole copies, at most two.
    held = {r.doc_id: tuple(r) for r in clean}
    copies: dict = {}
    for r in mixed:
        assert tuple(r) == held[r.doc_id]
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) == 2
    # Encoding is the library's.
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted(((r.doc_id, r.ids) for r in coded), key=str) == sorted(((r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids) for r in mixed), key=str)
    assert all(r.n_tokens == len(r.ids) for r in coded)


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    x, y, z, w = (" ".join(RNG.choices(WORDS, k=40)) for _ in range(4))
    rows = [(3, x), (7, x), (7, y), (7, z), (8, w), (8, w), (8, w + " more"), (9, y), (11, ""), (11, None), (11, z)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id not in (8, 11)) == sorted([(3, x), (7, y), (7, z)])
    assert len([r for r in got if r.doc_id == 8]) == 1 and [r.text or "" for r in got if r.doc_id == 11] == [""]


def test_run_is_the_stages(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.count() > 100 and got.columns == ["doc_id", "n_tokens", "ids"]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_entry_has_all_queries():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


