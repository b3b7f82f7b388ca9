import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from basalt.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def ours():
    return bpe.TrieBPE(bpe.read_vocabulary(PATH))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(raw):
    return list(memoryview(raw).cast("i"))


def samples():
    rng = random.Random(11)
    pool = "aabbee  \n\t'srtvmdl09é中\U0001f600_-=.,!?<|>endoftext　\x85\x1c\x0b​"
    for i in range(1500):
        s = "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        if i % 3 == 0:
            s = "".join(chr(rng.choice([rng.randint(1, 0x7F), rng.randint(0x80, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(rng.randint(0, 15)))
        yield s + "<|endoftext|>" * (i % 7 == 0) + s
    yield from ("", "x" * 30_000, "ab" * 20_000, "=" * 20_000 + "y", " " * 5000, "the the the's")


def test_same_as_the_library(ours, library):
    texts = list(samples())
    found = ours.encode_batch(texts)
    for text, raw, theirs in zip(texts, found, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids(raw) == theirs.ids, text[:80]
        assert ours.decode(ids(raw)) == library.decode(theirs.ids, skip_special_tokens=False)


def test_every_letter_and_digit_is_cut_alike(ours, library):
    for c in [*range(1, 0xD800, 13), *range(0xE000, 0x32000, 29), 0x88F, 0x1C89, 0x13460, 0x1E5F1]:
        s = f"a{chr(c)}1"
        assert ours.words(s) == [s[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(s)], hex(c)


def test_order_and_batches_do_not_matter(ours):
    words = ["abc", "ab", "abcd", "b", "zzz"]
    assert ours.encode_batch([" ".join(words)] * 2)[0] == ours.encode_batch([" ".join(words)])[0]


def test_broken_bytes_decode_to_replacements(ours, library):
    one = ours.encode_batch(["é"])[0]
    assert len(ids(one)) == 1
    half = [next(i for i, b in ours.bytes_of.items() if b == b"\xc3")]
    assert ours.decode(half) == library.decode(half, skip_special_tokens=False) == "�"
    with pytest.raises(KeyError):
        ours.decode([10**6])


def test_vocabulary_is_checked(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_VOCAB_BYTES", 10)
    with pytest.raises(ValueError, match="bytes"):
        bpe.read_vocabulary(PATH)


def test_query(spark, tmp_path, library):
    texts = {1: "Hello world", 2: None, 3: "", 4: "x<|endoftext|>y", 5: "Hello world", 6: "naïve café " * 3000}
    spark.createDataFrame([(k, v, 7) for k, v in texts.items()], "doc_id bigint, text string, ids int").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in bpe.op2_bpe_encode_decode(spark, str(tmp_path)).collect()}
    for k, v in texts.items():
        theirs = library.encode(v or "", add_special_tokens=False).ids
        text = library.decode(theirs, skip_special_tokens=False)
        assert tuple(got[k]) == (k, len(theirs), hashlib.sha256(",".join(map(str, theirs)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_encode_then_decode(spark):
    df = spark.createDataFrame([(1, "one two"), (2, None)], "id int, text string")
    back = bpe.decode(bpe.encode(df, PATH, "id"), PATH)
    assert sorted((r.id, r.text) for r in back.collect()) == [(1, "one two"), (2, "")]
    assert bpe.encode(df.limit(0), PATH, "id").count() == 0
    nothing = spark.createDataFrame([(1, None)], "id int, ids array<int>")
    assert bpe.decode(nothing, PATH).first().text == ""
