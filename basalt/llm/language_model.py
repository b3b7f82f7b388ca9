"""Language-model scoring by deleted interpolation.

A token's probability mixes the maximum-likelihood estimates of its bigram and its unigram with the uniform one:
    l2(b) * c(h, w) / c(h) + l1(b) * c(w) / N + l0(b) / (V + 1)
where b = floor(log2(c(h) + 1)) is the bucket of the context's frequency. The weights of each bucket are learned by
expectation-maximisation on held-out counts: a part of the training texts is deleted from the counts, its tokens are
looked up in what is left, and the likelihood of that part is maximised. Scores then use the counts of all training texts.

Counts cover all training texts. Texts are coded once, in blocks of about `BLOCK_BYTES`, and kept in the checkpoint folder;
each block asks for the counts of its distinct unigrams and bigrams (see exchange.py). What reaches the driver is N, V and
the held-out counts in classes of (bucket, bigram estimate, unigram estimate) a quarter of an octave wide: at most some
hundred thousand numbers, however large the corpus is.

Words are compared by 64-bit hashes (two of 10^8 distinct words meet with a chance of 3 in 10^4), bigrams by hashes of twice as many bits
as their number has, so that at most a few of all bigrams meet.

Defined results: a null or empty text has one token, the end; a null id counts as the empty text for the split; without training
texts N and V are 0 and both scores use the uniform estimate 1; repeated rows each count and each get a row; empty tables give
empty tables; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import crc32_mod, cut, pick, sliced, table, tidy
from basalt.llm.exchange import buckets_for, cut_by_range, grouped, mixed, pack, pack_sorted, unpack, unpack_sorted

BLOCK_BYTES = 8 << 20
#: A class of estimates is 1 / CLASSES octave; estimates reach down to 2^-LOWEST.
CLASSES, LOWEST = 4, 60
END = b"\n"
FIT, DELETED, SCORED = 0, 1, 2
MESSAGE = "block bigint, kind string, bucket int, ids binary, n bigint, v bigint, a binary, b binary, c binary, d binary"


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Numbers of words of each text, and all words: runs of bytes other than 20 and 09 to 0D, A-Z in lower case."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = split.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    keep = full.to_numpy(zero_copy_only=False)
    if not keep.all():
        of = np.repeat(np.arange(len(sizes)), sizes)
        sizes = np.bincount(of[keep], minlength=len(sizes))
        flat = flat.filter(full)
    return sizes, flat


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text with its end, as numbers of words by falling frequency, and hashes of the words."""
    sizes, flat = words_of(texts)
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names = coded.dictionary.cast(pa.large_binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, [*names, END]), np.uint64, len(names) + 1)
    del flat, coded, names
    end = len(hashes) - 1
    at = np.cumsum(sizes + 1) - 1
    all_codes = np.full(len(codes) + len(sizes), end, np.int64)
    inner = np.ones(len(all_codes), bool)
    inner[at] = False
    all_codes[inner] = codes
    order = np.argsort(-np.bincount(all_codes, minlength=end + 1), kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return sizes + 1, rank[all_codes].astype(np.uint32), hashes[order]


class Block:
    """A block's tokens, their contexts and their distinct bigrams."""

    def __init__(self, sizes: np.ndarray, codes: np.ndarray, hashes: np.ndarray, bits: int) -> None:
        self.sizes, self.codes, self.hashes = sizes, codes.astype(np.int64), hashes
        self.first = np.cumsum(sizes) - sizes
        end = self.codes[-1] if len(self.codes) else 0
        self.context = np.empty_like(self.codes)
        self.context[1:] = self.codes[:-1]
        self.context[self.first] = end
        pairs = self.context * (len(hashes) + 1) + self.codes
        distinct, self.pair_at = np.unique(pairs, return_inverse=True)
        before, after = np.divmod(distinct, len(hashes) + 1)
        keys = mixed(hashes[before], mixed(hashes[after], np.uint64(1))) >> np.uint64(64 - bits) << np.uint64(64 - bits)
        self.pair_order = np.argsort(keys, kind="stable")
        self.pair_keys = keys[self.pair_order]
        self.word_order = np.argsort(hashes, kind="stable")

    def counts(self, roles: np.ndarray, role: int) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each word and each bigram, in the order of their keys, in texts of a role."""
        of = np.repeat(roles == role, self.sizes)
        words = np.bincount(self.codes[of], minlength=len(self.hashes))[self.word_order]
        pairs = np.bincount(self.pair_at[of], minlength=len(self.pair_keys))[self.pair_order]
        return words, pairs


def message(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"block": pa.int64(), "kind": pa.string(), "bucket": pa.int32(), "ids": pa.binary(), "n": pa.int64(), "v": pa.int64(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary(), "d": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in kinds.items()], names=list(kinds))


def frame(ids: pa.Array) -> bytes:
    """An Arrow column as bytes."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, pa.schema([("id", ids.type)])) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays([ids], names=["id"]))
    return out.getvalue().to_pybytes()


def unframe(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_all().column(0).combine_chunks()


def blocks(docs: DataFrame) -> DataFrame:
    """Messages with the coded texts of blocks; deleted texts stand in blocks of their own. docs: id, text, role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        waiting: dict[bool, list[pa.RecordBatch]] = {False: [], True: []}

        def flush(deleted: bool) -> pa.RecordBatch | None:
            nonlocal number
            held, waiting[deleted] = waiting[deleted], []
            rows = pa.Table.from_batches(held).combine_chunks()
            sizes, codes, hashes = coded(rows.column("text").combine_chunks())
            number += 1
            pairs = len(codes)
            tidy()
            return message([{"block": number, "kind": "deleted" if deleted else "texts", "ids": frame(rows.column("id").combine_chunks()), "n": pairs, "a": pack(sizes.astype(np.uint32)), "b": pack(codes), "c": hashes.tobytes(), "d": pack(rows.column("role").combine_chunks().to_numpy(zero_copy_only=False).astype(np.uint8))}])

        for batch in sliced(batches):
            mask = pc.equal(batch.column("role"), DELETED)
            for deleted in (False, True):
                part = batch.filter(mask if deleted else pc.invert(mask))
                if part.num_rows:
                    waiting[deleted].append(part)
                    if sum(b.nbytes for b in waiting[deleted]) >= BLOCK_BYTES // (4 if deleted else 1):
                        yield flush(deleted)
        for deleted in (False, True):
            if waiting[deleted]:
                yield flush(deleted)

    return docs.select("id", "text", "role").mapInArrow(run, MESSAGE)


def open_block(row: dict, bits: int) -> tuple[Block, np.ndarray]:
    roles = unpack(row["d"], "u1")
    return Block(unpack(row["a"], "u4").astype(np.int64), unpack(row["b"], "u4"), np.frombuffer(row["c"], np.uint64), bits), roles


def requests(held: DataFrame, buckets: int, bits: int) -> DataFrame:
    """Messages that bring a block's counts to the buckets of its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block, roles = open_block(row, bits)
                (w_fit, p_fit), (w_del, p_del) = (block.counts(roles, r) for r in (FIT, DELETED))
                words = block.hashes[block.word_order]
                for bucket, s, e in cut_by_range(words, buckets):
                    yield message([{"block": row["block"], "kind": "word", "bucket": bucket, "a": pack_sorted(words[s:e]), "c": pack(w_fit[s:e].astype(np.uint64)), "d": pack(w_del[s:e].astype(np.uint64))}])
                for bucket, s, e in cut_by_range(block.pair_keys, buckets):
                    yield message([{"block": row["block"], "kind": "pair", "bucket": bucket, "a": pack_sorted(block.pair_keys[s:e] >> np.uint64(64 - bits)), "c": pack(p_fit[s:e].astype(np.uint64)), "d": pack(p_del[s:e].astype(np.uint64))}])

    return held.mapInArrow(run, MESSAGE)


def answers(asked: DataFrame) -> DataFrame:
    """Messages that bring total counts (fit, deleted) back to the blocks, and each bucket's share of N and V."""

    def run(rows: pa.Table) -> pa.Table:
        out = []
        for kind in ("word", "pair"):
            own = [r for r in rows.select(["block", "kind", "bucket", "a", "c", "d"]).filter(pc.equal(rows.column("kind"), kind)).to_pylist()]
            if not own:
                continue
            own.sort(key=lambda r: r["block"])
            keys = [unpack_sorted(r["a"]) for r in own]
            flat = np.concatenate(keys)
            order = np.argsort(flat, kind="stable")
            new = np.diff(flat[order], prepend=np.uint64(0)) != 0
            new[0] = True
            group = np.empty(len(flat), np.int64)
            group[order] = np.cumsum(new) - 1
            totals = [np.bincount(group, weights=np.concatenate([unpack(r[c], "u8") for r in own]), minlength=int(new.sum())).astype(np.uint64) for c in "cd"]
            start = 0
            for r, k in zip(own, keys, strict=True):
                at = group[start : start + len(k)]
                start += len(k)
                out.append({"block": r["block"], "kind": kind, "bucket": r["bucket"], "c": pack(totals[0][at]), "d": pack(totals[1][at])})
            if kind == "word":
                both = totals[0] + totals[1]
                out.append({"block": -1, "kind": "sum", "bucket": own[0]["bucket"], "n": int(both.sum()), "v": int((both > 0).sum())})
        tidy()
        return pa.Table.from_batches([message(out)])

    return grouped(asked, "bucket", run, MESSAGE)


def looked_up(rows: pa.Table, counted: str, bits: int) -> Iterator[tuple[dict, Block, np.ndarray, dict[str, np.ndarray]]]:
    """Of each block among the rows: its row, tokens, roles, and totals by token: word, pair and context. counted: c (fit) or cd (with deleted)."""
    by: dict[int, dict] = {}
    parts: dict[tuple[int, str], list[dict]] = {}
    for r in rows.to_pylist():
        if r["kind"] in ("texts", "deleted"):
            by[r["block"]] = r
        else:
            parts.setdefault((r["block"], r["kind"]), []).append(r)
    for number, row in by.items():
        block, roles = open_block(row, bits)
        total = {}
        for kind, order, at in (("word", block.word_order, block.codes), ("pair", block.pair_order, block.pair_at)):
            mine = sorted(parts.get((number, kind), []), key=lambda r: r["bucket"])
            values = np.zeros(len(order))
            for column in counted if mine else "":
                values[order] += np.concatenate([unpack(r[column], "u8") for r in mine])
            total[kind] = values[at]
            if kind == "word":
                total["context"] = values[block.context]
        yield row, block, roles, total


def estimates(pair: np.ndarray, word: np.ndarray, context: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The context's bucket, and the estimates by bigram and by unigram."""
    bucket = np.floor(np.log2(context + 1)).astype(np.int64)
    return bucket, np.divide(pair, context, out=np.zeros_like(pair), where=context > 0), word / n if n else np.zeros_like(word)


def held_out_counts(rows: DataFrame, n_fit: int, bits: int) -> DataFrame:
    """bucket, pair, word, tokens: how many deleted tokens have estimates of these classes (-1: zero)."""

    def classes(p: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.where(p > 0, np.minimum(np.floor(-np.log2(np.where(p > 0, p, 1)) * CLASSES), LOWEST * CLASSES), -1).astype(np.int64)

    def run(table_: pa.Table) -> pa.Table:
        cells: dict[int, int] = {}
        for _, _, _, t in looked_up(table_, "c", bits):
            bucket, pair, word = estimates(t["pair"], t["word"], t["context"], n_fit)
            cell, count = np.unique((bucket * 1024 + classes(pair) + 1) * 1024 + classes(word) + 1, return_counts=True)
            for c, k in zip(cell.tolist(), count.tolist(), strict=True):
                cells[c] = cells.get(c, 0) + k
        cell = np.array(list(cells), np.int64)
        return pa.table({"bucket": cell >> 20, "pair": (cell >> 10 & 1023) - 1, "word": (cell & 1023) - 1, "tokens": pa.array(list(cells.values()), pa.int64())})

    found = grouped(rows, "block", run, "bucket bigint, pair bigint, word bigint, tokens bigint")
    return found.groupBy("bucket", "pair", "word").agg(F.sum("tokens").alias("tokens"))


def learn_weights(cells: list[tuple[int, int, int, int]], v: int, rounds: int = 200) -> np.ndarray:
    """(64, 3): weights of bigram, unigram and uniform estimate for each bucket, by expectation-maximisation."""
    out = np.tile([0.3, 0.6, 0.1], (64, 1))
    out[0] = [0, 0.9, 0.1]
    data = np.array(cells, np.float64).reshape(-1, 4)
    middle = lambda c: np.where(c < 0, 0.0, 2.0 ** (-(c + 0.5) / CLASSES))
    for b in range(64):
        own = data[data[:, 0] == b]
        if not len(own):
            if b:
                out[b] = out[b - 1] if b > 1 else out[b]
            continue
        p = np.stack([middle(own[:, 1]), middle(own[:, 2]), np.full(len(own), 1 / (v + 1))], axis=1)
        w = np.array([0.4, 0.4, 0.2])
        for _ in range(rounds):
            part = p * w
            new = (part / part.sum(axis=1, keepdims=True) * own[:, 3:]).sum(axis=0) / own[:, 3].sum()
            if np.abs(new - w).max() < 1e-7:
                break
            w = new
        w = np.maximum(w, [0, 1e-6, 1e-6])  # every token keeps a probability
        out[b] = w / w.sum()
    return out


def score_texts(df: DataFrame, role: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, role, n_tokens, n_known, train_tokens, base_score, score. role (of `id`): FIT, DELETED (both train) or SCORED."""
    spark = df.sparkSession
    docs = pick(df, id=id_col, text=text_col)
    kind = docs.schema["id"].dataType.simpleString()
    held = cut(blocks(docs.withColumn("role", role)))
    tokens = held.agg(F.sum("n")).first()[0] or 0
    buckets, bits = buckets_for(spark, tokens), min(64, 2 * tokens.bit_length() + 2)
    told = cut(answers(requests(held, buckets, bits)))
    n, v = told.where("kind = 'sum'").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    replies = told.where("kind != 'sum'")
    deleted = held.where("kind = 'deleted'")
    n_deleted = deleted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    to_deleted = replies.join(deleted.select("block"), "block", "left_semi")
    cells = held_out_counts(deleted.unionByName(to_deleted.select(deleted.columns)), n - n_deleted, bits).collect() if n_deleted else []
    weights = learn_weights([tuple(c) for c in cells], v)

    def run(rows: pa.Table) -> pa.Table:
        out = []
        for row, block, roles, t in looked_up(rows, "cd", bits):
            word = t["word"]
            bucket, p2, p1 = estimates(t["pair"], word, t["context"], n)
            p = weights[bucket, 0] * p2 + weights[bucket, 1] * p1 + weights[bucket, 2] / (v + 1)
            if not n:
                p = np.full_like(p, 1 / (v + 1))
            base = np.log10((word + 1) / (n + v + 1))
            sums = [np.add.reduceat(x, block.first) for x in (base, np.log10(p), (word > 0).astype(np.int64))]
            out.append(pa.RecordBatch.from_arrays([unframe(row["ids"]), pa.array(roles.astype(np.int32)), pa.array(block.sizes.astype(np.int64)), pa.array(sums[2]), pa.array(np.full(len(roles), n, np.int64)), pa.array(sums[0]), pa.array(sums[1])], names=["id", "role", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        tidy()
        return pa.Table.from_batches(out)

    schema = f"id {kind}, role int, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return grouped(held.unionByName(replies), "block", run, schema)


def op3_language_model_scores(spark, sf_dir: str) -> DataFrame:
    """All whole texts scored; learned from ids whose crc32 mod 7 is not 2, of which those with 3 are deleted for the weights."""
    rest = crc32_mod(F.col("id"), 7)
    role = F.when(rest == 2, SCORED).when(rest == 3, DELETED).otherwise(FIT)
    found = score_texts(table(spark, sf_dir, "documents"), role)
    return found.select(F.col("id").alias("doc_id"), (F.col("role") == SCORED).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
