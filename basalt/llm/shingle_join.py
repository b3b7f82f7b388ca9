"""N-gram Jaccard join by a token-group matrix.

1. A document's set is its distinct word shingles, as 64-bit hashes. Equal sets are one class, known by a 128-bit digest.
2. A document can only link when most of its shingles occur elsewhere too. Blocks of documents send their shingles, cut to a few
   bits more than their number needs, to buckets that tell which occur more than once; a document with too few such shingles links
   with nothing. (Cut hashes that meet by chance only let a document stay.)
3. The classes that stay are partitioned into groups of similar documents: those whose shared shingles have the same least
   hash, dealt to tiles of about `TILE_ROWS` where a group is large. A group's members are compared with each other, all tiles of a group with its first class as well, and
   the group's token union is stored once.
4. The token-group matrix tells which groups hold a token. Of a query only its prefix is looked up, its rarest tokens, so many that any partner
   shares one of them; in the matrix stand the prefixes of the members for the same reason. Groups that are connected with the query as a whole already aren't asked.
5. The query's tokens meet the stored unions of the groups that it asks. A group is opened only when the overlap reaches what the threshold needs; only then its members are shipped,
   and compared exactly by counting common tokens along inverted lists. Tasks see about one tile of members and one of
   queries, and give out a spanning forest of the links they find; connected components join the forests.

Nothing is capped: classes at the threshold share a task unless a path of links between them is known.

Defined results: null and empty texts, and rows with a null id, have no set and link with nothing (n_shingles 0 for texts
without words); repeated rows and copies are of one class; pairs just at the threshold link; empty tables give empty tables; extra
columns are ignored.
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
from pyspark.sql.types import BinaryType, StructField, StructType

from basalt.llm.common import as_binary, cut, pick, sliced, table, text_bytes, tidy
from basalt.llm.components import connected_components, join_labels
from basalt.llm.exchange import buckets_for, cut_by_range, mixed, pack, pack_sorted, unpack, unpack_sorted
from basalt.llm.language_model import frame, unframe, words_of

BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 60_000
#: Bytes of text for a shingle, that is for a word, on average at least.
SHINGLE_BYTES = 5
#: Stands for several documents of a block.
SEVERAL = 65_535
TILE_ROWS = 1024
#: Reps whose ids are broadcast at most; beyond that the join is by shuffle.
BROADCAST_IDS = 1_000_000
ASKED = "block bigint, bucket int, ids binary, sizes binary, keys binary, cells binary, rows binary"


def needed(n: Column, percent: int) -> Column:
    """Common tokens that a set of n tokens needs with any partner."""
    return F.ceil(n * percent / 100).cast("int")


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Set sizes, and the texts' distinct shingle hashes in ascending order, one text after another."""
    sizes, flat = words_of(texts)
    coded = flat.dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    word = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.uint64)
    if not len(word):
        return np.zeros(len(sizes), np.int64), word
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(sizes)), sizes)
    left = (ends[of] - np.arange(len(word))).astype(np.int64)  # words from here to the text's end
    whole = np.minimum(sizes, words)[of]  # words of a shingle of this text
    at = np.flatnonzero((left >= whole) & ((sizes[of] >= words) | (left == sizes[of])))
    value = np.full(len(at), 7, np.uint64)
    for k in range(words):
        inside = whole[at] > k
        if inside.all():
            value = mixed(value, word[at + k])
        else:
            value[inside] = mixed(value[inside], word[at[inside] + k])
    of = of[at]
    order = np.argsort(value, kind="stable")
    if len(sizes) < 1 << 16:
        order = order[np.argsort(of[order].astype(np.uint16), kind="stable")]
    else:
        order = order[np.argsort(of[order], kind="stable")]
    value, of = value[order], of[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    return np.bincount(of[new], minlength=len(sizes)), value[new]


def set_keys(sizes: np.ndarray, values: np.ndarray) -> list[bytes]:
    """A digest of each text's set; empty sets have none."""
    raw, out, at = values.tobytes(), [], 0
    for n in (sizes * 8).tolist():
        out.append(xxhash.xxh3_128_digest(raw[at : at + n]) if n else b"")
        at += n
    return out


def in_blocks(batches: Iterator[pa.RecordBatch], block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.Table]]:
    """Numbered tables of whole rows of about so many bytes."""
    number = TaskContext.get().partitionId() << 24
    held, size, rows = [], 0, 0
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            held.append(part)
            size, rows = size + part.nbytes, rows + part.num_rows
            if size >= block_bytes or rows >= BLOCK_ROWS:
                yield number, pa.Table.from_batches(held)
                number, held, size, rows = number + 1, [], 0, 0
                tidy()
    if held:
        yield number, pa.Table.from_batches(held)
    tidy()


def asked(kinds: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=kinds)


def classes_that_may_link(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """id, n, key, may: every row's set size and digest, and whether so many of its shingles occur elsewhere. docs: id, text."""
    spark = docs.sparkSession
    size = max(1, text_bytes(docs, "text"))
    bits = min(64, size.bit_length() + 6)
    buckets = buckets_for(spark, size // SHINGLE_BYTES)
    kinds = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("ids", "sizes", "keys", "cells", "rows"))])
    id_kind = docs.schema["id"].dataType.simpleString()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in in_blocks(batches):
            rows = rows.combine_chunks()
            sizes, values = shingle_sets(rows.column("text").combine_chunks(), words)
            keys = pack(np.frombuffer(b"".join(k.ljust(16, b"\0") for k in set_keys(sizes, values)), np.uint64))
            ids = rows.column("id").combine_chunks()
            of = np.repeat(np.arange(len(sizes)), sizes)
            known = ids.is_valid().to_numpy(zero_copy_only=False)[of]
            values, of = values[known], of[known]
            order = np.argsort(values, kind="stable")
            values, of = values[order], of[order]
            first = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
            several = np.diff(np.append(first, len(values))) > 1
            # Shingles of several documents of the block are counted here, and asked for once, so that none is hot.
            local = np.bincount(of[np.repeat(several, np.diff(np.append(first, len(values))))], minlength=len(sizes))
            asker = np.where(several, SEVERAL, of[first])
            values = values[first]
            head = {"block": number, "bucket": number % buckets, "ids": frame(ids), "sizes": pack(sizes.astype(np.uint32)), "keys": keys, "rows": pack(local.astype(np.uint32))}
            parts = [{"block": number, "bucket": bucket, "cells": pack_sorted(values[s:e] >> np.uint64(64 - bits)), "rows": pack(asker[s:e].astype(np.uint16))} for bucket, s, e in cut_by_range(values, buckets)]
            yield asked(kinds, [head, *parts])

    def answer(rows: pa.Table) -> pa.Table:
        heads = rows.filter(pc.is_valid(rows.column("ids")))
        out = heads.to_pylist()
        own = rows.filter(pc.is_null(rows.column("ids"))).select(["block", "bucket", "cells", "rows"]).to_pylist()
        if own:
            cells = [unpack_sorted(r["cells"]) for r in own]
            flat = np.concatenate(cells)
            order = np.argsort(flat, kind="stable")
            same = flat[order][1:] == flat[order][:-1]
            shared = np.zeros(len(flat), bool)
            shared[order[1:]] |= same
            shared[order[:-1]] |= same
            start = 0
            for r, c in zip(own, cells, strict=True):
                of = unpack(r["rows"], "u2")[shared[start : start + len(c)]]
                start += len(c)
                out.append({"block": r["block"], "bucket": r["bucket"], "rows": pack(of[of != SEVERAL])})
        tidy()
        return pa.Table.from_pylist(out, schema=kinds)

    def decide(rows: pa.Table) -> pa.Table:
        out = []
        counts: dict[int, np.ndarray] = {}
        listed = rows.to_pylist()
        heads = {r["block"]: r for r in listed if r["ids"] is not None}
        for number, head in heads.items():
            counts[number] = unpack(head["rows"], "u4").astype(np.int64)
        for r in listed:
            if r["ids"] is None:
                counts[r["block"]] += np.bincount(unpack(r["rows"], "u2"), minlength=len(counts[r["block"]]))
        for number, head in heads.items():
            sizes = unpack(head["sizes"], "u4").astype(np.int64)
            raw = unpack(head["keys"], "u8").tobytes()
            keys = [raw[i * 16 : i * 16 + 16] if n else None for i, n in enumerate(sizes.tolist())]
            may = (sizes > 0) & (counts[number] * 100 >= sizes * percent)
            out.append(pa.table({"id": unframe(head["ids"]), "n": pa.array(sizes), "key": pa.array(keys, pa.binary()), "may": pa.array(may)}))
        return pa.concat_tables(out)

    told = docs.mapInArrow(ask, ASKED).groupBy("bucket").applyInArrow(answer, ASKED)
    return told.groupBy("block").applyInArrow(decide, f"id {id_kind}, n bigint, key binary, may boolean")


def sets_of(docs: DataFrame, reps: DataFrame, words: int) -> DataFrame:
    """key, n, tokens array<long> of each class among reps (id, key), from its text."""
    few = reps.count() <= BROADCAST_IDS
    wanted = reps.select(F.col("id").alias("rep"), F.col("key").alias("rep_key"))
    texts = docs.join(F.broadcast(wanted) if few else wanted, F.col("id") == F.col("rep")).select("text", "rep_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sizes, values = shingle_sets(batch.column("text"), words)
            keys = set_keys(sizes, values)
            wanted = batch.column("rep_key").to_pylist()
            ends = np.cumsum([0, *sizes])
            keep = [i for i, k in enumerate(keys) if k == wanted[i]]  # of equal ids the one with this set
            lists = [values[ends[i] : ends[i + 1]].view(np.int64) for i in keep]
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in keep], pa.binary()), pa.array([len(v) for v in lists], pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["key", "n", "tokens"])

    return texts.mapInArrow(run, "key binary, n bigint, tokens array<bigint>").dropDuplicates(["key"])


def links_within(lists: pa.ListArray, members: np.ndarray, queries: np.ndarray, node: np.ndarray, label: np.ndarray, percent: int) -> None:
    """Joins the labels of nodes that link, of each query with the members, exactly: common tokens are counted along the members' inverted lists."""
    flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    sizes = np.diff(ends)
    of = np.repeat(np.arange(len(members)), sizes[members])
    held = np.concatenate([flat[ends[i] : ends[i + 1]] for i in members]) if len(members) else np.zeros(0, np.int64)
    order = np.argsort(held, kind="stable")
    tokens, first = np.unique(held[order], return_index=True)
    lists_of, starts = of[order], np.append(first, len(held))
    for q in queries.tolist():
        own = flat[ends[q] : ends[q + 1]]
        at = np.searchsorted(tokens, own)
        at = at[(at < len(tokens)) & (tokens[np.minimum(at, len(tokens) - 1)] == own)] if len(tokens) else at[:0]
        spans = starts[at + 1] - starts[at]
        where = np.repeat(starts[at] - np.concatenate(([0], np.cumsum(spans)[:-1])), spans) + np.arange(spans.sum())
        common = np.bincount(lists_of[where], minlength=len(members))
        hit = np.flatnonzero(common * 100 >= percent * (len(own) + sizes[members] - common))
        if len(hit):
            join_labels(label, np.full(len(hit), node[q]), node[members[hit]])


def grouped_sets(sets: DataFrame, percent: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """key, prefix, group, guest: the classes that may link, in groups of similar sets: those whose shared tokens have the same least hash.

    prefix: a class's rarest shared tokens, so many that any partner has one of them. A group of more than tile_rows classes is dealt to tiles, each a group of its
    own that sees the class with the least key as a guest. sets: key, n, tokens.
    """
    tokens = sets.select("key", "n", F.explode("tokens").alias("t"))
    often = tokens.groupBy(F.col("t").alias("token")).agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = tokens.join(often, F.col("t") == F.col("token")).groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("shared"))
    least = needed(F.col("n"), percent)
    prefix = F.slice("shared", F.lit(1), (F.size("shared") - least + 1))
    open_ = cut(shared.where(F.size("shared") >= least).select("key", prefix["t"].alias("prefix"), F.array_min(F.transform("shared", lambda s: F.xxhash64(s["t"]))).alias("g")))
    tiles = open_.groupBy(F.col("g").alias("k")).agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("tiles"), F.min("key").alias("head"))
    name = lambda tile: F.concat_ws("/", "g", tile)
    tile = F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int")
    placed = open_.join(tiles, F.col("g") == F.col("k")).select("key", "prefix", name(tile).alias("group"), F.lit(False).alias("guest"))
    others = tiles.where("tiles > 1").withColumnRenamed("k", "g").select("g", "head", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.pmod(F.xxhash64("head"), F.col("tiles")).cast("int").alias("own"))
    guests = others.where("tile != own").select(F.col("head").alias("key"), F.lit(None).cast("array<bigint>").alias("prefix"), name(F.col("tile")).alias("group"), F.lit(True).alias("guest"))
    return cut(placed.unionByName(guests))


def compared_groups(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The members of each group compared with each other: (group, key, label) of each member, where label is the least key that its links in the group lead to,
    and of each group (group, sole, union): its token union, stored once, and the label of all its members where they have one."""
    dealt = placed.join(sets.select(F.col("key").alias("k"), "tokens"), F.col("key") == F.col("k")).select("group", "key", "guest", "tokens")

    def compare(rows: pa.Table) -> pa.Table:
        keys = rows.column("key").to_pylist()
        own = np.flatnonzero(~rows.column("guest").to_numpy(zero_copy_only=False))
        lists = rows.column("tokens").combine_chunks()
        everyone = np.argsort(np.array(keys, object), kind="stable")  # so that the least index of a label is its least key
        node = np.empty(len(keys), np.int64)
        node[everyone] = np.arange(len(keys))
        label = np.arange(len(keys))
        if len(keys) > 1:
            links_within(lists, np.arange(len(keys)), np.arange(len(keys)), node, label, percent)
        labels = [keys[everyone[label[node[i]]]] for i in own.tolist()]
        union = np.unique(np.concatenate([lists[i].values.to_numpy() for i in own.tolist()])).view(np.uint64) if len(own) else np.zeros(0, np.uint64)
        group, n = rows.column("group")[0].as_py(), len(own)
        tidy()
        return pa.table({
            "group": [group] * (n + 1),
            "key": pa.array([*(keys[i] for i in own.tolist()), None], pa.binary()),
            "label": pa.array([*labels, None], pa.binary()),
            "sole": pa.array([None] * n + [labels[0] if len(set(labels)) == 1 else None], pa.binary()),
            "union": pa.array([None] * n + [pack_sorted(np.sort(union))], pa.binary()),
        })

    return dealt.groupBy("group").applyInArrow(compare, "group string, key binary, label binary, sole binary, union binary")


def asked_groups(placed: DataFrame, homes: DataFrame) -> DataFrame:
    """key, at: the other groups of which a query's prefix meets a token in the token-group matrix. Groups that a query is known to be connected with as a whole aren't asked."""
    own = homes.where("key is not null").select("key", "label")
    sole = homes.where("key is null").select(F.col("group").alias("g"), "sole")
    looked = placed.where(~F.col("guest")).join(own.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).select("key", "group", "label", F.explode("prefix").alias("t"))
    matrix = looked.select(F.col("t").alias("token"), F.col("group").alias("at")).distinct().join(sole, F.col("at") == F.col("g")).select("token", "at", "sole")
    met = looked.join(matrix, (F.col("t") == F.col("token")) & (F.col("at") < F.col("group")) & (F.col("sole").isNull() | (F.col("sole") != F.col("label"))))
    return met.select("key", "at").distinct()


def in_chunks(met: DataFrame, tile_rows: int) -> tuple[DataFrame, DataFrame]:
    """(key, at, chunk) of met and (at, chunk), where a chunk has about tile_rows of a group's queries."""
    chunks = met.groupBy(F.col("at").alias("k")).agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("chunks"))
    dealt = met.join(chunks, F.col("at") == F.col("k")).select("key", "at", F.pmod(F.xxhash64("key", F.lit(1)), F.col("chunks")).cast("int").alias("chunk"))
    return dealt, chunks.select(F.col("k").alias("at"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))


def opened_groups(met: DataFrame, homes: DataFrame, sets: DataFrame, percent: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """The rows of met whose query has enough tokens in the group's union to link with any of its members; the other groups stay closed and ship nothing."""
    queries, chunks = in_chunks(met, tile_rows)
    tokens = sets.select(F.col("key").alias("k"), "tokens")
    task = F.concat_ws("/", "at", "chunk").alias("task")
    asked_ = queries.join(tokens, F.col("key") == F.col("k")).select(task, "at", "key", "tokens", F.lit(None).cast("binary").alias("union"))
    unions = chunks.join(homes.where("key is null").select("group", "union"), F.col("at") == F.col("group")).select(task, "at", F.lit(None).cast("binary").alias("key"), F.lit(None).cast("array<bigint>").alias("tokens"), "union")

    def bound(rows: pa.Table) -> pa.Table:
        held = unpack_sorted(next(u for u in rows.column("union").to_pylist() if u is not None))
        own = rows.filter(pc.is_valid(rows.column("key")))
        lists = own.column("tokens").combine_chunks()
        flat, ends = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
        at = np.minimum(np.searchsorted(held, flat), max(0, len(held) - 1))
        common = np.append(0, np.cumsum(held[at] == flat if len(held) else np.zeros(len(flat), bool)))
        keep = (common[ends[1:]] - common[ends[:-1]]) * 100 >= percent * np.diff(ends)
        tidy()
        return own.select(["key", "at"]).filter(pa.array(keep))

    return asked_.unionByName(unions).groupBy("task").applyInArrow(bound, "key binary, at string")


def open_groups(opened: DataFrame, placed: DataFrame, sets: DataFrame, percent: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """a, b: a spanning forest of the links between queries and the members of the groups that they open."""
    queries, chunks = in_chunks(opened, tile_rows)
    members = chunks.join(placed.where(~F.col("guest")).select("key", "group"), F.col("at") == F.col("group")).select("key", "at", "chunk", F.lit(False).alias("query"))
    both = members.unionByName(queries.select("key", "at", "chunk", F.lit(True).alias("query")))
    dealt = both.join(sets.select(F.col("key").alias("k"), "tokens"), F.col("key") == F.col("k")).select(F.concat_ws("/", "at", "chunk").alias("task"), "query", "key", "tokens")

    def compare(rows: pa.Table) -> pa.Table:
        query = rows.column("query").to_numpy(zero_copy_only=False)
        keys = rows.column("key").to_pylist()
        label = np.arange(len(keys))
        links_within(rows.column("tokens").combine_chunks(), np.flatnonzero(~query), np.flatnonzero(query), np.arange(len(keys)), label, percent)
        moved = np.flatnonzero(label != np.arange(len(keys)))
        tidy()
        return pa.table({"a": pa.array([keys[i] for i in moved], pa.binary()), "b": pa.array([keys[i] for i in label[moved]], pa.binary())})

    return dealt.groupBy("task").applyInArrow(compare, "a binary, b binary")


def class_links(sets: DataFrame, percent: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """a, b: a spanning forest of the links between classes. sets: key, n, tokens."""
    placed = grouped_sets(sets, percent, tile_rows)
    homes = cut(compared_groups(placed, sets, percent))
    opened = cut(opened_groups(asked_groups(placed, homes), homes, sets, percent, tile_rows))
    inner = homes.where("key is not null").select(F.col("key").alias("a"), F.col("label").alias("b"))
    return inner.unionByName(open_groups(opened, placed, sets, percent, tile_rows)).where("a != b")


def shingle_labels(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """id, n_shingles, component_id, key, component: one row for each row of df; key is of the row's set and component that of one of its
    component's sets, both null for empty sets."""
    docs = pick(df, id=id_col, text=text_col)
    rows = cut(classes_that_may_link(docs, words, percent))
    classes = rows.where("id is not null and key is not null").groupBy("key").agg(F.min("id").alias("id"), F.max("may").alias("may"))
    sets = cut(sets_of(docs, classes.where("may").select("id", "key"), words))
    nodes = connected_components(class_links(sets, percent))
    known = classes.join(nodes, F.col("key") == F.col("node"), "left").select("key", "id", F.coalesce("component", "key").alias("component"))
    least = known.groupBy(F.col("component").alias("c")).agg(F.min("id").alias("component_id"))
    known = known.join(least, F.col("component") == F.col("c")).select(F.col("key").alias("k"), "component_id", "component")
    out = rows.join(known, F.col("key") == F.col("k"), "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"), "key", "component")


def shingle_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """id, n_shingles, component_id: one row for each row of df."""
    return shingle_labels(df, id_col, text_col, words, percent).select("id", "n_shingles", "component_id")


def with_set_key(df: DataFrame, text_col: str = "text", words: int = 4) -> DataFrame:
    """df and set_key, the key of the text's shingle set; empty for empty sets."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keys = set_keys(*shingle_sets(as_binary(batch.column(at)), words))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*batch.schema.names, "set_key"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("set_key", BinaryType())]))


def op5_shingle_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """All whole texts of documents by sets of 4-word shingles, linked at a Jaccard similarity of 0.85."""
    found = shingle_components(table(spark, sf_dir, "documents"), words=4, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
