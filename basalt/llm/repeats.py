"""Removing long repeats between documents with run-length indexes.

A byte goes when a 50-byte string over it also starts in a document with a smaller id.

1. Copies: documents equal as a whole are one class; those with a greater id than the class's least go entirely.
2. Anchors: of the hashes of all 32-byte strings the least of each 50-byte window is an anchor; equal windows have equal
   anchors. Blocks of documents ask buckets which of their anchors occur in other documents too (see exchange.py). A window
   whose anchor, its leftmost least hash, no other document has is no repeat. What is left is short.
3. Pieces: the windows of one shared anchor are a piece, and pieces go to buckets by the anchor, packed: a task's pieces for a bucket are one message,
   sorted by anchor, with equal ones stored once.
4. Index: all pieces of a bucket enter its run-length index (run-compressed Burrows-Wheeler transform with sampled run ends), equal ones as one string of
   their oldest document. The matching statistics of each string are streamed through it, and matches of 50 bytes
   of whose runs a sample belongs to an older document are repeats.

Anchors with more than `HOT_ROWS` occurrences, which the buckets tell, have their different pieces cut on into single windows, which are
aggregated by their hash, so that no anchor's rows need to meet in a task. All windows of all texts are covered; the result is exact.

Defined results: a null text is the empty text; texts under 50 bytes stay whole; rows with a null id neither lose bytes nor
take any from others; rows of one id don't take from each other, and each loses what its own text repeats; repeated rows each get a row; empty tables give empty
tables; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from basalt.llm.common import as_binary, cut, exchanges_let_go, pick, sliced, table, text_bytes, tidy
from basalt.llm.exchange import buckets_for, cut_by_range, mixed, pack, pack_sorted, unpack, unpack_sorted
from basalt.llm.language_model import frame, unframe
from basalt.llm.run_index import RunIndex, places_of
from basalt.llm.shingle_join import SEVERAL, asked, in_blocks

GRAM = 32
#: Stands for the places of several documents of a block.
SEVERAL_PLACES = (1 << 32) - 1
BLOCK_BYTES = 1 << 20
#: Bytes of text for an anchor, at least: the least hash of 19 changes once in ten bytes.
ANCHOR_BYTES = 8
#: Bytes of pieces, repeated ones included, that one index is built for.
INDEX_BYTES = 1 << 20
#: A bucket's task holds all rows of an anchor up to so many, some 300 bytes each.
HOT_ROWS = 200_000
#: Rows that an index bucket holds on average at most.
BUCKET_ROWS = 200_000
#: Bytes of pieces that a task packs at once; of hot anchors' pieces, which come back as rows, fewer.
PACK_BYTES, HOT_PACK_BYTES = 16 << 20, 4 << 20
#: A table is broadcast up to this size.
BROADCAST_BYTES = 64 << 20
ASKED = "block bigint, bucket int, ids binary, sizes binary, keys binary, cells binary, places binary"
PACKED = "bucket int, ids binary, keys binary, anchors binary, starts binary, new binary, windows binary, bytes binary"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all 32-byte strings of data."""
    h = data.astype(np.uint64) + np.uint64(1)
    step = np.uint64(0x9E3779B97F4A7C15)
    for n in (1, 2, 4, 8, 16):
        if len(h) <= n:
            return np.zeros(0, np.uint64)
        h = h[:-n] * step + h[n:]
        step = np.uint64(int(step) ** 2 & (1 << 64) - 1)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def sliding(op: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = op(x[:-n], x[n:])
        n *= 2
    return op(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


class Anchors:
    """Anchors of texts laid end to end: places (of the 32-byte string), hashes, and the windows they belong to."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, least: int) -> None:
        span = least - GRAM + 1
        self.span, self.windows = span, max(0, len(data) - least + 1)
        empty = np.zeros(0, np.int64)
        if not self.windows:
            self.low, self.places, self.hashes, self.order = np.zeros(0, np.uint32), empty, np.zeros(0, np.uint64), np.zeros(0, np.uint32)
            return
        hashes = gram_hashes(data)
        self.order = (hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        low = sliding(np.minimum, self.order, span)
        edge = np.zeros(len(data) + 1, np.int32)  # windows that cross a text's end
        starts = np.concatenate(([0], ends[:-1]))
        np.add.at(edge, np.maximum(starts, ends - least + 1), 1)
        np.add.at(edge, ends, -1)
        low[np.cumsum(edge[:-1])[: self.windows] > 0] = 0
        self.low = low  # 0: no window
        pad = np.zeros(span - 1, np.uint32)
        top = sliding(np.maximum, np.concatenate((pad, low, pad)), span)
        self.places = np.flatnonzero(top == self.order)
        self.hashes = mixed(hashes[self.places], np.uint64(1))  # anchors are low hashes: buckets need even ones

    def owners(self, windows: np.ndarray) -> np.ndarray:
        """For each window the index of its leftmost least anchor."""
        at = np.searchsorted(self.places, windows)
        wrong = np.flatnonzero(self.order[self.places[at]] != self.low[windows])
        while len(wrong):
            at[wrong] += 1
            wrong = wrong[self.order[self.places[at[wrong]]] != self.low[windows[wrong]]]
        return at


def digest(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


def shared_anchors(docs: DataFrame, least: int) -> tuple[DataFrame, int]:
    """id, n_bytes, key (the text's digest), anchors (how many occur in other rows too), shared (their places in the text, packed); and how many bits
    of an anchor's hash are told apart. Rows with n_bytes -1 have in `anchors` the bits of a hot anchor. docs: id, text."""
    spark = docs.sparkSession
    size = max(1, text_bytes(docs, "text"))
    bits = min(64, size.bit_length() + 5)
    buckets = buckets_for(spark, size // ANCHOR_BYTES)
    kinds = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("ids", "sizes", "keys", "cells", "places"))])
    id_kind = docs.schema["id"].dataType.simpleString()
    id_type = to_arrow_type(docs.schema["id"].dataType)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in in_blocks(batches, BLOCK_BYTES):
            rows = rows.combine_chunks()
            ids = rows.column("id").combine_chunks()
            texts = as_binary(rows.column("text").combine_chunks()).to_pylist()
            sizes = np.array([len(t) for t in texts], np.int64)
            ends = np.cumsum(sizes)
            keys = b"".join(map(digest, texts))
            data = np.frombuffer(b"".join(texts), np.uint8)
            found = Anchors(data, ends, least)
            of = np.searchsorted(ends, found.places, side="right")
            known = ids.is_valid().to_numpy(zero_copy_only=False)[of]
            places, hashes, of = found.places[known], found.hashes[known], of[known]
            order = np.argsort(hashes, kind="stable")
            places, hashes, of = places[order], hashes[order], of[order]
            first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)])
            often = np.diff(np.append(first, len(hashes)))
            several = np.minimum.reduceat(of, first) != np.maximum.reduceat(of, first) if len(first) else np.zeros(0, bool)
            # Anchors of several documents of the block are known to be shared, and asked for once, so that none is hot.
            shared = np.repeat(several, often)
            local = places[shared]
            asks = ~shared
            asks[first] = True
            count = np.ones(len(hashes), np.int64)
            count[first] = np.where(several, often, 1)
            places, of = np.where(shared, SEVERAL_PLACES, places)[asks], np.where(shared, SEVERAL, of)[asks]
            hashes, count = hashes[asks], count[asks]
            head = {"block": number, "bucket": number % buckets, "ids": frame(ids), "sizes": pack(sizes.astype(np.uint64)), "keys": pack(np.frombuffer(keys, np.uint64)), "places": pack(local.astype(np.uint32))}
            parts = [
                {"block": number, "bucket": bucket, "cells": pack_sorted(hashes[s:e] >> np.uint64(64 - bits)), "places": pack(places[s:e].astype(np.uint32)), "sizes": pack(of[s:e].astype(np.uint16)), "keys": pack(count[s:e].astype(np.uint32))}
                for bucket, s, e in cut_by_range(hashes, buckets)
            ]
            yield asked(kinds, [head, *parts])

    def answer(rows: pa.Table) -> pa.Table:
        out = rows.filter(pc.is_valid(rows.column("ids"))).to_pylist()
        own = rows.filter(pc.is_null(rows.column("ids"))).to_pylist()
        if own:
            cells = [unpack_sorted(r["cells"]) for r in own]
            flat = np.concatenate(cells)
            row = np.concatenate([np.full(len(c), i) for i, c in enumerate(cells)]) << 16 | np.concatenate([unpack(r["sizes"], "u2") for r in own])
            order = np.argsort(flat, kind="stable")
            flat, row_in = flat[order], row[order]
            first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
            many = np.minimum.reduceat(row_in, first) != np.maximum.reduceat(row_in, first)
            shared = np.empty(len(flat), bool)
            shared[order] = np.repeat(many, np.diff(np.append(first, len(flat))))
            often = np.add.reduceat(np.concatenate([unpack(r["keys"], "u4") for r in own]).astype(np.int64)[order], first)
            if len(hot := flat[first[often > HOT_ROWS]]):
                out.append({"block": -1, "bucket": own[0]["bucket"], "cells": pack(hot)})
            start = 0
            for r, c in zip(own, cells, strict=True):
                hit = shared[start : start + len(c)]
                start += len(c)
                places = unpack(r["places"], "u4")[hit]
                if len(places := places[places != SEVERAL_PLACES]):
                    out.append({"block": r["block"], "bucket": r["bucket"], "places": pack(places)})
        tidy()
        return pa.Table.from_pylist(out, schema=kinds)

    def gather(rows: pa.Table) -> pa.Table:
        out = []
        listed = rows.to_pylist()
        if listed[0]["block"] < 0:
            hot = np.concatenate([unpack(r["cells"], "u8") for r in listed]).view(np.int64)
            none = lambda kind: pa.nulls(len(hot), kind)
            return pa.table({"id": none(id_type), "n_bytes": pa.array(np.full(len(hot), -1)), "key": none(pa.binary()), "anchors": pa.array(hot), "shared": none(pa.binary())})
        for head in (r for r in listed if r["ids"] is not None):
            sizes = unpack(head["sizes"], "u8").astype(np.int64)
            raw = unpack(head["keys"], "u8").tobytes()
            parts = [unpack(r["places"], "u4") for r in listed if r["ids"] is None and r["block"] == head["block"]]
            places = np.sort(np.concatenate([unpack(head["places"], "u4"), *parts])).astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            cuts = np.searchsorted(places, np.append(starts, sizes.sum()))
            cuts[-1] = len(places)
            counts = np.diff(cuts)
            shared = [pack(np.diff(places[s:e] - begin, prepend=0).astype(np.uint32)) if e > s else None for s, e, begin in zip(cuts[:-1].tolist(), cuts[1:].tolist(), starts.tolist(), strict=True)]
            out.append(pa.table({"id": unframe(head["ids"]), "n_bytes": pa.array(sizes), "key": pa.array([raw[i * 16 : i * 16 + 16] for i in range(len(sizes))], pa.binary()), "anchors": pa.array(counts.astype(np.int64)), "shared": pa.array(shared, pa.binary())}))
        return pa.concat_tables(out)

    told = docs.mapInArrow(ask, ASKED).groupBy("bucket").applyInArrow(answer, ASKED)
    return told.groupBy("block").applyInArrow(gather, f"id {id_kind}, n_bytes bigint, key binary, anchors bigint, shared binary"), bits


PIECES = "key binary, start int, windows int, anchor bigint, place int, kind bigint, bytes binary"


def pieces_of(texts: list[bytes], shared: list[np.ndarray], least: int) -> tuple[np.ndarray, ...]:
    """text, start, windows, anchor, the anchor's place in the piece, and bytes of the runs of windows of each shared anchor."""
    raw = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts])
    starts = np.concatenate(([0], ends[:-1]))
    places = np.concatenate([s + begin for s, begin in zip(shared, starts.tolist(), strict=True)])
    of = np.searchsorted(ends, places, side="right")
    # Only the bytes that windows of shared anchors can reach.
    low, high = np.maximum(starts[of], places - (least - GRAM)), np.minimum(ends[of], places + least)
    first = np.flatnonzero(np.append(True, (low[1:] > high[:-1]) | (of[1:] != of[:-1])))
    begin, finish, text = low[first], high[np.append(first[1:] - 1, len(high) - 1)], of[first]
    data = b"".join([raw[s:e] for s, e in zip(begin.tolist(), finish.tolist(), strict=True)])
    cuts = np.cumsum(finish - begin)
    shift = begin - np.concatenate(([0], cuts[:-1]))  # from a place in data to one in raw
    found = Anchors(np.frombuffer(data, np.uint8), cuts, least)
    segment = np.searchsorted(cuts, found.places, side="right")
    open_ = np.isin(found.places + shift[np.minimum(segment, len(shift) - 1)], places)
    windows = np.flatnonzero(found.low)
    owner = found.owners(windows)
    keep = open_[owner]
    windows, owner = windows[keep], owner[keep]
    if not len(windows):
        return (np.zeros(0, np.int64),) * 5 + ([],)
    new = np.append(True, (windows[1:] != windows[:-1] + 1) | (owner[1:] != owner[:-1]))
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(windows)))
    windows, owner = windows[first], owner[first]
    segment = np.searchsorted(cuts, windows, side="right")
    bytes_ = [data[s:e] for s, e in zip(windows.tolist(), (windows + counts + (least - 1)).tolist(), strict=True)]
    return text[segment], windows + shift[segment] - starts[text[segment]], counts, found.hashes[owner].view(np.int64), found.places[owner] - windows, bytes_


def piece_batches(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """id, key and the pieces of each text; key only where several texts have the id. batches: id, key, several, text, shared."""
    for batch in sliced(batches, 256):
        data = as_binary(batch.column("text")).to_pylist()
        keys = batch.column("key").to_pylist()
        own = [i for i, (d, k) in enumerate(zip(data, keys, strict=True)) if digest(d) == k]  # else another text of this id
        if own:
            shared = [np.cumsum(unpack(batch.column("shared")[i].as_py(), "u4").astype(np.int64)) for i in own]
            of, start, windows, anchor, place, bytes_ = pieces_of([data[i] for i in own], shared, least)
            told = pc.if_else(batch.column("several"), batch.column("key"), pa.scalar(None, batch.column("key").type))
            yield piece_batch(batch.column("id"), told, np.array(own)[of], start, windows, anchor, place, bytes_)


def pack_column(values: pa.Array) -> bytes:
    """An Arrow column, whole numbers without nulls by byte plane."""
    if pa.types.is_signed_integer(values.type) and not values.null_count:
        return b"n" + pack(values.cast(pa.int64()).to_numpy())
    return b"f" + pack(np.frombuffer(frame(values), np.uint8))


def unpack_column(data: bytes, kind: pa.DataType) -> pa.Array:
    return pa.array(unpack(data[1:], "i8")).cast(kind) if data[:1] == b"n" else unframe(unpack(data[1:], "u1").tobytes())


def packed(batches: Iterator[pa.RecordBatch], buckets: int, bits: int, most: int) -> Iterator[pa.RecordBatch]:
    """Pieces in messages to the buckets of their anchors, of which so many bits are kept; equal pieces of a message are stored once."""
    kinds = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("ids", "keys", "anchors", "starts", "new", "windows", "bytes"))])

    def told(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        ids, keys, bytes_ = (rows.column(c).combine_chunks() for c in ("id", "key", "bytes"))
        starts, windows = (rows.column(c).to_numpy().astype(np.uint32) for c in ("start", "windows"))
        anchors = rows.column("anchor").to_numpy().view(np.uint64)
        coded = bytes_.dictionary_encode()
        code = coded.indices.to_numpy()
        order = np.lexsort((code, anchors))
        out = []
        for bucket, s, e in cut_by_range(anchors[order], buckets):
            at = order[s:e]
            new = np.append(True, code[at[1:]] != code[at[:-1]])
            own = keys.take(pa.array(at))
            text = b"".join(coded.dictionary.take(pa.array(code[at[new]])).to_pylist())
            message = {"ids": pack_column(ids.take(pa.array(at))), "keys": pack_column(own) if own.null_count < len(own) else None, "anchors": pack_sorted(anchors[at] >> np.uint64(64 - bits))}
            out.append(message | {"bucket": bucket, "starts": pack(starts[at]), "new": pack(new), "windows": pack(windows[at[new]]), "bytes": pack(np.frombuffer(text, np.uint8), level=3)})
        return asked(kinds, out)

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            full, held, size = [told(held)], [], 0
            yield from sliced(full, 128)
    if held:
        yield from sliced([told(held)], 128)


def opened(rows: list[dict], id_type: pa.DataType, least: int) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """ids, keys, anchors, starts, windows and bytes of the pieces in messages."""
    ids = [unpack_column(r["ids"], id_type) for r in rows]
    keys = [unpack_column(r["keys"], pa.binary()) if r["keys"] else pa.nulls(len(i), pa.binary()) for r, i in zip(rows, ids, strict=True)]
    anchors = np.concatenate([unpack_sorted(r["anchors"]) for r in rows])
    starts = np.concatenate([unpack(r["starts"], "u4") for r in rows]).astype(np.int64)
    of = np.cumsum(np.concatenate([unpack(r["new"], "u1") for r in rows]), dtype=np.int64) - 1
    windows = np.concatenate([unpack(r["windows"], "u4") for r in rows]).astype(np.int64)
    cuts = np.append(0, np.cumsum(windows + (least - 1))).astype(np.int32)
    text = b"".join(unpack(r["bytes"], "u1") for r in rows)
    distinct = pa.Array.from_buffers(pa.binary(), len(windows), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(text)])
    return pa.concat_arrays(ids), pa.concat_arrays(keys), anchors, starts, windows[of], distinct.take(pa.array(of))


def piece_rows(messages: DataFrame, id_kind: DataType, least: int) -> DataFrame:
    """The pieces in messages, a row for each."""
    id_type = to_arrow_type(id_kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            ids, keys, anchors, starts, windows, bytes_ = opened(batch.to_pylist(), id_type, least)
            yield piece_batch(ids, keys, np.arange(len(ids)), starts, windows, anchors.view(np.int64), np.zeros(len(ids), np.int64), bytes_.to_pylist())

    return messages.mapInArrow(run, f"id {id_kind.simpleString()}, {PIECES}")


def piece_batch(ids: pa.Array, keys: pa.Array, of: np.ndarray, start: np.ndarray, windows: np.ndarray, anchor: np.ndarray, place: np.ndarray, bytes_: list[bytes]) -> pa.RecordBatch:
    kind = np.fromiter(map(xxhash.xxh3_64_intdigest, bytes_), np.uint64, len(bytes_)).view(np.int64)
    arrays = [*(c.take(pa.array(of, pa.int64())) for c in (ids, keys)), pa.array(start, pa.int32()), pa.array(windows, pa.int32()), pa.array(anchor, pa.int64()), pa.array(place, pa.int32()), pa.array(kind), pa.array(bytes_, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["id", "key", "start", "windows", "anchor", "place", "kind", "bytes"])


def single_windows(pieces: DataFrame, least: int) -> DataFrame:
    """Pieces cut into their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            starts, counts = (batch.column(c).to_numpy().astype(np.int64) for c in ("start", "windows"))
            of = np.repeat(np.arange(len(counts)), counts)
            inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            data = batch.column("bytes").to_pylist()
            own = [data[i][k : k + least] for i, k in zip(of.tolist(), inner.tolist(), strict=True)]
            yield piece_batch(batch.column("id"), batch.column("key"), of, starts[of] + inner, np.ones(len(of), np.int64), batch.column("anchor").to_numpy()[of], inner, own)

    return pieces.mapInArrow(run, f"id {pieces.schema['id'].dataType.simpleString()}, {PIECES}")


def with_least(pieces: DataFrame) -> DataFrame:
    """Pieces with the least id that has an equal one."""
    per = pieces.groupBy(F.col("anchor").alias("a"), F.col("kind").alias("d")).agg(F.min("id").alias("least"))
    return pieces.join(per, (F.col("anchor") == F.col("a")) & (F.col("kind") == F.col("d"))).drop("a", "d")


def gone(pieces: DataFrame, least: int) -> DataFrame:
    return pieces.select("id", "key", "start", (F.col("start") + F.col("windows") + (least - 1)).cast("int").alias("end"))


def indexed_repeats(messages: DataFrame, id_kind: DataType, least: int) -> DataFrame:
    """id, key, start, end of repeats among the pieces of each bucket's messages."""
    id_type = to_arrow_type(id_kind)

    def run(rows: pa.Table) -> pa.Table:
        ids, keys, anchors, starts, counts, held = opened(rows.to_pylist(), id_type, least)
        schema = pa.schema([("id", id_type), ("key", keys.type), ("start", pa.int32()), ("end", pa.int32())])
        ages = pc.rank(ids, tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(anchors, kind="stable")
        heads = np.flatnonzero(np.append(True, anchors[order[1:]] != anchors[order[:-1]]))
        low, high = np.minimum.reduceat(ages[order], heads), np.maximum.reduceat(ages[order], heads)
        ends = np.append(heads[1:], len(order))
        size = np.cumsum(pc.binary_length(held).to_numpy()[order])
        found, part, reached = [np.zeros((3, 0), np.int64)], [], 0
        # Anchors don't meet each other, so indices are built for some of them at a time.
        for s, e in zip(heads[low < high].tolist(), ends[low < high].tolist(), strict=True):
            part.append(order[s:e])
            reached += int(size[e - 1] - (size[s - 1] if s else 0))
            if reached >= INDEX_BYTES:
                found.append(repeats_of(held, np.concatenate(part), ages, starts, counts, least))
                part, reached = [], 0
        if part:
            found.append(repeats_of(held, np.concatenate(part), ages, starts, counts, least))
        at = np.concatenate(found, axis=1)
        tidy()
        return pa.table([*(c.take(pa.array(at[0], pa.int64())) for c in (ids, keys)), pa.array(at[1], pa.int32()), pa.array(at[2], pa.int32())], schema=schema)

    return messages.groupBy("bucket").applyInArrow(run, f"id {id_kind.simpleString()}, key binary, start int, end int")


def repeats_of(held: pa.Array, rows: np.ndarray, ages: np.ndarray, starts: np.ndarray, counts: np.ndarray, least: int) -> np.ndarray:
    """(3, n): row, start and end of what pieces repeat of older documents, by a run-length index over their distinct strings."""
    coded = held.take(pa.array(rows)).dictionary_encode()
    of = coded.indices.to_numpy()
    distinct = coded.dictionary
    mine, starts, counts = ages[rows], starts[rows], counts[rows]
    oldest = np.full(len(distinct), 1 << 31, np.int64)
    np.minimum.at(oldest, of, mine)
    sizes = pc.binary_length(distinct).to_numpy().astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    flat = np.frombuffer(b"".join(distinct.to_pylist()), np.uint8)
    index = RunIndex(flat, begin, sizes, oldest, least)
    windows = sizes - least + 1
    first = np.cumsum(windows) - windows
    by_window = index.oldest_matches(flat, begin, sizes, 1 << 31)[places_of(begin, windows)]
    lowest, highest = np.minimum.reduceat(by_window, first)[of], np.maximum.reduceat(by_window, first)[of]
    whole = np.flatnonzero(highest < mine)
    out = [np.stack([rows[whole], starts[whole], starts[whole] + counts[whole] + least - 1])]
    mixed_ = np.flatnonzero((lowest < mine) & (highest >= mine))
    if len(mixed_):
        n = windows[of[mixed_]]
        row = np.repeat(mixed_, n)
        inner = places_of(np.zeros(len(n), np.int64), n)
        hit = by_window[first[of[row]] + inner] < mine[row]
        row, inner = row[hit], inner[hit]
        new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (inner[1:] != inner[:-1] + 1)))
        last = np.append(new[1:], len(row)) - 1
        out.append(np.stack([rows[row[new]], starts[row[new]] + inner[new], starts[row[new]] + inner[last] + least]))
    return np.concatenate(out, axis=1)


def broadcast_if_small(df: DataFrame, size: Column) -> DataFrame:
    """df (cut before) marked for broadcast when its rows are few and small; else it is joined by shuffle."""
    rows, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if 48 * rows + total <= BROADCAST_BYTES else df


def repeated_ranges(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(id, key, start, end) of bytes that repeat those of smaller ids, where key is null unless several texts have the id, and (id, key) of the rows that are whole copies."""
    spark = docs.sparkSession
    found, bits = shared_anchors(docs, least)
    found = cut(found)
    hot = found.where("n_bytes < 0").select(F.col("anchors").alias("cell"))
    known = found.where("n_bytes >= 0 and id is not null")
    first = known.groupBy(F.col("key").alias("k")).agg(F.min("id").alias("first_id"))
    copies = known.join(first, (F.col("key") == F.col("k")) & (F.col("id") > F.col("first_id"))).select("id", "key").distinct()
    reps = known.where("anchors > 0").join(first, (F.col("key") == F.col("k")) & (F.col("id") == F.col("first_id")), "left_semi").dropDuplicates(["id", "key"])
    unlike = cut(known.groupBy(F.col("id").alias("u")).agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("u"))
    reps = reps.join(broadcast_if_small(unlike, F.lit(0)), F.col("id") == F.col("u"), "left")
    wanted = cut(reps.select(F.col("id").alias("i"), "key", F.col("u").isNotNull().alias("several"), "shared", "anchors"))
    total = wanted.agg(F.coalesce(F.sum("anchors"), F.lit(0))).first()[0]
    texts = docs.join(broadcast_if_small(wanted.drop("anchors"), F.octet_length("shared")), F.col("id") == F.col("i")).select("id", "key", "several", "text", "shared")
    id_kind = docs.schema["id"].dataType
    buckets = max(1, -(-total // BUCKET_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 500)))
    if hot.limit(1).count():
        hot = broadcast_if_small(cut(hot), F.lit(0))
        pieces = texts.mapInArrow(lambda batches: piece_batches(batches, least), f"id {id_kind.simpleString()}, {PIECES}").withColumn("bits", F.shiftrightunsigned("anchor", 64 - bits))
        held = cut(pieces.join(hot, F.col("bits") == F.col("cell"), "left_semi").drop("bits").mapInArrow(lambda batches: packed(batches, 1, bits, HOT_PACK_BYTES), PACKED))
        many = with_least(piece_rows(held, id_kind, least))
        single = with_least(single_windows(many.where("id = least").drop("least"), least))
        # Held before the other pieces travel, so that the exchanges of these and of those are not there at once.
        aside = cut(gone(many.where("id > least"), least).unionByName(gone(single.where("id > least"), least)))
        rest = pieces.join(hot, F.col("bits") == F.col("cell"), "left_anti").drop("bits").mapInArrow(lambda batches: packed(batches, buckets, bits, PACK_BYTES), PACKED)
        repeats = indexed_repeats(rest, id_kind, least).unionByName(aside)
    else:
        messages = texts.mapInArrow(lambda batches: packed(piece_batches(batches, least), buckets, bits, PACK_BYTES), PACKED)
        repeats = indexed_repeats(messages, id_kind, least)
    return repeats, copies


def removed_of_ids(docs: DataFrame, least: int) -> DataFrame:
    """i, ranges, by_key, copy_keys: of each id that loses bytes its runs, those of each of its texts where it has several, and the digests of texts that go entirely."""
    repeats, copies = repeated_ranges(docs, least)
    ranges = repeats.groupBy(F.col("id").alias("i")).agg(F.collect_list(F.struct("start", "end", "key")).alias("ranges"))
    kind = docs.schema["id"].dataType.simpleString()

    def joined_runs(pairs: np.ndarray) -> bytes:
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        reach = np.maximum.accumulate(pairs[:, 1])
        new = np.flatnonzero(np.append(True, pairs[1:, 0] > reach[:-1]))
        return np.stack([pairs[new, 0], reach[np.append(new[1:] - 1, len(pairs) - 1)]], axis=1).astype(np.int32).tobytes()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            only, several = [], []
            for own in batch.column("ranges"):
                pairs = np.stack([own.values.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end")], axis=1).astype(np.int64)
                keys = own.values.field("key")
                if keys.null_count:  # one text has this id
                    only.append(joined_runs(pairs))
                    several.append(None)
                else:
                    coded = keys.dictionary_encode()
                    of = coded.indices.to_numpy(zero_copy_only=False)
                    only.append(None)
                    several.append([{"key": k, "ranges": joined_runs(pairs[of == n])} for n, k in enumerate(coded.dictionary.to_pylist())])
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(only, pa.binary()), pa.array(several, pa.list_(pa.struct([("key", pa.binary()), ("ranges", pa.binary())])))], names=["i", "ranges", "by_key"])

    merged_ranges = ranges.mapInArrow(merge, f"i {kind}, ranges binary, by_key array<struct<key:binary,ranges:binary>>")
    whole = copies.groupBy(F.col("id").alias("c")).agg(F.collect_set("key").alias("copy_keys"))
    return cut(merged_ranges.join(whole, F.col("i") == F.col("c"), "full").select(F.coalesce("i", "c").alias("i"), "ranges", "by_key", "copy_keys"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50) -> DataFrame:
    """id, n_bytes, removed array<struct<start, end>> (maximal runs), kept (binary): one row for each row of df."""
    docs = pick(df, id=id_col, text=text_col)
    with exchanges_let_go(docs.sparkSession):
        both = removed_of_ids(docs, least)
    size = F.coalesce(F.octet_length("ranges"), F.lit(0)) + 32 * F.coalesce(F.size("copy_keys"), F.lit(0))
    size += F.coalesce(F.aggregate("by_key", F.lit(0), lambda a, r: a + 32 + F.octet_length(r["ranges"])), F.lit(0))
    joined = docs.join(broadcast_if_small(both, size), F.col("id") == F.col("i"), "left").select("id", "text", "ranges", "by_key", "copy_keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in sliced(batches):
            sizes, runs, kept = [], [], []
            columns = (batch.column(c) for c in ("ranges", "by_key", "copy_keys"))
            for data, ranges, by_key, keys in zip(as_binary(batch.column("text")).to_pylist(), *columns, strict=True):
                merged: list = []
                if keys.is_valid and len(data) >= least and digest(data) in keys.as_py():
                    merged = [[0, len(data)]]
                elif ranges.is_valid:
                    merged = np.frombuffer(ranges.as_py(), np.int32).reshape(-1, 2).tolist()
                elif by_key.is_valid and (own := {r["key"]: r["ranges"] for r in by_key.as_py()}.get(digest(data))):
                    merged = np.frombuffer(own, np.int32).reshape(-1, 2).tolist()
                sizes.append(len(data))
                runs.append([{"start": s, "end": e} for s, e in merged])
                at, parts = 0, []
                for s, e in merged:
                    parts.append(data[at:s])
                    at = e
                kept.append(b"".join([*parts, data[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(runs, runs_type), pa.array(kept, pa.binary())], names=["id", "n_bytes", "removed", "kept"])

    return joined.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n_bytes bigint, removed array<struct<start:int,end:int>>, kept binary")


def op10_remove_repeats(spark, sf_dir: str) -> DataFrame:
    """All whole texts of documents without the 50-byte repeats of smaller ids."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, r: a + (r["end"] - r["start"])).alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


