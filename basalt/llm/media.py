"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized, tiled as NPY, hashed.

Images are Netpbm (P1 to P6, any maxval up to 65535) or uncompressed BMP (8-bit palette, 24 and
32 bit, either row order). Resizing averages exact areas with an integral image in whole numbers,
so results never depend on rounding. Everything is row by row: no shuffle, no driver state, memory
of one Arrow batch.

Defined results: a null or empty image, or one that can't be decoded, gives null columns from
`media_columns`; a null text is the empty text in `store_texts`; repeated rows give repeated results;
an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import as_binary, new_path, pick, sliced, table

STRIDE = 64
TILE = 32


def encode_pgm(samples: np.ndarray) -> bytes:
    """8-bit grey samples (height, width) as binary Netpbm (P5)."""
    h, w = samples.shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(samples, np.uint8).tobytes()


def encode_ppm(samples: np.ndarray) -> bytes:
    """8-bit RGB samples (height, width, 3) as binary Netpbm (P6)."""
    h, w, _ = samples.shape
    return b"P6\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(samples, np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit RGB samples (height, width, 3) as a bottom-up 24-bit BMP."""
    h, w, _ = samples.shape
    row = -(-w * 3 // 4) * 4
    body = np.zeros((h, row), np.uint8)
    body[:, : w * 3] = samples[::-1, :, ::-1].reshape(h, w * 3)
    head = struct.pack("<2sIHHI", b"BM", 54 + row * h, 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, row * h, 2835, 2835, 0, 0) + body.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    fields, at = [], 2
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d{1,9})(?!\d)").match(data, at)
        if not m:
            raise ValueError("broken Netpbm header")
        fields.append(int(m[1]))
        at = m.end()
    w, h = fields[:2]
    top = fields[2] if len(fields) > 2 else 1
    if not 0 < top < 65536:
        raise ValueError("maxval out of range")
    depth = 3 if kind in (b"P3", b"P6") else 1
    n = w * h * depth
    row = -(-w // 8)
    wide = 1 if top < 256 else 2
    if kind in (b"P4", b"P5", b"P6"):
        if not data[at : at + 1].isspace():
            raise ValueError("broken Netpbm header")
        at += 1
    if len(data) - at < (row * h if kind == b"P4" else n * wide if kind in (b"P5", b"P6") else n):
        raise ValueError("short Netpbm image")
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n\r]*", b"", data[at:])
        digits = re.findall(rb"[01]" if kind == b"P1" else rb"\d+", body)[:n]
        if len(digits) < n or any(len(d) > 9 for d in digits):
            raise ValueError("short or broken Netpbm image")
        flat = np.array([int(d) for d in digits], np.int64)
    elif kind == b"P4":
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * h, at).reshape(h, row), axis=1)
        flat = bits[:, :w].reshape(-1).astype(np.int64)
    else:
        flat = np.frombuffer(data, np.uint8 if wide == 1 else ">u2", n, at)
    if n and int(flat.max()) > top:
        raise ValueError("sample above maxval")
    if kind in (b"P1", b"P4"):
        flat = 1 - flat  # 1 is black
    if top != 255:
        flat = (flat.astype(np.int64) * 255 + top // 2) // top
    return flat.astype(np.uint8).reshape((h, w, 3) if depth == 3 else (h, w))


def decode_bmp(data: bytes) -> np.ndarray:
    start, head, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or bits not in (8, 24, 32) or packed == 3 and bits != 32 or head < 40 or w < 0:
        raise ValueError("unsupported BMP")
    if packed == 3 and struct.unpack_from("<III", data, 54) != (0xFF0000, 0xFF00, 0xFF):
        raise ValueError("unsupported BMP masks")
    rows, row = abs(h), -(-w * bits // 32) * 4
    if start < 14 + head or len(data) - start < row * rows:
        raise ValueError("short BMP")
    body = np.frombuffer(data, np.uint8, row * rows, start).reshape(rows, row)
    if h > 0:
        body = body[::-1]
    if bits == 8:
        n = struct.unpack_from("<I", data, 46)[0] or 256
        if n > 256 or 14 + head + 4 * n > len(data):
            raise ValueError("broken BMP palette")
        palette = np.frombuffer(data, np.uint8, n * 4, 14 + head).reshape(n, 4)[:, 2::-1]
        if body[:, :w].size and int(body[:, :w].max()) >= n:
            raise ValueError("sample beyond the BMP palette")
        return palette[body[:, :w]]
    return np.ascontiguousarray(body[:, : w * bits // 8].reshape(rows, w, bits // 8)[:, :, 2::-1])


def decode_image(data: bytes) -> np.ndarray:
    """(height, width) grey or (height, width, 3) RGB, 8-bit."""
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    r, g, b = (image[:, :, i].astype(np.int64) for i in range(3))
    return ((299 * r + 587 * g + 114 * b + 500) // 1000).astype(np.uint8)


def area_sums(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Sum over each output cell's exact area, times height * width, from one integral image."""
    h, w = image.shape
    integral = np.zeros((h + 1, w + 1), np.int64)
    np.cumsum(image, axis=0, dtype=np.int64, out=integral[1:, 1:])
    np.cumsum(integral[1:, 1:], axis=1, out=integral[1:, 1:])

    def edges(n: int, out: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        whole, part = np.divmod(np.arange(out + 1, dtype=np.int64) * n, out)
        return whole, np.minimum(whole + 1, n), part

    y, y1, py = edges(h, height)
    x, x1, px = edges(w, width)
    rows = integral[y] * (height - py)[:, None] + integral[y1] * py[:, None]
    at = rows[:, x] * (width - px) + rows[:, x1] * px
    return at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each output cell's exact area, rounded half up."""
    if image.ndim == 3:
        return np.stack([area_resize(image[:, :, i], height, width) for i in range(image.shape[2])], axis=2)
    area = image.shape[0] * image.shape[1]
    return ((2 * area_sums(image, height, width) + area) // (2 * area)).astype(np.uint8)


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: is each cell of an 8 x 9 area resize darker than its right neighbour."""
    cells = area_sums(grey(image), 8, 9)
    return np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, edge: int = TILE) -> bytes:
    """The area-resized image as the bytes of an .npy file."""
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(area_resize(image, edge, edge)), allow_pickle=False)
    return out.getvalue()


def media_columns(df: DataFrame, id_col: str = "id", media_col: str = "media", edge: int = TILE) -> DataFrame:
    """id, height, width, channels, samples (raw 8-bit), tile (NPY bytes), difference_hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for data in as_binary(batch.column("media")).to_pylist():
                try:
                    image = decode_image(data)
                    if not image.size:
                        raise ValueError("no pixels")
                except (ValueError, struct.error):
                    rows.append((None,) * 6)
                    continue
                depth = image.shape[2] if image.ndim == 3 else 1
                rows.append((*image.shape[:2], depth, image.tobytes(), npy_tile(image, edge), difference_hash(image)))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string())
            names = ("height", "width", "channels", "samples", "tile", "difference_hash")
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            kept = [c for c in batch.schema.names if c != "media"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=[*kept, *names])

    source = pick(df, id=id_col, media=media_col)
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, height int, width int, channels int, samples binary, tile binary, difference_hash string"
    return source.mapInArrow(run, schema)


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media: each text's UTF-8 bytes, zero-filled to a positive multiple of 64, as a P5 image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sizes, images = [], []
            for data in as_binary(batch.column("text")).to_pylist():
                rows = max(1, -(-len(data) // STRIDE))
                samples = np.frombuffer(data.ljust(rows * STRIDE, b"\0"), np.uint8).reshape(rows, STRIDE)
                sizes.append(len(data))
                images.append(encode_pgm(samples))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(images, pa.binary())], names=["id", "n_bytes", "media"])

    source = pick(df, id=id_col, text=text_col)
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n_bytes bigint, media binary")


def write_tiles(columns: DataFrame, path: str) -> None:
    """Tiles as rows of id, name, npy; any file system, atomic per job, a lost task is written again."""
    kept = columns.where(F.col("tile").isNotNull())
    kept.select("id", F.concat(F.col("id").cast("string"), F.lit(".npy")).alias("name"), F.col("tile").alias("npy")).write.mode("errorifexists").parquet(path)


def op1_media_columns(spark, sf_dir: str) -> DataFrame:
    """Every whole text stored as an image in a table of the shared folder, read back from there and described."""
    path = new_path(spark, "media")
    store_texts(table(spark, sf_dir, "documents")).write.option("compression", "zstd").parquet(path)
    stored = spark.read.parquet(path)
    keyed = stored.select(F.struct("id", "n_bytes", F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")).alias("key"), "media")
    seen = media_columns(keyed, "key", "media")
    return seen.select(
        F.col("id.id").alias("doc_id"),
        F.col("id.n_bytes").alias("n_bytes"),
        F.octet_length("samples").cast("bigint").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -STRIDE, STRIDE)).alias("tail_crc32"),
        F.col("id.media_bytes").alias("media_bytes"),
        F.col("id.media_sha256").alias("media_sha256"),
        F.col("difference_hash").alias("feature"),
        F.sha2("tile", 256).alias("tile_sha256"),
    )
