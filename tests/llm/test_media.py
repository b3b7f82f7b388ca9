import hashlib
import zlib
from struct import error as struct_error

import numpy as np
import pytest

from basalt.llm import media

RNG = np.random.default_rng(5)


def slow_resize(image, height, width):
    """Area means by spreading every pixel over height * width parts."""
    big = np.repeat(np.repeat(image.astype(np.int64), height, 0), width, 1)
    cells = big.reshape(height, image.shape[0], width, image.shape[1]).sum(axis=(1, 3))
    area = image.shape[0] * image.shape[1]
    return ((2 * cells + area) // (2 * area)).astype(np.uint8)


@pytest.mark.parametrize("shape", [(1, 1), (3, 7), (64, 64), (17, 5)])
def test_round_trips(shape):
    grey, rgb = RNG.integers(0, 256, shape, np.uint8), RNG.integers(0, 256, (*shape, 3), np.uint8)
    assert np.array_equal(media.decode_image(media.encode_pgm(grey)), grey)
    assert np.array_equal(media.decode_image(media.encode_ppm(rgb)), rgb)
    assert np.array_equal(media.decode_image(media.encode_bmp(rgb)), rgb)
    assert np.array_equal(np.load(__import__("io").BytesIO(media.npy_tile(grey, 4))), slow_resize(grey, 4, 4))


def test_text_and_bit_images():
    assert media.decode_netpbm(b"P1 # bits\n3 2\n1 0 1\n010").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode_netpbm(b"P2\n2 1\n# top\n10\n0 10").tolist() == [[0, 255]]
    assert media.decode_netpbm(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode_netpbm(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode_netpbm(b"P5\n1 1\n65535\n\xff\xff").tolist() == [[255]]
    for bad in (b"", b"P5\n2 2\n255\nx", b"P9 1 1 1 0", b"hello"):
        with pytest.raises(ValueError):
            media.decode_netpbm(bad)


def test_palette_and_upright_bmp():
    import struct

    head = struct.pack("<2sIHHI", b"BM", 0, 0, 0, 62) + struct.pack("<IiiHHIIiiII", 40, 2, -1, 1, 8, 0, 0, 0, 0, 2, 0)
    assert media.decode_bmp(head + bytes([1, 2, 3, 0, 4, 5, 6, 0]) + bytes([0, 1, 0, 0])).tolist() == [[[3, 2, 1], [6, 5, 4]]]


@pytest.mark.parametrize(("h", "w"), [(5, 3), (8, 9), (32, 32), (1, 1)])
def test_resize_is_exact(h, w):
    image = RNG.integers(0, 256, (23, 41), np.uint8)
    assert np.array_equal(media.area_resize(image, h, w), slow_resize(image, h, w))


def test_difference_hash():
    assert media.difference_hash(np.tile(np.arange(9, dtype=np.uint8), (8, 1))) == "f" * 16
    assert media.difference_hash(np.zeros((8, 9), np.uint8)) == "0" * 16


def test_query(spark, tmp_path):
    texts = {1: "", 2: None, 3: "a" * 64, 4: "é" * 70, 5: "é" * 70, 6: "x" * 200_000}
    spark.createDataFrame([(k, v, "en") for k, v in texts.items()], "doc_id bigint, text string, TEXT2 string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in media.op1_media_columns(spark, str(tmp_path)).collect()}
    for k, v in texts.items():
        data = (v or "").encode()
        padded = data.ljust(max(1, -(-len(data) // 64)) * 64, b"\0")
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        stored = media.encode_pgm(np.frombuffer(padded, np.uint8).reshape(-1, 64))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert got[4][1:] == got[5][1:]


def test_columns_and_tiles(spark, tmp_path):
    rows = [(1, media.encode_bmp(np.zeros((4, 4, 3), np.uint8))), (2, None), (3, b"junk"), (4, b"")]
    df = media.media_columns(spark.createDataFrame(rows, "id int, media binary"))
    got = {r.id: r for r in df.collect()}
    assert (got[1].height, got[1].width, got[1].channels) == (4, 4, 3) and got[2].tile is None and got[3].tile is None and got[4].tile is None
    media.write_tiles(df, str(tmp_path / "tiles"))
    assert [tuple(r)[:2] for r in spark.read.parquet(str(tmp_path / "tiles")).collect()] == [(1, "1.npy")]
    assert media.media_columns(spark.createDataFrame([], "id int, media binary")).count() == 0


def test_broken_images_are_nulls(spark):
    import struct

    head = struct.pack("<2sIHHI", b"BM", 0, 0, 0, 62) + struct.pack("<IiiHHIIiiII", 40, 2, -1, 1, 8, 0, 0, 0, 0, 2, 0)
    palette = head + bytes([1, 2, 3, 0, 4, 5, 6, 0]) + bytes([0, 7, 0, 0])
    huge = [b"P%d\n%s %s\n255\n1 2 3" % (k, n, n) for k in range(1, 7) for n in (b"99999999999999999999", b"999999999", b"4000000000")]
    top = [b"P2 1 1 255 300", b"P2 1 1 0 0", b"P5 1 1 0\n\0", b"P5 1 1 70000\n\0\0", b"P2 1 1 255 99999999999999999999", b"P5 1 1 10\n\xff", b"P5 1 1 300\n\xff\xff"]
    rows = list(enumerate([palette, *huge, *top, b"BM", b"P5", b"P5 1 1 255"]))
    got = media.media_columns(spark.createDataFrame(rows, "id int, media binary")).where("tile is not null").collect()
    assert got == []


def test_damaged_images_never_fail():
    rng = np.random.default_rng(8)
    rgb, dot = rng.integers(0, 256, (5, 7, 3), np.uint8), rng.integers(0, 256, (6, 5), np.uint8)
    whole = [media.encode_bmp(rgb), media.encode_ppm(rgb), media.encode_pgm(dot), b"P1 3 2 1 0 1 0 1 0", b"P2\n2 2\n10\n0 10 3 4", b"P3 1 1 255 1 2 3", b"P4\n3 1\n\xa0"]
    for data in whole:
        for _ in range(1500):
            bad = bytearray(data)
            for at in rng.integers(0, len(bad), rng.integers(1, 4)):
                bad[at] ^= 1 << int(rng.integers(0, 8))
            bad = bytes(bad[: rng.integers(0, len(bad) + 1)]) if rng.random() < 0.5 else bytes(bad)
            try:
                image = media.decode_image(bad)
                assert image.dtype == np.uint8
            except (ValueError, struct_error):
                pass
