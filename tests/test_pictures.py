"""PNG decoding and perceptual hashes against naive versions."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaarlake.functions import pictures
from bazaarlake.operators import media, picture_files


def naive_hash(grey):
    """Area means of 32 x 32 parts by exact fractions, the cosine transform by its sum, bits above the median."""
    h, w = len(grey), len(grey[0])

    def means(line):
        out = []
        for k in range(32):
            low, high = k * len(line) / 32, (k + 1) * len(line) / 32
            out.append(sum(line[i] * (min(high, i + 1) - max(low, i)) for i in range(int(low), min(len(line), math.ceil(high)))) * 32 / len(line))
        return out

    columns = [means([grey[y][x] for y in range(h)]) for x in range(w)]
    small = [means([columns[x][y] for x in range(w)]) for y in range(32)]
    low = []
    for u in range(8):
        for v in range(8):
            low.append(round(sum(small[y][x] * 4 * math.cos(math.pi * u * (2 * y + 1) / 64) * math.cos(math.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)), 6))
    middle = sum(sorted(low)[31:33]) / 2
    value = int("".join(str(int(x > middle)) for x in low), 2)
    return value - 2**64 if value >= 2**63 else value


def png(width, height, depth, colour, rows, extra=()):
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    header = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)
    return pictures.SIGNATURE + chunk(b"IHDR", header) + b"".join(chunk(*e) for e in extra) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows))) + chunk(b"IEND", b"")


def scene(height, width, seed):
    """A smooth picture of any size."""
    rng = np.random.default_rng(seed)
    waves = rng.normal(size=(6, 4))
    y, x = np.mgrid[0:height, 0:width]
    y, x = (y + 0.5) / height, (x + 0.5) / width
    total = sum(a * np.cos(3 * b * x + 4 * c * y + 6 * d) for a, b, c, d in waves)
    return np.round((total - total.min()) * 255 / np.ptp(total)).astype(int)


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("shape", [(32, 32), (20, 45), (1, 1), (97, 64)])
def test_filters_and_hash_equal_naive(kind, shape):
    grey = scene(*shape, seed=kind) if shape != (1, 1) else np.array([[7]])
    data = pictures.png_of(grey, kind)
    assert (pictures.grey_of(data) == grey).all()
    assert pictures.picture_hash(data) == (shape[1], shape[0], naive_hash(grey.tolist()))


def test_resized_copies_lie_near_and_others_far():
    bits = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    of = lambda size, seed: pictures.picture_hash(pictures.png_of(scene(*size, seed), seed % 5))[2]
    near = [bits(of((240, 320), s), of(size, s)) for s in range(8) for size in ((120, 160), (480, 640), (200, 300), (64, 64))]
    far = [bits(of((240, 320), s), of((240, 320), s + 100)) for s in range(8)]
    assert max(near) <= 10 < min(far)


def test_colours_depths_and_palettes():
    rgb = png(2, 1, 8, 2, [bytes([255, 0, 0, 0, 0, 255])])
    assert np.allclose(pictures.grey_of(rgb), [[76.245, 29.07]])
    assert np.allclose(pictures.grey_of(png(1, 1, 8, 6, [bytes([0, 255, 0, 9])])), [[149.685]])
    assert pictures.grey_of(png(2, 1, 16, 0, [bytes([200, 1, 100, 255])])).tolist() == [[200, 100]]
    assert pictures.grey_of(png(3, 1, 1, 0, [bytes([0b10100000])])).tolist() == [[255, 0, 255]]
    assert pictures.grey_of(png(2, 1, 4, 0, [bytes([0xF3])])).tolist() == [[255, 51]]
    assert np.allclose(pictures.grey_of(png(2, 1, 2, 3, [bytes([0b01000000])], [(b"PLTE", bytes([0, 0, 0, 255, 255, 255]))])), [[255, 0]])
    assert pictures.grey_of(png(1, 2, 8, 4, [bytes([5, 1]), bytes([6, 1])])).tolist() == [[5], [6]]


def test_broken_files_have_no_hash():
    good = pictures.png_of(scene(9, 9, 1), 4)
    broken = bytearray(good)
    broken[60] ^= 1
    short = png(9, 9, 8, 0, [bytes(9)])
    for data in (None, b"", b"GIF89a", good[:50], bytes(broken), short, png(2, 1, 8, 3, [bytes([0, 1])]), png(0, 1, 8, 0, [b""]), png(1, 1, 8, 5, [b"\0"]), good.replace(b"\0\0\0\x09\0\0\0\x09", b"\0\0\0\x09\0\0\0\x09", 1)[:-12]):
        assert pictures.picture_hash(data) is None


def test_files_become_image_rows_and_are_found_by_their_bytes(spark, tmp_path):
    for k in range(6):
        (tmp_path / f"{k}.png").write_bytes(pictures.png_of(scene(120, 160, k), k % 5))
    (tmp_path / "7.png").write_bytes(b"no picture")
    (tmp_path / "large.png").write_bytes(bytes(5000) + b"x" * 50_000)
    files = picture_files.picture_files(spark, str(tmp_path), 40_000)
    assert files.count() == 7 and files.filter("phash IS NULL").count() == 1
    listed = files.select("key", F.regexp_extract("key", r"(\d)\.png", 1).cast("long").alias("owner_id"), F.col("key").alias("url"), F.lit(0).alias("position"))
    known = spark.createDataFrame([], "owner_id long, url string, position int, n_bytes long, sha256 string, path string, width int, height int, phash long")
    rows = media.taken_in(picture_files.new_images(listed, files), known)
    assert rows.count() == 6 and {(r.width, r.height) for r in rows.collect()} == {(160, 120)}
    pool = rows.select(F.col("owner_id").alias("image_id"), (F.col("owner_id") + 100).alias("product_id"), "phash")
    wanted = spark.createDataFrame([(900 + k, pictures.png_of(scene(60, 80, k), 2)) for k in range(3)] + [(999, b"broken"), (998, None)], "query long, content binary")
    best = {r.query: r.product_id for r in picture_files.search_bytes(wanted, pool, 10).filter("place = 1").collect()}
    assert best == {900: 100, 901: 101, 902: 102}


def test_query_hashes_every_embedding(spark, sf_dir):
    got = picture_files.picture_hashes(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count() and all(r.phash is not None and r.width == r.height for r in got)
    one = picture_files.drawn(spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("CAST(vec_id AS BIGINT) AS key", "embedding").filter("key = 3"), 5).first().content
    assert {r.image_id: r.phash for r in got}[3] == naive_hash(pictures.grey_of(bytes(one)).tolist())
