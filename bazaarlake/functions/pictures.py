"""Perceptual hashes of PNG files: decoding, grey, area resize, cosine transform, bits above the median.

Defined results: null for what is no PNG, is cut short, fails its checksums, is interlaced or larger than MAX_PIXELS; transparency is
dropped; 16-bit samples count by their high byte."""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np

MAX_PIXELS = 1 << 26
SIDE, LOW = 32, 8  # edge of the reduced picture; of the block of low frequencies
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # by colour type
GREY = np.array([0.299, 0.587, 0.114])


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """The file's chunks (kind, content), checked; ValueError for a broken one."""
    out, at = [], len(SIGNATURE)
    if data[:at] != SIGNATURE:
        raise ValueError("no PNG")
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError("broken chunk")
        out.append((kind, body))
        at += 12 + size
        if kind == b"IEND":
            return out
    raise ValueError("no end")


def unfiltered(raw: bytes, height: int, width_bytes: int, step: int) -> np.ndarray:
    """Rows of bytes with their filters undone; step: bytes of a pixel, at least 1."""
    rows = np.frombuffer(raw, np.uint8, height * (width_bytes + 1)).reshape(height, width_bytes + 1)
    out = np.zeros((height + 1, width_bytes), np.uint8)  # a row of zeros lies above the first
    for y in range(height):
        kind, line, above, here = rows[y, 0], rows[y, 1:], out[y], out[y + 1]
        if kind == 0:
            here[:] = line
        elif kind == 2:
            here[:] = line + above
        elif kind == 1:
            for c in range(step):
                here[c::step] = np.cumsum(line[c::step], dtype=np.uint8)
        elif kind in (3, 4):
            here[:] = _average(line, above, step) if kind == 3 else _paeth(line, above, step)
        else:
            raise ValueError("unknown filter")
    return out[1:]


def _average(line: np.ndarray, above: np.ndarray, step: int) -> list[int]:
    done = [0] * step
    for x, (value, up) in enumerate(zip(line.tolist(), above.tolist(), strict=True)):
        done.append((value + ((done[x] + up) >> 1)) & 255)
    return done[step:]


def _paeth(line: np.ndarray, above: np.ndarray, step: int) -> list[int]:
    done, up = [0] * step, [0] * step + above.tolist()
    for x, value in enumerate(line.tolist()):
        a, b, c = done[x], up[x + step], up[x]
        to_a, to_b, to_c = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        done.append((value + (a if to_a <= to_b and to_a <= to_c else b if to_b <= to_c else c)) & 255)
    return done[step:]


def grey_of(data: bytes) -> np.ndarray:
    """The picture's brightness, rows of 0 to 255; ValueError where it can't be read."""
    found = chunks(data)
    if not found or found[0][0] != b"IHDR" or len(found[0][1]) != 13:
        raise ValueError("no header")
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", found[0][1])
    if not width or not height or width * height > MAX_PIXELS or interlaced or colour not in CHANNELS or depth not in (1, 2, 4, 8, 16):
        raise ValueError("not supported")
    channels = CHANNELS[colour]
    width_bytes = -(-width * channels * depth // 8)
    reader = zlib.decompressobj()
    raw = reader.decompress(b"".join(body for kind, body in found if kind == b"IDAT"), height * (width_bytes + 1))
    if len(raw) < height * (width_bytes + 1):
        raise ValueError("cut short")
    rows = unfiltered(raw, height, width_bytes, max(1, channels * depth // 8))
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        shifts = np.arange(8 - depth, -1, -depth)
        rows = ((rows[:, :, None] >> shifts.astype(np.uint8)) & (2**depth - 1)).reshape(height, -1)[:, :width]
        rows = rows if colour == 3 else rows * (255 // (2**depth - 1))
    pixels = rows.reshape(height, width, channels)
    if colour == 3:
        palette = np.frombuffer(next((body for kind, body in found if kind == b"PLTE"), b""), np.uint8)
        palette = palette[: len(palette) // 3 * 3].reshape(-1, 3)
        if not len(palette) or pixels.max() >= len(palette):
            raise ValueError("no palette")
        pixels = palette[pixels[:, :, 0]]
    return pixels[:, :, :3] @ GREY if pixels.shape[2] >= 3 else pixels[:, :, 0].astype(float)


@lru_cache(maxsize=256)
def shares(size: int, parts: int) -> np.ndarray:
    """parts x size: by how much each of size cells lies in each of as many equal parts, rows summing to 1."""
    edges = np.arange(parts + 1) * size / parts
    cells = np.arange(size)
    over = np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells)
    return np.clip(over, 0, None) * parts / size


@lru_cache(maxsize=1)
def cosines() -> np.ndarray:
    """The first LOW rows of the cosine transform of SIDE samples."""
    k, n = np.arange(LOW)[:, None], np.arange(SIDE)
    return 2 * np.cos(np.pi * k * (2 * n + 1) / (2 * SIDE))


def picture_hash(data: bytes | None) -> tuple[int, int, int] | None:
    """Width, height and 64-bit hash (signed, the first bit highest) of a PNG; null where it can't be read."""
    try:
        grey = grey_of(data or b"")
    except (ValueError, zlib.error, struct.error):
        return None
    small = shares(grey.shape[0], SIDE) @ grey @ shares(grey.shape[1], SIDE).T
    low = cosines() @ small @ cosines().T
    bits = np.round(low, 6) > np.median(np.round(low, 6))
    return grey.shape[1], grey.shape[0], int(np.packbits(bits.ravel()).view(">i8")[0])


def png_of(grey: np.ndarray, kind: int = 0) -> bytes:
    """A grey picture (rows of 0 to 255) as PNG, all rows by one filter (0 none, 1 left, 2 above, 3 mean, 4 nearest of three)."""
    rows = np.asarray(grey, np.int64)
    left, up = np.pad(rows, ((0, 0), (1, 0)))[:, :-1], np.pad(rows, ((1, 0), (0, 0)))[:-1]
    corner = np.pad(rows, ((1, 0), (1, 0)))[:-1, :-1]
    to = [abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)]
    nearest = np.where((to[0] <= to[1]) & (to[0] <= to[2]), left, np.where(to[1] <= to[2], up, corner))
    lines = (rows - [np.zeros_like(rows), left, up, (left + up) // 2, nearest][kind]).astype(np.uint8)
    raw = np.concatenate([np.full((len(rows), 1), kind, np.uint8), lines], axis=1).tobytes()
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", rows.shape[1], rows.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
