"""Baseline JPEG files from pixels: halved chroma, quantised cosine coefficients, prefix codes made for the picture. All blocks are coded at once, in numpy."""

from __future__ import annotations

import heapq
from itertools import count

import numpy as np

from pixkin.sources.jpeg import PICTURES, ZIGZAG

# The standard's example quantisation tables at quality 50, row by row.
LUMINANCE = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMINANCE = [17, 18, 24, 47, *[99] * 4, 18, 21, 26, 66, *[99] * 4, 24, 26, 56, *[99] * 5, 47, 66, *[99] * 38]
LONGEST_CODE, ZEROS, END = 16, 0xF0, 0x00


def quantisers(quality: int) -> np.ndarray:
    """Two tables of 64 divisors in zigzag order."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array([LUMINANCE, CHROMINANCE]) * scale + 50) // 100, 1, 255)[:, ZIGZAG]


def code_lengths(weights: dict[int, int]) -> dict[int, int]:
    """Lengths of a prefix code of 16 bits at most, in which no code is all ones: rare symbols gain weight until the longest fits."""
    floor = 1
    while True:
        order = count()
        heap = [(max(w, floor), next(order), (s,)) for s, w in weights.items()] + [(0, next(order), (-1,))]  # the all-ones code is nobody's
        heapq.heapify(heap)
        depth = dict.fromkeys([*weights, -1], 0)
        while len(heap) > 1:
            (w, _, x), (v, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            for s in x + y:
                depth[s] += 1
            heapq.heappush(heap, (w + v, next(order), x + y))
        if max(depth.values()) <= LONGEST_CODE:
            break
        floor *= 2
    deepest = max(depth.values())
    depth[-1] = deepest  # it lies deepest anyway: the lightest of all
    return depth


def prefix_code(symbols: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(counts of lengths and symbols as the file lists them, code of each symbol, its length)."""
    found, times = np.unique(symbols, return_counts=True)
    depth = code_lengths(dict(zip(found.tolist(), times.tolist())) or {0: 1})
    listed = sorted((d, s) for s, d in depth.items() if s >= 0)
    codes, lengths, code, before = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, listed[0][0]
    for d, s in listed:
        code <<= d - before
        codes[s], lengths[s], before = code, d, d
        code += 1
    counts = np.bincount([d for d, _ in listed], minlength=17)[1:]
    return bytes(counts.tolist()) + bytes(s for _, s in listed), codes, lengths


def blocks_of(plane: np.ndarray) -> np.ndarray:
    """height / 8 x width / 8 x 64."""
    h, w = plane.shape
    return plane.reshape(h // 8, 8, w // 8, 8).swapaxes(1, 2).reshape(h // 8, w // 8, 64)


def coefficients(rgb: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """units x 6 x 64 quantised coefficients in zigzag order: four of luminance, then one of each chroma."""
    h, w = rgb.shape[:2]
    x = np.pad(rgb, ((0, -h % 16), (0, -w % 16), (0, 0)), mode="edge").astype(np.float64)
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    y = 0.299 * r + 0.587 * g + 0.114 * b
    halved = lambda p: p.reshape(p.shape[0] // 2, 2, p.shape[1] // 2, 2).mean((1, 3))
    luma = blocks_of(y - 128)
    down, across = luma.shape[0] // 2, luma.shape[1] // 2
    luma = luma.reshape(down, 2, across, 2, 64).swapaxes(1, 2).reshape(-1, 4, 64)
    chroma = [blocks_of(halved((c - y) * k)).reshape(-1, 1, 64) for c, k in ((b, 0.5 / 0.886), (r, 0.5 / 0.701))]
    spectrum = np.concatenate([luma, *chroma], axis=1) @ PICTURES.astype(np.float64).T
    return np.rint(spectrum / tables[[0, 0, 0, 0, 1, 1]]).astype(np.int64)


def bit_sizes(values: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(values).astype(np.float64))[1].astype(np.int64)


def symbols_of(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(table, symbol, value, bits of value) in the order of the file. Tables: 0 and 1 are DC, 2 and 3 AC, of luminance and chroma."""
    n = len(units) * 6
    flat, chroma = units.reshape(n, 64), np.tile([0, 0, 0, 0, 1, 1], len(units))
    steps = [np.diff(units[:, part, 0].ravel(), prepend=0).reshape(len(units), -1) for part in (slice(0, 4), slice(4, 5), slice(5, 6))]
    dc = np.concatenate(steps, axis=1).ravel()
    block, at = np.nonzero(flat[:, 1:])
    at += 1
    first = np.r_[True, block[1:] != block[:-1]] if len(block) else np.zeros(0, bool)
    run = at - np.where(first, 0, np.r_[0, at[:-1]][: len(at)]) - 1
    ac, sixteens = flat[block, at], run // 16
    rest = np.ones(n, bool)
    rest[block[at == 63]] = False
    ends, far = np.flatnonzero(rest), np.repeat(np.arange(len(block)), sixteens)
    none = lambda like: np.zeros(len(like), np.int64)
    # Rows: place in the file, table, symbol, value. What stands for sixteen zeros comes before the coefficient it leads to.
    place = np.concatenate([np.arange(n) * 256, block[far] * 256 + at[far] * 2, block * 256 + at * 2 + 1, ends * 256 + 255])
    table = np.concatenate([chroma, 2 + chroma[block[far]], 2 + chroma[block], 2 + chroma[ends]])
    symbol = np.concatenate([bit_sizes(dc), none(far) + ZEROS, run % 16 * 16 + bit_sizes(ac), none(ends) + END])
    value = np.concatenate([dc, none(far), ac, none(ends)])
    order = np.argsort(place, kind="stable")
    value = value[order]
    size = bit_sizes(value)
    return table[order], symbol[order], np.where(value < 0, value + (1 << size) - 1, value), size


def encode_jpeg(rgba: np.ndarray, quality: int = 78) -> bytes:
    """A file of the picture (height x width x 3 or 4 of 8 bits); what is transparent shows white."""
    if not 1 <= quality <= 100 or rgba.ndim != 3 or not (0 < rgba.shape[0] < 65536 and 0 < rgba.shape[1] < 65536):
        raise ValueError("a picture of 1 to 65,535 pixels a side and a quality from 1 to 100 are needed")
    if rgba.shape[2] == 4:
        alpha = rgba[..., 3:] / 255
        rgba = np.rint(rgba[..., :3] * alpha + 255 * (1 - alpha)).astype(np.uint8)
    tables = quantisers(quality)
    table, symbol, value, size = symbols_of(coefficients(rgba, tables))
    segment = lambda kind, body: bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body
    code, length, listed = np.zeros(len(symbol), np.int64), np.zeros(len(symbol), np.int64), []
    for k, name in enumerate((0x00, 0x01, 0x10, 0x11)):
        of = table == k
        head, codes, lengths = prefix_code(symbol[of])
        code[of], length[of] = codes[symbol[of]], lengths[symbol[of]]
        listed.append(bytes([name]) + head)
    width = length + size
    ends = np.cumsum(width)
    bits = (np.repeat(code << size | value, width) >> (np.repeat(ends, width) - 1 - np.arange(ends[-1]))) & 1
    data = np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.int64)]).astype(np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")
    h, w = rgba.shape[:2]
    frame = bytes([8]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1])
    return b"".join([
        b"\xff\xd8", segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), segment(0xDB, b"".join(bytes([i, *t.tolist()]) for i, t in enumerate(tables))), segment(0xC0, frame),
        segment(0xC4, b"".join(listed)), segment(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])), data, b"\xff\xd9",
    ])
