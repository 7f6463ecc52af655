"""Byte payloads as progressive JPEG files; the reader is ``pixkin.sources.jpeg``.

The writer stores 64 payload bytes as the 64 quantised coefficients of a block, exactly: byte b has the magnitude 128 + b % 128 and is
negative below 128. All magnitudes have eight bits, so after the first scans of all but the last bit no coefficient is zero, and the
last bits go in refinement scans whose blocks are all one end-of-band run.
"""

from __future__ import annotations

import numpy as np

from pixkin.sources.jpeg import PICTURES, ZIGZAG, Picture, decode

__all__ = ["PICTURES", "ZIGZAG", "Picture", "decode", "encode_payload", "marker", "payload_of", "stuffed"]


def marker(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body


def huffman_table(key: int, width: int, symbols: list[int]) -> bytes:
    """All codes of one width."""
    counts = bytes(len(symbols) if n == width else 0 for n in range(1, 17))
    return bytes([key]) + counts + bytes(symbols)


DC_CODES, RUN_CODES = list(range(12)), [n << 4 for n in range(15)]
HEAD = (
    b"\xff\xd8"
    + marker(0xDB, b"\0" + b"\1" * 64)
    + marker(0xC4, huffman_table(0x00, 4, DC_CODES) + huffman_table(0x10, 1, [0x07]) + huffman_table(0x11, 4, RUN_CODES))
)


def stuffed(bits: np.ndarray) -> bytes:
    """Whole bytes, filled up with ones, an 0 after each 255."""
    fill = -len(bits) % 8
    if fill:
        bits = np.concatenate([bits, np.ones(fill, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def number_bits(values: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The lowest ``widths`` bits of each value, one after the other."""
    ends = np.cumsum(widths)
    shift = np.repeat(ends, widths) - 1 - np.arange(ends[-1] if len(ends) else 0)
    return ((np.repeat(values, widths) >> shift) & 1).astype(np.uint8)


def scan_head(component: int, table: int, first: int, last: int, high: int, low: int) -> bytes:
    return marker(0xDA, bytes([1, component, table, first, last, high << 4 | low]))


#: By payload byte: the coefficient, and its byte in a first scan of all bits but the last (code 0, then seven bits of value).
VALUES = np.array([b if b >= 128 else -128 - b for b in range(256)], np.int32)
FIRST_BYTES = np.array([abs(v) >> 1 if v > 0 else 127 - (abs(v) >> 1) for v in VALUES.tolist()], np.uint8)
SIZES = np.array([v.bit_length() for v in range(1024)], np.int64)
LAST_BITS = (np.abs(VALUES) & 1).astype(np.uint8)


def encode_payload(payload: bytes) -> bytes:
    """A progressive colour JPEG (4:2:0) whose coefficients are the payload's bytes; its length stands in a comment."""
    blocks = max(1, -(-len(payload) // 64))
    units = -(-blocks // 6)
    across = max(1, int(np.ceil(np.sqrt(units))))
    down = -(-units // across)
    units = across * down
    data = np.zeros((6 * units, 64), np.uint8)
    data.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    frame = bytes([8]) + (16 * down).to_bytes(2, "big") + (16 * across).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [HEAD, marker(0xFE, f"payload {len(payload)}".encode()), marker(0xC2, frame)]
    cuts = ((1, data[: 4 * units]), (2, data[4 * units : 5 * units]), (3, data[5 * units :]))
    # DC of all components together, unit by unit: the four luminance blocks, then one of each chroma.
    dc = VALUES[data[:, 0]]
    luma = dc[: 4 * units].reshape(down, 2, across, 2).swapaxes(1, 2).reshape(units, 4)
    together = np.concatenate([luma, dc[4 * units : 5 * units, None], dc[5 * units :, None]], axis=1)
    high = together >> 1
    diff = high.copy()
    diff[:, 1:4] -= high[:, :3]
    diff[1:, 0] -= high[:-1, 3]
    diff[1:, 4:] -= high[:-1, 4:]
    diff = diff.ravel()
    size = SIZES[np.abs(diff)]
    bits = number_bits(size << size | np.where(diff < 0, diff + (1 << size) - 1, diff), size + 4)
    out += [marker(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 0x01])), stuffed(bits)]
    for (key, part), (first, last) in zip((cuts[0], *cuts), ((1, 5), (6, 63), (1, 63), (1, 63))):
        out += [scan_head(key, 0x00, first, last, 0, 1), FIRST_BYTES[part[:, first : last + 1]].tobytes()]
    out += [marker(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 0x10])), stuffed((together & 1).astype(np.uint8).ravel())]
    for key, part in cuts:
        bits = []
        for i in range(0, len(part), 32767):
            run = part[i : i + 32767]
            n = len(run).bit_length() - 1
            bits += [number_bits(np.array([n << n | len(run) - (1 << n)]), np.array([n + 4])), LAST_BITS[run[:, 1:]].ravel()]
        out += [scan_head(key, 0x01, 1, 63, 1, 0), stuffed(np.concatenate(bits))]
    return b"".join(out) + b"\xff\xd9"


def payload_of(picture: Picture) -> bytes:
    """The bytes that encode_payload stored in a picture's coefficients."""
    if not picture.comment.startswith(b"payload "):
        raise ValueError("the picture holds no payload")
    n = int(picture.comment[8:])
    c = np.concatenate([x.coefficients for x in picture.components])
    return np.where(c > 0, c, -c - 128).astype(np.uint8).tobytes()[:n]
