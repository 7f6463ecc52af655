"""Pictures: decoders by format, and features of decoded pictures.

JPEG, PNG, BMP, GIF, TIFF and lossless WebP files are decoded here. Other formats need a decoder from the caller: ``register(format, function)``, on every executor.
"""

from __future__ import annotations

import struct
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixkin.config import Limits
from pixkin.functions import kernels
from pixkin.operators.skew import bounded_batches
from pixkin.sources.jpeg import decode_jpeg
from pixkin.sources.jpeg_writer import encode_jpeg
from pixkin.sources.tiff import capture_metadata, decode_tiff
from pixkin.sources.webp import decode_webp

DECODERS: dict[str, Callable[[bytes], np.ndarray]] = {}
#: A decoded picture takes four bytes a pixel and more while it is worked on.
MOST_PIXELS = 200_000_000
VARIANT = "struct<turn:int,aspect:double,a:bigint,d:bigint,p:bigint>"
FEATURES = f"width int, height int, aspect double, variants array<{VARIANT}>, histogram array<double>, luminance double, gray binary, decode_error string"


def register(name: str, decoder: Callable[[bytes], np.ndarray]) -> None:
    """``decoder`` takes a file's bytes and gives height x width x 4 of 8 bits, shown upright."""
    DECODERS[name] = decoder


def decode_png(data: bytes) -> np.ndarray:
    """8- and 16-bit, 1- to 4-bit grey and palette, all filters, Adam7."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, body, palette, alpha = 8, [], None, b""
    width = height = depth = kind = interlaced = 0
    while at + 8 <= len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + n]
        if len(chunk) != n or zlib.crc32(name + chunk) != int.from_bytes(data[at + 8 + n : at + 12 + n], "big"):
            raise ValueError("a PNG chunk is broken")
        at += 12 + n
        if name == b"IHDR":
            width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", chunk)
        elif name == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            alpha = chunk
        elif name == b"IDAT":
            body.append(chunk)
        elif name == b"IEND":
            break
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    passes = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)) if interlaced else ((0, 0, 1, 1),)
    if not 0 < width * height <= MOST_PIXELS:
        raise ValueError("a PNG header is missing, or the picture is too large")
    size = sum(max(0, -(-(height - y0) // dy)) * (1 + -(-max(0, -(-(width - x0) // dx)) * channels * depth // 8)) for x0, y0, dx, dy in passes)
    raw, place = zlib.decompressobj().decompress(b"".join(body), size), 0  # no more than the picture needs
    if len(raw) < size:
        raise ValueError("PNG data end early")
    out = np.zeros((height, width, channels), np.uint16)
    for x0, y0, dx, dy in passes:
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w <= 0 or h <= 0:
            continue
        line, step = -(-w * channels * depth // 8), max(1, channels * depth // 8)
        rows, place = unfiltered(raw[place : place + h * (line + 1)], h, line, step), place + h * (line + 1)
        if depth == 16:
            values = rows.reshape(h, -1, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)
        elif depth == 8:
            values = rows.astype(np.uint16)
        else:
            values = (np.unpackbits(rows, axis=1).reshape(h, -1, depth) @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint16)
        out[y0::dy, x0::dx] = values[:, : w * channels].reshape(h, w, channels)
    rgba = np.full((height, width, 4), 255, np.uint8)
    if kind == 3:
        rgba[..., :3] = palette[out[..., 0]]
        opacity = np.full(len(palette), 255, np.uint8)
        opacity[: len(alpha)] = np.frombuffer(alpha, np.uint8)
        rgba[..., 3] = opacity[out[..., 0]]
        return rgba
    if alpha and kind in (0, 2):
        key = np.frombuffer(alpha, ">u2")
        rgba[..., 3] = np.where((out == key).all(2), 0, 255)
    scaled = (out >> 8 if depth == 16 else out * (255 // ((1 << depth) - 1))).astype(np.uint8)
    rgba[..., :3] = scaled[..., :3] if channels >= 3 else scaled[..., :1]
    if kind in (4, 6):
        rgba[..., 3] = scaled[..., -1]
    return rgba


def unfiltered(raw: bytes, h: int, line: int, step: int) -> np.ndarray:
    """Scan lines without their filters. Lines that lean on the byte before and the line above at once are undone by diagonals, all lines together."""
    data = np.frombuffer(raw, np.uint8).reshape(h, line + 1)
    how = data[:, 0]
    if not (how >= 3).any():
        out = np.zeros((h + 1, line), np.uint8)
        for y in range(h):
            row = data[y, 1:]
            if how[y] == 1:
                for k in range(step):
                    out[y + 1, k::step] = np.cumsum(row[k::step], dtype=np.uint8)
            else:
                out[y + 1] = row + out[y] if how[y] == 2 else row
        return out[1:]
    w = -(-line // step)
    left = np.zeros((h, w * step), np.int16)
    left[:, :line] = data[:, 1:]
    left, out = left.reshape(h, w, step), np.zeros((h + 1, w + 1, step), np.int16)
    for d in range(w + h - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x, f = d - y, how[y, None]
        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
        pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        nearest = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        guess = np.where(f == 1, a, np.where(f == 2, b, np.where(f == 3, (a + b) >> 1, np.where(f == 4, nearest, 0))))
        out[y + 1, x + 1] = (left[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8).reshape(h, w * step)[:, :line]


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-, 24- and 32-bit."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP file")
    offset, size, width, height, _, bits, packed = struct.unpack("<IIiiHHI", data[10:34])
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("this kind of BMP isn't supported")
    line = -(-width * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, line * abs(height), offset).reshape(abs(height), line)
    rows = rows[::-1] if height > 0 else rows
    rgba = np.full((abs(height), width, 4), 255, np.uint8)
    if bits == 8:
        colours = np.frombuffer(data, np.uint8, offset - 14 - size, 14 + size).reshape(-1, 4)
        rgba[..., :3] = colours[rows[:, :width]][..., 2::-1]
    else:
        rgba[..., :3] = rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[..., 2::-1]
    return rgba


def decode_gif(data: bytes) -> np.ndarray:
    """The first frame on its canvas."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF file")
    width, height, flags = struct.unpack("<HHB", data[6:11])
    at, clear = 13, None
    table = np.frombuffer(data, np.uint8, 3 << (flags & 7) + 1, at).reshape(-1, 3) if flags & 128 else None
    at += 3 << (flags & 7) + 1 if flags & 128 else 0
    canvas = np.zeros((height, width, 4), np.uint8)

    def chunks(at: int) -> tuple[bytes, int]:
        out = []
        while n := data[at]:
            out.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        return b"".join(out), at + 1

    while data[at] != 0x2C:
        if data[at] != 0x21:
            raise ValueError("no frame")
        kind = data[at + 1]
        body, at = chunks(at + 2)
        if kind == 0xF9 and body[0] & 1:
            clear = body[3]
    x, y, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
    at += 10
    if flags & 128:
        table = np.frombuffer(data, np.uint8, 3 << (flags & 7) + 1, at).reshape(-1, 3)
        at += 3 << (flags & 7) + 1
    pixels = np.frombuffer(unpacked_codes(chunks(at + 1)[0], data[at], w * h), np.uint8).reshape(h, w)
    if flags & 64:  # rows in four passes
        order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
        pixels = pixels[np.argsort(order)]
    part = canvas[y : y + h, x : x + w]
    part[..., :3], part[..., 3] = table[pixels], 255
    if clear is not None:
        part[pixels == clear] = 0
    return canvas


def unpacked_codes(data: bytes, bits: int, size: int) -> bytes:
    """Variable-length codes of growing width, lowest bits first, that refer to earlier runs."""
    reset, out, width, held, n = 1 << bits, bytearray(), bits + 1, 0, 0
    words: list[bytes] = []
    before = b""
    for byte in data:
        held, n = held | byte << n, n + 8
        while n >= width:
            code, held, n = held & (1 << width) - 1, held >> width, n - width
            if code == reset:
                words, width, before = [bytes([i]) for i in range(reset)] + [b"", b""], bits + 1, b""
                continue
            if code == reset + 1 or len(out) >= size:
                return bytes(out[:size])
            if code > len(words) or (code == len(words) and not before):
                raise ValueError("a GIF code is broken")
            word = words[code] if code < len(words) else before + before[:1]
            out += word
            if before and len(words) < 4096:
                words.append(before + word[:1])
                if len(words) == 1 << width and width < 12:
                    width += 1
            before = word
    if len(out) < size:
        raise ValueError("GIF data end early")
    return bytes(out[:size])


register("jpeg", decode_jpeg)
register("png", decode_png)
register("bmp", decode_bmp)
register("gif", decode_gif)
register("tiff", decode_tiff)
register("webp", decode_webp)


def features_of(name: str, data: bytes, orientation: int | None = None, edge: int = Limits().analysis_edge, upright: bool = True) -> dict:
    """The record of one picture; ValueError if it can't be decoded. Not ``upright``: decoders leave the picture as stored, so one whose orientation isn't 1 gets no turned variants."""
    if name not in DECODERS:
        raise ValueError(f"no decoder for {name}")
    rgba = kernels.oriented(DECODERS[name](data), orientation if upright else None)
    height, width = rgba.shape[:2]
    small = kernels.area_square(rgba, edge)
    gray, aspect = kernels.grey(small), width / max(1, height)
    return {
        "width": width, "height": height, "aspect": aspect, "variants": [dict(zip(("turn", "aspect", "a", "d", "p"), v)) for v in kernels.variants(gray, aspect)][: 4 if upright or orientation in (None, 1) else 1],
        "histogram": kernels.hsv_histogram(small).tolist(), "luminance": float(gray.mean() / 255), "gray": gray.tobytes(), "decode_error": None,
    }


def image_features(images: DataFrame, upright: bool = True, clock: Accumulator | None = None) -> DataFrame:
    """``images`` (format, content, metadata and orientation if known) less content, plus metadata, orientation and FEATURES. A picture that can't be decoded keeps its row, with decode_error. ``clock`` gets the tasks' seconds."""
    if "metadata" not in images.columns:
        images = capture_metadata(images)
    # Decoders show TIFF and browsers' formats as stored; what the file says about its turn is applied once, TIFF's by its decoder.
    images = images if "orientation" in images.columns else images.withColumn("orientation", F.when(F.col("format") != "tiff", F.col("metadata.orientation")))
    carry = [c for c in images.columns if c != "content"]
    kinds = dict(images.dtypes)
    names = ["width", "height", "aspect", "variants", "histogram", "luminance", "gray", "decode_error"]
    oriented = "orientation" in images.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, start = [], time.monotonic()
            for i, (name, data) in enumerate(zip(pdf["format"], pdf["content"])):
                turn = pdf["orientation"].iloc[i] if oriented else None
                try:
                    rows.append(features_of(name, data, None if turn is None or pd.isna(turn) else int(turn), upright=upright))
                except (ValueError, KeyError, IndexError, TypeError, zlib.error, struct.error) as e:
                    rows.append(dict.fromkeys(names) | {"decode_error": str(e) or type(e).__name__})
            made = pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype=object) for n in names}).set_index(pdf.index)
            made = made.astype({"width": "Int32", "height": "Int32", "aspect": "Float64", "luminance": "Float64"})
            if clock is not None:
                clock.add(time.monotonic() - start)
            yield pd.concat([pdf[carry], made], axis=1)

    return bounded_batches(images).mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", " + FEATURES)


def thumbnail_of(name: str, data: bytes, orientation: int | None = None, edge: int = Limits().thumbnail_edge) -> dict:
    """key columns of one picture's thumbnail: its longest side fitted into ``edge``, never enlarged, as a JPEG file."""
    if name not in DECODERS:
        raise ValueError(f"no decoder for {name}")
    rgba = kernels.oriented(DECODERS[name](data), orientation)
    width, height = kernels.thumbnail_size(rgba.shape[1], rgba.shape[0], edge)
    return {"width": width, "height": height, "content": encode_jpeg(kernels.area_resize(rgba, width, height)), "decode_error": None}


def thumbnails(images: DataFrame, edge: int = Limits().thumbnail_edge) -> DataFrame:
    """``images`` (format, content, and orientation if known) with width, height and content of their thumbnails; a picture that can't be decoded has null ones and a decode_error.

    Rows stay where they are. A thumbnail of 360 pixels takes some 650 KB at the very most, so it always fits the store.
    """
    made = ("width", "height", "content", "decode_error")
    carry = [c for c in images.columns if c not in made]
    kinds = dict(images.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            turns = pdf["orientation"] if "orientation" in carry else pd.Series([None] * len(pdf), dtype=object)
            rows = []
            for name, data, turn in zip(pdf["format"], pdf["content"], turns):
                try:
                    rows.append(thumbnail_of(name, data, None if pd.isna(turn) else int(turn), edge))
                except (ValueError, KeyError, IndexError, TypeError, zlib.error, struct.error) as e:
                    rows.append(dict.fromkeys(made) | {"decode_error": str(e) or type(e).__name__})
            new = pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype=object) for n in made}).set_index(pdf.index).astype({"width": "Int32", "height": "Int32"})
            yield pd.concat([pdf[carry], new], axis=1)

    return bounded_batches(images).mapInPandas(run, "".join(f"`{c}` {kinds[c]}, " for c in carry) + "width int, height int, content binary, decode_error string")


def flat_hashes(features: DataFrame) -> DataFrame:
    """Adds a0 d0 p0 ... a270 d270 p270 from variants, as the pair join takes them."""
    return features.withColumns({f"{h}{t}": F.get("variants", F.lit(i)).getField(h) for i, t in enumerate((0, 90, 180, 270)) for h in "adp"})
