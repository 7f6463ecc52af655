"""TIFF structures: capture metadata of JPEG, TIFF, PNG and WebP files, and TIFF pictures."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixkin.functions import exif
from pixkin.functions.kernels import oriented
from pixkin.sources.webp import chunks

# Fixed values of the format: bytes of each field type, and the tags that are read.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
TYPE_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
MAKE, MODEL, ORIENTATION, SOFTWARE, EXIF_AT, GPS_AT = 0x010F, 0x0110, 0x0112, 0x0131, 0x8769, 0x8825
TAKEN, CREATED, OFFSET, SUBSECONDS, LENS = 0x9003, 0x9004, 0x9011, 0x9291, 0xA434

RAW = "make string, model string, software string, lens string, orientation string, taken string, offset string, subseconds string, latitude double, longitude double, altitude double, below int, unreadable boolean"


def directory(data: bytes, at: int, order: str) -> tuple[dict[int, object], int]:
    """Tags and values of one directory, and the place of the next. Texts are str; single values come without their list."""
    count = struct.unpack_from(order + "H", data, at)[0]
    out: dict[int, object] = {}
    for i in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        size = TYPE_BYTES.get(kind, 0) * n
        place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
        raw = data[place : place + size]
        if not size or len(raw) != size:
            continue
        if kind == 2:
            out[tag] = raw.split(b"\0")[0].decode("utf-8", "replace")
        elif kind in (5, 10):
            parts = struct.unpack(order + ("I" if kind == 5 else "i") * (2 * n), raw)
            values = [a / b if b else float("nan") for a, b in zip(parts[::2], parts[1::2])]
            out[tag] = values[0] if n == 1 else values
        elif kind == 7:
            out[tag] = raw
        else:
            values = list(struct.unpack(order + TYPE_CODES[kind] * n, raw))
            out[tag] = values[0] if n == 1 else values
    following = struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0] if at + 6 + 12 * count <= len(data) else 0
    return out, following


def first_directory(data: bytes) -> tuple[dict[int, object], str]:
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        raise ValueError("no TIFF header")
    return directory(data, struct.unpack_from(order + "I", data, 4)[0], order)[0], order


def block_of(data: bytes) -> bytes | None:
    """The TIFF block with a file's metadata: of a JPEG's APP1, a PNG's eXIf, a WebP's EXIF, or the file itself."""
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xDA, 0xD9):
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + size]
            at += 2 + size
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size = int.from_bytes(data[at : at + 4], "big")
            if data[at + 4 : at + 8] == b"eXIf":
                return data[at + 8 : at + 8 + size]
            at += 12 + size
        return None
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        block = next((body for name, body in chunks(data, 12) if name == b"EXIF"), None)
        return block[6:] if block and block[:6] == b"Exif\0\0" else block
    return data if data[:4] in (b"II*\0", b"MM\0*") else None


def degrees(value: object, side: object) -> float | None:
    if not isinstance(value, list) or len(value) < 3:
        return None
    return (value[0] + value[1] / 60 + value[2] / 3600) * (-1 if side in ("S", "W") else 1)


def raw_metadata(data: bytes) -> dict:
    """Fields as they stand in the file, by RAW's names."""
    block = block_of(data)
    if block is None:
        return {}
    main, order = first_directory(block)
    more = directory(block, main[EXIF_AT], order)[0] if EXIF_AT in main else {}
    gps = directory(block, main[GPS_AT], order)[0] if GPS_AT in main else {}
    text = lambda v: v if isinstance(v, str) else None
    below = gps.get(5)
    return {
        "make": text(main.get(MAKE)), "model": text(main.get(MODEL)), "software": text(main.get(SOFTWARE)), "lens": text(more.get(LENS)), "orientation": None if ORIENTATION not in main else str(main[ORIENTATION]),
        "taken": text(more.get(TAKEN)) or text(more.get(CREATED)), "offset": text(more.get(OFFSET)), "subseconds": text(more.get(SUBSECONDS)),
        "latitude": degrees(gps.get(2), gps.get(1)), "longitude": degrees(gps.get(4), gps.get(3)), "altitude": gps.get(6) if isinstance(gps.get(6), float) else None, "below": below if isinstance(below, int) else None,
    }


def capture_metadata(images: DataFrame) -> DataFrame:
    """``images`` (content and others) with metadata: latitude, longitude, altitude, at, zoned, make, model, lens, software, orientation, warnings.

    Files without metadata give nulls; broken ones a warning, never an error.
    """
    names = [f.split()[0] for f in RAW.split(", ")]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for contents in batches:
            rows = []
            for data in contents:
                try:
                    rows.append(dict.fromkeys(names) | (raw_metadata(data) if data is not None else {}) | {"unreadable": False})
                except (ValueError, KeyError, TypeError, struct.error, RecursionError):
                    rows.append(dict.fromkeys(names) | {"unreadable": True})
            out = pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype=object) for n in names})
            yield out.astype({"latitude": "Float64", "longitude": "Float64", "altitude": "Float64", "below": "Int32", "unreadable": bool})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    raw = F.pandas_udf(run, RAW)("content")
    rows = images.withColumn("_raw", raw)
    r = lambda n: F.col(f"_raw.{n}")
    place, offset = exif.gps(r("latitude"), r("longitude")), exif.utc_offset(r("offset"))
    at = exif.captured_at(r("taken"), offset, exif.subseconds(r("subseconds")))
    turn = exif.orientation(r("orientation"))
    warnings = F.array(
        place["warning"],
        F.when(r("orientation").isNotNull() & turn.isNull(), "Die EXIF-Bildausrichtung konnte nicht eindeutig gelesen werden."),
        F.when(r("unreadable"), "Vorhandene EXIF-Metadaten konnten nicht vollständig gelesen werden."),
    )
    clean = lambda n: exif.clean_text(r(n)).alias(n)
    metadata = F.struct(
        place["latitude"].alias("latitude"), place["longitude"].alias("longitude"), exif.altitude(r("altitude"), r("below")).alias("altitude"), at.alias("at"), F.when(at.isNotNull(), offset.isNotNull()).alias("zoned"),
        clean("make"), clean("model"), clean("lens"), clean("software"), turn.alias("orientation"), F.filter(warnings, lambda w: w.isNotNull()).alias("warnings"),
    )
    return rows.withColumn("metadata", metadata).drop("_raw")


def packed_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


def lzw_bytes(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, highest bits first, that refer to earlier runs; a code widens one entry before its table is full. At most ``size`` bytes."""
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    words, width, before, held, n, out = list(start), 9, b"", 0, 0, bytearray()
    for byte in data:
        held, n = (held & (1 << n) - 1) << 8 | byte, n + 8
        if n < width:
            continue
        n -= width
        code = held >> n
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            words, width, before = list(start), 9, b""
            continue
        if code > len(words) or (code == len(words) and not before):
            raise ValueError("a TIFF code is broken")
        word = words[code] if code < len(words) else before + before[:1]
        out += word
        if before and len(words) < 4096:
            words.append(before + word[:1])
            if len(words) == (1 << width) - 1 and width < 12:
                width += 1
        before = word
    return bytes(out[:size])


#: A picture's samples while it is decoded: 200 million pixels of four channels.
MOST_SAMPLES = 800_000_000
inflated = lambda data, size: zlib.decompressobj().decompress(data, size)
UNPACK = {1: lambda data, size: data[:size], 5: lzw_bytes, 8: inflated, 32946: inflated, 32773: packed_bits}


def samples(raw: bytes, rows: int, width: int, channels: int, bits: int, order: str, differenced: bool) -> np.ndarray:
    """rows x width x channels of one strip or tile. Rows begin with whole bytes."""
    line = (width * channels * bits + 7) // 8
    lines = np.frombuffer(raw, np.uint8, rows * line).reshape(rows, line)
    if bits < 8:
        ones = np.unpackbits(lines, axis=1)[:, : width * channels * bits].reshape(rows, width, channels, bits)
        return (ones << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(3, dtype=np.uint8)
    values = (lines if bits == 8 else lines.view(order + "u2").astype(np.uint16)).reshape(rows, width, channels)
    return np.cumsum(values, axis=1, dtype=values.dtype) if differenced else values


def decode_tiff(data: bytes) -> np.ndarray:
    """The first picture, shown upright: grey, colour table or RGB, with or without alpha, of 1, 2, 4, 8 or 16 bits, in strips or tiles, channels together or apart.

    Plain, LZW, PackBits or Deflate, with or without differencing. Of 16 bits the upper eight count.
    """
    tags, order = first_directory(data)
    listed = lambda t: tags[t] if isinstance(tags[t], list) else [tags[t]]
    width, height, kind, channels = tags[256], tags[257], tags.get(262, 1), tags.get(277, 1)
    depths = set(listed(258)) if 258 in tags else {1}
    bits, differenced, unpack = depths.pop(), tags.get(317, 1) == 2, UNPACK.get(tags.get(259, 1))
    if depths or bits not in (1, 2, 4, 8, 16) or kind not in (0, 1, 2, 3) or tags.get(317, 1) not in (1, 2) or (differenced and bits < 8) or (kind == 3 and (bits == 16 or 320 not in tags)):
        raise ValueError("this kind of TIFF isn't supported")
    if unpack is None or tags.get(266, 1) != 1:
        raise ValueError("this TIFF compression isn't supported")
    tiled, apart = 324 in tags, tags.get(284, 1) == 2
    wide, high = (tags[322], tags[323]) if tiled else (width, min(tags.get(278, height), height))
    if min(width, height, wide, high) <= 0 or channels < (3 if kind == 2 else 1):
        raise ValueError("a TIFF picture is empty")
    across, down, inner = -(-width // wide), -(-height // high), 1 if apart else channels
    if across * wide * down * high * channels > MOST_SAMPLES:
        raise ValueError("a TIFF picture is too large")
    places, sizes = (listed(324), listed(325)) if tiled else (listed(273), listed(279))
    planes = channels if apart else 1
    if min(len(places), len(sizes)) < across * down * planes:
        raise ValueError("parts of a TIFF picture are missing")
    pixels = np.empty((down * high, across * wide, channels), np.uint16 if bits == 16 else np.uint8)
    for i in range(across * down * planes):
        plane, (row, column) = i // (across * down), divmod(i % (across * down), across)
        rows = high if tiled else min(high, height - row * high)
        line = (wide * inner * bits + 7) // 8
        block = samples(unpack(data[places[i] : places[i] + sizes[i]], rows * line), rows, wide, inner, bits, order, differenced)
        pixels[row * high : row * high + rows, column * wide : (column + 1) * wide, plane if apart else 0 : plane + 1 if apart else channels] = block
    pixels = pixels[:height, :width]
    if bits == 16:
        pixels = (pixels >> 8).astype(np.uint8)
    rgba = np.full((height, width, 4), 255, np.uint8)
    if kind == 3:
        table = (np.array(listed(320), np.uint32).reshape(3, -1) >> 8).astype(np.uint8)
        rgba[..., :3] = table[:, pixels[..., 0]].transpose(1, 2, 0)
    else:
        shown = pixels * np.uint8(255 // ((1 << min(bits, 8)) - 1))
        shown = 255 - shown if kind == 0 else shown
        rgba[..., :3] = shown[..., :3] if kind == 2 else shown[..., :1]
        if channels in (2, 4):
            rgba[..., 3] = (255 - shown if kind == 0 else shown)[..., -1]
    turn = tags.get(ORIENTATION, 1)
    return oriented(rgba, turn if isinstance(turn, int) else 1)
