"""Files made from the driver's tables, which hold none: archives of pages and of pictures, to run sources and kernels on."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixkin.operators.skew import stored

FILES = "path string, modificationTime timestamp, length long, content binary"
ENTRIES_EACH = 64


def zipped(entries: list[tuple[str, bytes]], spoiled: set[str] = frozenset()) -> bytes:
    """A ZIP file of stored entries; of ``spoiled`` ones the last byte is turned over, so that checksums fail."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries:
            z.writestr(zipfile.ZipInfo(name, (2024, 1, 2, 3, 4, 6)), data)
        places = {i.filename: (i.header_offset, i.file_size) for i in z.infolist()}
    raw = bytearray(out.getvalue())
    for name in spoiled:
        at, size = places[name]
        raw[at + 30 + sum(struct.unpack_from("<HH", raw, at + 26)) + size - 1] ^= 255
    return bytes(raw)


def archived(rows: DataFrame, number: str, prefix: str, entries_of) -> DataFrame:
    """FILES: an archive of each ENTRIES_EACH numbers of ``rows``, made once: they are read for their entries, again for their findings and for what is unpacked. ``entries_of``: pandas rows to (entries, spoiled names)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        content = zipped(*entries_of(pdf.sort_values(number)))
        name = f"{prefix}-{int(pdf[number].iloc[0]) // ENTRIES_EACH}.zip"
        return pd.DataFrame({"path": [name], "modificationTime": [pd.Timestamp("2024-01-02")], "length": [len(content)], "content": [content]})

    return stored(rows.withColumn("_archive", F.floor(F.col(number) / ENTRIES_EACH)).groupBy("_archive").applyInPandas(one, FILES))


def page_archives(pages: DataFrame) -> DataFrame:
    """Pages as entries of archives."""
    return archived(pages.select("page_id", F.coalesce("html", F.lit("")).alias("html")), "page_id", "pages", lambda pdf: ([(f"p{i}.html", h.encode()) for i, h in zip(pdf["page_id"], pdf["html"])], set()))


def colours(v: np.ndarray) -> np.ndarray:
    """Vectors of 64 numbers as 8 x 8 RGB pictures; green and blue are shifted by a third of the numbers."""
    g = np.floor(np.clip((v.astype(np.float64) + 1) * 127.5, 0, 255)).astype(np.uint8)
    return np.stack([g, np.roll(g, -21, axis=1), np.roll(g, -42, axis=1)], axis=2).reshape(-1, 8, 8, 3)


def exif_block(tags: dict[int, tuple[int, bytes, int]], below: dict[int, dict[int, tuple[int, bytes, int]]]) -> bytes:
    """A big-endian TIFF block. Tags: (type, bytes, count); ``below``: directories under pointer tags."""

    def directory(entries: dict[int, tuple[int, bytes, int]], at: int) -> bytes:
        head, tail, end = struct.pack(">H", len(entries)), b"", at + 6 + 12 * len(entries)
        for tag, (kind, raw, n) in sorted(entries.items()):
            head += struct.pack(">HHI", tag, kind, n) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(">I", end + len(tail)))
            tail += raw + b"\0" * (len(raw) % 2) if len(raw) > 4 else b""
        return head + bytes(4) + tail

    tags = tags | {t: (4, bytes(4), 1) for t in below}
    at = 8 + len(directory(tags, 8))
    parts = b""
    for t, entries in below.items():
        tags[t] = (4, struct.pack(">I", at + len(parts)), 1)
        parts += directory(entries, at + len(parts))
    return b"MM\0*" + struct.pack(">I", 8) + directory(tags, 8) + parts


def text_tag(text: str) -> tuple[int, bytes, int]:
    raw = text.encode() + b"\0"
    return 2, raw, len(raw)


def exif_of(i: int) -> bytes:
    """Capture metadata from a number: orientation, camera, time with or without zone, place, some out of range."""
    ratio = lambda *v: (5, struct.pack(f">{2 * len(v)}I", *(x for n in v for x in (n, 1))), len(v))
    taken = {0x9003: text_tag(f"2024:0{i % 9 + 1}:1{i % 10} 07:0{i % 10}:09"), 0x9291: text_tag(str(i % 1000))} | ({0x9011: text_tag("+02:00")} if i % 2 else {})
    place = {1: text_tag("N" if i % 3 else "S"), 2: ratio(i % 100, 30, 0), 3: text_tag("E"), 4: ratio(i % 180, 0, 36), 5: (1, bytes([i % 2]), 1), 6: ratio(i % 500)}
    return exif_block({0x010F: text_tag("ACME  Inc "), 0x0110: text_tag(f" M{i % 7}"), 0x0112: (3, struct.pack(">H", i % 9), 1)}, {0x8769: taken, 0x8825: place})


def png_file(pixels: np.ndarray, exif: bytes = b"") -> bytes:
    """Eight-bit RGB, rows filtered in turn by all five filters."""
    h, w = pixels.shape[:2]
    rows = pixels.reshape(h, -1).astype(np.int64)
    lines = []
    for y, row in enumerate(rows):
        up = rows[y - 1] if y else np.zeros_like(row)
        left, corner = (np.concatenate([np.zeros(3, np.int64), x[:-3]]) for x in (row, up))
        p = left + up - corner
        near = np.stack([np.abs(p - left), np.abs(p - up), np.abs(p - corner)])
        guess = (np.zeros_like(row), left, up, (left + up) // 2, np.choose(near.argmin(0), [left, up, corner]))[y % 5]
        lines.append(bytes([y % 5]) + ((row - guess) & 255).astype(np.uint8).tobytes())
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + (chunk(b"eXIf", exif) if exif else b"") + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def bmp_file(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape[:2]
    rows = np.zeros((h, -(-w * 3 // 4) * 4), np.uint8)
    rows[:, : w * 3] = pixels[::-1, :, ::-1].reshape(h, -1)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 0, 0, 0, 0) + rows.tobytes()


def webp_file(pixels: np.ndarray) -> bytes:
    """Lossless, red and blue less green, every value as a code of eight bits."""
    h, w = pixels.shape[:2]
    bytewise = [(0, 1), (8, 4), *[(0, 3)] * 11, (1, 3)]  # the only length is 8, so lengths take no bits
    fields = [(0x2F, 8), (w - 1, 14), (h - 1, 14), (0, 1), (0, 3), (1, 1), (2, 2), (0, 1), (0, 1), (0, 1)]
    fields += [*bytewise, (1, 1), (3, 3), (254, 8), *bytewise, (0, 1), *bytewise, (0, 1)]  # green has a byte's 256 symbols of 280
    fields += [(1, 1), (0, 1), (1, 1), (255, 8), (1, 1), (0, 1), (0, 1), (0, 1)]  # one opacity, no distances
    head = "".join(f"{v:0{n}b}"[::-1] for v, n in fields)
    green = pixels[..., 1:2]
    body = "".join(f"{v:08b}" for v in np.concatenate([green, pixels[..., ::2] - green], axis=2).ravel().tolist())
    bits = head + body + "0" * (-len(head + body) % 8)
    data = int(bits[::-1], 2).to_bytes(len(bits) // 8, "little")
    data += b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(data) + 12) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data


def picture_archives(embeddings: DataFrame) -> DataFrame:
    """Vectors as pictures in archives: odd ids as PNG with capture metadata, even ones as BMP, or WebP where they aren't multiples of 4.

    Every 13th is named .txt, every 17th .gif, every 19th has a broken checksum, and in every fifth archive the sixth entry is an archive
    by its first bytes.
    """

    def entries_of(pdf: pd.DataFrame) -> tuple[list[tuple[str, bytes]], set[str]]:
        out, spoiled = [], set()
        for i, picture in zip(pdf["vec_id"].astype(int), colours(np.stack(pdf["embedding"].to_list()))):
            data = png_file(picture, exif_of(i)) if i % 2 else webp_file(picture) if i % 4 else bmp_file(picture)
            name = f"p/v{i}." + ("txt" if i % 13 == 0 else "gif" if i % 17 == 0 else "png" if i % 2 else "webp" if i % 4 else "bmp")
            out.append((name, b"PK\3\4" + data if i // ENTRIES_EACH % 5 == 3 and i % ENTRIES_EACH == 5 else data))
            if i % 19 == 0:
                spoiled.add(name)
        return out, spoiled

    return archived(embeddings.where(F.size("embedding") == 64).select("vec_id", "embedding"), "vec_id", "pictures", entries_of)
