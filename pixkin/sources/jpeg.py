"""JPEG files in numpy: a reader that accumulates scans into coefficient arrays.

It takes any Huffman-coded baseline or progressive file of 8 bits with one or three components: spectral selection and successive
approximation, interleaved scans, restart intervals, end-of-band runs, chroma of any integer ratio. Coefficients are inverse-transformed
by one matrix product, chroma is repeated to full resolution, and RGB comes out.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np


def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order."""
    return np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def inverse_transform() -> np.ndarray:
    """64 x 64: row z is the picture of the z-th zigzag coefficient."""
    x = np.arange(8)
    cosines = np.sqrt(np.where(x == 0, 1 / 8, 2 / 8))[:, None] * np.cos((2 * x[None] + 1) * x[:, None] * np.pi / 16)
    return np.einsum("ux,vy->uvxy", cosines, cosines).reshape(64, 64)[zigzag()].astype(np.float32)


ZIGZAG, PICTURES = zigzag(), inverse_transform()


@dataclass
class Component:
    key: int
    h: int
    v: int
    table: int
    across: int = 0  # blocks that the component has
    down: int = 0
    stride: int = 0  # blocks that are stored, whole units
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int16))


class Huffman:
    def __init__(self, lengths: bytes, symbols: bytes):
        self.length, self.symbol = np.zeros(65536, np.uint8), np.zeros(65536, np.uint8)
        code = place = 0
        self.first = (0, 0)
        for n, count in enumerate(lengths, 1):
            for _ in range(count):
                span = slice(code << (16 - n), (code + 1) << (16 - n))
                self.length[span], self.symbol[span] = n, symbols[place]
                if place == 0:
                    self.first = (n, symbols[0])
                code, place = code + 1, place + 1
            code <<= 1
        self.lengths_, self.symbols_ = self.length.tolist(), self.symbol.tolist()


class Bits:
    """One segment's bits, without stuffing."""

    def __init__(self, data: bytes):
        self.data = data.replace(b"\xff\x00", b"\xff")
        self.n = 8 * len(self.data)
        self.at = 0
        self._bits: np.ndarray | None = None

    @property
    def bits(self) -> np.ndarray:
        if self._bits is None:
            self._bits = np.unpackbits(np.frombuffer(self.data, np.uint8))
        return self._bits

    def peek(self) -> int:
        i = self.at >> 3
        return (int.from_bytes(self.data[i : i + 3].ljust(3, b"\xff"), "big") >> (8 - (self.at & 7))) & 0xFFFF

    def symbol(self, table: Huffman) -> int:
        code = self.peek()
        n = table.lengths_[code]
        if not n or self.at >= self.n:
            raise ValueError("JPEG data end early or hold an unknown code")
        self.at += n
        return table.symbols_[code]

    def number(self, n: int) -> int:
        if not n:
            return 0
        i, j = self.at >> 3, (self.at + n + 7) >> 3
        value = int.from_bytes(self.data[i:j].ljust(j - i, b"\xff"), "big") >> ((8 * (j - i)) - (self.at & 7) - n)
        self.at += n
        return value & ((1 << n) - 1)

    def take(self, n: int) -> np.ndarray:
        if self.at + n > self.n:
            raise ValueError("JPEG data end early")
        self.at += n
        return self.bits[self.at - n : self.at]


def extended(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Signed numbers from their bits: those with a leading 0 are negative."""
    return np.where(value < (1 << np.maximum(size, 1) >> 1), value - (1 << size) + 1, value) * (size > 0)


def read_dc(bits: Bits, tables: list[Huffman], of: np.ndarray, low: int) -> list[np.ndarray]:
    """First scan of DC: the values of each component's next blocks, from their differences; ``of``: the components in turn.

    Code lengths are looked up at every bit, so that only the chain of places is walked one by one.
    """
    b = np.frombuffer(bits.data + b"\xff\xff\xff", np.uint8).astype(np.uint32)
    words = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    p = np.arange(bits.n)
    peek = (words[p >> 3] >> (8 - (p & 7))) & 0xFFFF
    made = {}
    for t in tables:
        if id(t) not in made:
            length = t.length[peek]
            jump = p + length
            jump += t.symbol[peek]
            jump[length == 0] = bits.n + 1
            made[id(t)] = jump.tolist()
    jumps = [made[id(t)] for t in tables]
    at, places = bits.at, []
    try:
        if len(made) == 1:
            jump = jumps[0]
            for _ in range(len(of)):
                places.append(at)
                at = jump[at]
        else:
            for k in of.tolist():
                places.append(at)
                at = jumps[k][at]
    except IndexError:
        raise ValueError("JPEG data end early") from None
    places = np.array(places, np.int64)
    wide = np.concatenate([b, np.zeros(4, np.uint32)]).astype(np.uint64)
    out = []
    for k, t in enumerate(tables):
        own = places[of == k] if len(tables) > 1 else places
        code = peek[own]
        n, start = t.symbol[code].astype(np.int64), own + t.length[code]
        i = start >> 3
        word = wide[i] << np.uint64(24) | wide[i + 1] << np.uint64(16) | wide[i + 2] << np.uint64(8) | wide[i + 3]
        value = ((word >> (32 - (start & 7) - n).astype(np.uint64)) & ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        out.append(np.cumsum(extended(value, n)) << low)
    bits.at = at
    return out


def read_ac(bits: Bits, table: Huffman, c: np.ndarray, low: int, first: int, last: int) -> None:
    """First scan of a band; c: the segment's blocks."""
    length, symbol = table.first
    band = last - first + 1
    if length == 1 and 0 < symbol < 16:
        # If all coefficients have the one-bit code with no run, their fields are alike in length: read them as a matrix.
        n = len(c) * band * (1 + symbol)
        if bits.at == 0 and n <= bits.n < n + 8:
            if symbol == 7:
                v = np.frombuffer(bits.data, np.uint8)
                alike = v.max(initial=0) < 128
                v = v.astype(np.int16)
            else:
                m = bits.bits[:n].reshape(-1, 1 + symbol)
                v, alike = m.astype(np.int16) @ (1 << np.arange(symbol, -1, -1)), not m[:, 0].any()
            if alike:
                c[:, first : last + 1] = (np.where(v < 1 << (symbol - 1), v - (1 << symbol) + 1, v) << low).reshape(len(c), band)
                bits.at = n
                return
    block = 0
    while block < len(c):
        k = first
        while k <= last:
            rs = bits.symbol(table)
            run, size = rs >> 4, rs & 15
            if size:
                k += run
                value = bits.number(size)
                c[block, k] = (value if value >> (size - 1) else value - (1 << size) + 1) << low
                k += 1
            elif run == 15:
                k += 16
            else:
                block += (1 << run) + bits.number(run) - 1
                break
        block += 1


def read_ac_more(bits: Bits, table: Huffman, c: np.ndarray, low: int, first: int, last: int) -> None:
    """Refinement scan of a band. Correction bits of an end-of-band run are taken together."""
    one, block, k = 1 << low, 0, first

    def correct(part: np.ndarray) -> None:
        there = part != 0
        part[there] += np.sign(part[there]) * (bits.take(int(there.sum())).astype(np.int16) << low)

    while block < len(c):
        rs = bits.symbol(table)
        run, size = rs >> 4, rs & 15
        if size == 0 and run < 15:
            blocks = (1 << run) + bits.number(run)
            correct(c[block, k : last + 1])
            rest = c[block + 1 : block + blocks, first : last + 1]
            flat = rest.ravel()
            correct(flat)
            rest[:] = flat.reshape(rest.shape)
            block, k = block + blocks, first
            continue
        value = (one if bits.number(1) else -one) if size else 0
        row = c[block]
        while k <= last:
            if row[k]:
                if bits.number(1):
                    row[k] += one if row[k] > 0 else -one
            elif run:
                run -= 1
            else:
                row[k] = value
                k += 1
                break
            k += 1
        if k > last:
            block, k = block + 1, first


def read_sequential(bits: Bits, dc: list[Huffman], ac: list[Huffman], rows: list[tuple[int, np.ndarray]]) -> None:
    before = [0] * len(dc)
    for k, row in rows:
        size = bits.symbol(dc[k])
        value = bits.number(size)
        before[k] += (value if not size or value >> (size - 1) else value - (1 << size) + 1)
        row[0], i = before[k], 1
        while i < 64:
            rs = bits.symbol(ac[k])
            run, size = rs >> 4, rs & 15
            if not size:
                if run < 15:
                    break
                i += 16
                continue
            i += run
            value = bits.number(size)
            row[i] = value if value >> (size - 1) else value - (1 << size) + 1
            i += 1


@dataclass
class Picture:
    width: int
    height: int
    components: list[Component]
    tables: dict[int, np.ndarray]
    comment: bytes

    def planes(self) -> list[np.ndarray]:
        """Samples of each component at full resolution, 0 to 255, as floats."""
        out, most_h, most_v = [], max(c.h for c in self.components), max(c.v for c in self.components)
        for c in self.components:
            pixels = (c.coefficients * self.tables[c.table]).astype(np.float32) @ PICTURES
            down = len(c.coefficients) // c.stride
            plane = pixels.reshape(down, c.stride, 8, 8).swapaxes(1, 2).reshape(8 * down, 8 * c.stride)
            plane = np.clip(np.rint(plane) + 128, 0, 255)
            if (c.h, c.v) != (most_h, most_v):
                plane = plane.repeat(most_v // c.v, 0).repeat(most_h // c.h, 1)
            out.append(plane[: self.height, : self.width])
        return out

    def rgb(self) -> np.ndarray:
        """height x width x 3, 8 bits."""
        planes = self.planes()
        if len(planes) == 1:
            return np.repeat(planes[0].astype(np.uint8)[:, :, None], 3, 2)
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        out = np.empty((self.height, self.width, 3), np.float32)
        out[:, :, 0] = y + 1.402 * cr
        out[:, :, 1] = y - 0.344136 * cb - 0.714136 * cr
        out[:, :, 2] = y + 1.772 * cb
        return np.clip(np.rint(out, out=out), 0, 255, out=out).astype(np.uint8)


def segments(data: bytes, at: int) -> tuple[list[bytes], int]:
    """Entropy-coded segments from ``at``, cut at restart markers, and the place of the next other marker."""
    out, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return [*out, data[start:]], len(data)
        kind = data[at + 1]
        if kind == 0 or kind == 0xFF:
            at += 1 + (kind == 0)
        elif 0xD0 <= kind <= 0xD7:
            out.append(data[start:at])
            start = at = at + 2
        else:
            return [*out, data[start:at]], at


def decode(data: bytes) -> Picture:
    """The picture with the coefficients that all its scans add up to. ValueError: not such a file, or broken."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, picture, quant, huffman, restart, comment, progressive = 2, None, {}, {}, 0, b"", True
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xFE:
            comment += body
        elif kind == 0xDB:
            i = 0
            while i < len(body):
                wide, key = body[i] >> 4, body[i] & 15
                n = 128 if wide else 64
                quant[key] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, i + 1).astype(np.int32)
                i += 1 + n
        elif kind == 0xC4:
            i = 0
            while i < len(body):
                n = sum(body[i + 1 : i + 17])
                huffman[body[i]] = known_table(body[i + 1 : i + 17], body[i + 17 : i + 17 + n])
                i += 17 + n
        elif kind == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif kind in (0xC0, 0xC1, 0xC2):
            progressive = kind == 0xC2
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            if body[0] != 8 or body[5] not in (1, 3) or not height or not width:
                raise ValueError("only 8 bits and one or three components are supported")
            parts = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
            most_h, most_v = max(c.h for c in parts), max(c.v for c in parts)
            units = -(-width // (8 * most_h)), -(-height // (8 * most_v))
            for c in parts:
                c.across, c.down = -(-(-(-width * c.h // most_h)) // 8), -(-(-(-height * c.v // most_v)) // 8)
                c.stride = units[0] * c.h
                c.coefficients = np.zeros((units[1] * c.v * c.stride, 64), np.int16)
            picture = Picture(width, height, parts, quant, b"")
        elif 0xC3 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise ValueError("this JPEG process isn't supported")
        elif kind == 0xDA:
            if picture is None:
                raise ValueError("a scan before the frame")
            n = body[0]
            chosen = [(next(c for c in picture.components if c.key == body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
            first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            coded, at = segments(data, at)
            scan(picture, chosen, coded, restart, huffman, progressive, first, last, high, low)
    if picture is None:
        raise ValueError("no frame")
    picture.comment = comment
    return picture


_tables: dict[tuple[bytes, bytes], Huffman] = {}


def known_table(lengths: bytes, symbols: bytes) -> Huffman:
    if len(_tables) > 64:
        _tables.clear()
    if (lengths, symbols) not in _tables:
        _tables[lengths, symbols] = Huffman(lengths, symbols)
    return _tables[lengths, symbols]


@lru_cache(512)
def interleaved(across: int, down: int, shapes: tuple[tuple[int, int, int], ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """For units of (h, v, stride) components: the stored places of each one's blocks in scan order, and the components in turn."""
    places = []
    for h, v, stride in shapes:
        y = (np.arange(down)[:, None, None, None] * v + np.arange(v)[None, None, :, None]) * stride
        places.append((y + np.arange(across)[None, :, None, None] * h + np.arange(h)[None, None, None, :]).ravel())
    return places, np.tile(np.concatenate([np.full(h * v, k) for k, (h, v, _) in enumerate(shapes)]), across * down)


def scan(picture: Picture, chosen: list, coded: list[bytes], restart: int, huffman: dict, progressive: bool, first: int, last: int, high: int, low: int) -> None:
    """Add one scan, segment by segment, to the coefficients."""
    if len(chosen) == 1:  # blocks in rows, without those that only fill up units
        c = chosen[0][0]
        rows = None if c.stride == c.across else (np.arange(c.down)[:, None] * c.stride + np.arange(c.across)).ravel()
        units, per_unit, places, of = c.down * c.across, [1], [rows], None
    else:
        c = chosen[0][0]
        across, down = c.stride // c.h, len(c.coefficients) // c.stride // c.v
        places, of = interleaved(across, down, tuple((c.h, c.v, c.stride) for c, _, _ in chosen))
        units, per_unit = across * down, [c.h * c.v for c, _, _ in chosen]
    step = restart or units
    for j, data in enumerate(coded):
        a, b = j * step, min(units, (j + 1) * step)
        if a >= b:
            break
        bits = Bits(data)
        at = [slice(a * n, b * n) if p is None else p[a * n : b * n] for n, p in zip(per_unit, places)]
        mine = np.zeros(b - a, np.int64) if of is None else of[a * sum(per_unit) : b * sum(per_unit)]
        if progressive and first == 0:
            if high:
                got = bits.take(len(mine)).astype(np.int16) << low
                for k, (c, _, _) in enumerate(chosen):
                    c.coefficients[at[k], 0] |= got[mine == k]
            else:
                for (c, _, _), x, values in zip(chosen, at, read_dc(bits, [huffman[d] for _, d, _ in chosen], mine, low)):
                    c.coefficients[x, 0] = values
            continue
        blocks = [c.coefficients[x] for (c, _, _), x in zip(chosen, at)]
        if progressive:
            (read_ac_more if high else read_ac)(bits, huffman[16 + chosen[0][2]], blocks[0], low, first, last)
        else:
            rows = [iter(x) for x in blocks]
            read_sequential(bits, [huffman[d] for _, d, _ in chosen], [huffman[16 + t] for _, _, t in chosen], [(k, next(rows[k])) for k in mine.tolist()])
        for (c, _, _), x, block in zip(chosen, at, blocks):
            if not isinstance(x, slice):
                c.coefficients[x] = block


def decode_jpeg(data: bytes) -> np.ndarray:
    """height x width x 4, 8 bits. ValueError: not such a file, or broken."""
    try:
        rgb = decode(data).rgb()
    except (KeyError, IndexError, StopIteration, TypeError, ZeroDivisionError) as e:
        raise ValueError(f"a JPEG file is broken: {e!r}") from e
    return np.concatenate([rgb, np.full((*rgb.shape[:2], 1), 255, np.uint8)], axis=2)
