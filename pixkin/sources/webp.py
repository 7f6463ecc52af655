"""Lossless WebP pictures (VP8L): prefix codes, repeats, recent colours and the four transforms. Lossy ones are refused."""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the format: in what order the lengths of length codes are stored, and the bits that repeat a length.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
REPEATS = {16: (3, 2), 17: (3, 3), 18: (11, 7)}
#: Places of the 120 nearest earlier pixels (left, up), by distance, then by columns, those on the left first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
HASH = 0x1E35A7BD
#: Bits of a code that a table resolves in one step; longer codes are looked up by length.
QUICK = 9
MOST_PIXELS = 200_000_000

Code = tuple[list[int], int, dict[int, int]]


class Bits:
    """Bits from the lowest of each byte on."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.size = data + bytes(16), 0, 8 * len(data)

    def peek(self) -> int:
        """65 bits at least."""
        if self.at > self.size:
            raise ValueError("WebP data end early")
        return int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 9], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        value = self.peek() & (1 << n) - 1
        self.at += n
        return value

    def symbol(self, code: Code) -> int:
        value, used = found(code, self.peek())
        self.at += used
        return value


def prefix_code(lengths: list[int]) -> Code:
    """A table by the next bits, its mask, and the codes too long for it. Entries are symbol << 4 | bits; a lone symbol takes no bits."""
    used = [(n, s) for s, n in enumerate(lengths) if n]
    if len(used) == 1:
        return [used[0][1] << 4], 0, {}
    if sum(1 << 15 - n for n, _ in used) != 1 << 15:
        raise ValueError("a WebP prefix code is broken")
    bits = min(QUICK, max(n for n, _ in used))
    table, long, code, before = [0] * (1 << bits), {}, 0, 0
    for n, s in sorted(used):
        code <<= n - before
        turned = int(f"{code:0{n}b}"[::-1], 2)
        if n <= bits:
            table[turned :: 1 << n] = [s << 4 | n] * (1 << bits - n)
        else:
            long[1 << n | turned] = s << 4 | n
        code, before = code + 1, n
    return table, (1 << bits) - 1, long


def found(code: Code, word: int) -> tuple[int, int]:
    """The symbol that ``word`` begins with, and its bits."""
    table, mask, long = code
    entry = table[word & mask]
    if not entry & 15 and mask:
        entry = next(long[k] for n in range(QUICK + 1, 16) if (k := 1 << n | word & (1 << n) - 1) in long)
    return entry >> 4, entry & 15


def read_code(bits: Bits, size: int) -> Code:
    """The prefix code of an alphabet of ``size`` symbols."""
    lengths = [0] * size
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        for symbol in [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else []):
            if symbol >= size:
                raise ValueError("a WebP prefix code is broken")
            lengths[symbol] = 1
        return prefix_code(lengths)
    inner = [0] * 19
    for place in LENGTH_ORDER[: 4 + bits.read(4)]:
        inner[place] = bits.read(3)
    # Lengths of length codes have three bits, and the test for full codes holds for them as well.
    code, left, at, before = prefix_code(inner), size, 0, 8
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    while at < size and left > 0:
        n, left = bits.symbol(code), left - 1
        if n < 16:
            lengths[at], at, before = n, at + 1, n or before
            continue
        least, more = REPEATS[n]
        times = least + bits.read(more)
        if at + times > size:
            raise ValueError("a WebP prefix code is broken")
        lengths[at : at + times] = [before if n == 16 else 0] * times
        at += times
    return prefix_code(lengths)


def read_pixels(bits: Bits, width: int, height: int, outer: bool) -> np.ndarray:
    """height x width of ARGB numbers, before transforms. ``outer``: the picture itself, whose parts may have codes of their own."""
    cache = bits.read(4) if bits.read(1) else 0
    if cache > 11:
        raise ValueError("a WebP colour cache is broken")
    grain, kinds = 0, None
    if outer and bits.read(1):
        grain = bits.read(3) + 2
        kinds = ((read_pixels(bits, -(-width >> grain), -(-height >> grain), False) >> 8) & 0xFFFF).tolist()
    count = 1 + max(map(max, kinds)) if kinds else 1
    sizes = (280 + (1 << cache if cache else 0), 256, 256, 256, 40)
    groups = [[read_code(bits, n) for n in sizes] for _ in range(count)]
    out, total, recent, kept, shift = [], width * height, [0] * (1 << cache), 0, 32 - cache
    data, at, size, group = bits.data, bits.at, bits.size, groups[0]
    step = 1 << grain if kinds else width
    border = 0
    while (place := len(out)) < total:
        if place >= border:  # where another code may begin
            y, x = divmod(place, width)
            if kinds:
                group = groups[kinds[y >> grain][x >> grain]]
            border = place - x + min(width, (x // step + 1) * step)
            green, red, blue, alpha, distance = group
        if at > size:
            raise ValueError("WebP data end early")
        word, used = int.from_bytes(data[at >> 3 : (at >> 3) + 9], "little") >> (at & 7), 0
        entry = green[0][word & green[1]]
        n = entry & 15
        if not n and green[1]:
            s, n = found(green, word)
        else:
            s = entry >> 4
        word >>= n
        used += n
        if s < 256:
            value = s << 8
            for code, up in ((red, 16), (blue, 0), (alpha, 24)):
                entry = code[0][word & code[1]]
                n, v = entry & 15, entry >> 4
                if not n and code[1]:
                    v, n = found(code, word)
                value |= v << up
                word >>= n
                used += n
            out.append(value)
        elif s < 280:
            span, n = extended(s - 256, word)
            word >>= n
            used += n
            s, n = found(distance, word)
            back, more = extended(s, word >> n)
            used += n + more
            back = back - 120 if back > 120 else max(1, NEAR[back - 1][0] + NEAR[back - 1][1] * width)
            if back > place or place + span > total:
                raise ValueError("a WebP repeat leaves the picture")
            piece = out[place - back : place - back + span]
            out += piece if back >= span else (piece * -(-span // back))[:span]
        else:
            for value in out[kept:]:
                recent[(value * HASH & 0xFFFFFFFF) >> shift] = value
            kept = place
            out.append(recent[s - 280])
        at += used
    if at > size:
        raise ValueError("WebP data end early")
    bits.at = at
    return np.array(out, np.uint32).reshape(height, width)


def extended(symbol: int, word: int) -> tuple[int, int]:
    """The number that a symbol and the bits after it stand for, and how many bits those are."""
    if symbol < 4:
        return symbol + 1, 0
    n = symbol - 2 >> 1
    return (2 + (symbol & 1) << n) + (word & (1 << n) - 1) + 1, n


def parts(pixels: np.ndarray) -> np.ndarray:
    """ARGB numbers as alpha, red, green and blue of 8 bits."""
    return pixels.astype(">u4").view(np.uint8).reshape(*pixels.shape, 4)


def spread(small: np.ndarray, grain: int, height: int, width: int) -> np.ndarray:
    return small.repeat(1 << grain, 0)[:height].repeat(1 << grain, 1)[:, :width]


def predicted(left: np.ndarray, modes: np.ndarray) -> np.ndarray:
    """Pixels from their differences to what neighbours foretell. A pixel leans on its left, upper and upper right neighbours, so those with the same x + 2 y are independent."""
    h, w = left.shape[:2]
    out = np.zeros((h, w, 4), np.uint8)
    modes = modes.copy()
    modes[0], modes[:, 0] = 1, 2
    modes[0, 0] = 0
    kinds = set(np.unique(modes).tolist())
    flat = out.reshape(-1, 4)
    for d in range(w + 2 * h - 2):
        y = np.arange(max(0, (d - w + 2) // 2), min(h, d // 2 + 1))
        x = d - 2 * y
        place, mode = y * w + x, modes[y, x]
        # Beyond the last column lies the first pixel of the same row; what would lie before the picture is never asked for.
        l, t, r, c = (flat[np.maximum(place - back, 0)].astype(np.int16) for back in (1, w, w - 1, w + 1))
        guess = np.zeros((len(y), 4), np.int16)
        for kind in kinds & set(mode.tolist()):
            here = mode == kind
            guess[here] = foretold(kind, l[here], t[here], r[here], c[here])
        out[y, x] = left[y, x] + guess.astype(np.uint8)
    return out


def foretold(kind: int, l: np.ndarray, t: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The guess of a mode from the left, upper, upper right and upper left pixels."""
    mean = lambda a, b: (a + b) >> 1
    if kind == 11:
        nearer = np.abs(t - c).sum(1) < np.abs(l - c).sum(1)
        return np.where(nearer[:, None], l, t)
    if kind == 12:
        return np.clip(l + t - c, 0, 255)
    if kind == 13:
        middle = mean(l, t)
        gap = middle - c
        return np.clip(middle + (gap + (gap < 0) >> 1), 0, 255)
    simple = {
        1: lambda: l, 2: lambda: t, 3: lambda: r, 4: lambda: c, 5: lambda: mean(mean(l, r), t), 6: lambda: mean(l, c), 7: lambda: mean(l, t),
        8: lambda: mean(c, t), 9: lambda: mean(t, r), 10: lambda: mean(mean(l, c), mean(t, r)),
    }
    return simple[kind]() if kind in simple else np.array([255, 0, 0, 0], np.int16)


def recoloured(pixels: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Red and blue get back the shares of green, and of red, that were taken from them."""
    signed = lambda v: v.view(np.int8).astype(np.int32)
    pixels, f = pixels.copy(), signed(factors)
    green = signed(np.ascontiguousarray(pixels[..., 2]))
    pixels[..., 1] += ((f[..., 3] * green) >> 5).astype(np.uint8)
    red = signed(np.ascontiguousarray(pixels[..., 1]))
    pixels[..., 3] += ((f[..., 2] * green) >> 5).astype(np.uint8) + ((f[..., 1] * red) >> 5).astype(np.uint8)
    return pixels


def lossless(data: bytes) -> np.ndarray:
    """height x width x 4 of one stream."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("a WebP stream is broken")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)  # whether the writer saw transparency: only a hint
    if bits.read(3):
        raise ValueError("this version of WebP isn't supported")
    if width * height > MOST_PIXELS:
        raise ValueError("a WebP picture is too large")
    steps, wide = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in [s[0] for s in steps]:
            raise ValueError("a WebP transform is repeated")
        if kind < 2:
            grain = bits.read(3) + 2
            steps.append((kind, wide, spread(parts(read_pixels(bits, -(-wide >> grain), -(-height >> grain), False)), grain, height, wide)))
        elif kind == 2:
            steps.append((kind, wide, None))
        else:
            count = bits.read(8) + 1
            table = np.cumsum(parts(read_pixels(bits, count, 1, False))[0], axis=0, dtype=np.uint8)
            steps.append((kind, wide, table))
            packed = 3 if count <= 2 else 2 if count <= 4 else 1 if count <= 16 else 0
            wide = -(-wide >> packed)
    pixels = parts(read_pixels(bits, wide, height, True)).copy()
    for kind, wide, more in reversed(steps):
        if kind == 0:
            pixels = predicted(pixels, more[..., 2] & 15)
        elif kind == 1:
            pixels = recoloured(pixels, more)
        elif kind == 2:
            pixels[..., 1] += pixels[..., 2]
            pixels[..., 3] += pixels[..., 2]
        else:
            index, each = pixels[..., 2], 8 if len(more) > 16 else 4 if len(more) > 4 else 2 if len(more) > 2 else 1
            if each < 8:  # several in a byte, the first in its lowest bits
                index = ((index[..., None] >> np.arange(0, 8, each, dtype=np.uint8)) & (1 << each) - 1).reshape(height, -1)[:, :wide]
            table = np.zeros((256, 4), np.uint8)  # numbers beyond the table are clear
            table[: len(more)] = more
            pixels = table[index]
    return pixels[..., [1, 2, 3, 0]]


def chunks(data: bytes, at: int) -> list[tuple[bytes, bytes]]:
    """Names and contents from ``at`` on; the last may be cut off."""
    out = []
    while at + 8 <= len(data):
        name, n = struct.unpack_from("<4sI", data, at)
        out.append((name, data[at + 8 : at + 8 + n]))
        at += 8 + n + n % 2
    return out


def decode_webp(data: bytes) -> np.ndarray:
    """A lossless picture; of a moving one the first frame on its canvas."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    canvas = None
    for name, body in chunks(data, 12):
        if name == b"VP8L":
            return lossless(body)
        if name == b"VP8 ":
            break
        if name == b"VP8X" and len(body) >= 10:
            canvas = [1 + int.from_bytes(body[i : i + 3], "little") for i in (4, 7)]
        if name == b"ANMF" and canvas:
            if canvas[0] * canvas[1] > MOST_PIXELS:
                raise ValueError("a WebP picture is too large")
            x, y = (2 * int.from_bytes(body[i : i + 3], "little") for i in (0, 3))
            frame = next((b for n, b in chunks(body, 16) if n == b"VP8L"), None)
            if frame is None:
                break
            shown, out = lossless(frame), np.zeros((canvas[1], canvas[0], 4), np.uint8)
            if x + shown.shape[1] > canvas[0] or y + shown.shape[0] > canvas[1]:
                raise ValueError("a WebP frame leaves its canvas")
            out[y : y + shown.shape[0], x : x + shown.shape[1]] = shown
            return out
    raise ValueError("lossy WebP isn't supported" if len(data) > 12 else "a WebP file is empty")
