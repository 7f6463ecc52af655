"""Lossless WebP: a slow writer of every feature, files of another writer, and broken ones."""

from __future__ import annotations

import base64
import heapq
import pathlib
import random
import struct
from itertools import count

import numpy as np
import pytest

from pixkin.plans import standins
from pixkin.sources import images, tiff, webp


class Out:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n)]

    def bytes(self):
        return b"".join(sum(b << i for i, b in enumerate(self.bits[k : k + 8])).to_bytes(1, "little") for k in range(0, len(self.bits), 8))


def lengths_of(counts):
    if len(counts) == 1:
        return dict.fromkeys(counts, 1)
    order = count()
    heap = [(n, next(order), [s]) for s, n in counts.items()]
    heapq.heapify(heap)
    depth = dict.fromkeys(counts, 0)
    while len(heap) > 1:
        (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in a + b:
            depth[s] += 1
        heapq.heappush(heap, (n + m, next(order), a + b))
    assert max(depth.values()) <= 15
    return depth


def codes_of(lengths):
    out, code, before = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - before
        out[s], code, before = [code >> n - 1 - i & 1 for i in range(n)], code + 1, n
    return {s: [] for s in out} if len(out) == 1 else out


INNER = codes_of({s: 4 if s < 13 else 5 for s in range(19)})


def write_code(out, counts, size):
    """Writes a prefix code and returns its codes. Runs of lengths are shortened; lengths end with the last symbol."""
    lengths = lengths_of(counts or {0: 1})
    if len(lengths) <= 2 and max(lengths) < 256:
        used = sorted(lengths)
        out.put(1, 1), out.put(len(used) - 1, 1), out.put(int(used[0] > 1), 1), out.put(used[0], 8 if used[0] > 1 else 1)
        for s in used[1:]:
            out.put(s, 8)
        return codes_of(dict.fromkeys(used, 1))
    listed = [lengths.get(s, 0) for s in range(max(lengths) + 1)]
    items, at, before = [], 0, 8
    while at < len(listed):
        n = listed[at]
        run = next((k for k, v in enumerate(listed[at:]) if v != n), len(listed) - at)
        if n == 0 and run >= 11:
            run = min(run, 138)
            items.append((18, run - 11, 7))
        elif n == 0 and run >= 3:
            items.append((17, run - 3, 3))
        elif n and n == before and run >= 3:
            run = min(run, 6)
            items.append((16, run - 3, 2))
        else:
            run, before = 1, n or before
            items.append((n, 0, 0))
        at += run
    out.put(0, 1), out.put(15, 4)
    for s in webp.LENGTH_ORDER:
        out.put(4 if s < 13 else 5, 3)
    if len(listed) < size or len(items) < size:
        out.put(1, 1), out.put(4, 3), out.put(len(items) - 2, 10)
    else:
        out.put(0, 1)
    for s, more, n in items:
        out.bits += INNER[s]
        out.put(more, n)
    return codes_of(lengths)


def prefixed(value):
    if value <= 4:
        return value - 1, 0, 0
    for s in range(4, 40):
        n = (s - 2) >> 1
        base = (2 + s % 2) << n
        if base <= value - 1 < base + (1 << n):
            return s, value - 1 - base, n


def write_pixels(out, pixels, rng, cache=0, grain=0, outer=False):
    """ARGB bytes (height x width x 4) as literals, repeats and recent colours."""
    h, w = pixels.shape[:2]
    values = [int.from_bytes(bytes(p), "big") for p in pixels.reshape(-1, 4)]
    out.put(int(cache > 0), 1)
    if cache:
        out.put(cache, 4)
    kinds = None
    if outer:
        out.put(int(grain > 0), 1)
        if grain:
            kinds = np.array([[rng.randrange(3) for _ in range(-(-w >> grain))] for _ in range(-(-h >> grain))])
            kinds[0, 0] = 2
            out.put(grain - 2, 3)
            small = np.zeros((*kinds.shape, 4), np.uint8)
            small[..., 2] = kinds
            write_pixels(out, small, rng)
    tokens, at, recent = [], 0, {}
    while at < len(values):
        group = int(kinds[at // w >> grain][at % w >> grain]) if kinds is not None else 0
        backs = [b for b in {1, w, w + 1, max(1, w - 1), rng.randint(1, at)} if b <= at and values[at - b] == values[at]] if at else []
        span = 0
        if backs:
            back = rng.choice(backs)
            while at + span < len(values) and values[at + span] == values[at + span - back] and span < 4000:
                span += 1
        slot = (values[at] * 0x1E35A7BD % 2**32) >> (32 - cache) if cache else None
        if span >= 3:
            near = [i + 1 for i, (x, y) in enumerate(webp.NEAR) if max(1, x + y * w) == back]
            (a, ea, na), (b, eb, nb) = prefixed(span), prefixed(rng.choice(near) if near and rng.random() < 0.8 else back + 120)
            tokens.append((group, [(0, 256 + a), (ea, na, None), (4, b), (eb, nb, None)]))
        elif cache and recent.get(slot) == values[at] and rng.random() < 0.9:
            tokens.append((group, [(0, 280 + slot)]))
            span = 1
        else:
            v, span = values[at], 1
            tokens.append((group, [(0, v >> 8 & 255), (1, v >> 16 & 255), (2, v & 255), (3, v >> 24)]))
        for v in values[at : at + span]:
            if cache:
                recent[(v * 0x1E35A7BD % 2**32) >> (32 - cache)] = v
        at += span
    sizes, codes = (280 + (1 << cache if cache else 0), 256, 256, 256, 40), []
    for group in range(3 if kinds is not None else 1):
        codes.append([])
        for k, size in enumerate(sizes):
            counts = {}
            for g, items in tokens:
                for item in items:
                    if g == group and len(item) == 2 and item[0] == k:
                        counts[item[1]] = counts.get(item[1], 0) + 1
            codes[-1].append(write_code(out, counts, size))
    for g, items in tokens:
        for item in items:
            if len(item) == 2:
                out.bits += codes[g][item[0]][item[1]]
            else:
                out.put(item[0], item[1])


def guessed(mode, l, t, r, c):
    """One pixel's guess, channel by channel."""
    if mode == 11:
        p = [a + b - d for a, b, d in zip(l, t, c)]
        return l if sum(abs(x - a) for x, a in zip(p, l)) < sum(abs(x - b) for x, b in zip(p, t)) else t
    clip = lambda v: max(0, min(255, v))
    one = {
        1: lambda l, t, r, c: l, 2: lambda l, t, r, c: t, 3: lambda l, t, r, c: r, 4: lambda l, t, r, c: c, 5: lambda l, t, r, c: ((l + r) // 2 + t) // 2, 6: lambda l, t, r, c: (l + c) // 2,
        7: lambda l, t, r, c: (l + t) // 2, 8: lambda l, t, r, c: (c + t) // 2, 9: lambda l, t, r, c: (t + r) // 2, 10: lambda l, t, r, c: ((l + c) // 2 + (t + r) // 2) // 2,
        12: lambda l, t, r, c: clip(l + t - c), 13: lambda l, t, r, c: clip((l + t) // 2 + int(((l + t) // 2 - c) / 2)),
    }
    return [one[mode](*v) for v in zip(l, t, r, c)] if mode in one else [255, 0, 0, 0]


def webp_bytes(pixels, rng, transforms=(), cache=0, grain=0):
    """A WebP file of ARGB bytes; ``transforms`` in the order in which they are made."""
    h, w = pixels.shape[:2]
    out, pixels = Out(), pixels.astype(int)
    out.put(0x2F, 8), out.put(w - 1, 14), out.put(h - 1, 14), out.put(1, 1), out.put(0, 3)
    signed = lambda v: v - 256 if v > 127 else v
    for kind in transforms:
        out.put(1, 1), out.put(kind, 2)
        h, w = pixels.shape[:2]
        if kind in (0, 1):
            g = rng.randint(2, 4)
            out.put(g - 2, 3)
            more = np.zeros((-(-h >> g), -(-w >> g), 4), np.uint8)
            more[..., 0] = 255
            for y in range(more.shape[0]):
                for x in range(more.shape[1]):
                    more[y, x, 1:] = [0, rng.randrange(16), 0] if kind == 0 else [rng.randrange(256) for _ in range(3)]
            write_pixels(out, more, rng)
            left = pixels.copy()
            flat = pixels.reshape(-1, 4).tolist()
            for y in range(h):
                for x in range(w):
                    a, m, i = pixels[y, x], more[y >> g, x >> g].tolist(), y * w + x
                    if kind == 0:
                        mode = (0 if x == 0 else 1) if y == 0 else 2 if x == 0 else m[2]
                        left[y, x] = a - guessed(mode, *(flat[max(0, i - k)] for k in (1, w, w - 1, w + 1)))
                    else:
                        green, red = signed(int(a[2])), signed(int(a[1]))
                        left[y, x, 1] = a[1] - (signed(m[3]) * green >> 5)
                        left[y, x, 3] = a[3] - (signed(m[2]) * green >> 5) - (signed(m[1]) * red >> 5)
            pixels = left % 256
        elif kind == 2:
            pixels = pixels.copy()
            pixels[..., [1, 3]] = (pixels[..., [1, 3]] - pixels[..., 2:3]) % 256
        else:
            table = sorted({tuple(p) for p in pixels.reshape(-1, 4).tolist()})
            out.put(len(table) - 1, 8)
            steps = np.diff(np.array([(0, 0, 0, 0), *table]), axis=0) % 256
            write_pixels(out, steps[None].astype(np.uint8), rng)
            index = np.array([[table.index(tuple(p)) for p in row] for row in pixels.tolist()])
            each = next(k for k, most in ((8, 2), (4, 4), (2, 16), (1, 256)) if len(table) <= most)
            wide = np.zeros((h, -(-w // each) * each), int)
            wide[:, :w] = index
            packed = (wide.reshape(h, -1, each) << np.arange(each) * (8 // each)).sum(2)
            pixels = np.zeros((*packed.shape, 4), int)
            pixels[..., 0], pixels[..., 2] = 255, packed
    out.put(0, 1)
    write_pixels(out, pixels.astype(np.uint8), rng, cache, grain, outer=True)
    body = out.bytes()
    return riff(chunk(b"VP8L", body))


def chunk(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def riff(body):
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


def picture(rng, h, w, colours=None):
    """ARGB bytes: slopes, repeated rows and noise, or few colours."""
    if colours:
        table = np.array([[rng.randrange(256) for _ in range(4)] for _ in range(colours)], np.uint8)
        return table[np.array([[rng.randrange(colours) if rng.random() < 0.4 else (x // 5 + y // 4) % colours for x in range(w)] for y in range(h)])]
    a = np.array([[[255 - y % 3, (3 * x + y) % 256, (x * y + rng.randrange(3)) % 256, rng.randrange(256) if x % 7 == 0 else 90] for x in range(w)] for y in range(h)], np.uint8)
    a[h // 2 :] = a[: h - h // 2] if rng.random() < 0.5 else a[h // 2 :]
    return a


@pytest.mark.parametrize("transforms", [(), (2,), (0,), (1,), (2, 0, 1), (0, 1, 2), (1, 2, 0), (3,), (3, 0)])
def test_every_feature_comes_back(transforms):
    rng = random.Random(str(transforms))
    for n, (h, w) in enumerate([(1, 1), (1, 9), (9, 1), (2, 2), (23, 37), (40, 31)]):
        few = (2, 3, 11, 40, 4, 200)[n]
        a = picture(rng, h, w, few if 3 in transforms else None)
        data = webp_bytes(a, rng, transforms, cache=rng.choice([0, 1, 4, 11]), grain=rng.choice([0, 2, 3]))
        assert (images.DECODERS["webp"](data) == a[..., [1, 2, 3, 0]]).all(), (h, w)


def test_places_of_near_pixels():
    assert len(webp.NEAR) == 120 and webp.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)] and webp.NEAR[-3:] == [(-7, 7), (8, 6), (8, 7)]
    assert webp.NEAR[34:42] == [(0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5)]


def test_files_of_another_writer():
    clear, white = (webp.decode_webp(base64.b64decode(s)) for s in ("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==", "UklGRh4AAABXRUJQVlA4TBEAAAAvAAAAAAfQ//73v/+BiOh/AAA="))
    assert clear.tolist() == [[[0, 0, 0, 0]]] and white.tolist() == [[[255, 255, 255, 255]]]
    folder = pathlib.Path(random.__file__).parent / "test" / "test_email" / "data"
    if not (folder / "python.webp").exists():
        pytest.skip("Python's own tests aren't installed")
    opacity = dict(webp.chunks((folder / "python.webp").read_bytes(), 12))[b"ALPH"]  # the same kind of stream without a head
    head = 0x2F | 15 << 8 | 15 << 22
    assert (webp.lossless(head.to_bytes(5, "little") + opacity[1:])[..., 1] == images.decode_png((folder / "python.png").read_bytes())[..., 3]).all()


def test_frames_and_standins():
    rng = random.Random(5)
    a = picture(rng, 6, 8)
    one = webp_bytes(a, rng)[12:]
    moving = riff(chunk(b"VP8X", bytes([2, 0, 0, 0, 11, 0, 0, 9, 0, 0])) + chunk(b"ANIM", bytes(6)) + chunk(b"ANMF", bytes([1, 0, 0, 2, 0, 0, 7, 0, 0, 5, 0, 0]) + bytes(4) + one))
    got = webp.decode_webp(moving)
    assert got.shape == (10, 12, 4) and (got[4:, 2:10] == a[..., [1, 2, 3, 0]]).all() and not got[:4].any() and not got[:, :2].any()
    assert (webp.decode_webp(standins.webp_file(a[..., 1:]))[..., :3] == a[..., 1:]).all()
    assert images.features_of("webp", standins.webp_file(a[..., 1:]))["width"] == 8


def test_capture_metadata():
    file = standins.webp_file(picture(random.Random(7), 4, 4)[..., 1:])
    block = standins.exif_of(7)
    for body in (block, b"Exif\0\0" + block):
        got = tiff.raw_metadata(riff(file[12:] + chunk(b"EXIF", body)))
        assert (got["make"], got["orientation"], got["subseconds"]) == ("ACME  Inc ", "7", "7")
    assert tiff.raw_metadata(file) == {}


def test_broken_files_are_refused():
    rng = random.Random(6)
    good = webp_bytes(picture(rng, 20, 20), rng, (2, 0), cache=4)
    for n in range(0, len(good) - 8, 7):
        with pytest.raises((ValueError, IndexError)):
            webp.decode_webp(good[:n])
    for data in (b"", riff(b""), riff(chunk(b"VP8 ", bytes(20))), riff(chunk(b"VP8L", b"\x2e" + bytes(20)))):
        with pytest.raises(ValueError):
            webp.decode_webp(data)
    for _ in range(300):  # any bytes give a picture or one of the errors that become findings
        spoiled = bytearray(good)
        for _ in range(3):
            spoiled[rng.randrange(25, len(good))] ^= 1 << rng.randrange(8)
        try:
            webp.decode_webp(bytes(spoiled))
        except (ValueError, IndexError, KeyError, TypeError):
            pass
