"""Image kernels in numpy: grey, histogram, hashes, turns. Each takes and returns arrays; Arrow functions wrap them."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from pixkin.config import TURNS


def grey(rgba: np.ndarray) -> np.ndarray:
    """Rounded luma of RGB or RGBA pixels, alpha ignored."""
    p = rgba.astype(np.float64)
    return np.floor(p[..., 0] * 0.299 + p[..., 1] * 0.587 + p[..., 2] * 0.114 + 0.5).astype(np.uint8)


def hsv_histogram(rgba: np.ndarray) -> np.ndarray:
    """8 x 4 x 4 bins of hue, saturation and value, as shares of the pixels."""
    p = rgba.reshape(-1, rgba.shape[-1])[:, :3].astype(np.float64) / 255
    high, low = p.max(1), p.min(1)
    delta = high - low
    r, g, b = p.T
    safe = np.where(delta == 0, 1, delta)
    hue = np.where(high == r, np.fmod((g - b) / safe, 6), np.where(high == g, (b - r) / safe + 2, (r - g) / safe + 4))
    hue = np.where(delta == 0, 0, np.fmod(hue * 60 + 360, 360))
    saturation = np.where(high == 0, 0, delta / np.where(high == 0, 1, high))
    bin_ = lambda x, n: np.minimum(n - 1, np.floor(x * n)).astype(int)
    return np.bincount(bin_(hue / 360, 8) * 16 + bin_(saturation, 4) * 4 + bin_(high, 4), minlength=128) / max(1, len(p))


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, of a picture or a stack of them; each pixel is interpolated across first, then down, so that flat areas stay exactly flat."""
    x = image.astype(np.float64)

    def along(x: np.ndarray, target: int) -> np.ndarray:
        source = x.shape[-1]
        at = np.clip((np.arange(target) + 0.5) * (source / target) - 0.5, 0, source - 1)
        low = np.floor(at).astype(int)
        left, right = x[..., low], x[..., np.minimum(source - 1, low + 1)]
        return left + (right - left) * (at - low)

    return along(along(x, width).swapaxes(-1, -2), height).swapaxes(-1, -2)


def packed(bits: np.ndarray) -> np.ndarray:
    """The last two axes' 64 booleans as signed numbers, the first as the highest bit."""
    return np.ascontiguousarray(np.packbits(bits.reshape(*bits.shape[:-2], 64), axis=-1)).view(">i8")[..., 0].astype(np.int64)


def average_hash(image: np.ndarray) -> np.ndarray:
    p = resize(image, 8, 8)
    return packed(p >= p.mean((-1, -2), keepdims=True))


def difference_hash(image: np.ndarray) -> np.ndarray:
    p = resize(image, 9, 8)
    return packed(p[..., :-1] > p[..., 1:])


@lru_cache(1)
def cosines() -> np.ndarray:
    """The lowest 8 rows of the orthonormal DCT of 32 values."""
    k, n = np.arange(8)[:, None], np.arange(32)[None]
    return np.sqrt(np.where(k == 0, 1 / 32, 2 / 32)) * np.cos((2 * n + 1) * k * np.pi / 64)


@lru_cache(16)
def spread_cosines(source: int) -> np.ndarray:
    """The cosines of 32 values that are interpolated from ``source`` ones."""
    at = np.clip((np.arange(32) + 0.5) * (source / 32) - 0.5, 0, source - 1)
    spread = np.zeros((32, source))
    for i, x in enumerate(at):
        spread[i, int(x)] += 1 - (x - int(x))
        spread[i, min(source - 1, int(x) + 1)] += x - int(x)
    return cosines() @ spread


def in_turn(x: np.ndarray, across: np.ndarray, down: np.ndarray) -> np.ndarray:
    """``down`` @ x @ ``across``.T, of a picture or a stack of them, with all sums from left to right.

    Of whole numbers some coefficients are equal, and rounding alone tells them apart: so that must not depend on a library's order of sums.
    """
    rows = sum(x[..., k, None] * across[:, k] for k in range(x.shape[-1]))
    return sum(rows[..., k, None, :] * down[:, k, None] for k in range(x.shape[-2]))


def coefficients(image: np.ndarray) -> np.ndarray:
    """The lowest 8 x 8 DCT coefficients of a picture, or a stack of them, drawn into 32 x 32 pixels.

    Small pictures meet interpolated cosines, and pictures of flat squares cosines summed by squares: a value is multiplied once.
    """
    if max(image.shape[-2:]) < 32:
        return in_turn(image.astype(np.float64), spread_cosines(image.shape[-1]), spread_cosines(image.shape[-2]))
    x = resize(image, 32, 32)
    squares = x.reshape(*x.shape[:-2], 8, 4, 8, 4)
    flat = (squares == squares[..., :1, :, :1]).all((-1, -2, -3, -4))
    by_four = cosines().reshape(8, 8, 4).sum(2)
    if flat.all():
        return in_turn(x[..., ::4, ::4], by_four, by_four)
    c = in_turn(x, cosines(), cosines())
    if flat.any():
        c[flat] = in_turn(x[flat][..., ::4, ::4], by_four, by_four)
    return c


def perceptual_hash(image: np.ndarray) -> np.ndarray:
    c = coefficients(image)
    c[np.abs(c) < 1e-9] = 0
    middle = np.sort(c.reshape(*c.shape[:-2], 64)[..., 1:], axis=-1)[..., 31]
    return packed(c > middle[..., None, None])


def turned(image: np.ndarray, degrees: int) -> np.ndarray:
    """Clockwise by quarter turns, of a picture or a stack of them."""
    return np.rot90(image, -degrees // 90, axes=(-2, -1))


def hashes(image: np.ndarray) -> dict[str, np.ndarray]:
    """Average, difference and perceptual hashes of the four turns of a picture or a stack of them: a0, d0, p0 ... p270."""
    out = {}
    for turn in TURNS:
        t = turned(image, turn)
        out |= {f"a{turn}": average_hash(t), f"d{turn}": difference_hash(t), f"p{turn}": perceptual_hash(t)}
    return out


def variants(image: np.ndarray, aspect: float) -> list[tuple[int, float, int, int, int]]:
    """(turn, aspect, average, difference and perceptual hash) of the four turns."""
    if not 0 < aspect < float("inf"):
        raise ValueError("the aspect ratio must be positive and finite")
    h = hashes(image)
    return [(t, 1 / aspect if t in (90, 270) else aspect, *(int(h[f"{k}{t}"]) for k in "adp")) for t in TURNS]


def oriented(pixels: np.ndarray, orientation: int | None) -> np.ndarray:
    """Pixels as EXIF orientations 1 to 8 want them shown; others change nothing."""
    moves = {
        2: lambda p: p[:, ::-1],
        3: lambda p: p[::-1, ::-1],
        4: lambda p: p[::-1],
        5: lambda p: p.swapaxes(0, 1),
        6: lambda p: np.rot90(p, -1),
        7: lambda p: p[::-1, ::-1].swapaxes(0, 1),
        8: lambda p: np.rot90(p, 1),
    }
    return moves.get(orientation or 1, lambda p: p)(pixels)


def global_ssim(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Structural similarity over whole pictures, with sample variances; of pictures (n values each) or stacks of them (k x n)."""
    if x.shape != y.shape or x.shape[-1] < 2:
        raise ValueError("pictures of one size are needed")
    a, b = x.astype(np.float64), y.astype(np.float64)
    c1, c2, n = (0.01 * 255) ** 2, (0.03 * 255) ** 2, a.shape[-1] - 1
    ma, mb = a.mean(-1, keepdims=True), b.mean(-1, keepdims=True)
    da, db = a - ma, b - mb
    va, vb, cov = ((p * q).sum(-1) / n for p, q in ((da, da), (db, db), (da, db)))
    ma, mb = ma[..., 0], mb[..., 0]
    value = np.clip((2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2)), -1, 1)
    return np.where((x == y).all(-1), 1.0, value)


def area_resize(rgba: np.ndarray, width: int, height: int) -> np.ndarray:
    """The picture drawn into ``width`` x ``height`` pixels, aspect ignored, each the mean of the area that it covers."""

    def weights(n: int, edge: int) -> np.ndarray:
        a, b = np.arange(edge) * n / edge, (np.arange(edge) + 1) * n / edge
        i = np.arange(n)
        return np.clip(np.minimum(b[:, None], i + 1) - np.maximum(a[:, None], i), 0, None) * edge / n

    wy, wx = weights(rgba.shape[0], height), weights(rgba.shape[1], width)
    return np.clip(np.rint(np.einsum("yh,hwc,xw->yxc", wy, rgba.astype(np.float64), wx, optimize=True)), 0, 255).astype(np.uint8)


def area_square(rgba: np.ndarray, edge: int) -> np.ndarray:
    return area_resize(rgba, edge, edge)


def thumbnail_size(width: int, height: int, edge: int = 360) -> tuple[int, int]:
    """The longest edge fitted, never enlarged, at least a pixel."""
    scale = min(1.0, edge / max(width, height, 1))
    return max(1, int(np.floor(width * scale + 0.5))), max(1, int(np.floor(height * scale + 0.5)))
