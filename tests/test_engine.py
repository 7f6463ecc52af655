"""Kernels, archives, pair join, clustering, reports, store and stream."""

from __future__ import annotations

import io
import itertools
import json
import random
import shutil
import struct
import zipfile
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixkin.config import MODES, TURNS, Limits
from pixkin.functions import kernels, tables
from pixkin.operators import clusters, comparisons, graph, pairs, reports, results, validate
from pixkin.operators.skew import cut
from pixkin.plans import catalog_review, oracles, standins
from pixkin.plans.analysis import analyse
from pixkin.plans.progress import Cancelled, Progress
from pixkin.sources import archive, images
from pixkin.sources.store import Store
from pixkin.streaming import incremental
from pixkin.streaming.incremental import watch

signed = lambda h: int.from_bytes(bytes.fromhex(h), "big", signed=True)


def png(a: np.ndarray, how: int = 0) -> bytes:
    h = a.shape[0]
    raw = b"".join(bytes([how]) + (a[y] if how == 0 else a[y] - np.vstack([np.zeros((1, *a[y].shape[1:]), np.uint8), a[y][:-1]])).astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def motif() -> np.ndarray:
    y, x = np.mgrid[0:160, 0:240]
    a = np.stack([x * 255 // 240, y * 255 // 160, np.full_like(x, 80)], axis=2).astype(np.uint8)
    a[40:110, 50:120], a[20:70, 150:220], a[120:150, 10:230] = (220, 40, 30), (20, 60, 200), (240, 230, 90)
    return a


@pytest.fixture(scope="session")
def zips(tmp_path_factory):
    base, folder = motif(), tmp_path_factory.mktemp("zips")
    y, x = np.mgrid[0:150, 0:220]
    small = base[np.arange(120) * 160 // 120][:, np.arange(180) * 240 // 180]
    entries = {
        "baustelle/a/original.png": png(base), "baustelle/a/kopie.png": png(base, 1), "baustelle/a/klein.png": png(small), "baustelle/a/heller.png": png(np.clip(base.astype(int) + 24, 0, 255).astype(np.uint8)),
        "baustelle/a/hochkant.png": png(np.rot90(base).copy()), "baustelle/b/karos.png": png((((x // 18 + y // 18) % 2) * 255).astype(np.uint8)[..., None].repeat(3, 2)),
        "hinweise/nicht.txt": b"text", "baustelle/beschaedigt.jpg": b"plain text", "baustelle/kaputt.png": b"\x89PNG\r\n\x1a\nnothing",
    }
    with zipfile.ZipFile(folder / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries.items():
            z.writestr(name, data)
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("x", "y")
    with zipfile.ZipFile(folder / "disguised.zip", "w") as z:
        z.writestr("ok.png", png(base))
        z.writestr("bad.png", inner.getvalue())
    (folder / "broken.zip").write_bytes(b"no archive")
    return str(folder)


def test_flat_picture_hashes():
    flat = np.full((64, 64), 128, np.uint8)
    assert (kernels.average_hash(flat), kernels.difference_hash(flat), kernels.perceptual_hash(flat)) == (-1, 0, signed("8000000000000000"))


def test_equal_coefficients_fall_as_sums_from_left_to_right_do():
    """Pictures whose coefficients nearest the middle are equal but for rounding, as they are and drawn larger in flat squares."""
    known = [("8298966b7d7063807d7680978488867e747a67606f868d957f9f7a7c8570578c8083808f748369a0858d9d7a6d737891767d6d8e7b6e7f868e99786e6a898672", "ea0b55cb6269633c"), ("8f8a8389826794967668708a7686728d7c5a9e7a8f778f927786698a7498735f79868d77808c8896796868998c958c758d77927688858b74877a9a6c6f6d8273", "8fa86db860d58da3")]
    total = lambda values: list(itertools.accumulate(values))[-1]  # noqa: E731  sum() corrects its roundings
    for digits, hash_ in known:
        small = np.frombuffer(bytes.fromhex(digits), np.uint8).reshape(8, 8)
        assert kernels.perceptual_hash(small) == signed(hash_)
        large = np.kron(small, np.ones((8, 8), np.uint8))
        for picture, across in ((small, oracles.COSINES), (large, kernels.cosines().reshape(8, 8, 4).sum(2))):
            rows = [[total(float(small[y, k]) * across[u, k] for k in range(8)) for u in range(8)] for y in range(8)]
            want = [[total(rows[k][u] * across[v, k] for k in range(8)) for u in range(8)] for v in range(8)]
            assert kernels.coefficients(np.stack([picture] * 3)).tolist() == [want] * 3
    mixed = np.stack([large, (np.arange(4096) % 251).reshape(64, 64)])
    assert np.allclose(kernels.coefficients(mixed), kernels.cosines() @ kernels.resize(mixed, 32, 32) @ kernels.cosines().T)


def test_turns_and_orientations():
    a = np.array([[1, 2, 3], [4, 5, 6]], np.uint8)
    assert [kernels.turned(a, t).ravel().tolist() for t in (90, 180, 270)] == [[4, 1, 5, 2, 6, 3], [6, 5, 4, 3, 2, 1], [3, 6, 2, 5, 1, 4]]
    want = {1: [1, 2, 3, 4, 5, 6], 2: [3, 2, 1, 6, 5, 4], 3: [6, 5, 4, 3, 2, 1], 4: [4, 5, 6, 1, 2, 3], 5: [1, 4, 2, 5, 3, 6], 6: [4, 1, 5, 2, 6, 3], 7: [6, 3, 5, 2, 4, 1], 8: [3, 6, 2, 5, 1, 4]}
    assert {o: kernels.oriented(a, o).ravel().tolist() for o in want} == want


def test_resize_against_a_pixel_loop():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (7, 11)).astype(np.uint8)
    got = kernels.resize(a, 9, 8)
    for ty in range(8):
        for tx in range(9):
            sy, sx = np.clip((ty + 0.5) * 7 / 8 - 0.5, 0, 6), np.clip((tx + 0.5) * 11 / 9 - 0.5, 0, 10)
            y0, x0 = int(sy), int(sx)
            y1, x1 = min(6, y0 + 1), min(10, x0 + 1)
            f = lambda y, x: float(a[y, x])
            top, low = f(y0, x0) + (f(y0, x1) - f(y0, x0)) * (sx - x0), f(y1, x0) + (f(y1, x1) - f(y1, x0)) * (sx - x0)
            assert got[ty, tx] == pytest.approx(top + (low - top) * (sy - y0))


def test_histogram_and_ssim():
    red = np.zeros((4, 4, 4), np.uint8)
    red[..., 0], red[..., 3] = 255, 255
    h = kernels.hsv_histogram(red)
    assert h[0 * 16 + 3 * 4 + 3] == 1 and h.sum() == 1
    y, x = np.mgrid[0:64, 0:64]
    board = (((x // 8 + y // 8) % 2) * 200).astype(np.uint8).ravel()
    assert kernels.global_ssim(board, board) == 1 and kernels.global_ssim(board, board + 10) > 0.98 and kernels.global_ssim(board, 200 - board) < 0
    assert kernels.thumbnail_size(7200, 10) == (360, 1) and kernels.thumbnail_size(100, 50) == (100, 50)


def test_decoders():
    a = motif()
    assert (images.decode_png(png(a))[..., :3] == a).all() and (images.decode_png(png(a, 1))[..., :3] == a).all()
    rows = np.zeros((160, 720), np.uint8)
    rows[:, :] = a[::-1, :, ::-1].reshape(160, -1)
    bmp = b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 240, 160, 1, 24, 0, rows.size, 0, 0, 0, 0) + rows.tobytes()
    assert (images.decode_bmp(bmp)[..., :3] == a).all()
    with pytest.raises(ValueError):
        images.features_of("webp", b"")


def random_records(spark, n, seed=3, without=0):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(6)]
    flip = lambda h, k: h ^ sum(1 << b for b in rng.sample(range(64), k))
    to_signed = lambda h: h - 2**64 if h >= 2**63 else h
    rows = []
    for i in range(n):
        hashes = [to_signed(flip(rng.choice(base), rng.randint(0, 20))) for _ in range(12)]
        if i < without:
            hashes[3:] = [None] * 9
        rows.append((f"i{i:03d}", i, rng.choice([1.0, 1.5, 0.66]), rng.random(), *hashes))
    names = [f"{h}{t}" for t in TURNS for h in "adp"]
    return rows, spark.createDataFrame(rows, "id string, ord int, aspect double, luminance double, " + ", ".join(f"{c} long" for c in names))


@pytest.mark.parametrize("without", [0, 12])
def test_pair_join_and_best_partners_against_loops(spark, without):
    s = MODES["balanced"].but(top_k=3)
    rows, df = random_records(spark, 40, without=without)
    bits = lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count()
    diff = lambda p, q: abs(p - q) / max(p, q)
    found, tops = {}, {i: [] for i in range(40)}
    for x, y in itertools.combinations(rows, 2):
        options = []
        for k, t in enumerate(TURNS):
            if y[4 + 3 * k] is None:
                continue
            a, d, p = (bits(x[4 + j], y[4 + 3 * k + j]) for j in range(3))
            asp = diff(x[2], y[2] if t in (0, 180) else 1 / y[2])
            options.append((p * 0.5 + d * 0.3 + a * 0.2 + asp * 20, t, a, d, p, asp))
        r, t, a, d, p, asp = min(options)
        lum, near = abs(x[3] - y[3]), min(a, d, p) <= 4
        ok = (asp <= 0.38 or near) and (lum <= 0.35 or near) and (near or (a <= 17) + (d <= 17) + (p <= 17) >= 2)
        if not ok and y[7] is None and diff(x[2], 1 / y[2]) <= 0.08 and lum <= 0.08 and min(a, d, p) <= 32 and (a + d + p) / 3 <= 38:
            ok, t, asp = True, 90 if y[2] < x[2] else 270, diff(x[2], 1 / y[2])
        if ok:
            found[x[1], y[1]] = (t, a, d, p)
            for end in (x[1], y[1]):
                bucket = tops[end]
                bucket.append((r + lum * 10, x[1], y[1]))
                if len(bucket) > 3:
                    bucket.remove(next(b for b in bucket if b[0] == max(z[0] for z in bucket)))
    got = pairs.candidate_pairs(df, s, block_rows=7)
    assert {(r.source.ord, r.target.ord): (r.turn, r.a, r.d, r.p) for r in got.collect()} == found and len(found) > 20
    ranks = [r["rank"] for r in pairs.by_rank(got).collect()]
    assert ranks == sorted(ranks)
    best = {(r.source.ord, r.target.ord) for r in pairs.best_partners(got, 3).collect()}
    assert best == {b[1:] for bucket in tops.values() for b in bucket}


def test_narrower_modes_come_from_the_widest_join(spark):
    _, df = random_records(spark, 40, without=8)
    wide = pairs.candidate_pairs(df, MODES["sensitive"], block_rows=9).cache()
    for s in MODES.values():
        assert sorted(pairs.narrowed(wide, s).collect()) == sorted(pairs.candidate_pairs(df, s).collect())
    wide.unpersist()


def test_pairs_that_no_end_keeps_stay_in_their_group(spark, monkeypatch):
    monkeypatch.setattr(pairs, "MOST_WAITING", 30)  # thinned out again and again
    modes = [s.but(top_k=k) for s, k in zip(MODES.values(), (1, 2, 3))]
    for without in (0, 12):
        _, df = random_records(spark, 60, without=without)
        every = pairs.candidate_pairs(df, modes[-1]).cache()
        few = pairs.candidate_pairs(df, modes[-1], block_rows=9, kept=modes, part_rows=25).cache()
        assert few.count() < every.count()
        for s in modes:
            best = sorted(pairs.best_partners(pairs.narrowed(every, s), s.top_k).collect())
            assert sorted(pairs.best_partners(pairs.narrowed(few, s), s.top_k).collect()) == best == sorted(pairs.best_pairs(df, s).collect())
        every.unpersist(), few.unpersist()


def test_pairs_of_odd_records(spark):
    rows, df = random_records(spark, 6)
    alike = [("p", k, 1.0, 0.5, *([7] * 12)) for k in (0, 3, 10**12)]  # places far apart, equal ids
    odd = [("nan", 1, float("nan"), 0.5, *([7] * 12)), ("dark", 2, 1.0, None, *([7] * 12)), ("blank", 4, 1.0, 0.5, None, *([7] * 11)), ("nowhere", None, 1.0, 0.5, *([7] * 12)), ("flat", 5, 0.0, 0.5, *([7] * 12))]
    lone = [("half", 6, 1.0, 0.5, *([7] * 11), None)]  # lacks one turned hash: unturned only
    made = spark.createDataFrame(alike + odd + lone, ", ".join(f"{f.name} {'long' if f.name == 'ord' else f.dataType.simpleString()}" for f in df.schema))
    got = {(r.source.ord, r.target.ord, r.turn) for r in pairs.candidate_pairs(made, MODES["strict"], block_rows=2).collect()}
    between = {(0, 3, 0), (0, 6, 0), (0, 10**12, 0), (3, 6, 0), (3, 10**12, 0), (6, 10**12, 0)}
    flat = {(0, 5, 0), (3, 5, 0), (5, 6, 0), (5, 10**12, 0)}  # equal hashes let any known aspect through
    assert got == between | flat
    assert pairs.candidate_pairs(made.limit(0), MODES["strict"]).count() == 0


def edge_rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i, (a, b) in enumerate(itertools.combinations(range(n), 2)):
        if rng.random() < 0.45:
            a, b = (a, b) if rng.random() < 0.5 else (b, a)
            score = rng.choice([70, 80, 90])
            kind = "almost-certain-duplicate" if score == 90 else rng.choice(["probable-duplicate", "needs-review", "probably-different"])
            out.append((f"e{i:03d}", f"n{a:02d}", f"n{b:02d}", score >= 80 and kind != "needs-review", score, kind))
    return out


def brute_groups(edges, sizes):
    rank = {"almost-certain-duplicate": 4, "probable-duplicate": 3, "needs-review": 2, "probably-different": 1}
    order = lambda e: (not e[3], -e[4], -rank[e[5]], e[0])
    relevant = sorted((e for e in edges if e[5] != "probably-different"), key=order)
    strong = {frozenset(e[1:3]) for e in relevant if e[3]}
    cluster = {n: frozenset([n]) for n in sizes}
    for e in (e for e in relevant if e[3]):
        x, y = cluster[e[1]], cluster[e[2]]
        if x != y and all(frozenset((p, q)) in strong for p in x for q in y):
            for n in x | y:
                cluster[n] = x | y
    drafts = []

    def reference(ids, own):
        total = lambda n: sum(e[4] for e in own if n in e[1:3])
        return min(ids, key=lambda n: (-total(n), -sizes[n][0] * sizes[n][1], -sizes[n][2], n))

    held = set()
    for c in sorted({c for c in cluster.values() if len(c) > 1}, key=min):
        own = [e for e in relevant if e[1] in c and e[2] in c]
        held |= {e[0] for e in own}
        ref = reference(c, own)
        drafts.append((ref, [ref, *sorted(c - {ref})], [], sorted(e[0] for e in own)))
    for e in relevant:
        if e[0] not in held:
            ref = reference(e[1:3], [e])
            drafts.append((ref, [ref], [e[2] if ref == e[1] else e[1]], [e[0]]))
    drafts.sort(key=lambda d: d[0])
    return [(f"group-{i + 1}", *d) for i, d in enumerate(drafts)]


@pytest.mark.parametrize(("seed", "finish"), [(1, 100_000), (2, 6)])
def test_groups_against_a_plain_model(spark, monkeypatch, seed, finish):
    monkeypatch.setattr(clusters, "FINISH_PAIRS", finish)
    edges = edge_rows(12, seed)
    rng = random.Random(seed)
    sizes = {f"n{i:02d}": (rng.choice([10, 20]), 10, rng.choice([1, 2])) for i in range(12)}
    want = brute_groups(edges, sizes)
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "id string, source_id string, target_id string, strong boolean, score int, category string")
    pics = spark.createDataFrame([(n, *s) for n, s in sizes.items()], "id string, width int, height int, size int")
    got = clusters.duplicate_groups(df, pics).collect()
    key = lambda g: int(g[0].split("-")[1])
    assert sorted(((g.id, g.reference_id, g.member_ids, g.uncertain_ids, g.edge_ids) for g in got), key=key) == want


@pytest.mark.parametrize(("seed", "nodes", "share", "finish"), [(1, 11, 0.6, 0), (3, 40, 0.1, 8)])
def test_rounds_merge_as_the_ordered_process(spark, monkeypatch, seed, nodes, share, finish):
    """Random graphs with many equal scores, merged in rounds and edge by edge."""
    monkeypatch.setattr(clusters, "FINISH_PAIRS", finish)
    rng = random.Random(seed)
    edges = [(f"n{a:02d}::n{b:02d}", f"n{a:02d}", f"n{b:02d}", True, rng.randint(84, 90), rng.choice(["almost-certain-duplicate", "probable-duplicate"])) for a in range(nodes) for b in range(a + 1, nodes) if rng.random() < share]
    linked = {frozenset(e[1:3]) for e in edges}
    cluster = {n: frozenset([n]) for e in edges for n in e[1:3]}
    for e in sorted(edges, key=lambda e: (-e[4], e[5] != "almost-certain-duplicate", e[0])):
        x, y = cluster[e[1]], cluster[e[2]]
        if x != y and all(frozenset((p, q)) in linked for p in x for q in y):
            cluster.update(dict.fromkeys(x | y, x | y))
    got = {r.image: r.core for r in clusters.complete_link(spark.createDataFrame(edges, "id string, source_id string, target_id string, strong boolean, score int, category string")).collect()}
    assert got == {n: min(c) for n, c in cluster.items() if len(c) > 1}


def test_a_part_where_all_are_linked_is_one_core_at_once(spark, monkeypatch):
    monkeypatch.setattr(clusters, "FINISH_PAIRS", 0)
    edges = [(f"{a:03d}::{b:03d}", f"{a:03d}", f"{b:03d}", True, 90, "probable-duplicate") for a in range(120) for b in range(a + 1, 120)]
    got = clusters.complete_link(spark.createDataFrame(edges, "id string, source_id string, target_id string, strong boolean, score int, category string")).collect()
    assert len(got) == 120 and {r.core for r in got} == {"000"}


def test_groups_are_numbered_in_each_archive(spark):
    rows = [(f"{z}{i}::{z}{i + 1}", f"{z}{i}", f"{z}{i + 1}", True, 90 + i, "probable-duplicate", z) for z in "pq" for i in (0, 2, 4)]
    pics = spark.createDataFrame([(f"{z}{i}", 1, 1, 1) for z in "pq" for i in range(6)], "id string, width int, height int, size int")
    got = clusters.duplicate_groups(spark.createDataFrame(rows, "id string, source_id string, target_id string, strong boolean, score int, category string, archive string"), pics).collect()
    by = {}
    for g in got:
        by.setdefault(g.reference_id[0], []).append((g.reference_id, g.id[8:]))
    assert {z: sorted(v) for z, v in by.items()} == {z: [(f"{z}0", "-group-1"), (f"{z}2", "-group-2"), (f"{z}4", "-group-3")] for z in "pq"} and len({g.id for g in got}) == 6


def test_chain_is_no_core(spark):
    df = spark.createDataFrame([("ab", "a", "b", True, 95, "almost-certain-duplicate"), ("bc", "b", "c", True, 90, "almost-certain-duplicate"), ("aa", "a", "a", True, 99, "probable-duplicate"), ("ax", "a", "x", True, 99, "probable-duplicate")], "id string, source_id string, target_id string, strong boolean, score int, category string")
    pics = spark.createDataFrame([(n, 1, 1, 1) for n in "abc"], "id string, width int, height int, size int")
    groups = clusters.duplicate_groups(df, pics).collect()
    assert sorted((sorted(g.member_ids), g.uncertain_ids) for g in groups) == [(["a", "b"], []), (["b"], ["c"])]
    assert clusters.duplicate_groups(df.where("false"), pics).count() == 0


@pytest.mark.parametrize("finish", [100_000, 20, 0])
def test_components(spark, monkeypatch, finish):
    monkeypatch.setattr(graph, "FINISH_EDGES", finish)
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = {n: find(n) for e in edges if e[0] != e[1] for n in e}
    assert {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def entries_frame(spark, rows):
    return spark.createDataFrame([("z", i, *r) for i, r in enumerate(rows)], "archive string, index int, filename string, directory boolean, compressed_size long, uncompressed_size long, encrypted boolean")


@pytest.mark.parametrize(
    ("rows", "limits", "code", "at"),
    [
        ([("a.png", False, 10, 10, False)], Limits(), None, None),
        ([("a.png", False, -1, 10, False)], Limits(), "invalid-zip", 0),
        ([("ok.png", False, 1, 1, False), ("../a.png", False, 1, 1, False)], Limits(), "unsafe-path", 1),
        ([("A/x.png", False, 1, 1, False), ("a\\X.PNG", False, 1, 1, False)], Limits(), "duplicate-path", 1),
        ([("x.txt", False, 1, 60, False), ("a.png", False, 1, 60, False)], Limits(total_bytes=100), "archive-too-large", 1),
        ([("a.png", False, 1, 1, True)], Limits(), "encrypted-zip", 0),
        ([("a.png", False, 0, 1, False)], Limits(), "compression-ratio", 0),
        ([("a.png", False, 1, 100, False), ("b.png", False, 1, 101, False)], Limits(), "compression-ratio", 1),
        ([("__MACOSX/a.zip", False, 1, 1, False)], Limits(), "nested-zip", 0),
        ([("a.png", False, 9, 11, False)], Limits(image_bytes=10), "entry-too-large", 0),
        ([(f"{i}.png", False, 1, 1, False) for i in range(3)], Limits(images=2), "too-many-images", 2),
        ([(f"{i}.png", False, 1, 1, False) for i in range(3)], Limits(entries=2), "too-many-entries", None),
    ],
)
def test_entry_checks(spark, rows, limits, code, at):
    r = validate.inspect(validate.check_entries(entries_frame(spark, rows), limits, unicode=False), limits).first()
    assert (r.code, r.at_index) == (code, at)


def test_entry_counts(spark):
    rows = [("d/", True, 0, 0, False), ("d/a.JPG", False, 5, 10, False), ("d/b.png", False, 5, 20, False), ("leer.png", False, 0, 0, False), (".DS_Store", False, 1, 6, False), ("x.txt", False, 1, 7, False), ("c.jpg", False, 1, 1, None)]
    r = validate.inspect(validate.check_entries(entries_frame(spark, rows), unicode=False)).first()
    assert (r.code, r.total_entries, r.supported_images, r.skipped_entries, r.total_bytes, r.formats, len(r.warnings)) == (None, 6, 3, 3, 44, ["jpeg", "png"], 3)


def test_archives_to_reports(spark, zips, tmp_path):
    files, told = archive.archives(spark, zips), []
    progress = Progress(spark, lambda phase, percent: told.append((phase, percent)))
    found = analyse(files, progress=progress)
    starts, percents = [1, 10, 61, 94, 98, 100], [t[1] for t in told]
    assert percents == sorted(set(percents)) and set(starts) <= set(percents) and set(progress.timings) == {t[0] for t in told} - {"completed"} and all(v >= 0 for v in progress.timings.values())
    assert set(progress.worker_seconds) == {"pictures", "pairs"} and all(v > 0 for v in progress.worker_seconds.values())
    progress.cancel()
    with pytest.raises(Cancelled):
        analyse(files, progress=progress)
    errors = {(r.archive.rsplit("/", 1)[1], r.path): (r.code, r.fatal) for r in found.errors.collect()}
    assert errors == {("a.zip", "baustelle/beschaedigt.jpg"): ("format-mismatch", False), ("a.zip", "baustelle/kaputt.png"): ("unsupported-image", False), ("disguised.zip", "bad.png"): ("nested-zip", True), ("broken.zip", None): ("invalid-zip", True)}
    names = {r.id: r.name for r in found.images.collect()}
    assert sorted(names.values()) == ["heller.png", "hochkant.png", "karos.png", "klein.png", "kopie.png", "original.png"]
    edges = {frozenset((names[r.source_id], names[r.target_id])): r for r in found.edges.collect()}
    assert edges[frozenset(("original.png", "kopie.png"))].score == 100 and edges[frozenset(("original.png", "hochkant.png"))].turn in (90, 270)
    group = found.groups.first()
    assert found.groups.count() == 1 and len(group.member_ids) == 5 and all(e.strong for e in edges.values())
    resolved = found.resolved().cache()
    lines = [r.text for r in reports.comparison_report(resolved, found.images).collect()]
    assert len(lines) == 5 and lines[0].startswith("Gruppen-ID;Status") and all(line.count(";") == 42 for line in lines)
    assert reports.framed(lines).startswith("﻿Gruppen-ID") and reports.framed(lines).endswith("\r\n")
    assert {len(r.text.split(",")) for r in reports.comparison_report(resolved, found.images, delimiter=",", exact_gps=True).collect()} >= {47}
    reports.write_csv(reports.comparison_report(resolved, found.images), str(tmp_path / "csv"))
    text = b"".join(f.read_bytes() for f in sorted((tmp_path / "csv").glob("part-*"))).decode()
    assert text.startswith("﻿Gruppen-ID") and text.count("\r\n") == 5
    cleaned = results.cleaned_files(found.images, found.groups, resolved).collect()
    assert [r.category for r in cleaned].count("ungeklärt") == 4 and [r.path for r in cleaned] == sorted(r.path for r in cleaned)
    hits = results.search(found.images, resolved, text=" KOPIE ", facet="almost-certain-duplicate", tier="strong").collect()
    assert [h.group_id for h in hits] == ["group-1"] and hits[0].best_score == 100
    assert results.search(found.images, resolved, text="nirgends").count() == 0
    assert results.shown_tier(comparisons.presented(resolved), "low-priority") == "strong"
    decided = found.images.withColumn("decision", F.when(F.col("name") == "kopie.png", "duplicate").otherwise(F.col("decision")))
    again = comparisons.with_decisions(comparisons.resolve(found.groups, found.edges), decided, spark.createDataFrame([], "edge_id string, decision string"))
    assert [r.category for r in results.cleaned_files(decided, found.groups, again).collect() if r.name == "kopie.png"] == ["bestätigtes-duplikat"]
    one = archive.read_one(files, "./baustelle//a/kopie.png").where(F.col("archive").endswith("a.zip")).collect()
    assert len(one) == 1 and one[0].content[:4] == b"\x89PNG"
    document = reports.json_document(spark.range(1).select(F.lit("a.zip").alias("name")), found.images, found.edges, found.groups, resolved, found.errors, "2026-01-01T00:00:00Z")
    reports.write_json(document, str(tmp_path / "json"))
    text = json.loads(b"".join(f.read_bytes() for f in sorted((tmp_path / "json").glob("part-*"))))
    assert [i["id"] for i in text["images"]] == sorted(names) and list(text)[-5:] == ["images", "edges", "groups", "comparisons", "errors"]
    assert text["exportVersion"] == 4 and all("gray" not in i and "aspect" in i for i in text["images"]) and len(text["comparisons"]) == 4 and set(text["groups"][0]) == {"id", "referenceId", "memberIds", "uncertainIds", "edgeIds", "status"}
    assert set(text["comparisons"][0]) >= {"groupId", "groupReferenceId", "comparisonBaseId", "candidateId", "edgeId", "directToReference", "effectiveCandidateRotationDegrees", "candidateKind", "presentationTier", "decision"}


def test_documents_written_by_ranges(spark, tmp_path):
    lines = spark.range(5000).select(F.col("id").alias("g"), F.concat(F.lit("Zeile "), F.col("id").cast("string")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges, however small
    try:
        reports.write_csv(lines.union(lines.limit(10)).repartition(7), str(tmp_path / "csv"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "csv").glob("part-*"))
    text = b"".join(f.read_bytes() for f in files).decode()
    want = sorted([*range(5000), *range(10)])  # equal lines stay
    assert text == "\ufeff" + "".join(f"Zeile {i}\r\n" for i in want) and len(files) > 1
    back = reports.read_parts(spark, str(tmp_path / "csv")).orderBy("nth").collect()
    assert [r.nth for r in back] == list(range(1, 5011)) and back[0].text == "\ufeffZeile 0\r" and back[-1].text == "Zeile 4999\r"


@pytest.mark.parametrize("there", [(0, 0, 0, 0, 0), (3, 3, 3, 3, 3), (3, 0, 0, 3, 0), (0, 3, 0, 0, 3), (0, 0, 3, 0, 0)])
def test_json_documents_with_empty_parts(spark, there):
    rows = [(0, "head", "", 0, 0, "", '{"a":1}')] + [(i, k, "", 9 - j, 0, "", json.dumps({"n": 9 - j, "t": 'x"\n'})) for i, (k, n) in enumerate(zip(reports.KINDS[1:], there), 1) for j in range(n)]
    document = spark.createDataFrame(rows, "part int, kind string, book string, place long, step long, key string, json string")
    text = json.loads("\n".join(r.text for r in reports.json_lines(document).orderBy("nth").collect()))
    assert text == {"a": 1} | {k: [{"n": i, "t": 'x"\n'} for i in (7, 8, 9)[: n]] for k, n in zip(reports.KINDS[1:], there)}
    if not any(there):
        with pytest.raises(ValueError):
            reports.json_lines(document.limit(0))


def test_store_and_stream(spark, zips, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.get("groups") is None
    for _ in range(2):  # the second run finds nothing new
        watch(spark, zips, store, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert store.get("analyses").count() == 3 and store.get("groups").count() == 1
    mark = store.get("analyses").where("name = 'a.zip'").first()
    assert store.resume(mark.fingerprint, "a.zip", mark["size"]) is not None and store.resume(mark.fingerprint, "b.zip", mark["size"]) is None
    store.delete(mark.fingerprint)
    assert store.get("analyses").count() == 2
    store.clear()
    assert not store.exists("analyses")


def test_updates(spark):
    groups = spark.createDataFrame([("group-1", "a", ["a", "b"], ["c"], ["a::b", "a::c"], "unreviewed")], "id string, reference_id string, member_ids array<string>, uncertain_ids array<string>, edge_ids array<string>, status string")
    g = results.set_reference(groups, "group-1", "c").first()
    assert (g.reference_id, g.member_ids, g.uncertain_ids) == ("c", ["a", "b", "c"], [])
    g = results.remove_image(groups, "group-1", "b").first()
    assert (g.member_ids, g.edge_ids) == (["a"], ["a::c"])
    edges = spark.createDataFrame([("a::b", "a", "b", True, 95, "almost-certain-duplicate", 90, "neutral"), ("a::c", "a", "c", False, 70, "needs-review", 0, "conflicts")], "id string, source_id string, target_id string, strong boolean, score int, category string, turn int, s string").withColumn("metadata", F.struct(F.col("s").alias("status")))
    resolved = comparisons.resolve(groups, edges)
    r = {x.candidate_id: x for x in resolved.collect()}
    assert (r["b"].tier, r["b"].turn, r["b"].direct) == ("strong", 90, True) and (r["c"].tier, r["c"].kind) == ("low-priority", "manual-review")
    assert [tuple(x) for x in comparisons.safe_candidates(groups, edges).collect()] == [("group-1", "b")]
    log = results.decide(resolved, [("group-1", "b"), ("group-1", "c")], "duplicate")
    assert log.count() == 2 and log.where("edge_id = 'a::c'").count() == 1
    stamped = log.unionByName(results.decide(resolved, [("group-1", "c")], "different")).withColumns({"at": F.current_timestamp(), "seq": F.monotonically_increasing_id()})
    latest = results.current_decisions(stamped, "edge_id")
    images = spark.createDataFrame([(n, "duplicate" if n == "b" else "unreviewed") for n in "abc"], "id string, decision string")
    decided = comparisons.with_decisions(resolved, images, latest)
    assert results.mark_reviewed(groups, decided, "group-1").first().status == "reviewed"
    assert results.dissolve(groups, "group-1").count() == 0 and results.confirm_safe(groups, edges).count() == 1
    assert results.reset_status(groups.withColumn("status", F.lit("reviewed")), spark.createDataFrame([("group-1", "later")], "group_id string, decision string")).first().status == "unreviewed"


def test_a_batch_is_one_analysis_and_equals_a_full_run(spark, zips, tmp_path, monkeypatch):
    folder, runs = tmp_path / "zips", []
    folder.mkdir()
    source = Path(zips) / "a.zip"
    for n in ("one", "two"):
        shutil.copy2(source, folder / f"{n}.zip")
    real = incremental.analyse
    monkeypatch.setattr(incremental, "analyse", lambda files, *rest, **more: runs.append(files.count()) or real(files, *rest, **more))
    store = Store(spark, str(tmp_path / "store"))
    watch(spark, str(folder), store, str(tmp_path / "checkpoint")).awaitTermination(120)
    shutil.copy2(source, folder / "three.zip")
    watch(spark, str(folder), store, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert runs == [2, 1]
    full = analyse(archive.archives(spark, str(folder)))
    ids = lambda df: sorted(r.id for r in df.select("id").collect())
    for table in ("images", "edges", "groups"):
        assert ids(store.get(table)) == ids(getattr(full, table)) and len(ids(store.get(table))) % 3 == 0
    assert store.get("errors").count() == full.errors.count() and store.get("analyses").count() == 3
    mark = store.get("analyses").where("name = 'two.zip'").first().fingerprint
    assert {r.fingerprint for r in store.get("groups").where("archive like '%two.zip'").collect()} == {mark}
    assert incremental.analyse_new(archive.archives(spark, str(folder)), store) == 0
    store.remove("analyses", [mark])  # as if a run had broken before its last step
    assert incremental.analyse_new(archive.archives(spark, str(folder)), store) == 1 and ids(store.get("edges")) == ids(full.edges)


def test_incident_edges_grow_with_edges(spark):
    """A star of 40 images: 39 edges are 39 rows, not each candidate's with each edge."""
    ids = [f"i{n:02d}" for n in range(40)]
    groups = spark.createDataFrame([("group-1", ids[0], ids[:20], ids[20:], [f"e{n}" for n in range(1, 40)])], "id string, reference_id string, member_ids array<string>, uncertain_ids array<string>, edge_ids array<string>")
    edges = spark.createDataFrame([(f"e{n}", ids[0], ids[n], n % 2 == 0, n) for n in range(1, 40)] + [("x", ids[3], "out", True, 99)], "id string, source_id string, target_id string, strong boolean, score int")
    rows = comparisons.incident(groups, edges).select("candidate_id", "base_id", "edge_id").collect()
    assert sorted(map(tuple, rows)) == [(ids[n], ids[0], f"e{n}") for n in range(1, 40)]


def test_parts_are_read_by_blocks(spark, tmp_path):
    """One part of many blocks: as many tasks as blocks, every line in its place, the mark at its start only where there was one."""
    lines = spark.range(20_000, numPartitions=1).select(F.format_string("%08d", "id").alias("text"))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    for mark, name in ((True, "with"), (False, "without")):
        reports.write_csv(lines, str(tmp_path / name), mark)
        (tmp_path / name / "one").mkdir()
        parts = sorted((tmp_path / name).glob("part-*"))
        (tmp_path / name / "one" / "part-0").write_bytes(b"".join(p.read_bytes() for p in parts))
        spark.conf.set(key, "20000")
        try:
            back = reports.read_parts(spark, str(tmp_path / name / "one")).withColumn("task", F.spark_partition_id()).collect()
        finally:
            spark.conf.set(key, before)
        assert len({r.task for r in back}) > 5
        want = [f"{n:08d}\r" for n in range(20_000)]
        assert [(r.nth, r.text) for r in sorted(back, key=lambda r: r.nth)] == [*enumerate(["\ufeff" * mark + want[0], *want[1:]], 1)]


def test_file_lists_are_ordered_once_by_a_key_that_is_a_column(spark):
    """A regular expression within an order is made again at each comparison of two rows."""
    images, _, groups, resolved = catalog_review.review(spark, "/root/testdata/sf0.001")
    for df in (results.cleaned_files(images, groups, resolved), catalog_review.cleaned_lines(spark, "/root/testdata/sf0.001")):
        sorts = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if line.lstrip(" :+-").startswith("Sort [")]
        assert len(sorts) == 1 and "regexp" not in sorts[0]


def test_a_comparison_report_orders_what_it_has_stored(spark):
    """What made the comparisons and joined their images holds no disk while lines are ordered; edges meet their groups' lists without copies of them."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    images, edges, groups, resolved = catalog_review.review(spark, "/root/testdata/sf0.001")
    assert "Join" not in plan(reports.comparison_report(resolved, images, exact_gps=True))
    rows = comparisons.incident(groups, edges)
    assert not any("edge_id" in line and "inside" in line for line in plan(rows).splitlines() if "Generate" in line and "edge_ids" in line)


def test_cells_of_each_kind(spark):
    odd = [None, "", "a", "-1", " =x", "\tx", "x\ty", "a;b", 'a"b', "a\nb", "=a;b", "\r"]
    rows = spark.createDataFrame([(x,) for x in odd], "c string").select(tables.cell(F.col("c"), True).alias("text"), tables.cell(F.col("c"), False).alias("plain")).collect()
    assert [r.text for r in rows] == ["", "", "a", "'-1", "' =x", "'\tx", "x\ty", '"a;b"', '"a""b"', '"a\nb"', '"\'=a;b"', '"\'\r"']
    assert [r.plain for r in rows] == ["", "", "a", "-1", " =x", "\tx", "x\ty", '"a;b"', '"a""b"', '"a\nb"', '"=a;b"', '"\r"']


def test_stand_in_archives_are_made_once(spark):
    made = standins.page_archives(spark.createDataFrame([(1, "a"), (70, None)], "page_id long, html string"))
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().optimizedPlan().toString() and made.count() == 2


def test_groups_and_their_reviews_build_no_table_on_the_driver(spark):
    """Growing tables meet in shuffles though these are small enough for a broadcast."""
    edges = spark.createDataFrame([(f"e{i}", f"v{i}", f"v{i + 1}", i % 2 == 0, 50 + i, "probable-duplicate", 0) for i in range(6)], "id string, source_id string, target_id string, strong boolean, score int, category string, turn int")
    pics = spark.createDataFrame([(f"v{i}", 8, 8, i) for i in range(7)], "id string, width int, height int, size int")
    groups = cut(clusters.duplicate_groups(edges, pics))
    ends = edges.select(F.col("id").alias("draft"), F.explode(F.array("source_id", "target_id")).alias("image"))
    for df in (clusters.best_edges(edges, pics), clusters.with_reference(ends, edges.withColumn("draft", F.col("id")), pics), comparisons.resolve(groups, edges)):
        assert df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
