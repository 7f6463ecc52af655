"""GIF, TIFF and capture metadata."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixkin.functions.kernels import area_resize
from pixkin.plans import standins
from pixkin.plans.analysis import analyse
from pixkin.sources import images, tiff
from pixkin.sources.images import thumbnails
from pixkin.sources.jpeg import decode_jpeg
from pixkin.sources.jpeg_writer import code_lengths, encode_jpeg
from pixkin.sources.store import Store


def tiff_file(order: str, tags: dict[int, tuple[int, list]], extra: dict[int, dict[int, tuple[int, list]]] | None = None, tail: bytes = b"") -> bytes:
    """Tags to a TIFF file; ``extra`` puts directories under pointer tags; ``tail`` follows at the offset that tag 273 gets."""
    code = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II"}

    def build(entries, at):
        body, late = struct.pack(order + "H", len(entries)), b""
        end = at + 2 + 12 * len(entries) + 4
        for tag, (kind, values) in sorted(entries.items()):
            raw = values if kind == 2 else b"".join(struct.pack(order + code[kind], *(v if isinstance(v, tuple) else (v,))) for v in values)
            n = len(raw) if kind == 2 else len(values)
            body += struct.pack(order + "HHI", tag, kind, n)
            if len(raw) <= 4:
                body += raw.ljust(4, b"\0")
            else:
                body += struct.pack(order + "I", end + len(late))
                late += raw + b"\0" * (len(raw) % 2)
        return body + b"\0\0\0\0" + late

    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    tags = dict(tags)
    for t in extra or {}:
        tags[t] = (4, [0])
    at = 8 + len(build(tags, 8))
    parts = b""
    for t, entries in (extra or {}).items():
        tags[t] = (4, [at + len(parts)])
        parts += build(entries, at + len(parts))
    if tail:
        tags[273] = (4, [at + len(parts)])
    return head + build(tags, 8) + parts + tail


META = {0x010F: (2, b"ACME\0"), 0x0110: (2, b"  X  1\0"), 0x0112: (3, [6])}
SUB = {
    0x8769: {0x9003: (2, b"2024:05:06 07:08:09\0"), 0x9011: (2, b"+02:00\0"), 0x9291: (2, b"5\0"), 0xA434: (2, b"Lens\0")},
    0x8825: {1: (2, b"S\0"), 2: (5, [(10, 1), (30, 1), (0, 1)]), 3: (2, b"E\0"), 4: (5, [(20, 1), (0, 1), (36, 1)]), 5: (1, [1]), 6: (5, [(25, 2)])},
}


@pytest.mark.parametrize("order", ["<", ">"])
def test_metadata(spark, order):
    block = tiff_file(order, META, SUB)
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block + b"\xff\xd9"
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", len(block)) + b"eXIf" + block + b"\0\0\0\0"
    bad = jpeg.replace(b"\x87\x69" if order == ">" else b"\x69\x87", b"\x87\x69" if order == ">" else b"\x69\x87")[:60]
    df = spark.createDataFrame([(0, jpeg), (1, png), (2, block), (3, b"GIF89a"), (4, None), (5, bad)], "i int, content binary")
    got = {r.i: r.metadata for r in tiff.capture_metadata(df).collect()}
    for i in range(3):
        m = got[i]
        assert (m.make, m.model, m.lens, m.orientation, m.zoned, m.altitude, m.warnings) == ("ACME", "X 1", "Lens", 6, True, -12.5, [])
        assert m.latitude == -10.5 and m.longitude == pytest.approx(20.01) and m["at"].isoformat() == "2024-05-06T05:08:09.500000"
    assert got[3].make is None and got[4].make is None and got[4].warnings == [] and got[5].warnings


@pytest.mark.parametrize(("packing", "pack"), [(1, bytes), (8, lambda b: __import__("zlib").compress(b)), (32773, lambda b: b"".join(bytes([0, x]) for x in b))])
def test_tiff_pictures(packing, pack):
    a = np.random.default_rng(1).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    data = pack(a.tobytes())
    tags = {256: (3, [7]), 257: (3, [5]), 258: (3, [8, 8, 8]), 259: (3, [packing]), 262: (3, [2]), 273: (4, [0]), 277: (3, [3]), 278: (3, [5]), 279: (4, [len(data)])}
    assert (images.DECODERS["tiff"](tiff_file("<", tags, tail=data))[..., :3] == a).all()
    turned = images.DECODERS["tiff"](tiff_file("<", tags | {0x0112: (3, [6])}, tail=data))
    assert (turned[..., :3] == np.rot90(a, -1)).all()


def gif_file(a: np.ndarray, interlaced=False) -> bytes:
    """Nine-bit codes with a reset before they would grow."""
    h, w = a.shape
    rows = np.concatenate([np.arange(s, h, t) for s, t in ((0, 8), (4, 8), (2, 4), (1, 2))]) if interlaced else np.arange(h)
    codes = []
    for i, p in enumerate(a[rows].ravel().tolist()):
        codes += [256, p] if i % 200 == 0 else [p]
    held = n = 0
    body = bytearray()
    for c in [*codes, 257]:
        held, n = held | c << n, n + 9
        while n >= 8:
            body.append(held & 255)
            held, n = held >> 8, n - 8
    body.append(held)
    table = bytes(x for i in range(256) for x in (i, 255 - i, i // 2))
    blocks = b"".join(bytes([len(body[i : i + 255])]) + body[i : i + 255] for i in range(0, len(body), 255))
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0xF7, 0, 0) + table + b"\x21\xf9\x04\x01\0\0\x07\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 64 * interlaced) + b"\x08" + blocks + b"\0\x3b"


@pytest.mark.parametrize("interlaced", [False, True])
def test_gif_pictures(interlaced):
    a = np.random.default_rng(2).integers(0, 256, (21, 33)).astype(np.uint8)
    got = images.decode_gif(gif_file(a, interlaced))
    clear = a == 7
    assert (got[..., 0][~clear] == a[~clear]).all() and (got[..., 1][~clear] == 255 - a[~clear]).all() and (got[..., 3] == np.where(clear, 0, 255)).all()


def test_lzw_with_growing_codes():
    """A plain compressor whose table grows through all widths."""
    data = bytes(np.random.default_rng(3).integers(0, 4, 9000).astype(np.uint8))
    table, width, out, n, held, word = {bytes([i]): i for i in range(4)}, 3, bytearray(), 0, 0, b""

    def put(code, width):
        nonlocal held, n
        held, n = held | code << n, n + width
        while n >= 8:
            out.append(held & 255)
            held, n = held >> 8, n - 8

    put(4, 3)
    following = 6
    for byte in data:
        longer = word + bytes([byte])
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        if following < 4096:
            table[longer] = following
            following += 1
            if following > 1 << width and width < 12:
                width += 1
        word = bytes([byte])
    put(table[word], width)
    put(5, width)
    out.append(held)
    assert images.unpacked_codes(bytes(out), 2, len(data)) == data


@pytest.mark.parametrize(("w", "h"), [(1, 1), (7, 3), (33, 21), (5, 40)])
def test_png_with_all_filters(w, h):
    a = np.random.default_rng(w).integers(0, 256, (h, w, 3)).astype(np.uint8)
    assert (images.decode_png(standins.png_file(a))[..., :3] == a).all()
    with pytest.raises(ValueError):
        images.decode_png(standins.png_file(a)[:-20])


def jpeg_file(levels: np.ndarray) -> bytes:
    """A grey baseline file of one level a block: codes of four bits for the sizes of DC differences, and the end of each block."""
    bits, before = [], 0
    for level in ((levels.astype(int) - 128) * 8).ravel():
        v, before = int(level) - before, int(level)
        n = abs(v).bit_length()
        bits += [n >> k & 1 for k in (3, 2, 1, 0)] + [(v if v >= 0 else v + (1 << n) - 1) >> k & 1 for k in range(n - 1, -1, -1)] + [0]
    bits += [1] * (-len(bits) % 8)
    marker = lambda kind, body: bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body
    table = lambda key, width, symbols: bytes([key]) + bytes(len(symbols) if n == width else 0 for n in range(1, 17)) + bytes(symbols)
    h, w = levels.shape
    frame = bytes([8]) + (8 * h).to_bytes(2, "big") + (8 * w).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    data = np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\0")
    return b"\xff\xd8" + marker(0xDB, b"\0" + b"\1" * 64) + marker(0xC4, table(0, 4, list(range(12))) + table(0x10, 1, [0])) + marker(0xC0, frame) + marker(0xDA, bytes([1, 1, 0, 0, 63, 0])) + data + b"\xff\xd9"


def test_a_jpeg_original_and_its_png_copy(spark):
    """They are one picture to the engine, also where the JPEG is stored on its side."""
    levels = np.random.default_rng(5).integers(20, 230, (9, 12)).astype(np.uint8)
    pixels = levels.repeat(8, 0).repeat(8, 1)
    block = tiff_file(">", {0x0112: (3, [6])})
    side = jpeg_file(np.rot90(levels))
    side = side[:2] + b"\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block + side[2:]
    png = standins.png_file(np.repeat(pixels[:, :, None], 3, 2))
    files = standins.zipped([("a/original.jpg", jpeg_file(levels)), ("a/kopie.png", png), ("a/seite.jpg", side), ("a/kaputt.jpg", jpeg_file(levels)[:60])])
    df = spark.createDataFrame([("x.zip", len(files), files)], "path string, length long, content binary").withColumn("modificationTime", F.current_timestamp())
    found = analyse(df)
    names = {r.id: r.name for r in found.images.collect()}
    assert sorted(names.values()) == ["kopie.png", "original.jpg", "seite.jpg"] and [r.code for r in found.errors.collect()] == ["unsupported-image"]
    assert sorted(tuple(sorted((names[e.source_id], names[e.target_id]))) + (e.score, e.turn) for e in found.edges.collect()) == [("kopie.png", "original.jpg", 100, 0), ("kopie.png", "seite.jpg", 100, 0), ("original.jpg", "seite.jpg", 100, 0)]


def test_variants_are_withheld_where_the_turn_is_unknown():
    data = standins.png_file(np.random.default_rng(1).integers(0, 256, (6, 9, 3)).astype(np.uint8))
    assert [len(images.features_of("png", data, turn, upright=upright)["variants"]) for turn, upright in ((6, True), (6, False), (1, False), (None, False))] == [4, 1, 4, 4]


def test_keyed_rows(spark, tmp_path):
    from pixkin.sources.store import Store

    store = Store(spark, str(tmp_path / "keyed"))
    log = store.keyed("decisions")
    rows = lambda *r: spark.createDataFrame(r, "fingerprint string, key string, decision string")
    assert log.get() is None and not store.agreed()
    log.compact()
    log.put(rows(("f", "a", "later"), ("f", "b", "later"), ("g", "a", "different"), (None, "x", "later"), ("f", None, "later")))
    log.put(rows(("f", "a", "duplicate")))
    seen = lambda **k: sorted(tuple(r)[:3] for r in log.get(**k).select("fingerprint", "key", "decision").collect())
    want = [("f", "a", "duplicate"), ("f", "b", "later"), ("g", "a", "different")]
    assert seen() == want and seen(fingerprint="f", key="a") == want[:1] and seen(key="a") == [want[0], want[2]]
    log.delete(rows(("f", "b", ""), ("h", "none", "")))
    assert seen() == [want[0], want[2]]
    log.compact()
    assert seen() == [want[0], want[2]] and len(log.folders()) == 1 and len(list((tmp_path / "keyed/keyed/decisions").iterdir())) == 1
    (tmp_path / "keyed/keyed/decisions/put-000000000099").mkdir()  # a job that never committed
    log.put(rows(("f", "b", "different")).withColumn("note", F.lit("new column")))
    assert seen() == [want[0], ("f", "b", "different"), want[2]] and log.get(key="b").first().note == "new column"
    assert not store.keyed("thumbnails").put(rows(("f", "t", "x"))) and store.keyed("thumbnails").get() is None
    store.agree(True)
    assert store.keyed("thumbnails").put(rows(("f", "t", "x"))) and store.keyed("thumbnails").get("f", "t").count() == 1
    store.agree(False)
    assert not store.keyed("thumbnails").put(rows(("f", "u", "x"))) and store.keyed("thumbnails").get().count() == 1


def zip_folder(folder):
    import zipfile

    rng = __import__("random").Random(4)
    for z in range(3):
        with zipfile.ZipFile(folder / f"a{z}.zip", "w") as out:
            for i in range(20):
                out.writestr(zipfile.ZipInfo(f"dir/ä{i}.png", (2024, 1, 2, 3, 4, 6)), b"\x89PNG\r\n\x1a\n" + rng.randbytes(400 + i * 40) * 2, zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED)
            out.writestr("dir/", b"")
            out.writestr("notes.txt", b"no picture")
            out.comment = b"a comment" * z
    (folder / "broken.zip").write_bytes(b"no archive at all")
    (folder / "empty.zip").write_bytes(b"")
    data = bytearray((folder / "a1.zip").read_bytes())
    at = data.find(b"dir/\xc3\xa42.png") + 20
    data[at + 10] ^= 255
    (folder / "a1.zip").write_bytes(b"something before" + bytes(data))  # moved, and one entry spoiled


def test_ranges_give_what_whole_archives_give(spark, tmp_path):
    from pixkin.sources import archive

    zip_folder(tmp_path)
    light, whole = archive.archives(spark, str(tmp_path)), archive.archives(spark, str(tmp_path), content=True)
    assert light.columns == ["path", "modificationTime", "length"]
    shown = lambda df: sorted(map(str, df.collect()))
    names = ["archive", "index", "filename", "directory", "compressed_size", "uncompressed_size", "encrypted", "last_modified"]
    assert shown(archive.read_entries(light).where("error is null").select(*names)) == shown(archive.read_entries(whole).where("error is null").select(*names))
    assert archive.read_entries(light).where("error is not null").count() == archive.read_entries(whole).where("error is not null").count() == 1  # Spark lists no empty files
    (images, errors), (images2, errors2) = archive.read_images(light), archive.read_images(whole)
    assert shown(images) == shown(images2.select(*images.columns)) and shown(errors) == shown(errors2.select(*errors.columns)) and images.count() == 59
    assert errors.where("code = 'corrupt-entry'").count() == 1
    assert shown(archive.identity(light)) == shown(archive.identity(whole)) and shown(archive.identity(light, 100)) == shown(archive.identity(whole, 100))
    assert shown(archive.read_one(light, "dir//\u00e43.png")) == shown(archive.read_one(whole, "dir//\u00e43.png")) and archive.read_one(light, "dir/ä3.png").count() == 3


def test_an_end_mark_in_a_comment_is_none():
    import io
    import zipfile

    from pixkin.sources import ranged

    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as out:
        out.writestr("a.txt", b"text")
        out.comment = b"a comment with PK\5\6 and more of it than a record holds"
    data = made.getvalue()
    assert [e.filename for e in ranged.entries(lambda at, n: data[at : at + n], len(data))] == ["a.txt"]


def test_lookup_by_the_source_reads_two_ranges(spark, tmp_path, monkeypatch):
    from pixkin.sources import ranged

    zip_folder(tmp_path)
    spark.dataSource.register(ranged.ZipSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("zip").load(str(tmp_path / "a2.zip"))
    assert rows.count() == 21 and rows.where("filename = 'dir/ä5.png' and size > 0").select("index").collect()[0][0] == 5
    seen = []
    monkeypatch.setattr(ranged, "reader_of", lambda file: lambda at, n: seen.append(n) or file.read_at(n, at))
    reader = ranged.ZipReader(str(tmp_path / "a2.zip"))
    assert list(reader.pushFilters([ranged.EqualTo(("filename",), "dir/ä5.png")])) == []
    found = list(reader.read(reader.partitions()[0]))
    assert len(found) == 1 and found[0][4].startswith(b"\x89PNG") and len(seen) == 4  # end, directory, the entry's head and bytes


def test_directories_of_large_archives():
    """ZIP64: more entries than 16 bits count, sizes and places beyond 32 bits; the file is only described, not written."""
    from pixkin.sources import ranged

    far, n = 5 << 30, 70_000
    record = lambda i: ranged.ENTRY.pack(b"PK\1\2", 45, 45, 0x800, 0, 0, 33, 7, 0xFFFFFFFF, 0xFFFFFFFF, len(str(i)), 28, 0, 0, 0, 0, 0xFFFFFFFF) + str(i).encode() + ranged.struct.pack("<2H3Q", 1, 24, far + i, far + 1, i * far)
    data = b"".join(map(record, range(n)))
    start = n * far
    tail = data + ranged.END64.pack(b"PK\6\6", 44, 45, 45, 0, 0, n, n, len(data), start) + ranged.END64_PLACE.pack(b"PK\6\7", 0, start + len(data), 1) + ranged.END.pack(b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    found = list(ranged.entries(lambda at, k: tail[at - start : at - start + k], start + len(tail)))
    assert len(found) == n and found[9].offset == 9 * far and found[9].compressed_size == far + 1 and found[9].uncompressed_size == far + 9 and found[9].filename == "9"


def wedge(h, w):
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([x * 255 // w, y * 255 // h, (x + y) * 255 // (w + h)], -1).astype(np.uint8)


def halved_chroma(picture):
    """The picture with the mean chroma of each two by two pixels, by the definition of the colour space."""
    h, w = picture.shape[:2]
    x = np.pad(picture, ((0, h % 2), (0, w % 2), (0, 0)), mode="edge").astype(float)
    y = x @ [0.299, 0.587, 0.114]
    both = []
    for channel, scale in ((2, 1.772), (0, 1.402)):
        c = (x[..., channel] - y) / scale
        both.append(c.reshape(c.shape[0] // 2, 2, c.shape[1] // 2, 2).mean((1, 3)).repeat(2, 0).repeat(2, 1))
    cb, cr = both
    rgb = np.stack([y + 1.402 * cr, y - (0.114 * 1.772 * cb + 0.299 * 1.402 * cr) / 0.587, y + 1.772 * cb], -1)
    return np.clip(rgb, 0, 255)[:h, :w]


@pytest.mark.parametrize("shape", [(1, 1), (8, 8), (16, 16), (17, 33), (1, 40), (40, 1), (64, 100)])
def test_written_jpeg_files_are_read_again(shape):
    rng = np.random.default_rng(shape[1])
    sparse = np.zeros((*shape, 3), np.uint8)
    sparse[::7, ::5] = 255
    noise = rng.integers(0, 256, (*shape, 3)).astype(np.uint8)
    for picture in (wedge(*shape), np.full((*shape, 3), 77, np.uint8), noise, noise // 32 * 32, sparse):
        back = decode_jpeg(encode_jpeg(picture, 100))[..., :3].astype(float)  # divisors of one: what is lost is rounding
        assert back.shape == picture.shape and np.abs(back - halved_chroma(picture)).max() <= 5
        coarse = encode_jpeg(picture, 1)
        assert decode_jpeg(coarse).shape[:2] == shape and len(coarse) <= len(encode_jpeg(picture, 100))


def test_jpeg_writer_blends_with_white_and_refuses_odd_input():
    clear = np.zeros((8, 8, 4), np.uint8)
    assert (decode_jpeg(encode_jpeg(clear))[..., :3] == 255).all()
    for bad, quality in ((np.zeros((0, 3, 3), np.uint8), 78), (clear, 0), (clear, 101), (clear[..., 0], 78)):
        with pytest.raises(ValueError):
            encode_jpeg(bad, quality)


def test_prefix_codes_stay_within_sixteen_bits():
    weights = {i: 2**i for i in range(30)}  # would need 30 bits
    depth = code_lengths(weights)
    assert max(depth.values()) <= 16 and sum(2.0**-d for d in depth.values()) <= 1 and depth[-1] == max(depth.values())
    assert code_lengths({5: 9})[5] == 1


def test_thumbnails_fit_and_are_stored(spark, tmp_path):
    big, tall = wedge(300, 900), wedge(500, 100)
    rows = [("a", "jpeg", encode_jpeg(big, 95), 1), ("b", "jpeg", encode_jpeg(tall, 95), 6), ("c", "jpeg", b"\xff\xd8 broken", None), ("d", "heic", b"x", None), ("e", "jpeg", None, None)]
    made = {r.key: r for r in thumbnails(spark.createDataFrame(rows, "key string, format string, content binary, orientation int")).collect()}
    assert (made["a"].width, made["a"].height) == (360, 120) and (made["b"].width, made["b"].height) == (360, 72)
    small = decode_jpeg(bytes(made["a"].content))[..., :3].astype(int)
    assert np.abs(small - area_resize(big, 360, 120)).mean() < 3
    assert all(made[k].content is None and made[k].decode_error for k in "cde")
    store = Store(spark, str(tmp_path / "store"))
    store.agree(True)
    store.put_thumbnails(spark.createDataFrame([(k, bytes(made[k].content)) for k in "ab"], "key string, content binary"), "f")
    assert {(r.key, bytes(r.content)) for r in store.get("thumbnails", "f").collect()} == {(k, bytes(made[k].content)) for k in "ab"}


def lzw_packed(data: bytes) -> bytes:
    """The compressor's side, as the format describes it: a code widens after entry 511 (1023, 2047) is made, entry 4094 starts the table anew."""
    codes, table, run, width = [(256, 9)], {bytes([i]): i for i in range(256)}, b"", 9
    after = 258
    for byte in data:
        longer = run + bytes([byte])
        if longer in table:
            run = longer
            continue
        codes.append((table[run], width))
        table[longer], after, run = after, after + 1, bytes([byte])
        if after - 1 in (511, 1023, 2047):
            width += 1
        if after - 1 == 4094:
            codes.append((256, width))
            table, after, width = {bytes([i]): i for i in range(256)}, 258, 9
    if run:
        codes.append((table[run], width))
        width += after in (511, 1023, 2047)  # the reader makes an entry for the last run too
    bits = "".join(format(c, f"0{w}b") for c, w in [*codes, (257, width)])
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


@pytest.mark.parametrize("n", [0, 1, 255, 260, 3000, 20_000])
def test_lzw_codes_of_all_widths(n):
    rng = np.random.default_rng(n)
    for data in (rng.integers(0, 256, n).astype(np.uint8).tobytes(), rng.integers(0, 3, n).astype(np.uint8).tobytes(), b"a" * n):
        assert tiff.lzw_bytes(lzw_packed(data), n) == data and tiff.lzw_bytes(lzw_packed(data), n // 2) == data[: n // 2]
    with pytest.raises(ValueError):
        tiff.lzw_bytes(bytes.fromhex("807f") + b"\xff" * 20, 100)  # a code that the table lacks


def picture_tiff(order, picture, bits, kind, packing=1, tile=None, apart=False, differenced=False, more=None):
    """A TIFF file of samples (height x width x channels), the data before the directory."""
    h, w, channels = picture.shape
    pack = {1: bytes, 5: lzw_packed, 8: zlib.compress}[packing]
    wide, high = tile or (w, 5)
    segments = []
    for plane in (range(channels) if apart else [slice(None)]):
        part = picture[..., [plane] if apart else plane]
        for top in range(0, h, high):
            for left in range(0, w, wide):
                block = part[top : top + high, left : left + wide]
                if tile:
                    block = np.pad(block, ((0, high - block.shape[0]), (0, wide - block.shape[1]), (0, 0)))
                if differenced:
                    block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
                rows = block.reshape(len(block), -1)
                if bits < 8:
                    raw = np.packbits((rows[..., None] >> np.arange(bits)[::-1] & 1).reshape(len(rows), -1).astype(np.uint8), axis=1).tobytes()
                else:
                    raw = rows.astype(order + f"u{bits // 8}").tobytes()
                segments.append(pack(raw))
    places = [8 + sum(map(len, segments[:i])) for i in range(len(segments))]
    tags = {256: (4, [w]), 257: (4, [h]), 258: (3, [bits] * channels), 259: (3, [packing]), 262: (3, [kind]), 277: (3, [channels]), 284: (3, [2 if apart else 1]), 317: (3, [2 if differenced else 1])} | (more or {})
    tags |= {322: (4, [wide]), 323: (4, [high]), 324: (4, places), 325: (4, [len(s) for s in segments])} if tile else {278: (4, [high]), 273: (4, places), 279: (4, [len(s) for s in segments])}
    data = b"".join(segments)
    at = 8 + len(data)
    body, late = struct.pack(order + "H", len(tags)), b""
    for tag, (form, values) in sorted(tags.items()):
        raw = struct.pack(order + {3: "H", 4: "I"}[form] * len(values), *values)
        body += struct.pack(order + "HHI", tag, form, len(values))
        body += raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", at + 2 + 12 * len(tags) + 4 + len(late))
        late += raw if len(raw) > 4 else b""
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", at) + data + body + b"\0" * 4 + late


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("tile", [None, (16, 16)])
@pytest.mark.parametrize("packing", [1, 5, 8])
def test_tiff_depths_tiles_and_planes(order, tile, packing):
    rng = np.random.default_rng(7)
    read_picture = images.DECODERS["tiff"]
    for bits, channels, apart, differenced in [(8, 3, False, True), (8, 4, True, False), (16, 3, False, True), (16, 1, False, False), (16, 3, True, True), (8, 2, False, False)]:
        a = rng.integers(0, 1 << bits, (21, 37, channels)).astype(f"u{bits // 8}")
        back = read_picture(picture_tiff(order, a, bits, 2 if channels > 2 else 1, packing, tile, apart, differenced))
        want = (a >> (bits - 8)).astype(np.uint8)
        assert (back[..., :3] == (want[..., :3] if channels > 2 else want[..., :1])).all()
        assert (back[..., 3] == (want[..., -1] if channels in (2, 4) else 255)).all()
    for bits in (1, 2, 4):
        a = rng.integers(0, 1 << bits, (21, 37, 1)).astype(np.uint8)
        shade = a * (255 // ((1 << bits) - 1))
        assert (read_picture(picture_tiff(order, a, bits, 1, packing, tile))[..., :3] == shade).all()
        assert (read_picture(picture_tiff(order, a, bits, 0, packing, tile))[..., :3] == 255 - shade).all()
    a, table = rng.integers(0, 256, (21, 37, 1)).astype(np.uint8), rng.integers(0, 65536, (3, 256))
    back = read_picture(picture_tiff(order, a, 8, 3, packing, tile, more={320: (3, table.ravel().tolist())}))
    assert (back[..., :3] == (table >> 8).T[a[..., 0]]).all()


def test_tiff_pictures_that_are_refused():
    a = np.zeros((4, 4, 3), np.uint8)
    good = dict(order="<", picture=a, bits=8, kind=2)
    for change in ({"more": {259: (3, [7])}}, {"more": {258: (3, [8, 8, 16])}}, {"kind": 6}, {"more": {256: (4, [0])}}, {"more": {256: (4, [10**9]), 257: (4, [10**9])}}, {"more": {257: (4, [40])}}, {"more": {317: (3, [3])}}):
        with pytest.raises(ValueError):
            images.DECODERS["tiff"](picture_tiff(**(good | change)))
    with pytest.raises((ValueError, struct.error)):  # callers take both for a broken picture
        images.DECODERS["tiff"](picture_tiff(**good)[:20])
