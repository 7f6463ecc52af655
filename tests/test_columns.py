"""Column builders against values worked out by hand."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from pixkin.config import MODES, Limits, worker_count
from pixkin.functions import bits, context, exif, names, similarity, tables
from pixkin.operators import comparisons, results, validate


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_hex_and_hamming(spark):
    h = lambda t: bits.from_hex(F.lit(t))
    r = one(spark, a=bits.hamming(h("0123456789abcdef"), h("0123456789abcdee")), b=bits.hamming(h("A" * 16), h("5" * 16)), c=h("ffffffffffffffff"), d=h("xyz"), e=bits.to_hex(h("00FF00ff00ff00ff")))
    assert tuple(r) == (1, 64, -1, None, "00ff00ff00ff00ff")


def test_histogram_overlap(spark):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    r = one(
        spark,
        same=similarity.bhattacharyya(arr(1, 2, 1), arr(2, 4, 2)), apart=similarity.bhattacharyya(arr(1, 0, 0), arr(0, 0, 5)), zeros=similarity.bhattacharyya(arr(0, 0), arr(0, 0)),
        half=similarity.bhattacharyya(arr(0, 0), arr(1, 0)), bad=similarity.bhattacharyya(arr(1, -1), arr(1, 1)), unlike=similarity.bhattacharyya(arr(1), arr(1, 1)),
    )
    assert r.same == pytest.approx(1) and tuple(r)[1:] == (0.0, 1.0, 0.0, None, None)


def assessed(spark, mode, **metrics):
    s = MODES[mode]
    m = {n: F.lit(v) for n, v in metrics.items()}
    u = similarity.supports(m, s)
    score = similarity.score(m, s)
    kind = similarity.category(score, u, s)
    return one(spark, score=score, category=kind, confidence=similarity.confidence(kind, u, m), reasons=similarity.reasons(m, u, s))


def test_assessment_of_a_clear_duplicate(spark):
    r = assessed(spark, "balanced", p=2, d=2, a=1, ssim=0.97, histogram=0.94, aspect=0.01, resolution=0.5)
    assert r.score >= 94 and r.category == "almost-certain-duplicate" and r.confidence == "very-high"
    assert r.reasons[0] == "pHash-Abstand 2/64 liegt im Grenzwert (≤ 14)." and r.reasons[-1].startswith("Ausgeglichen-Modus") and len(r.reasons) == 6


@pytest.mark.parametrize(("mode", "kind"), [("strict", "probably-different"), ("balanced", "probable-duplicate"), ("sensitive", "probable-duplicate")])
def test_modes_differ(spark, mode, kind):
    assert assessed(spark, mode, p=12, d=12, a=12, ssim=0.85, histogram=0.7, aspect=0.04, resolution=0.5).category == kind


def test_high_score_without_support_stays_different(spark):
    r = assessed(spark, "balanced", p=17, d=21, a=14, ssim=0.74, histogram=0.79, aspect=0.01, resolution=0.9)
    assert r.score >= 60 and r.category == "probably-different"


def test_missing_evidence_has_no_weight(spark):
    r = assessed(spark, "balanced", p=0)
    assert r.score == 100 and r.category == "probably-different"
    assert one(spark, s=similarity.score({"p": F.lit(None).cast("int")}, MODES["balanced"])).s == 0


def test_gate(spark):
    s = MODES["balanced"]
    g = lambda *v: similarity.gate(*[F.lit(x) for x in v], s)
    r = one(spark, near=g(4, 60, 60, 0.9, 0.9), two=g(17, 17, 60, 0.38, 0.35), aspect=g(17, 17, 60, 0.39, 0.1), single=g(17, 18, 60, 0.0, 0.0), nan=g(0, 0, 0, float("nan"), 0.0), negative=g(0, 0, 0, -0.1, 0.0))
    assert tuple(r) == (True, True, False, False, False, False)


def test_haversine(spark):
    d = lambda *v: context.haversine(*[F.lit(float(x)) for x in v])
    r = one(spark, a=d(0, 0, 0, 0.001), b=d(0, 179.999, 0, -179.999), c=d(91, 0, 0, 0), poles=d(90, 0, -90, 0))
    assert r.a == pytest.approx(111.2, abs=0.1) and r.b == pytest.approx(222.4, abs=0.1) and r.c is None and r.poles == pytest.approx(math.pi * 6371008.8)


def side(lat=None, lon=None, at=None, zoned=None, make=None, model=None):
    return {"latitude": F.lit(lat).cast("double"), "longitude": F.lit(lon).cast("double"), "at": F.lit(at).cast("timestamp"), "zoned": F.lit(zoned).cast("boolean"), "make": F.lit(make).cast("string"), "model": F.lit(model).cast("string")}


def test_context_status(spark):
    a = side(50.0, 8.0, "2024-01-01 10:00:00", True, "ACME", "X 1")
    r = one(
        spark,
        same=context.context(a, side(50.0, 8.0001, "2024-01-01 10:00:01", True, "acme", "x  1")), far=context.context(a, side(51.0, 8.0, "2024-01-01 10:00:01", True)),
        days=context.context(a, side(at="2024-01-03 10:00:00", zoned=True)), unzoned=context.context(a, side(at="2024-01-03 10:00:00", zoned=False)), none=context.context(a, side()),
    )
    assert [r[i].status for i in range(5)] == ["corroborates", "conflicts", "conflicts", "neutral", "unavailable"]
    assert r.same.same_camera is True and r.same.score > 90 and r.none.score is None and r.none.reasons == ["Keine gemeinsam vergleichbaren EXIF-Metadaten vorhanden."]
    assert "2,0 Tage" in r.days.reasons[0]


def test_paths(spark):
    n = lambda p: names.normalized(F.lit(p))
    r = one(spark, a=n(".\\Baustelle\\Fotos//bild.jpg"), **{f"u{i}": n(p) for i, p in enumerate(["", "/x", "C:\\x", "a/../b", "a\x01b", "./."])})
    assert r.a == "Baustelle/Fotos/bild.jpg" and not any(tuple(r)[1:])
    s = lambda p: names.is_system(F.lit(p))
    assert tuple(one(spark, a=s("x/__MACOSX/y.jpg"), b=s("Thumbs.db"), c=s("a/.hidden.png"), d=s("a/b.png"))) == (True, True, True, False)
    assert one(spark, a=n("e\u0301.png")).a == "\u00e9.png"


def test_formats(spark):
    f = lambda h: names.format_of_bytes(F.unhex(F.lit(h)))
    heads = {"jpeg": "FFD8FFE0", "png": "89504E470D0A1A0A", "webp": "5249464600000000" + "57454250", "gif": "474946383961", "bmp": "424D", "tiff": "4D4D002A", "avif": "0000001866747970" + "61766966", "heic": "0000001866747970" + "6D696631"}
    r = one(spark, **{k: f(h) for k, h in heads.items()}, none=f("00"), short=f("FFD8"))
    assert tuple(r) == (*heads, None, None)
    assert tuple(one(spark, a=names.format_of_name(F.lit("A.b.JPeG")), b=names.format_of_name(F.lit("noext")), c=names.is_archive_name(F.lit("x.EPUB")), d=names.is_zip(F.unhex(F.lit("504B0506"))))) == ("jpeg", None, True, True)


def test_cells(spark):
    c = lambda v, text=True: tables.cell(F.lit(v), text)
    r = one(spark, a=c("a;b"), b=c('sagt "ja"'), n=c("x\ny"), f=c("=1"), g=c(" +1"), h=c("\tx"), num=c(-2, False), none=tables.cell(F.lit(None).cast("string"), True))
    assert tuple(r) == ('"a;b"', '"sagt ""ja"""', '"x\ny"', "'=1", "' +1", "'\tx", "-2", "")
    r = one(spark, a=tables.file_name(F.lit('a<b>:"c"/d. . ')), b=tables.file_name(F.lit(" ..")), c=tables.report_stem(F.lit("Bau.ZIP")), d=tables.byte_text(F.lit(1536)), e=tables.byte_text(F.lit(0)), m=tables.millis_text(F.lit(61500)), p=tables.percent_text(F.lit(12.4)))
    assert tuple(r) == ("a_b___c__d", "bericht", "Bau-bericht", "1,5 KB", "0 B", "1 Min. 1 Sek.", "12 %")


def test_exif_texts(spark):
    t = lambda v: F.lit(v).cast("string")
    r = one(
        spark,
        text=exif.clean_text(t(" A\u00a0 B ")), turn=exif.orientation(t("Rotate 90 CW")), digit=exif.orientation(t(" 8 ")), bad=exif.orientation(t("9")), zone=exif.utc_offset(t("+02:00")), nozone=exif.utc_offset(t("+15:00")),
        sub=exif.subseconds(t("5")), at=exif.captured_at(t("2024:02:29 10:11:12.5"), t("+02:00"), t(None)), never=exif.captured_at(t("2023:02:29 10:11:12"), t(None), t(None)),
    )
    assert (r.text, r.turn, r.digit, r.bad, r.zone, r.nozone, r["sub"], r.never) == ("A B", 6, 8, None, "+02:00", None, "500", None)
    assert one(spark, a=F.date_format(exif.captured_at(t("2024:02:29 10:11:12.5"), t("+02:00"), t(None)), "yyyy-MM-dd HH:mm:ss.SSS")).a == "2024-02-29 08:11:12.500"


def test_limits_and_workers():
    with pytest.raises(ValueError, match="positive"):
        Limits(images=0)
    assert [worker_count(n) for n in (1, 2, 4, 64)] == [1, 1, 3, 4]


def test_error_ids_are_fnv(spark):
    def fnv(text):
        h = 2166136261
        units = text.encode("utf-16-be")
        for i in range(0, len(units), 2):
            h = (h ^ int.from_bytes(units[i : i + 2], "big")) * 16777619 & 0xFFFFFFFF
        return f"zip-{h:08x}"

    r = one(spark, a=validate.error_id(F.lit("invalid-zip"), F.lit("ä/😀"), F.lit("m")), b=validate.error_id(F.lit("x"), F.lit(None).cast("string"), F.lit("")))
    assert tuple(r) == (fnv("invalid-zip\0ä/😀\0m"), fnv("x\0\0"))


def test_turns_and_scales(spark):
    t = lambda target, turn: comparisons.effective_turn(F.lit(target), F.lit(turn))
    assert tuple(one(spark, a=t(True, 90), b=t(False, 90), c=t(False, 0))) == (90, 270, 0)
    f = lambda a, b, t: comparisons.fit_scale(F.lit(a), F.lit(b), F.lit(t))
    assert tuple(one(spark, a=f(1.5, 1.5, 0), b=f(1.5, 1 / 1.5, 90), c=f(0.0, 1.0, 90))) == (1.0, 1.5, 1.0)


def test_file_decisions(spark):
    cases = {"a": ("unreviewed", ["different", "duplicate"]), "b": ("unreviewed", ["later", "different"]), "c": ("unreviewed", ["different", "different"]), "d": ("different", ["unreviewed"]), "e": ("unreviewed", ["unreviewed", "different"]), "f": ("unreviewed", [None]), "g": ("later", [])}
    rows = spark.createDataFrame([(k, own, r) for k, (own, rel) in cases.items() for r in rel], "k string, own string, relation string")
    flags = rows.groupBy("k").agg(results.relation_flags(F.col("relation")).alias("flags"))
    files = spark.createDataFrame([(k, own) for k, (own, _) in cases.items()], "k string, own string").join(flags, "k", "left")
    got = {r.k: r.d for r in files.select("k", results.file_decision(F.col("own"), F.col("flags")).alias("d")).collect()}
    assert got == {"a": "duplicate", "b": "later", "c": "different", "d": "different", "e": "unreviewed", "f": "unreviewed", "g": "later"}


def test_natural_order_of_long_numbers(spark):
    from pixkin.operators.results import natural_key

    names = ["img1000000000000000000000000", "img5", "img12", "img0003", "IMG7", "img9999999999999999999999999", "img", "img5b2", "img5b10", "img999999999999999999999"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(natural_key(F.col("n"))).collect()]
    assert got == ["img", "img0003", "img5", "img5b2", "img5b10", "IMG7", "img12", "img999999999999999999999", "img1000000000000000000000000", "img9999999999999999999999999"]


def test_left_join_of_hot_keys_keeps_every_row(spark):
    from pixkin.operators.skew import attach_left

    rows = spark.createDataFrame([("hot", i) for i in range(3000)] + [("none", i) for i in range(2000)] + [(f"k{i}", i) for i in range(300)], "k string, v int")
    groups = spark.createDataFrame([("hot", 1), ("k5", 2), ("unused", 3)], "k string, g int")
    got = attach_left(rows, groups, ["k"])
    assert got.count() == 5300 and got.where("g is not null").groupBy("k").count().collect().__len__() == 2
    assert got.where("k = 'hot' and g = 1").count() == 3000 and got.where("k = 'none' and g is null").count() == 2000
    assert attach_left(rows.where("false"), groups, ["k"]).count() == 0
