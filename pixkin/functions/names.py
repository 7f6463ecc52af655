"""Entry names, formats and signatures, as column builders."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats by extension, and extensions of archives.
EXTENSIONS = {
    "jpg": "jpeg", "jpeg": "jpeg", "png": "png", "webp": "webp", "heic": "heic", "heif": "heic", "hif": "heic", "avif": "avif",
    "gif": "gif", "bmp": "bmp", "dib": "bmp", "tif": "tiff", "tiff": "tiff",
}
ARCHIVES = r"(?i)\.(?:zip|zipx|jar|apk|epub)\z"
CONTROL = r"[\x{00}-\x{1f}\x{7f}-\x{9f}]"


def normal_form(c: Column, form: str) -> Column:
    """Spark has no normal forms: an Arrow function, made when it is used, since making one needs a session."""

    def run(s: pd.Series) -> pd.Series:
        return s.str.normalize(form)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(c)


def nfc(c: Column) -> Column:
    return normal_form(c, "NFC")


def nfkc(c: Column) -> Column:
    return normal_form(c, "NFKC")


def segments(path: Column) -> Column:
    return F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda s: (s != "") & (s != "."))


def is_safe(path: Column) -> Column:
    """Not empty, relative, without control characters, drives, or steps upwards, and with a name."""
    slashed = F.translate(path, "\\", "/")
    bad = (path == "") | path.rlike(CONTROL) | slashed.startswith("/") | slashed.rlike(r"^[a-zA-Z]:") | F.array_contains(segments(path), "..")
    return F.coalesce(~bad & (F.size(segments(path)) > 0), F.lit(False))


def normalized(path: Column, unicode: bool = True) -> Column:
    """Forward slashes, no empty or single-dot segments, NFC; null if unsafe."""
    joined = F.array_join(segments(path), "/")
    return F.when(is_safe(path), nfc(joined) if unicode else joined)


def collision_key(path: Column) -> Column:
    return F.lower(path)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_system(path: Column) -> Column:
    return F.exists(F.split(F.lower(path), "/"), lambda s: s == "__macosx") | F.lower(base_name(path)).isin("thumbs.db") | base_name(path).startswith(".")


def format_of_name(path: Column) -> Column:
    extension = F.lower(F.substring_index(path, ".", -1))
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.try_element_at(table, extension)


def is_archive_name(path: Column) -> Column:
    return path.rlike(ARCHIVES)


def format_of_bytes(data: Column) -> Column:
    """The format that the first 64 bytes tell, or null."""
    head = F.hex(F.substring(data, 1, 64))
    brands = F.hex(F.substring(data, 9, 56))
    any_of = lambda names: "^(?:..)*(?:" + "|".join(n.encode().hex().upper() for n in names.split()) + ")"
    return (
        F.when(head.startswith("FFD8FF"), "jpeg")
        .when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("52494646") & F.substring(head, 17, 8).eqNullSafe("57454250"), "webp")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "gif")
        .when(head.startswith("424D"), "bmp")
        .when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff")
        .when((F.substring(head, 9, 8) == "66747970") & brands.rlike(any_of("avif avis")), "avif")
        .when((F.substring(head, 9, 8) == "66747970") & brands.rlike(any_of("heic heix hevc hevx heim heis mif1 msf1")), "heic")
    )


def is_zip(data: Column) -> Column:
    return F.coalesce(F.hex(F.substring(data, 1, 4)).isin("504B0304", "504B0506", "504B0708"), F.lit(False))


def content_matches(path: Column, data: Column) -> Column:
    return F.coalesce(format_of_name(path) == format_of_bytes(data), F.lit(False))


def compression_ratio(compressed: Column, size: Column) -> Column:
    return F.when(size == 0, 0.0).when(compressed == 0, float("inf")).otherwise(F.try_divide(size, compressed))
