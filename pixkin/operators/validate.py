"""Validation of archive entries: one code for each entry, one verdict for each archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixkin.config import Limits
from pixkin.functions import names

SAFE_INTEGER = 2**53 - 1
# Which codes of entries map to which public ones, and which of those let a run go on.
PUBLIC = {
    "encrypted-zip": "encrypted-zip", "corrupt-entry": "corrupt-entry", "format-mismatch": "corrupt-image", "cancelled": "cancelled",
    "too-many-entries": "limit-exceeded", "too-many-images": "limit-exceeded", "entry-too-large": "limit-exceeded",
    "archive-too-large": "limit-exceeded", "compression-ratio": "limit-exceeded",
}
RECOVERABLE = ("corrupt-entry", "corrupt-image", "unsupported-image")


def sizes_fine(compressed: Column, size: Column) -> Column:
    return F.coalesce(compressed.between(0, SAFE_INTEGER) & size.between(0, SAFE_INTEGER), F.lit(False))


def check_entries(entries: DataFrame, limits: Limits = Limits(), unicode: bool = True) -> DataFrame:
    """Adds normal_path, code (the entry's fatal finding or null), skip (why it is passed over or null), format and ratio.

    ``entries``: archive, index, filename, directory, compressed_size, uncompressed_size, encrypted. Checks come in their fixed order;
    totals count the files up to an entry, unsupported ones too, as long as nothing before it is fatal.
    """
    in_order = Window.partitionBy("archive").orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    e = entries.withColumn("normal_path", names.normalized(F.col("filename"), unicode)).withColumn("ratio", names.compression_ratio(F.col("compressed_size"), F.col("uncompressed_size")))
    is_file = ~F.col("directory")
    e = e.withColumn("format", names.format_of_name(F.col("normal_path")))
    ignored = names.is_system(F.col("normal_path"))
    skip = (
        F.when(F.col("directory"), "directory").when(F.col("uncompressed_size") == 0, "empty").when(ignored, "system").when(F.col("format").isNull(), "unsupported")
    )
    e = e.withColumn("skip", skip)
    same = Window.partitionBy("archive", names.collision_key(F.col("normal_path"))).orderBy("index")
    e = e.withColumn("_nth", F.row_number().over(same))
    e = e.withColumn("_total", F.sum(F.when(is_file, F.col("uncompressed_size")).otherwise(0)).over(in_order))
    e = e.withColumn("_images", F.sum(F.col("skip").isNull().cast("int")).over(in_order))
    code = (
        F.when(~sizes_fine(F.col("compressed_size"), F.col("uncompressed_size")), "invalid-zip")
        .when(F.col("normal_path").isNull(), "unsafe-path")
        .when(F.col("_nth") > 1, "duplicate-path")
        .when(F.col("directory"), None)
        .when(F.col("_total") > limits.total_bytes, "archive-too-large")
        .when(F.coalesce("encrypted", F.lit(False)), "encrypted-zip")
        .when(F.col("ratio") > limits.ratio, "compression-ratio")
        .when(names.is_archive_name(F.col("normal_path")), "nested-zip")
        .when(F.col("skip").isNotNull(), None)
        .when(F.col("uncompressed_size") > limits.image_bytes, "entry-too-large")
        .when(F.col("_images") > limits.images, "too-many-images")
    )
    return e.withColumn("code", code).drop("_nth", "_total", "_images")


def inspect(checked: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A row for each archive: code (the first entry's that is fatal; null: fine), at_index, counts, bytes, formats in order of first sight, warnings."""
    kept = F.col("skip").isNull()
    of = lambda reason: F.count_if(F.col("skip") == reason)
    first_seen = F.array_sort(F.collect_set(F.when(kept, F.struct("format", "index"))))
    out = checked.groupBy("archive").agg(
        F.count("*").alias("entries"),
        F.min(F.when(F.col("code").isNotNull(), F.struct("index", "code"))).alias("_first"),
        F.count_if(~F.col("directory")).alias("total_entries"),
        F.count_if(kept).alias("supported_images"),
        F.count_if(F.col("skip").isNotNull() & ~F.col("directory")).alias("skipped_entries"),
        F.sum(F.when(~F.col("directory"), F.col("uncompressed_size")).otherwise(0)).alias("total_bytes"),
        of("unsupported").alias("unsupported"), of("system").alias("system"), of("empty").alias("empty"),
        first_seen.alias("_seen"),
    )
    order = F.array_sort(F.transform("_seen", lambda s: F.struct(s["index"], s["format"])))
    formats = F.array_distinct(F.transform(order, lambda s: s["format"]))
    number = lambda c: F.translate(F.format_number(c, 0), ",", ".")
    warn = [
        F.when(F.col(c) > 0, F.concat(number(F.col(c)), F.lit(text)))
        for c, text in (("unsupported", " nicht unterstützte Datei(en) werden übersprungen."), ("system", " System- oder Metadatendatei(en) werden ignoriert."), ("empty", " leere Datei(en) werden ignoriert."))
    ]
    many = F.col("entries") > limits.entries
    return out.select(
        "archive", F.when(many, "too-many-entries").otherwise(F.col("_first.code")).alias("code"), F.when(~many, F.col("_first.index")).alias("at_index"),
        "total_entries", "supported_images", "skipped_entries", "total_bytes", formats.alias("formats"), F.filter(F.array(*warn), lambda w: w.isNotNull()).alias("warnings"),
    )


def public_code(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in PUBLIC.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), F.lit("invalid-zip"))


def is_recoverable(public: Column) -> Column:
    return public.isin(*RECOVERABLE)


def error_id(code: Column, path: Column, message: Column) -> Column:
    """'zip-' and the 32-bit FNV-1a hash of the texts' UTF-16 units, joined by NUL."""
    text = F.concat_ws("\0", code, F.coalesce(path, F.lit("")), message)
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(....)"), F.lit(1))
    step = lambda acc, u: ((acc.bitwiseXOR(F.conv(u, 16, 10).cast("long"))) * 16777619).bitwiseAND(0xFFFFFFFF)
    return F.concat(F.lit("zip-"), F.lpad(F.lower(F.hex(F.aggregate(units, F.lit(2166136261).cast("long"), step))), 8, "0"))
