"""ZIP archives as tables: entries, images and errors.

Archives come by their paths alone, and are read by ranges (``ranged``), or with their content, where only Spark's readers reach them.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixkin.config import Limits
from pixkin.functions import names
from pixkin.operators.skew import bounded_batches
from pixkin.operators.validate import check_entries, inspect
from pixkin.sources import ranged

ENTRIES = "archive string, index int, filename string, directory boolean, compressed_size long, uncompressed_size long, encrypted boolean, last_modified timestamp"
HEADER_BYTES = 256
#: Leads the text that is hashed into an archive's identity.
IDENTITY_TAG = "pixkin:zip:v1"


def archives(spark: SparkSession, path: str, glob: str = "*.zip", content: bool = False) -> DataFrame:
    """path, modificationTime, length of the archives under a path; with ``content``, which is limited to 2 GB an archive, also their bytes, for stores that Spark alone can read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files if content else files.select("path", "modificationTime", "length")  # unread where it isn't selected


def read_entries(files: DataFrame) -> DataFrame:
    """The central directories: ENTRIES, and error for files that are no archives (then index is null); by ranges also the entries' places. No payload is unpacked."""
    if "content" not in files.columns:
        return ranged.read_directories(files, ENTRIES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows = [
                            (path, i, e.orig_filename, e.is_dir(), e.compress_size, e.file_size, bool(e.flag_bits & 1), datetime(*e.date_time, tzinfo=timezone.utc) if 1 <= e.date_time[1] <= 12 and e.date_time[2] else None, None)
                            for i, e in enumerate(z.infolist())
                        ]
                except (zipfile.BadZipFile, ValueError, OSError) as e:
                    rows = [(path, None, None, None, None, None, None, None, str(e))]
                out = pd.DataFrame(rows, columns=["archive", "index", "filename", "directory", "compressed_size", "uncompressed_size", "encrypted", "last_modified", "error"])
                for c in ("index", "compressed_size", "uncompressed_size"):
                    out[c] = out[c].astype("Int64")
                yield out

    return bounded_batches(files).select("path", "content").mapInPandas(run, ENTRIES + ", error string")


def unpack(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """archive, index, content, error of wanted (archive, index) entries. Size and checksum are verified; one bad entry spoils no other. Without content in ``files`` no byte of an archive is shuffled."""
    if "content" not in files.columns:
        placed = wanted if "offset" in wanted.columns else wanted.select("archive", "index").join(read_entries(files).where("error is null"), ["archive", "index"])
        return ranged.read_payloads(placed)
    lists = wanted.groupBy("archive").agg(F.sort_array(F.collect_list("index")).alias("indexes"))
    both = files.join(lists, F.col("path") == F.col("archive")).select("archive", "content", "indexes")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content, indexes in zip(pdf["archive"], pdf["content"], pdf["indexes"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    infos = z.infolist()
                    for i in indexes:
                        data = error = None
                        try:
                            data = z.read(infos[i])
                            if len(data) != infos[i].file_size:
                                data, error = None, "corrupt-entry"
                        except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, OSError):
                            error = "corrupt-entry"
                        yield pd.DataFrame({"archive": [path], "index": [i], "content": [data], "error": [error]})

    return bounded_batches(both).mapInPandas(run, "archive string, index int, content binary, error string")


def read_images(files: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(images, errors). Images: archive, index, path, name, format, sizes, content. Errors: archive, index, path, code, fatal.

    An archive with a fatal finding gives no images: unsafe entries, exceeded limits, or a disguised archive among its images. A
    payload that doesn't match its name or checksum is an error of its own.
    """
    entries = read_entries(files)
    broken = entries.where("error is not null").select("archive", F.lit(None).cast("int").alias("index"), F.lit(None).cast("string").alias("path"), F.lit("invalid-zip").alias("code"), F.lit(True).alias("fatal"))
    checked = check_entries(entries.where("error is null").drop("error"), limits)
    verdict = inspect(checked, limits).where("code is not null").select("archive", F.col("code").alias("fatal_code"), "at_index")
    at = verdict.join(checked.select("archive", F.col("index").alias("at_index"), F.col("filename").alias("at_path")), ["archive", "at_index"], "left")
    refused = at.select("archive", F.col("at_index").alias("index"), F.col("at_path").alias("path"), F.col("fatal_code").alias("code"), F.lit(True).alias("fatal"))
    good = checked.where("skip is null").join(verdict.select("archive"), "archive", "left_anti")
    content = unpack(files, good.select("archive", "index"))
    rows = good.select("archive", "index", F.col("normal_path").alias("path"), names.base_name(F.col("normal_path")).alias("name"), "format", "compressed_size", F.col("uncompressed_size").alias("size"), "last_modified").join(content, ["archive", "index"])
    head = F.substring("content", 1, HEADER_BYTES)
    code = F.coalesce("error", F.when(names.is_zip(head), "nested-zip"), F.when(~F.coalesce(names.format_of_bytes(head) == F.col("format"), F.lit(False)), "format-mismatch"))
    rows = rows.withColumn("code", code).drop("error")
    disguised = rows.where("code = 'nested-zip'").select("archive").distinct()
    images = rows.where("code is null").join(disguised, "archive", "left_anti").drop("code")
    errors = rows.where("code is not null").select("archive", "index", "path", "code", (F.col("code") == "nested-zip").alias("fatal"))
    return images, broken.unionByName(refused).unionByName(errors)


def read_one(files: DataFrame, path: str) -> DataFrame:
    """The content of one entry by its path, normalised."""
    entries = read_entries(files).where("error is null")
    asked = files.sparkSession.range(1).select(names.normalized(F.lit(path)).alias("asked"))
    found = entries.withColumn("normal", names.normalized(F.col("filename"))).join(asked, F.col("normal") == F.col("asked")).drop("normal", "asked", "error")
    return unpack(files, found)


def identity(files: DataFrame, chunk: int = Limits().fingerprint_chunk, tag: str = IDENTITY_TAG) -> DataFrame:
    """archive, name, size, fingerprint: SHA-256 of a tag, the file's facts as JSON, and its first and last ``chunk`` bytes without overlap."""
    if chunk <= 0:
        raise ValueError("the chunk must be positive")
    name = F.element_at(F.split("path", "/"), -1)
    facts = F.to_json(F.struct(name.alias("name"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("lastModified"), F.lit(chunk).alias("chunkBytes")))
    if "content" in files.columns:
        head = F.expr(f"substring(content, 1, {chunk})")
        start = F.greatest(F.least(F.col("length"), F.lit(chunk)), F.col("length") - chunk)
        tail = F.substr(F.col("content"), (start + 1).cast("int"), F.lit(chunk))
    else:
        files, head, tail = ranged.ends(files, chunk), F.col("head"), F.col("tail")
    whole = F.concat(F.encode(F.concat(F.lit(tag + "\n"), facts, F.lit("\n")), "UTF-8"), head, tail)
    return files.select(F.col("path").alias("archive"), name.alias("name"), F.col("length").alias("size"), F.sha2(whole, 256).alias("fingerprint"))
