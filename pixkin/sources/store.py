"""Analyses at rest: Parquet tables partitioned by the archive's fingerprint, replaced one partition at a time, and logs of keyed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixkin.operators.skew import unused

VERSION = 4
#: Kept only once the user has agreed to it: see ``Store.agree``.
CACHES = ("analyses", "thumbnails", "values")
MOST_THUMBNAIL_BYTES = 2 << 20


class Store:
    """Keyed tables under one path: analyses, images, edges, groups, thumbnails, decisions, values ... Records of other versions are not seen."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def where(self, table: str) -> str:
        return f"{self.path}/{table}"

    def put(self, table: str, rows: DataFrame, fingerprint: str) -> None:
        """Replace what the table holds of one archive."""
        self.put_all(table, rows.withColumn("fingerprint", F.lit(fingerprint)))

    def put_all(self, table: str, rows: DataFrame) -> None:
        """Replace what the table holds of the archives that ``rows`` name in their fingerprint."""
        stamped = rows.withColumns({"version": F.lit(VERSION), "updated_at": F.current_timestamp()})
        stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fingerprint").parquet(self.where(table))

    def put_thumbnails(self, rows: DataFrame, fingerprint: str) -> None:
        """key, content: from one byte to 2 MiB of WebP, JPEG or PNG; others are refused."""
        from pixkin.functions.names import format_of_bytes

        fine = F.octet_length("content").between(1, MOST_THUMBNAIL_BYTES) & F.coalesce(format_of_bytes(F.col("content")).isin("webp", "jpeg", "png"), F.lit(False))
        self.put("thumbnails", rows.where(fine), fingerprint)

    def get(self, table: str, fingerprint: str | None = None) -> DataFrame | None:
        """Rows of this version, of one archive if named (only its partition is read); None if there is no table."""
        if not self.exists(table):
            return None
        rows = self.spark.read.option("mergeSchema", "true").parquet(self.where(table)).where(F.col("version") == VERSION)
        return rows.where(F.col("fingerprint") == fingerprint) if fingerprint is not None else rows

    def latest(self) -> DataFrame | None:
        """Analyses, the newest first."""
        rows = self.get("analyses")
        return rows and rows.orderBy(F.desc("updated_at"))

    def resume(self, fingerprint: str, name: str, size: int) -> DataFrame | None:
        """The analysis of an archive if fingerprint, name and size agree."""
        rows = self.get("analyses", fingerprint)
        rows = rows and rows.where((F.col("name") == name) & (F.col("size") == size))
        return None if rows is None or rows.isEmpty() else rows

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, table: str) -> bool:
        fs, p = self._fs(self.where(table))
        return fs.exists(p)

    def remove(self, table: str, fingerprints: list[str]) -> None:
        """What one table holds of some archives."""
        for fingerprint in fingerprints:
            fs, p = self._fs(f"{self.where(table)}/fingerprint={fingerprint}")
            fs.delete(p, True)

    def delete(self, fingerprint: str) -> None:
        """All that is held of one archive, in all tables."""
        fs, root = self._fs(self.path)
        if fs.exists(root):
            for table in fs.listStatus(root):
                part, p = self._fs(f"{table.getPath()}/fingerprint={fingerprint}")
                part.delete(p, True)

    def clear(self) -> None:
        fs, p = self._fs(self.path)
        fs.delete(p, True)

    def keyed(self, table: str) -> KeyedRows:
        return KeyedRows(self, table)

    def agree(self, to_caching: bool) -> None:
        """Caching is off until it is agreed to; what was kept before stays until it is deleted."""
        self.keyed("settings").put(self.spark.createDataFrame([("", "caching", "on" if to_caching else "off")], "fingerprint string, key string, value string"))

    def agreed(self) -> bool:
        found = self.keyed("settings").get("", "caching")
        return found is not None and not found.where("value = 'on'").isEmpty()


class KeyedRows:
    """A table of the store by (fingerprint, key): decisions, thumbnails, settings, values ...

    Puts and deletes are folders of Parquet that are added in turn, sorted by key so that a lookup reads few row groups. Of a key's rows the
    latest counts: by folder, then by ``at`` if rows have it, then by content, so rereads agree. A folder counts once its job has
    committed. One writer at a time. ``compact`` writes what is left as one folder and deletes those before it.
    """

    def __init__(self, store: Store, table: str):
        self.store, self.spark, self.table, self.path = store, store.spark, table, f"{store.where('keyed')}/{table}"

    def folders(self) -> list[tuple[int, str, str]]:
        """(number, kind, path) of the committed folders that count: the last whole one and what was added later."""
        fs, root = self.store._fs(self.path)
        if not fs.exists(root):
            return []
        found = []
        for status in fs.listStatus(root):
            kind, _, number = status.getPath().getName().partition("-")
            fs_, done = self.store._fs(f"{self.path}/{kind}-{number}/_SUCCESS")
            if number.isdigit() and fs_.exists(done):
                found.append((int(number), kind, f"{self.path}/{kind}-{number}"))
        first = max((n for n, kind, _ in found if kind == "whole"), default=0)
        return sorted(f for f in found if f[0] >= first)

    def _add(self, rows: DataFrame, kind: str) -> None:
        number = max((n for n, _, _ in self.folders()), default=0) + 1
        rows = rows.withColumns({"fingerprint": F.col("fingerprint").cast("string"), "key": F.col("key").cast("string"), "version": F.lit(VERSION), "folder": F.lit(number).cast("long")})
        rows.repartitionByRange("fingerprint", "key").sortWithinPartitions("fingerprint", "key").write.mode("overwrite").parquet(f"{self.path}/{kind}-{number:012d}")

    def put(self, rows: DataFrame) -> bool:
        """Adds or replaces the rows of their keys: fingerprint, key and any others. Rows without a fingerprint or key are left out. False, and nothing kept, for a cache that wasn't agreed to."""
        if self.table in CACHES and not self.store.agreed():
            return False
        self._add(rows.where("fingerprint is not null and key is not null").withColumn("deleted", F.lit(False)), "put")
        return True

    def delete(self, keys: DataFrame) -> None:
        """Deletes by fingerprint and key."""
        self._add(keys.where("fingerprint is not null and key is not null").select("fingerprint", "key", F.lit(True).alias("deleted")), "put")

    def latest(self) -> DataFrame | None:
        folders = self.folders()
        if not folders:
            return None
        rows = self.spark.read.option("mergeSchema", "true").parquet(*[path for _, _, path in folders]).where(F.col("version") == VERSION)
        at = F.col("at") if "at" in rows.columns else F.lit(None).cast("timestamp")
        content = F.xxhash64(*[F.col(f"`{c}`") for c, kind in rows.dtypes if not kind.startswith("map")])
        return rows.withColumn("_place", F.struct("folder", at.alias("at"), content.alias("content")))

    def get(self, fingerprint: str | None = None, key: str | None = None) -> DataFrame | None:
        """The rows that count, of one fingerprint or key if named (filters reach the scan); None if nothing was ever put."""
        rows = self.latest()
        if rows is None:
            return None
        for name, value in (("fingerprint", fingerprint), ("key", key)):
            rows = rows if value is None else rows.where(F.col(name) == value)
        names = [c for c in rows.columns if c not in ("fingerprint", "key", "_place")]
        row = unused(rows, "row")[0]
        best = rows.groupBy("fingerprint", "key").agg(F.max_by(F.struct(*names), "_place").alias(row))  # reduced before it is shuffled
        return best.where(~F.col(f"{row}.deleted")).select("fingerprint", "key", *[F.col(f"{row}.`{c}`").alias(c) for c in names if c not in ("deleted", "version", "folder")])

    def compact(self) -> None:
        """What counts as one folder; folders before it are deleted. Readers that listed them before must list again."""
        old, rows = self.folders(), self.get()
        if rows is not None:
            self._add(rows.withColumn("deleted", F.lit(False)), "whole")
            for _, _, path in old:
                fs, p = self.store._fs(path)
                fs.delete(p, True)
