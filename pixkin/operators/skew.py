"""Shared folders, cut lineage and joins without hot tasks."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group is heavy if it holds over this share of all rows. There are fewer than 1 / HEAVY_SHARE of them, so they may be broadcast.
HEAVY_SHARE = 1 / 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Without one a local session gets a temporary folder; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext._jsc.sc().isLocal():
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Lineage cut by Parquet in the shared folder: packed by columns, and later reads take the columns they need. A checkpoint holds whole rows as they lie in memory."""
    path = new_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Checkpoints made in the block are deleted at its end. What it yields cuts a frame that is to outlive the block."""
    outer, inner = spark.sparkContext.getCheckpointDir() or shared_folder(spark), new_path(spark, "scratch")

    def keep(df: DataFrame) -> DataFrame:
        spark.sparkContext.setCheckpointDir(outer)
        try:
            return df.checkpoint(eager=True)
        finally:
            spark.sparkContext.setCheckpointDir(inner)

    spark.sparkContext.setCheckpointDir(inner)
    try:
        yield keep
    finally:
        spark.sparkContext.setCheckpointDir(outer)
        delete(spark, inner)


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` has no column of, whatever the case."""
    there = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in there:
            n = f"_{n}"
        out.append(n)
        there.add(n.lower())
    return out


def matched(left: DataFrame, right: DataFrame, on: list[str] | str | Column, how: str = "inner") -> DataFrame:
    """Join in a shuffle, whatever the sizes: neither table grows on the driver.

    A running plan takes a side for small by its bytes as they lie packed in a shuffle; texts of ids pack well, and a broadcast of 10 MB of
    them is ten times as much in the driver's heap, which collects, hashes and keeps it.
    """
    return left.join(right.hint("merge"), on, how)


def attach(rows: DataFrame, groups: DataFrame, key: list[str], weight: str, total: int, ready: bool = False, shuffled: bool = False) -> DataFrame:
    """Inner join of many rows to one row per group, without a hot task.

    ``groups`` has one row per key and the number of its rows in ``weight``. Groups with over HEAVY_SHARE of ``total`` rows
    (fewer than 1 / HEAVY_SHARE of them) are broadcast and their rows stay where they are; all others meet in a shuffle join,
    where no key has more than that share. No row is lost: the two filters are complementary, and keys must not be null. ``groups`` is
    read several times, so it is written first unless it is ``ready``. ``shuffled``: the shuffle join stays one, see ``matched``.
    """
    meet = matched if shuffled else DataFrame.join
    groups, limit = groups if ready else cut(groups), total * HEAVY_SHARE
    heavy = groups.where(F.col(weight) > limit)
    if heavy.isEmpty():
        return meet(rows, groups, key)
    light = groups.where(F.col(weight) <= limit)
    hot = rows.join(F.broadcast(heavy), key)
    cold = meet(rows.join(F.broadcast(heavy.select(*key)), key, "left_anti"), light, key)
    return hot.unionByName(cold)


def attach_left(rows: DataFrame, groups: DataFrame, key: list[str]) -> DataFrame:
    """Left join of many rows to at most one row a group, without a hot task.

    Keys (never null) of over HEAVY_SHARE of all rows are counted first. Their rows meet a broadcast of their groups, or of the fact that
    they have none, where they stand; all others meet in a shuffle join.
    """
    sizes = cut(rows.groupBy(*key).agg(F.count("*").alias("n")))
    limit = (sizes.agg(F.sum("n")).first()[0] or 0) * HEAVY_SHARE
    heavy = sizes.where(F.col("n") > limit).select(*key)  # fewer than 1 / HEAVY_SHARE rows
    if limit < 1 or heavy.isEmpty():
        return rows.join(groups, key, "left")
    hot = rows.join(F.broadcast(heavy.join(groups, key, "left")), key)
    return hot.unionByName(rows.join(F.broadcast(heavy), key, "left_anti").join(groups, key, "left"))


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner take the shuffle files, broadcasts and plans that nothing refers to any more; it learns of them only when the driver collects garbage. Checkpoints go by path: see ``scratch``."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with ``name``: 1, 2, 3 ... in ``order`` (a total one), without a task that sees all rows.

    Rows are dealt by ranges of the order and sorted there; a number is the place in its range plus the rows of the ranges before, of which
    the driver gets one count a range.
    """
    place = unused(df, "place")[0]
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn(place, F.monotonically_increasing_id())
    part = F.shiftright(place, 33)
    sizes = dict(ranged.groupBy(part.alias("part")).agg(F.count("*")).collect())
    starts, before = {}, 0
    for p in sorted(sizes):
        starts[p], before = before, before + sizes[p]
    table = F.create_map(*[F.lit(x) for p, n in starts.items() for x in (p, n)]) if starts else F.create_map(F.lit(0), F.lit(0))
    return ranged.withColumn(name, (F.element_at(table, part.cast("int")) + F.col(place).bitwiseAND((1 << 33) - 1) + 1).cast("long")).drop(place)


def bounded_batches(df: DataFrame, most: int = 64 << 20) -> DataFrame:
    """``df``, after making sure that Arrow batches of its session hold about ``most`` bytes at most: rows hold whole files, and a worker holds a batch at a time."""
    key, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    now = spark.conf.get(key)
    if not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(key, str(most))
    return df
