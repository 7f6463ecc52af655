"""Archives that arrive over time: those of a batch are analysed by one set of plans and stored under their identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pixkin.config import MODES, Limits, Settings
from pixkin.operators.skew import cut
from pixkin.plans.analysis import analyse
from pixkin.sources.archive import identity
from pixkin.sources.store import Store

BINARY = "path string, modificationTime timestamp, length long, content binary"
FACTS = ("path", "modificationTime", "length")


def fresh(files: DataFrame, store: Store) -> DataFrame:
    """The archives (path, modificationTime, length, name, size, fingerprint) that the store has no analysis of; of equal ones the first by path."""
    key = ["fingerprint", "name", "size"]
    ones = identity(files).groupBy(*key).agg(F.min("archive").alias("path"))
    known = store.get("analyses")
    if known is not None:
        ones = ones.join(known.select(*key), key, "left_anti")
    return cut(files.join(ones, "path"))


def analyse_new(files: DataFrame, store: Store, s: Settings = MODES["balanced"], limits: Limits = Limits()) -> int:
    """Analyses and stores those of ``files`` that are new; how many that were.

    All archives go through one analysis, whatever their number: pairs and groups are those of one archive, ids begin with what tells it
    apart, so the result doesn't depend on the company in which an archive came. What an earlier, broken run stored of them goes first,
    and the mark that an archive is done is written last.
    """
    new = fresh(files.select(*FACTS), store)
    done = [r.fingerprint for r in new.select("fingerprint").collect()]  # a batch's archives
    if not done:
        return 0
    found = analyse(new.select(*FACTS), s, limits, apart=True)
    of = F.broadcast(new.select(F.col("path").alias("archive"), "fingerprint"))
    groups = found.groups.join(found.images.select(F.col("id").alias("reference_id"), "archive"), "reference_id").select("archive", *found.groups.columns)
    for table, rows in {"images": found.images, "edges": found.edges, "groups": groups, "errors": found.errors}.items():
        store.remove(table, done)
        store.put_all(table, rows.join(of, "archive"))
    store.put_all("analyses", new.select("name", "size", F.lit(s.mode).alias("mode"), "fingerprint"))
    return len(done)


def watch(spark: SparkSession, path: str, store: Store, checkpoint: str, s: Settings = MODES["balanced"], limits: Limits = Limits(), files_per_trigger: int = 8, **trigger) -> StreamingQuery:
    """A query that analyses new archives under ``path``. Back-pressure is ``files_per_trigger``; stop() pauses, a new start resumes from ``checkpoint``.

    A batch that runs again replaces what it stored. An archive whose analysis of this version is stored already is passed over. Archives
    are read by ranges, never whole.
    """
    stream = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", "*.zip").option("maxFilesPerTrigger", files_per_trigger).load(path)

    def batch(files: DataFrame, _: int) -> None:
        analyse_new(files, store, s, limits)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer.trigger(availableNow=True)).start()
