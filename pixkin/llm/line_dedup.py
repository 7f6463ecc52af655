"""Line deduplication, with DataFrame operations only.

Lines become (hash, document, position). Hashes are range-partitioned and sorted by hash, document and position; one streaming pass
finds each hash's first document. Lines of a later document are dropped. What is returned is a compressed keep bitmap per document: the
64-line words that aren't all ones. Words that are not listed keep all their lines, so most documents carry a few bytes or none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixkin.llm.common import HEAVY_SHARE, WS, ascii_lower, attach_left, cut_lineage, unused


def document(doc_id: str) -> tuple[Column, Column]:
    """A document's place in the order: whether its id is null (those follow all others), and the id."""
    return F.col(doc_id).isNull(), F.coalesce(F.col(doc_id).cast("long"), F.lit(0).cast("long"))


def line_hashes(docs: DataFrame, text: str, doc_id: str, least: int) -> DataFrame:
    """h1, h2 (96 bits of two unrelated hashes), doc (struct of late and id), tid (tells apart texts of one id), pos; keys of ``least`` code points or more."""
    body = F.coalesce(F.col(text), F.lit(""))
    late, own = document(doc_id)
    lines = docs.select(F.struct(late.alias("late"), own.alias("id")).alias("doc"), F.xxhash64(body).alias("tid"), F.posexplode(F.split(body, "\n", -1)).alias("pos", "line"))
    key = F.btrim(ascii_lower(F.col("line")), F.lit(WS))
    return lines.select(key.alias("key"), "doc", "tid", "pos").where(F.length("key") >= least).select(F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"), "doc", "tid", "pos")


def keep_bitmaps(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", least: int = 10) -> DataFrame:
    """doc, tid, n_dropped long, words array<struct<word int, keep long>>: one row per document that loses lines.

    Null or empty texts have one empty line and lose nothing. Rows that repeat a doc_id count as one document, and rows with a null
    doc_id as one that follows all others. An empty table gives no rows.
    """
    lines = cut_lineage(line_hashes(docs, text, doc_id, least))
    # Hashes of over a thousandth of all lines: fewer than a thousand, found by a pre-aggregated count and decided where their lines are.
    limit = max(1, int(lines.count() * HEAVY_SHARE))
    heavy = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc").alias("first")).where(F.col("n") > limit).select("h1", "h2", "first")
    heavy = cut_lineage(heavy)
    hot = lines.join(F.broadcast(heavy), ["h1", "h2"])
    cold = lines.join(F.broadcast(heavy.select("h1", "h2")), ["h1", "h2"], "left_anti")
    # Range partitioning by the hash satisfies the window's distribution: one exchange, one sort, then a stream.
    ranged = cold.repartitionByRange(F.col("h1"), F.col("h2"))
    order = Window.partitionBy("h1", "h2").orderBy("doc", "pos").rowsBetween(Window.unboundedPreceding, 0)
    streamed = ranged.withColumn("first", F.first("doc").over(order)).where(F.col("doc") > F.col("first"))
    dropped = streamed.select("doc", "tid", "pos").unionByName(hot.where(F.col("doc") > F.col("first")).select("doc", "tid", "pos"))
    word, bit = F.shiftright("pos", 6), F.expr("shiftleft(1L, pos & 63)")
    words = dropped.groupBy("doc", "tid", word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("doc", "tid").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("keep")))).alias("words"))


def dedup_lines(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", least: int = 10) -> DataFrame:
    """``docs`` with ``text`` less its dropped lines, plus n_lines (before) and n_dropped (columns of these names are replaced); no row is lost.

    A text that loses no line is kept as it is (null stays null); long texts count whole; other columns may have any names.
    """
    maps = keep_bitmaps(docs, text=text, doc_id=doc_id, least=least)
    docs = docs.drop(*[c for c in docs.columns if c in ("n_lines", "n_dropped")])
    body = F.coalesce(F.col(text), F.lit(""))
    late, own, tid, n, words = unused(docs, "line_late", "line_doc", "line_tid", "line_n", "line_words")
    maps = maps.select(F.col("doc.late").alias(late), F.col("doc.id").alias(own), F.col("tid").alias(tid), F.col("n_dropped").alias(n), F.map_from_entries("words").alias(words))
    is_late, doc = document(doc_id)
    joined = attach_left(docs.withColumns({late: is_late, own: doc, tid: F.xxhash64(body)}), maps, [late, own, tid])
    bits = lambda i: F.coalesce(F.try_element_at(F.col(words), F.shiftright(i, 6)), F.lit(-1).cast("long"))
    stays = lambda line, i: F.getbit(bits(i), i.bitwiseAND(63)) == 1
    kept = F.array_join(F.filter(F.split(body, "\n", -1), stays), "\n")
    out = joined.withColumn("n_lines", F.size(F.split(body, "\n", -1)).cast("long")).withColumn("n_dropped", F.coalesce(n, F.lit(0).cast("long")))
    return out.withColumn(text, F.when(F.col(n).isNull(), F.col(text)).otherwise(kept)).drop(late, own, tid, n, words)


def line_report(docs: DataFrame) -> DataFrame:
    """The digest: doc_id, n_lines, n_dropped, kept_sha256."""
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


LINE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM {docs}),
k AS (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
g AS (SELECT k.doc_id, k.line, k.pos, coalesce(k.doc_id > f.first, false) AS gone FROM k LEFT JOIN f ON k.key = f.key)
"""
LINE_REPORT_SQL = (
    LINE_SQL
    + """SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY doc_id"""
).replace("{docs}", "documents")
