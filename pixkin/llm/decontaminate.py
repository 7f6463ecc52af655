"""Benchmark decontamination by a distributed positional inverted index, with DataFrame operations only.

Postings (text, term, position) of the corpus are stored as Parquet, dealt by documents, so no term has a hot task. A window of a test
item is searched from its rarest terms: the postings of the rarest are moved by the offset between the two rarest and intersected with
those of the second; what is left is few, and the lists of all its other terms are intersected with it in the same way, so a match is
exact. Windows that share their two rarest terms at one distance share that search. Terms that no item has can be in no match and aren't
stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixkin.llm.common import ascii_lower, attach_left, cut_lineage, unused
from pixkin.operators.skew import delete, new_path

#: Between words: ASCII other than digits and lower-case letters; with capitals, before lower-casing.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WIDTH = 10
#: Rows of term and pair tables that travel to the executors (30 MB at most); beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000
KEY = ["k1", "k2"]


def text_key(text: Column) -> list[Column]:
    """Two unrelated 64-bit hashes that stand for a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")]


def small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if it has BROADCAST_ROWS rows at most."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def postings(docs: DataFrame, text: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """k1, k2, term, pos of every word (of the vocabulary) of every text. Positions are consecutive; the first is 0, or 1 if the text begins with a gap."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(*text_key(body), F.posexplode(F.split(ascii_lower(body), GAPS)).alias("pos", "word")).where("word != ''")
    rows = rows.select(*KEY, F.xxhash64("word").alias("term"), "pos")
    # A vocabulary too large to travel selects nothing: joining all words by term would make hot tasks.
    return rows if vocabulary is None or vocabulary.count() > BROADCAST_ROWS else rows.join(F.broadcast(vocabulary), "term", "left_semi")


def item_windows(items: DataFrame, text: str, item_id: str, width: int) -> DataFrame:
    """item, window (array of terms): every ``width`` consecutive words of an item, or all of them if they are fewer; each once."""
    words = F.filter(F.split(ascii_lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), GAPS), lambda w: w != "")
    terms = items.select(F.col(item_id).cast("string").alias("item"), F.transform(words, lambda w: F.xxhash64(w)).alias("terms")).where("size(terms) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("terms") - F.lit(width - 1)))
    return terms.select("item", F.explode(F.transform(starts, lambda s: F.slice("terms", s, width))).alias("window")).distinct()


class Index:
    """Stored postings of ``docs`` for the terms of ``items``, with the items' windows."""

    def __init__(self, docs: DataFrame, items: DataFrame, *, text: str = "text", item_text: str = "text", item_id: str = "item_id", width: int = WIDTH):
        self.spark = docs.sparkSession
        self.windows = cut_lineage(item_windows(items, item_text, item_id, width))
        #: window number, terms; numbers stay as they are because the rows are checkpointed.
        self.grams = cut_lineage(self.windows.select("window").distinct()).withColumn("w", F.monotonically_increasing_id())
        self.terms = self.grams.select("w", "window", F.posexplode("window").alias("off", "term"))
        vocabulary = cut_lineage(self.terms.select("term").distinct())
        self.path = new_path(self.spark, "postings")
        postings(docs, text, vocabulary).write.parquet(self.path)
        self.lists = self.spark.read.parquet(self.path)
        self.counts = cut_lineage(self.lists.groupBy("term").agg(F.count("*").alias("n")))

    def rarest(self) -> DataFrame:
        """w, window, a, b (terms), at (place of a), gap (from a to b): the two rarest places of each window all of whose terms the corpus has."""
        known = self.terms.join(small(self.counts), "term")
        places = known.groupBy("w", "window").agg(F.array_sort(F.collect_list(F.struct("n", "off", "term"))).alias("p")).where("size(p) = size(window)")
        first, second = F.col("p")[0], F.coalesce(F.get("p", F.lit(1)), F.col("p")[0])
        return cut_lineage(places.select("w", "window", first["term"].alias("a"), second["term"].alias("b"), first["off"].alias("at"), (second["off"] - first["off"]).alias("gap")))

    def met(self, asked: DataFrame) -> DataFrame:
        """The rows of ``asked`` (k1, k2, pos, term and others, each once) whose posting is stored. Lists are read for the texts asked of only; copies of a text count once."""
        texts = small(cut_lineage(asked.select(*KEY).distinct()))
        lists = self.lists.join(texts, KEY, "left_semi").select(*KEY, "pos", "term").distinct()
        return asked.join(lists, [*KEY, "pos", "term"], "left_semi")

    def started(self, leads: DataFrame) -> DataFrame:
        """k1, k2, pos (of a), a, b, gap: where the postings of a and those of b, moved by their distance, meet."""
        of_a = small(cut_lineage(leads.select(F.col("a").alias("term"), "b", "gap").distinct()))
        of_b = small(cut_lineage(leads.select(F.col("b").alias("term")).distinct()))
        asked = self.lists.join(of_a, "term").select(*KEY, "pos", F.col("term").alias("a"), F.col("b").alias("term"), "gap").distinct()
        lists = self.lists.join(of_b, "term", "left_semi").select(*KEY, F.col("pos").alias("there"), "term").distinct()
        found = asked.withColumn("there", F.col("pos") + F.col("gap")).join(lists, [*KEY, "there", "term"], "left_semi")
        return found.select(*KEY, "pos", "a", F.col("term").alias("b"), "gap")

    def phrases(self) -> DataFrame:
        """k1, k2, w, start, size: every occurrence of a window."""
        leads = self.rarest()
        begun = self.started(leads).join(small(leads.select("w", "window", "a", "b", "at", "gap")), ["a", "b", "gap"])
        begun = cut_lineage(begun.select(*KEY, "w", "window", (F.col("pos") - F.col("at")).alias("start")))
        asked = begun.select(*KEY, "w", "start", F.size("window").alias("size"), F.posexplode("window").alias("off", "term")).withColumn("pos", F.col("start") + F.col("off"))
        whole = self.met(asked).groupBy(*KEY, "w", "start", "size").agg(F.count("*").alias("n")).where("n = size")
        return cut_lineage(whole.drop("n"))

    def near(self, reach: int) -> DataFrame:
        """k1, k2, w, pos: places of a window's rarest term that have all its other terms, in any order, ``reach`` words away at most."""
        leads = self.rarest()
        span = F.explode(F.sequence(F.col("pos") - reach, F.col("pos") + reach))
        found = self.lists.join(small(leads.select(F.col("a").alias("term"), "w", "b", "window")), "term").select(*KEY, "w", "pos", F.col("term").alias("a"), "b", "window").distinct()
        for want in (F.array("b"), F.array_except(F.array_distinct("window"), F.array("a", "b"))):
            # Second rarest first; the others are asked for only where it is near.
            found = cut_lineage(found)
            asked = found.select(*KEY, "w", F.col("pos").alias("at"), F.explode(want).alias("term"), F.col("pos")).select(*KEY, "w", "at", "term", span.alias("pos"))
            seen = self.met(asked).groupBy(*KEY, "w", "at").agg(F.count_distinct("term").alias("n")).withColumnRenamed("at", "pos")
            found = found.join(seen, [*KEY, "w", "pos"], "left").where(F.coalesce("n", F.lit(0)) >= F.size(want)).drop("n")
        return cut_lineage(found.select(*KEY, "w", "pos"))

    def items_of(self, found: DataFrame) -> DataFrame:
        """k1, k2, item: items that have one of the windows found in a text."""
        of = small(cut_lineage(self.windows.join(self.grams, "window").select("w", "item")))
        return found.select(*KEY, "w").distinct().join(of, "w").select(*KEY, "item").distinct()

    def drop(self) -> None:
        delete(self.spark, self.path)


def facts(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """k1, k2, n_hit, item_ids (sorted array of strings) of each text that holds a window."""
    index = Index(docs, items, **names)
    found = index.phrases()
    hits = found.select(*KEY, F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("pos")).groupBy(*KEY).agg(F.count_distinct("pos").alias("n_hit"))
    of = index.items_of(found).groupBy(*KEY).agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    out = cut_lineage(hits.join(of, KEY))
    index.drop()
    return out


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", item_text: str = "text", item_id: str = "item_id", width: int = WIDTH) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside a window of an item), item_ids (array<string>) and contaminated.

    A window is ``width`` consecutive words of an item, or all words of a shorter one; null and empty texts and items have none. Long texts
    count whole. Repeated rows and copies are all marked; repeated items count once, items without an id mark words and are in no list.
    Columns of ``docs`` named like the added ones are replaced, others may have any names. Empty tables give no rows, or no marks.
    """
    added = ("n_words", "n_hit", "item_ids", "contaminated")
    docs = docs.drop(*[c for c in docs.columns if c in added and c != text])
    found = facts(docs, items, text=text, item_text=item_text, item_id=item_id, width=width)
    x, y = unused(docs.withColumns({c: F.lit(0) for c in added}), "text_k1", "text_k2")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    k1, k2 = text_key(body)
    rows = docs.withColumns({"n_words": F.regexp_count(body, F.lit(ANY_WORD)).cast("long"), x: k1, y: k2})
    found = found.withColumnsRenamed({"k1": x, "k2": y})
    if found.count() <= BROADCAST_ROWS // 10:
        joined = rows.join(F.broadcast(found), [x, y], "left")
    else:
        joined = attach_left(rows, found, [x, y])
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.withColumns({"n_hit": hit, "item_ids": F.coalesce("item_ids", F.array().cast("array<string>"))}).withColumn("contaminated", F.col("n_hit") > 0).select(*docs.columns, *added)


def near_items(docs: DataFrame, items: DataFrame, *, reach: int = 2 * WIDTH, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", width: int = WIDTH) -> DataFrame:
    """doc_id, item: proximity matches, each once. A text has one if all words of a window of the item lie within ``reach`` words of an occurrence of the window's rarest word, in any order."""
    index = Index(docs, items, text=text, item_text=item_text, item_id=item_id, width=width)
    found = cut_lineage(index.items_of(index.near(reach)))
    index.drop()
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), *text_key(body)).join(small(found), KEY).select("doc_id", "item").distinct()


def contamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The digest: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    ids = F.col("item_ids")
    return decontaminate(docs.select("doc_id", "text"), items).select("doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The same in DuckDB, by comparing all windows of the documents with all windows of the items.
CONTAMINATION_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item, list_slice(w, s, s + least(10, len(w)) - 1) AS g FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
l AS (SELECT DISTINCT len(g) AS n FROM g),
c AS (SELECT r, s, n, list_slice(w, s, s + n - 1) AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, l WHERE len(w) >= n)),
o AS (SELECT c.r, c.s, c.n, g.item FROM c JOIN g ON c.g = g.g),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM o) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM o WHERE item IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(m.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN m ON d.r = m.r
"""
