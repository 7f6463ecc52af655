"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key. Sources are cut at their budgets along the key order: prefix sums of token counts are
taken over key ranges first, then only inside the one range of each source that holds its cut. The decision for a document is a
comparison of its key with its source's cut, so texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixkin.llm.common import WORD, cut_lineage, unused

#: Sources are few; their table is broadcast up to this many, and joined by a salted shuffle beyond.
BROADCAST_SOURCES = 100_000
SALTS = 64
#: Stands for a null id.
NO_ID = -(2**63)


def token_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, text: Column, seed: int) -> Column:
    """The first 15 hex digits of md5(doc_id '#' seed '#' md5(text)): uniform, the same in every run and engine, and others for other texts of one id."""
    return F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f"#{seed}#"), F.md5(F.coalesce(text, F.lit(""))))), 1, 15)


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Budgets by water filling. ``sources``: source, source_size. Adds target and rank (by code point, null last).

    Weights are dealt to the sources in order, repeating. The total is ``share`` of all sizes; no source gets over ``most`` times
    its size, and what it can't take goes to the others by weight. One row per source, so one task suffices.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    by_fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        sources.withColumn("w", w)
        .withColumn("cap", cap)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", level)
        .withColumn("level", F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level")))
        .withColumn("level", F.max("level").over(everything))  # later rows take off caps that aren't reached, so the first fit is the largest
        .withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("w")), F.col("cap")))
        .select("source", "source_size", "target")
    )


def source_cuts(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """One row per source: source_size, target, epochs (whole passes), cut_key and cut_id (last document of the partial pass; null: none), cut_n (how many of its equal rows are in the pass) and cut_of (of how many).

    ``sized``: doc_id, source, size, key. A row is in the partial pass if the middle of its words lies within what is left of the budget,
    so a source misses its target by half a document at most. Equal rows are added up before they are ordered.
    """
    rows = sized.count()
    digits = 2 if rows < 1_000_000 else 3 if rows < 100_000_000 else 4
    bucket = F.substring("key", 1, digits)
    slices = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("bucket_size"))
    slices = cut_lineage(slices)
    plan = targets(slices.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = cut_lineage(plan.withColumn("epochs", epochs).withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size")))
    in_source = Window.partitionBy("source").orderBy("bucket")
    starts = slices.withColumn("start", F.sum("bucket_size").over(in_source) - F.col("bucket_size"))
    of_plan = F.broadcast(plan.withColumnRenamed("source", "s")) if plan.count() <= BROADCAST_SOURCES else plan.withColumnRenamed("source", "s")
    starts = starts.join(of_plan, F.col("source").eqNullSafe(F.col("s"))).where("left > 0").select("source", "bucket", "bucket_size", "start", "left")
    # A bucket that ends within the budget is taken whole; the first one that doesn't holds the cut, unless its start is beyond already.
    whole = starts.where(F.col("start") + F.col("bucket_size") <= F.col("left")).groupBy("source").agg(F.max("bucket").alias("whole"))
    edge = starts.where((F.col("start") <= F.col("left")) & (F.col("start") + F.col("bucket_size") > F.col("left")))
    edge = cut_lineage(edge.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "start", "left"))
    inside = sized.withColumn("bucket", bucket).join(F.broadcast(edge) if plan.count() <= BROADCAST_SOURCES else edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    inside = inside.groupBy("source", "bucket", "key", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "size", "start", "left").agg(F.count("*").alias("rows"))
    in_bucket = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("start") + F.sum(F.col("size") * F.col("rows")).over(in_bucket) - F.col("size") * F.col("rows")
    fits = lambda n: F.col("before") + n * F.col("size") - F.col("size") / 2 <= F.col("left")  # noqa: E731  the middle of the n-th equal row
    n = F.floor((F.col("left") - F.col("before")) / F.greatest("size", F.lit(1)) + F.lit(0.5))
    n = F.when(fits(n + 1), n + 1).when(fits(n), n).otherwise(n - 1)
    taken = F.when(F.col("size") == 0, F.when(fits(F.lit(0)), F.col("rows")).otherwise(0)).otherwise(F.least("rows", n)).cast("long")
    last = inside.withColumn("before", before).withColumn("taken", taken).where("taken > 0").groupBy("source").agg(F.max(F.struct("key", "doc_id", "size", "taken", "rows")).alias("last"))
    out = plan
    for part in (whole, last):
        part = part.withColumnRenamed("source", "s")
        out = out.join(part, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    # ":" and "g" sort after all hex digits that follow in a key, so a bucket's name with it is a bound above all its keys.
    return out.select("source", "source_size", "target", "epochs", F.coalesce(F.col("last.key"), F.concat("whole", F.lit("g"))).alias("cut_key"), F.col("last.doc_id").alias("cut_id"), F.col("last.taken").alias("cut_n"), F.col("last.rows").alias("cut_of"))


def counted(rows: DataFrame, source: str, name: str) -> DataFrame:
    """``rows`` with ``name``: 1, 2, 3 ... in each source, as they lie. Numbers go by partitions of a checkpoint and one count a partition and source, so no task sees all rows of a source."""
    part, place = unused(rows, "count_part", "count_place")
    lying = cut_lineage(rows).withColumn(place, F.monotonically_increasing_id()).withColumn(part, F.shiftright(place, 33))
    counts = cut_lineage(lying.groupBy(source, part).agg(F.count("*").alias("rows")))
    before = F.sum("rows").over(Window.partitionBy(source).orderBy(part)) - F.col("rows")
    other = unused(rows, "count_source", "count_before")
    starts = counts.withColumn(other[1], before).select(F.col(source).alias(other[0]), F.col(part).alias(f"{part}_"), other[1])
    own = F.row_number().over(Window.partitionBy(part, source).orderBy(place))
    joined = lying.withColumn(name, own).join(starts, F.col(source).eqNullSafe(F.col(other[0])) & (F.col(part) == F.col(f"{part}_")))
    return joined.withColumn(name, F.col(name) + F.col(other[1])).drop(part, place, f"{part}_", *other)


def mix_sources(
    docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7, text: str = "text", source: str = "source", doc_id: str = "doc_id", sizes: bool = False
) -> DataFrame:
    """``docs`` with copies (how often the mix takes a document: 0, 1, 2 ...), source_size and target; with ``sizes``, also size.

    Null texts have size 0, a null source is a source of its own and comes last. Rows that agree in doc_id (null ids too) and text share
    one key; where a source's cut falls among them, as many of them as fit are taken once more. Other texts of one id have other keys. Long texts count whole; an empty table gives no rows.
    Columns of ``docs`` named like the added ones are replaced, others may have any names.
    """
    added = ("copies", "source_size", "target", *(("size",) if sizes else ()))
    docs = docs.drop(*[c for c in docs.columns if c in added])
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), token_count(F.col(text)).alias("size"), random_key(F.col(doc_id), F.col(text), seed).alias("key"))
    sized = cut_lineage(sized)
    cuts = cut_lineage(source_cuts(sized, weights, share, most))
    own = F.coalesce(F.col(doc_id), F.lit(NO_ID))
    key = random_key(F.col(doc_id), F.col(text), seed)
    s, k, i, e, n, salt, t = unused(docs.withColumns({c: F.lit(0) for c in added}), "mix_source", "mix_key", "mix_id", "mix_epochs", "mix_n", "mix_salt", "mix_turn")
    at_cut = (key == F.col(k)) & (own == F.coalesce(F.col(i), F.lit(NO_ID)))
    within = (key < F.col(k)) | ((key == F.col(k)) & (own <= F.coalesce(F.col(i), F.lit(NO_ID))))
    split = not cuts.where("cut_n < cut_of").isEmpty()  # a cut falls among equal rows
    cuts = cuts.select(F.col("source").alias(s), "source_size", "target", F.col("epochs").alias(e), F.col("cut_key").alias(k), F.col("cut_id").alias(i), F.when(F.col("cut_n") < F.col("cut_of"), F.col("cut_n")).alias(n))
    on = F.col(source).eqNullSafe(F.col(s))
    if cuts.count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(cuts), on)
    else:
        salted = docs.withColumn(salt, F.pmod(F.xxhash64(doc_id, text), F.lit(SALTS)))
        joined = salted.join(cuts.withColumn(t, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), on & (F.col(salt) == F.col(t)))
    shared = F.coalesce(at_cut & F.col(n).isNotNull(), F.lit(False))
    more = joined.where(shared) if split else None
    joined = (joined.where(~shared) if split else joined).withColumn("copies", (F.col(e) + F.coalesce(within.cast("long"), F.lit(0))).cast("long"))
    if split:
        turn = unused(more, "mix_turn")[0]
        more = counted(more, s, turn).withColumn("copies", (F.col(e) + (F.col(turn) <= F.col(n)).cast("long")).cast("long"))
        joined = joined.select(*docs.columns, "copies", "source_size", "target").unionByName(more.select(*docs.columns, "copies", "source_size", "target"))
    out = joined.select(*docs.columns, "copies", "source_size", "target")
    return out.withColumn("size", token_count(F.col(text))) if sizes else out


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as its copies say."""
    name = unused(mixed, "mix_copy")[0]
    rows = mixed.withColumn(name, F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))).otherwise(F.array())))
    return rows.drop(name, "copies", "source_size", "target")


def mix_report(docs: DataFrame) -> DataFrame:
    """The digest of the mix: doc_id, size, source_size, target, taken."""
    m = mix_sources(docs, sizes=True)
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: The same in DuckDB.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '#7#' || md5(coalesce(text, ''))), 1, 15) AS k
  FROM {docs}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT] AS w,
             source_size * 2.0::DOUBLE AS cap, CAST((SELECT sum(source_size) FROM s) AS DOUBLE) AS total FROM s),
l AS (SELECT *, (total * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, coalesce(least(cap, (SELECT max(level) FROM l WHERE level * w <= cap) * w), cap) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
p AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size / 2.0::DOUBLE AS middle
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
"""
MIX_REPORT_SQL = (MIX_SQL + "SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN middle <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM p").replace("{docs}", "documents")
