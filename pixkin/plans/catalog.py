"""Registry of the image engine's queries and their SQL twins.

The driver's tables hold no pictures, so operators run on stand-ins, over whole tables: a vector of 64 numbers is an 8 x 8 picture, events
are captures, pages are archive entries, order lines are edges. Each query says which.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixkin.config import MODES, TURNS
from pixkin.functions import bits, context, kernels, names, similarity, tables
from pixkin.operators import clusters, comparisons, pairs, results, validate
from pixkin.operators.skew import attach, cut, numbered
from pixkin.plans.analysis import metrics_of
from pixkin.plans.oracles import SQL

FLAGSHIP = "topk_per_item"
SETTINGS = MODES["sensitive"]
HASHES = [f"{h}{t}" for t in TURNS for h in "adp"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as records: a vector's 64 numbers are the grey values of an 8 x 8 picture. Hashes of four turns, brightness and a histogram by the engine's kernels; aspect and size from the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.asarray(b.column(1).flatten(), np.float64).reshape(-1, 64)
            gray = np.floor(np.clip((v + 1) * 127.5, 0, 255)).astype(np.uint8)
            made = kernels.hashes(gray.reshape(-1, 8, 8))
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(gray.mean(1) / 255), pa.array([g.tobytes() for g in gray], pa.binary()), pa.array(list(np.abs(v)), pa.list_(pa.float64())), *(pa.array(made[h]) for h in HASHES),
            ], ["vec_id", "luminance", "gray", "histogram", *HASHES])

    rows = read(spark, sf_dir, "embeddings").where(F.size("embedding") == 64).select("vec_id", "embedding")
    rows = rows.mapInArrow(run, "vec_id long, luminance double, gray binary, histogram array<double>, " + ", ".join(f"{h} long" for h in HASHES))
    return rows.withColumns({
        "archive": F.lit(""),
        "id": F.concat(F.lit("v"), F.lpad(F.col("vec_id").cast("string"), 9, "0")),
        "ord": F.col("vec_id"),
        "aspect": F.col("vec_id") % 5 * F.lit(0.1) + 1.0,
        "width": (F.col("vec_id") % 7 * 100 + 1000).cast("int"),
        "height": F.lit(800),
        "size": F.col("vec_id") % 11 * 1000,
    })


def ahash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average, difference and perceptual hashes as 16 hex digits, unturned and turned."""
    p = vector_pictures(spark, sf_dir)
    return p.select("vec_id", *(bits.to_hex(F.col(f"{h}{t}")).alias(f"{h}_hash_{t}") for h in "adp" for t in (0, 90)))


def turned_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashes of the other two turns, and how far each turn's are from the unturned ones."""
    p = vector_pictures(spark, sf_dir)
    return p.select("vec_id", *(bits.to_hex(F.col(f"{h}{t}")).alias(f"{h}_hash_{t}") for h in "adp" for t in (180, 270)), *(bits.hamming(F.col(f"{h}0"), F.col(f"{h}{t}")).alias(f"{h}_moves_{t}") for h in "adp" for t in TURNS[1:]))


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(vector_pictures(spark, sf_dir).select("id", "ord", "aspect", "luminance", *HASHES))


def found_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.candidate_pairs(hashed(spark, sf_dir), SETTINGS)


def shown(p: DataFrame) -> DataFrame:
    six = lambda c: F.round(F.col(c), 6).alias(c)
    return p.select(F.col("source.ord").alias("source"), F.col("target.ord").alias("target"), "turn", "a", "d", "p", six("aspect"), six("rank"))


def candidate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of vectors under the gate, with their best turn."""
    return shown(found_pairs(spark, sf_dir))


def topk_per_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs among the best of either end."""
    return shown(pairs.best_pairs(hashed(spark, sf_dir), SETTINGS))


def after(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows with the columns of the row that follows in the order of ``key`` (unique), as next_...; the last row has none and drops out."""
    rows = cut(numbered(df.select(key, *columns), [F.col(key)], "nth"))
    following = rows.select((F.col("nth") - 1).alias("nth"), *(F.col(c).alias(f"next_{c}") for c in (key, *columns)))
    return rows.join(following, "nth").drop("nth")


def hamming_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hamming distances of each vector's hashes to those of the next id."""
    rows = after(vector_pictures(spark, sf_dir), "vec_id", "a0", "d0", "p0")
    return rows.select("vec_id", *(bits.hamming(F.col(f"{h}0"), F.col(f"next_{h}0")).alias(f"{h}_distance") for h in "adp"))


def scored(spark: SparkSession, sf_dir: str, mode: str = "sensitive") -> DataFrame:
    """Best pairs with all metrics and their assessment, by the engine's own plan; vectors stand in for pictures of 8 x 8 pixels."""
    s, pictures = MODES[mode], cut(vector_pictures(spark, sf_dir))
    return ends_of(metrics_of(pairs.best_pairs(pictures, s), pictures, s, edge=8))


def ends_of(rows: DataFrame) -> DataFrame:
    """Adds the ids of vectors at both ends."""
    return rows.withColumns({f"{n}_ord": F.substring(f"{n}_id", 2, 9).cast("long") for n in ("source", "target")})


def assessed(r: DataFrame) -> DataFrame:
    return r.select(F.col("source_ord").alias("source"), F.col("target_ord").alias("target"), F.round("ssim", 6).alias("ssim"), F.round("histogram", 6).alias("histogram"), F.round("resolution", 6).alias("resolution"), "score", "category", "confidence", "strong")


def assess_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(scored(spark, sf_dir))


def assess_pairs_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(scored(spark, sf_dir, "balanced"))


def pair_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences that explain each assessment, in order."""
    return scored(spark, sf_dir).select(F.col("source_ord").alias("source"), F.col("target_ord").alias("target"), F.array_join("reasons", " | ").alias("reasons"))


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assessments by mode: one pair join under the widest gate, of whose pairs each mode keeps its own."""
    pictures, out = cut(vector_pictures(spark, sf_dir)), None
    wide = cut(pairs.candidate_pairs(pictures, MODES["sensitive"], kept=list(MODES.values())))
    for mode, s in MODES.items():
        best = pairs.best_partners(pairs.narrowed(wide, s), s.top_k)
        rows = ends_of(metrics_of(best, pictures, s, edge=8)).withColumn("mode", F.lit(mode))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("mode", "category", "confidence").agg(F.count("*").alias("pairs"), F.max("score").alias("best"), F.min("score").alias("worst"))


def legacy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate where every third record has no turned hashes: those meet unturned, or by the narrow way in for quarter turns."""
    p = vector_pictures(spark, sf_dir)
    known = F.col("vec_id") % 3 != 0
    p = p.withColumns({h: F.when(known, F.col(h)) for h in HASHES[3:]}).withColumn("aspect", F.when(F.col("vec_id") % 2 == 0, F.lit(1.5)).otherwise(F.lit(0.65)))
    return shown(pairs.candidate_pairs(cut(p.select("id", "ord", "aspect", "luminance", *HASHES)), SETTINGS))


def vector_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges among vectors (strong from 45 points, so that stand-ins have cores) and the pictures."""
    e = scored(spark, sf_dir).select("id", "source_id", "target_id", (F.col("score") >= 45).alias("strong"), "score", F.when(F.col("score") >= 45, "probable-duplicate").otherwise("needs-review").alias("category"), "turn")
    return cut(e), vector_pictures(spark, sf_dir).select("id", "width", "height", "size")


def complete_link_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate groups of vectors."""
    e, p = vector_edges(spark, sf_dir)
    g = clusters.duplicate_groups(e, p)
    return g.select("id", "reference_id", F.array_join("member_ids", ",").alias("members"), F.array_join("uncertain_ids", ",").alias("uncertain"), F.array_join("edge_ids", ",").alias("edges"), "status")


def resolved_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a review of those groups shows."""
    e, p = vector_edges(spark, sf_dir)
    e = e.withColumn("metadata", F.struct(F.when(F.col("score") % 7 == 0, "conflicts").otherwise("neutral").alias("status")))
    r = comparisons.resolve(clusters.duplicate_groups(e, p), e)
    return r.select("group_id", "candidate_id", "kind", "base_id", "direct", "tier", "turn", F.col("edge.score").alias("score"))


def histogram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of the event-type histograms of each user and the next one."""
    e = read(spark, sf_dir, "events")
    per = e.groupBy("user_id").agg(F.array(*[F.count_if(F.substring(F.md5("event_type"), 1, 1).isin(*k)).cast("double") for k in ("0123", "456", "789", "abc", "def")]).alias("h"))
    rows = after(per, "user_id", "h")
    return rows.select("user_id", F.col("next_user_id").alias("next_id"), F.round(similarity.bhattacharyya(F.col("h"), F.col("next_h")), 6).alias("overlap"))


def ssim_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural similarity of each vector and the next one, as 64 grey values, by the expression for arrays."""
    grey = F.transform("embedding", lambda x: F.floor(similarity.clamp((x.cast("double") + 1) * 127.5, 0.0, 255.0)).cast("double"))
    rows = after(read(spark, sf_dir, "embeddings").select("vec_id", grey.alias("gray")), "vec_id", "gray")
    return rows.select("vec_id", F.round(similarity.ssim(F.col("gray"), F.col("next_gray"), 64), 6).alias("ssim"))


def haversine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of suppliers of one nation to its first; places come from the keys."""
    place = lambda k: ((F.col(k) * 37 % 180 - 90).cast("double"), (F.col(k) * 73 % 360 - 180).cast("double"))
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    first = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("first"))
    d = context.haversine(*place("s_suppkey"), *place("first"))
    return s.join(first, "s_nationkey").select("s_suppkey", "first", F.round(d, 3).alias("metres"))


def metadata_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context of each event and the same user's next: time, place from the value, camera from the type."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    n = e.select("*", *(F.lead(c).over(w).alias(f"n_{c}") for c in ("event_id", "ts", "event_type", "value"))).where("n_event_id is not null")
    of = lambda p: {
        "latitude": F.when(F.col(f"{p}event_id") % 3 != 0, F.col(f"{p}event_id") % 2 * 0.0001), "longitude": F.when(F.col(f"{p}event_id") % 3 != 0, F.col(f"{p}event_id") % 5 * 0.02), "at": F.col(f"{p}ts"),
        "zoned": F.col(f"{p}event_id") % 2 == 0, "make": F.lit("Make"), "model": F.col(f"{p}event_type"),
    }
    c = context.context(of(""), of("n_"))
    return n.select("event_id", "n_event_id", F.explode(F.array(c)).alias("c")).select("event_id", "n_event_id", "c.status", "c.score", F.round("c.distance", 3).alias("distance"), "c.seconds", "c.same_camera")


def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as archive entries: the host is the archive, the address the name, an ending and sizes come from the id."""
    i = F.col("page_id")
    endings = F.array(*[F.lit(x) for x in (".jpg", ".PNG", ".txt", ".webp", "", ".tif", "/.hidden.gif", "/thumbs.db", ".bmp", "/../x.png", ".zip")])
    name = F.concat(F.regexp_replace("url", r"^[a-z]+://[^/]*/", ""), F.lit("-"), i.cast("string"), F.get(endings, F.when(i % 23 == 0, F.when(i % 46 == 0, 9).otherwise(10)).otherwise((i % 9).cast("int"))))
    host = F.regexp_extract("url", "^[a-z]+://([^/]*)", 1)
    size = F.when(i % 19 == 0, 0).otherwise(F.length("html")).cast("long")
    p = read(spark, sf_dir, "pages").select("page_id", host.alias("archive"), name.alias("filename"), (i % 31 == 0).alias("directory"), size.alias("uncompressed_size"), F.floor(size / (i % 120 + 1)).cast("long").alias("compressed_size"), (i % 97 == 5).alias("encrypted"))
    return p.withColumn("index", F.row_number().over(Window.partitionBy("archive").orderBy("page_id")) - 1)


def entry_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.check_entries(page_entries(spark, sf_dir)).select("page_id", "normal_path", "code", "skip", "format")


def archive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = validate.inspect(validate.check_entries(page_entries(spark, sf_dir)))
    return s.select("archive", "code", F.coalesce("at_index", F.lit(-1)).cast("int").alias("at_index"), "total_entries", "supported_images", "skipped_entries", "total_bytes", F.array_join("formats", ",").alias("formats"))


# Heads of files by kind, in hex.
HEADS = ["FFD8FFE0", "89504E470D0A1A0A00", "52494646000000005745425056", "474946383761", "474946383961", "424D0000", "49492A00", "4D4D002A", "000000186674797061766966", "00000018667479706D696631", "504B0304", "504B0506", "0000", "FFD8"]


def magic_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats and archive signatures of heads chosen by the part's size."""
    head = F.unhex(F.get(F.array(*[F.lit(h) for h in HEADS]), F.col("p_size") % len(HEADS)))
    p = read(spark, sf_dir, "part").select("p_partkey", head.alias("head"))
    return p.select("p_partkey", names.format_of_bytes(F.col("head")).alias("format"), names.is_zip(F.col("head")).alias("is_zip"))


def csv_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as cells, and formula-like starts made from ids."""
    text = F.concat(F.get(F.array(*[F.lit(x) for x in ("", "=", " +", "\t", "-", "@")]), (F.col("doc_id") % 6).cast("int")), F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(tables.cell(text, True)).alias("cell_md5"), F.length(tables.cell(text, True)).cast("long").alias("cell_length"))


def line_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as edges between parts and (as parts) suppliers."""
    kind = F.when(F.col("l_returnflag") == "R", "almost-certain-duplicate").when(F.col("l_returnflag") == "A", "probable-duplicate").when(F.col("l_linestatus") == "O", "needs-review").otherwise("probably-different")
    return read(spark, sf_dir, "lineitem").select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("id"), F.col("l_partkey").cast("string").alias("source_id"), F.col("l_suppkey").cast("string").alias("target_id"),
        (F.col("l_discount") >= 0.05).alias("strong"), F.col("l_quantity").cast("int").alias("score"), kind.alias("category"),
    )


def best_edge_per_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"))
    return clusters.best_edges(line_edges(spark, sf_dir), known).select("id", "source_id", "target_id", "strong", "score", "category")


def review_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best edges that matter and aren't held by a strong pair."""
    best = best_edge_per_pair(spark, sf_dir).where("category != 'probably-different'")
    held = best.where("strong").select("id")
    return best.join(held, "id", "left_anti").select("id", "source_id", "target_id", "score")


def reference_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of edge scores at both ends, and the best-placed image of each supplier's edges."""
    best = best_edge_per_pair(spark, sf_dir).withColumn("draft", F.col("target_id"))
    members = best.select("draft", F.explode(F.array("source_id", "target_id")).alias("image")).distinct()
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_size").alias("width"), F.lit(10).alias("height"), F.floor("p_retailprice").cast("long").alias("size"))
    return clusters.with_reference(members, best, parts).groupBy("draft", "reference").agg(F.count("*").alias("members"))


def decision_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as decisions: those of a source and language are the relations of its documents."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    own = F.when(F.col("n_chars") % 5 == 0, "different").when(F.col("n_chars") % 7 == 0, "later").when(F.col("n_chars") % 11 == 0, "duplicate").otherwise("unreviewed")
    of = F.when(F.col("toxic") == 1, "later").when(F.col("quality") == 0, "different").when(F.col("quality") == 1, "unreviewed")
    d = d.select("doc_id", "source", "lang", F.floor(F.col("n_chars") / 100).alias("page"), own.alias("own"), of.alias("relation"))
    rel = d.groupBy("source", "lang", "page").agg(results.relation_flags(F.col("relation")).alias("relations"), F.min("doc_id").alias("ref"), F.count("*").alias("n"))
    j = attach(d, rel, ["source", "lang", "page"], "n", max(1, d.count()))
    j = j.withColumn("decision", results.file_decision(F.col("own"), F.col("relations")))
    return j.select("doc_id", "decision", results.file_class(F.col("decision"), F.col("doc_id") != F.col("ref"), F.col("doc_id") == F.col("ref")).alias("category"))


def document_groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(images, comparisons with decisions): documents as images, in groups of one source and language whose smallest id is the reference."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    group = F.concat("source", F.lit("-"), "lang")
    d = d.withColumns({"id": F.col("doc_id").cast("string"), "name": F.concat(F.lit("name "), F.col("doc_id") % 10, F.lit("-"), "source"), "path": F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string")), "size": F.col("n_chars"), "group_id": group})
    ref = d.groupBy("group_id").agg(F.min("doc_id").alias("ref"))
    c = d.join(F.broadcast(ref), "group_id").where("doc_id != ref")  # a row a source and language
    category = F.when(F.col("quality") == 0, "needs-review").otherwise("probable-duplicate")
    resolved = c.select(
        "group_id", F.col("ref").cast("string").alias("reference_id"), F.col("id").alias("candidate_id"), F.col("doc_id").alias("place"), F.when(F.col("toxic") == 1, "manual-review").otherwise("strong").alias("tier"),
        F.struct((F.col("n_chars") % 101).alias("score"), category.alias("category")).alias("edge"), F.when(F.col("n_chars") % 3 == 0, "duplicate").otherwise("unreviewed").alias("decision"),
    )
    return d.select("id", "name", "path", "size"), resolved


def result_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search, facet, order and page over groups of documents."""
    images, resolved = document_groups(spark, sf_dir)
    found = results.search(images, resolved, text=" SRC1 ", facet="needs-review", sort="similarity-desc", tier="strong")
    return found.select("group_id", "tier", "reference_id", "candidates", "best_score")


def result_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of five groups in each of the six orders, by a facet of decisions."""
    images, resolved = document_groups(spark, sf_dir)
    out = None
    for sort in results.SORTS:
        rows = results.search(images, resolved, facet="duplicate", sort=sort, limit=5, offset=5).select(F.lit(sort).alias("sort"), "group_id", "tier", "reference_id", "candidates", "best_score")
        out = rows if out is None else out.unionByName(rows)
    return out


def result_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by tier, and what is shown when a tier without groups is asked for: the first one that has some."""
    images, resolved = document_groups(spark, sf_dir)
    counts = results.tier_counts(comparisons.presented(resolved)).select("tier", "groups")
    found = results.search(images, resolved, tier="low-priority", limit=None)
    return counts.unionByName(found.groupBy(F.concat(F.lit("shown "), "tier").alias("tier")).agg(F.count("*").alias("groups")))


def name_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names, base names, formats and sizes as text, of page addresses."""
    u = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", tables.file_name(u).alias("safe_name"), names.base_name(u).alias("base"), names.format_of_name(F.concat(u, F.lit(".JPeG"))).alias("format"), tables.report_stem(F.concat(u, F.lit(".ZIP"))).alias("stem"))


def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public codes and how often they come, for the findings of page entries."""
    e = entry_validation(spark, sf_dir).where("code is not null")
    public = validate.public_code(F.col("code"))
    return e.groupBy("code").agg(F.count("*").alias("entries")).select("code", public.alias("public"), validate.is_recoverable(public).alias("recoverable"), "entries")


def error_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FNV-1a ids of errors."""
    e = entry_validation(spark, sf_dir).where("code is not null")
    return e.select("page_id", validate.error_id(F.col("code"), F.col("normal_path"), F.lit("message")).alias("error_id"))


ALL = (
    ahash_embeddings, turned_hashes, hamming_neighbours, candidate_gate, topk_per_item, legacy_pairs, assess_pairs, assess_pairs_balanced, pair_reasons, category_counts, complete_link_groups, resolved_comparisons, histogram_similarity, ssim_pairs, haversine_pairs,
    metadata_context, entry_validation, archive_summary, magic_sniff, csv_escape, best_edge_per_pair, review_pairs, reference_scores, decision_rollup, result_query, result_orders, result_tiers, name_tools, error_codes, error_ids,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
