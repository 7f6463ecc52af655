"""Duplicate groups: complete-link cores, review pairs, references and order."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixkin.operators.graph import components
from pixkin.operators.skew import attach, cut, matched, numbered, release

CATEGORY_RANK = {"almost-certain-duplicate": 4, "probable-duplicate": 3, "needs-review": 2, "probably-different": 1}


def category_rank(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CATEGORY_RANK.items() for x in pair])
    return F.try_element_at(table, c)


def strength() -> list[Column]:
    """The order of edges, strongest first."""
    return [F.desc("strong"), F.desc("score"), F.desc(category_rank(F.col("category"))), F.asc("id")]


def best_edges(edges: DataFrame, images: DataFrame) -> DataFrame:
    """One edge for each unordered pair of known, different images: the strongest."""
    known = images.select(F.col("id").alias("known")).distinct()
    edges = edges.where("source_id != target_id")
    for end in ("source_id", "target_id"):
        edges = matched(edges, known, F.col(end) == F.col("known"), "left_semi")
    place = F.struct(~F.col("strong"), -F.col("score"), -category_rank(F.col("category")), "id")
    best = edges.groupBy(F.least("source_id", "target_id").alias("_a"), F.greatest("source_id", "target_id").alias("_b")).agg(F.min_by(F.struct(*edges.columns), place).alias("_best"))
    return best.select("_best.*")


#: Connected parts of the graph of clusters with so many pairs at most are finished by one task each (some 20 MB); larger ones go on in rounds.
FINISH_PAIRS = 100_000


def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    """cluster, core of one bounded part: pairs (x, y) of mergeable clusters, the best first, merge if all clusters of both sides are such pairs."""
    pdf = pdf.sort_values(["score", "kind", "id"], ascending=[False, False, True], kind="stable")
    linked: dict[str, set[str]] = {}
    for a, b in zip(pdf["x"], pdf["y"]):
        linked.setdefault(a, set()).add(b)
        linked.setdefault(b, set()).add(a)
    cluster = {n: {n} for n in linked}
    for a, b in zip(pdf["x"], pdf["y"]):
        x, y = cluster[a], cluster[b]
        if x is not y and all(y <= linked[m] for m in x):
            x |= y
            for m in y:
                cluster[m] = x
    return pd.DataFrame([(n, min(c)) for n, c in cluster.items()], columns=["cluster", "core"])


#: A round after which more than this share of the pairs is left did little; the next one takes off connected parts first.
STUCK = 0.7


def complete_link(edges: DataFrame) -> DataFrame:
    """image, core: clusters of two and more that merge, strongest edge first, only where all cross pairs are strong. core is the smallest image.

    ``edges``: strong best edges. Pairs of clusters with as many edges as members multiplied can merge; others never can, whatever they
    grow to, and go. Of those that can, a pair that is the best of both its clusters is merged by the ordered process too, since no merge
    elsewhere makes a better pair for either, so all such pairs merge at once and what they join is contracted, until FINISH_PAIRS are left for one task.
    Where a round merges few (equal edges, long chains), the next one takes off connected parts first: one in which every two clusters are a
    pair is one cluster, one of FINISH_PAIRS pairs at most is one task's work. Connected parts take many jobs, whose plans and statistics fill the driver.
    """
    a, b = F.least("source_id", "target_id"), F.greatest("source_id", "target_id")
    best = F.struct((-F.col("score")).alias("score"), (-category_rank(F.col("category"))).alias("kind"), F.col("id").alias("id"))
    pairs = cut(edges.select(a.alias("x"), b.alias("y"), best.alias("best"), F.lit(1).cast("long").alias("n")))
    ends = lambda p: p.select("x", "y", "best").unionByName(p.select(F.col("y").alias("x"), F.col("x").alias("y"), "best"))
    flat = lambda p, root: p.select(root, "x", "y", (-F.col("best.score")).alias("score"), (-F.col("best.kind")).alias("kind"), F.col("best.id").alias("id"))
    by_task = lambda p: p.groupBy("root").applyInPandas(greedy, "cluster string, core string")
    owner = cut(ends(pairs).select(F.col("x").alias("image"), F.col("x").alias("core")).distinct())
    images, count, stuck = owner.count(), pairs.count(), False
    while count:
        large, merged = pairs, None
        if count <= FINISH_PAIRS:
            large, merged = None, by_task(flat(pairs, F.lit(0).alias("root")))
        elif stuck:
            large, merged = parts_of(pairs, count, lambda p: by_task(flat(p, F.col("root"))))
        if large is not None:
            choice = ends(large).groupBy("x").agg(F.min_by("y", "best").alias("y"))
            mutual = matched(choice, choice.select(F.col("x").alias("y"), F.col("y").alias("x")), ["x", "y"]).where("x < y")
            met = cut(mutual.select(F.explode(F.array("x", "y")).alias("cluster"), F.col("x").alias("core")))
        step = cut(merged if large is None else met if merged is None else merged.unionByName(met))
        moved = matched(owner.groupBy("core").agg(F.count("*").alias("n")), step.withColumnRenamed("core", "to"), F.col("core") == F.col("cluster"), "left").select("core", "n", F.coalesce("to", "core").alias("to"))
        owner = cut(attach(owner, moved, ["core"], "n", max(1, images), shuffled=True).select("image", F.col("to").alias("core")))
        if large is None:
            break
        for end in ("x", "y"):
            large = matched(large, met.select(F.col("cluster").alias(end), F.col("core").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        large = large.where("x != y").groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        sizes = owner.groupBy("core").agg(F.count("*").alias("size"))
        for end in ("x", "y"):
            large = matched(large, sizes.select(F.col("core").alias(end), F.col("size").alias(f"{end}_size")), end)
        pairs = cut(large.where("n = x_size * y_size").select("x", "y", "best", "n"))
        before, count = count, pairs.count()
        stuck = count > before * STUCK
        release(edges.sparkSession)
    members = owner.groupBy("core").agg(F.count("*").alias("n")).where("n > 1")
    return attach(owner, members, ["core"], "n", max(1, images), shuffled=True).select("image", "core")


def parts_of(pairs: DataFrame, count: int, finished: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(pairs of large connected parts, cluster and core of the others): a part that is a whole is one cluster, a small one is ``finished`` by a task."""
    part = components(pairs.select(F.col("x").alias("a"), F.col("y").alias("b")))
    nodes = part.groupBy("root").agg(F.count("*").alias("nodes"))
    rooted = matched(pairs, part.withColumnRenamed("node", "x"), "x")
    parts = cut(matched(rooted.groupBy("root").agg(F.count("*").alias("pairs")), nodes, "root"))
    placed = cut(attach(rooted, parts, ["root"], "pairs", count, ready=True, shuffled=True))
    whole = F.col("pairs") * 2 == F.col("nodes") * (F.col("nodes") - 1)
    small = placed.where(~whole & (F.col("pairs") <= FINISH_PAIRS))
    merged = placed.where(whole).select(F.explode(F.array("x", "y")).alias("cluster"), F.col("root").alias("core")).distinct()
    return placed.where(~whole & (F.col("pairs") > FINISH_PAIRS)).select("x", "y", "best", "n"), merged.unionByName(finished(small))


def with_reference(members: DataFrame, edges: DataFrame, images: DataFrame) -> DataFrame:
    """Adds reference to (draft, image) rows: highest sum of edge scores, then pixels, bytes, smallest id. ``edges``: draft, source_id, target_id, score."""
    ends = edges.select("draft", "score", F.explode(F.array("source_id", "target_id")).alias("image")).groupBy("draft", "image").agg(F.sum("score").alias("total"))
    facts = images.select(F.col("id").alias("image"), (F.coalesce("width", F.lit(0)) * F.coalesce("height", F.lit(0))).alias("pixels"), F.coalesce("size", F.lit(0)).alias("bytes")).dropDuplicates(["image"])
    ranked = matched(matched(members, ends, ["draft", "image"], "left"), facts, "image", "left")
    place = F.struct(-F.coalesce("total", F.lit(0)), -F.coalesce("pixels", F.lit(0)), -F.coalesce("bytes", F.lit(0)), "image")
    first = ranked.groupBy("draft").agg(F.min_by("image", place).alias("reference"))
    return matched(members.select("draft", "image"), first, "draft").select("draft", "image", "reference")


def duplicate_groups(edges: DataFrame, images: DataFrame, apart: bool | None = None) -> DataFrame:
    """id, reference_id, member_ids, uncertain_ids, edge_ids, status: cores, and a pair for each other edge that isn't 'probably-different'.

    ``edges``: id, source_id, target_id, strong, score, category; ``images``: id, width, height, size. Groups are numbered in each
    archive if edges have an archive; ids begin with what tells it ``apart`` (None: where there are several).
    """
    edges = edges if "archive" in edges.columns else edges.withColumn("archive", F.lit(""))
    relevant = best_edges(edges, images).where("category != 'probably-different'").select("id", "source_id", "target_id", "strong", "score", "category", "archive")
    relevant = cut(relevant)
    cores = cut(complete_link(relevant.where("strong")))
    inside = matched(relevant, cores.select(F.col("image").alias("source_id"), F.col("core").alias("draft")), "source_id")
    inside = matched(inside, cores.select(F.col("image").alias("target_id"), F.col("core").alias("draft")), ["target_id", "draft"])
    inside = cut(inside.select("draft", "id", "source_id", "target_id", "score", "strong", "category", "archive"))
    review = matched(relevant, inside.select("id"), "id", "left_anti").withColumn("draft", F.concat(F.lit("edge\0"), F.col("id")))
    of_core = with_reference(cores.select(F.col("core").alias("draft"), "image"), inside, images)
    of_pair = with_reference(review.select("draft", F.explode(F.array("source_id", "target_id")).alias("image")), review, images)
    others = lambda: F.array_sort(F.collect_list(F.when(F.col("image") != F.col("reference"), F.col("image"))))
    none = F.array().cast("array<string>")
    core_groups = of_core.groupBy("draft", "reference").agg(others().alias("rest")).select("draft", F.col("reference").alias("reference_id"), F.concat(F.array("reference"), "rest").alias("member_ids"), none.alias("uncertain_ids"))
    core_groups = matched(core_groups, inside.groupBy("draft").agg(F.array_sort(F.collect_list("id")).alias("edge_ids"), F.min("archive").alias("archive")), "draft")
    pair_groups = of_pair.groupBy("draft", "reference").agg(others().alias("rest")).select("draft", F.col("reference").alias("reference_id"), F.array("reference").alias("member_ids"), F.col("rest").alias("uncertain_ids"))
    pair_groups = matched(pair_groups, review.select("draft", F.array("id").alias("edge_ids"), "strong", "score", "category", "id", "archive"), "draft")
    first = core_groups.select("*", F.lit(0).alias("kind"), F.lit(True).alias("strong"), F.lit(0).alias("score"), F.lit("").alias("category"), F.col("draft").alias("id"))
    every = first.unionByName(pair_groups.withColumn("kind", F.lit(1)))
    # Numbers follow the reference's order; among equals cores come first, then pairs by strength.
    every = numbered(every, [F.col("archive"), F.col("reference_id"), F.col("kind"), *strength()], "number")
    starts = cut(every.groupBy("archive").agg(F.min("number").alias("start"), F.count("*").alias("n")))
    every = attach(every, starts, ["archive"], "n", max(1, every.count()), ready=True, shuffled=True)
    prefix = F.concat(F.substring(F.sha2("archive", 256), 1, 8), F.lit("-group-")) if (starts.limit(2).count() > 1 if apart is None else apart) else F.lit("group-")
    return every.withColumn("group_id", F.concat(prefix, (F.col("number") - F.col("start") + 1).cast("string"))).select(F.col("group_id").alias("id"), "reference_id", "member_ids", "uncertain_ids", "edge_ids", F.lit("unreviewed").alias("status"))
