"""Connected components by contraction, distributed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixkin.operators.skew import HEAVY_SHARE, attach, cut, matched, release


#: What contraction leaves is finished by one task once it has so few edges (a few MB, whatever the graph's size was).
FINISH_EDGES = 100_000


def finished(edges: DataFrame) -> DataFrame:
    """node, root of at most FINISH_EDGES edges (a < b), by union and find in one task."""
    kind = dict(edges.dtypes)["a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def find(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        type_ = None
        for b in batches:
            type_ = b.schema.field(0).type
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, y = find(up.setdefault(x, x)), find(up.setdefault(y, y))
                up[max(x, y)] = min(x, y)
        if up:
            yield pa.RecordBatch.from_arrays([pa.array(list(up), type_), pa.array([find(x) for x in up], type_)], ["node", "root"])

    return edges.coalesce(1).mapInArrow(run, f"node {kind}, root {kind}")


def followed(pointer: DataFrame) -> DataFrame:
    """Pointers (node, root) moved to where their roots point, until none moves. A root that very many nodes share is looked up once."""
    total = pointer.count()
    while True:
        step = pointer.select(F.col("node").alias("root"), F.col("root").alias("next"))
        sizes = pointer.groupBy("root").agg(F.count("*").alias("n"))
        most = sizes.agg(F.max("n")).first()[0]
        onward = matched(pointer, step, "root") if most <= total * HEAVY_SHARE else attach(pointer, matched(sizes, step, "root"), ["root"], "n", total, shuffled=True)
        moved = cut(onward.select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        pointer = moved.select("node", "root")
        if moved.where("moved").isEmpty():
            return pointer


def composed(first: DataFrame, then: DataFrame) -> DataFrame:
    """Pointers of ``first`` moved on to where ``then`` points, if it has their roots."""
    step = then.select(F.col("node").alias("root"), F.col("root").alias("next"))
    used = first.groupBy("root").agg(F.count("*").alias("n"))
    used = matched(used, step, "root", "left").select("root", F.coalesce("next", "root").alias("next"), "n")
    return cut(attach(first, used, ["root"], "n", first.count(), shuffled=True).select("node", F.col("next").alias("root")))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of the component, for every node with an edge to another. edges: a, b of one ordered type.

    A round points every node at its smallest neighbour, doubles the pointers up to their ends and contracts what they join. Nodes with
    very many edges and roots with very many nodes are joined by ``attach``, so neither makes a hot task.
    """
    edges = cut(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    out = None
    while count := edges.count():
        if count <= FINISH_EDGES:
            pointer = cut(finished(edges))
            return composed(out, pointer) if out is not None else pointer
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(ends.groupBy("a").agg(F.min("b").alias("b"), F.count("*").alias("n")))
        pointer = followed(least.select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
        ranked = cut(matched(pointer, least.select(F.col("a").alias("node"), "n"), "node"))
        side = lambda c, name: ranked.select(F.col("node").alias(c), F.col("root").alias(name), "n")  # noqa: E731, B023
        joined = attach(attach(edges, side("a", "x"), ["a"], "n", 2 * count, ready=True, shuffled=True).drop("n"), side("b", "y"), ["b"], "n", 2 * count, ready=True, shuffled=True).where("x != y")
        edges = cut(joined.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        out = composed(out, pointer) if out is not None else pointer
        release(edges.sparkSession)
    return out if out is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
