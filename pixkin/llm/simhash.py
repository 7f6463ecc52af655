"""SimHash near-duplicates by vantage-point trees.

Distinct fingerprints are partitioned by their Hamming distances to vantage points: the upper levels of one tree, grown on a bounded
sample, deal them to shards. A fingerprint goes to its home shard, and as a query to each later shard whose side of a boundary the
triangle inequality can't exclude. Inside a shard the tree goes on in memory. Each shard returns a spanning forest of its links, and
components are merged by distributed contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixkin.llm.common import attach, cut_lineage, small_batches
from pixkin.operators.graph import components

SEED = 42
#: Home rows that a shard should have, and the deepest tree that deals to shards.
SHARD_ROWS, MOST_LEVELS = 2048, 15
#: Fingerprints for each shard that the tree's upper levels are grown on (4 MB in all at most); all fingerprints are then dealt by it.
SHARD_SAMPLE = 16
#: Home rows and asking rows of a shard that one task takes; larger shards are dealt out in blocks.
HOME_ROWS, ASK_ROWS = 8192, 65_536
LEAF = 96


def shingle_hashes(text: str | None, width: int = 3) -> list[int]:
    """XXH64 of each shingle of ``width`` words, in order; of the whole sequence if it has fewer; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :])]


def majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A bit is 1 if set in over half the hashes from one start to the next; no segment is empty."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    counts = np.diff(np.append(starts, len(hashes)))
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").reshape(-1, 8).view("<u8").ravel()


def fingerprints_of(texts: list[str | None], width: int = 3) -> np.ndarray:
    out, hashes, starts, rows = np.zeros(len(texts), np.uint64), [], [], []

    def flush() -> None:
        if rows:
            out[rows] = majority(np.array(hashes, np.uint64), np.array(starts))
            for x in (hashes, starts, rows):
                x.clear()

    for i, t in enumerate(texts):
        if h := shingle_hashes(t, width):
            rows.append(i)
            starts.append(len(hashes))
            hashes.extend(h)
            if len(hashes) > 100_000:
                flush()
    flush()
    return out


def fingerprint(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", width: int = 3) -> DataFrame:
    """doc_id long, fp long (the 64 bits as a signed number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints_of(b.column(1).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class Tree:
    """Vantage points and radii of a full binary tree, root first: left has distances below the radius."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.levels = levels
        self.points, self.radii = np.zeros(max(1, 2**levels - 1), np.uint64), np.zeros(max(1, 2**levels - 1), np.int64)
        rng = np.random.default_rng(7)
        parts = {0: sample}
        for node in range(2**levels - 1):
            part = parts.pop(node, sample[:0])
            self.points[node] = part[rng.integers(len(part))] if len(part) else rng.integers(2**63, dtype=np.uint64)
            d = np.bitwise_count(part ^ self.points[node]).astype(np.int64)
            self.radii[node] = balanced_radius(d)
            parts[2 * node + 1], parts[2 * node + 2] = part[d < self.radii[node]], part[d >= self.radii[node]]

    def route(self, fp: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, shards and whether the shard is the row's home: all shards within ``reach`` of a row, by the triangle bound."""
        rows, nodes, home = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.ones(len(fp), bool)
        for _ in range(self.levels):
            d = np.bitwise_count(fp[rows] ^ self.points[nodes]).astype(np.int64)
            r = self.radii[nodes]
            left, right = d - reach < r, d + reach >= r
            is_left = d < r
            rows, nodes, home = (
                np.concatenate([rows[left], rows[right]]),
                np.concatenate([2 * nodes[left] + 1, 2 * nodes[right] + 2]),
                np.concatenate([(home & is_left)[left], (home & ~is_left)[right]]),
            )
        return rows, nodes - (2**self.levels - 1), home


def balanced_radius(d: np.ndarray) -> int:
    """The radius that halves the distances best."""
    if not len(d):
        return 32
    below = np.cumsum(np.bincount(d, minlength=65))[:65]
    return int(np.argmin(np.abs(below - len(d) / 2))) + 1


def near_pairs(data: np.ndarray, queries: np.ndarray, reach: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (query, data) index pairs within ``reach``, in blocks: a vantage-point tree over ``data`` built while it is searched."""
    stack = [(np.arange(len(data)), np.arange(len(queries)))]
    while stack:
        own, ask = stack.pop()
        if not len(own) or not len(ask):
            continue
        if len(own) > LEAF:
            point = data[own[rng.integers(len(own))]]
            d, e = np.bitwise_count(data[own] ^ point).astype(np.int64), np.bitwise_count(queries[ask] ^ point).astype(np.int64)
            r = balanced_radius(d)
            left = d < r
            if 0 < left.sum() < len(own):
                stack.append((own[left], ask[e - reach < r]))
                stack.append((own[~left], ask[e + reach >= r]))
                continue
        step = max(1, 400_000 // len(own))
        for i in range(0, len(ask), step):
            q, x = np.nonzero(np.bitwise_count(queries[ask[i : i + step], None] ^ data[None, own]) <= reach)
            if len(q):
                yield ask[i + q], own[x]


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels with the links a-b added: each node points to the smallest of its component."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (jumped := label[label]).tobytes() != label.tobytes():
            label = jumped


def links(nodes: DataFrame, reach: int) -> DataFrame:
    """a, b (names): a forest that spans all pairs of different fingerprints within ``reach``. nodes: fp long (unique), name long (unique; what the result names them by).

    The sample that the tree is grown on grows with its levels, so leaves hold like numbers of rows. A shard that is still too large (many
    fingerprints at one distance of every point) is cut into blocks: parts of its home rows, each with all parts of its asking rows.
    """
    count = nodes.count()
    levels = int(np.clip(np.ceil(np.log2(max(1, count / SHARD_ROWS))), 0, MOST_LEVELS))
    sample = nodes.orderBy(F.xxhash64("fp"), "fp").select("fp").limit(SHARD_SAMPLE << max(levels, 9)).toArrow()["fp"].to_numpy().view(np.uint64) if levels else np.zeros(0, np.uint64)
    tree = nodes.sparkSession.sparkContext.broadcast(Tree(sample, levels))  # 2^MOST_LEVELS points

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, name = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i in range(0, len(fp), 20_000):
                part, names = fp[i : i + 20_000], name[i : i + 20_000]
                rows, shard, home = tree.value.route(part.view(np.uint64), reach)
                first = np.empty(len(part), np.int64)
                first[rows[home]] = shard[home]
                keep = home | (shard > first[rows])  # a pair meets once: in the later of its two shards
                yield pa.RecordBatch.from_arrays([pa.array(shard[keep].astype(np.int32)), pa.array(part[rows[keep]]), pa.array(names[rows[keep]]), pa.array(home[keep])], ["shard", "fp", "name", "home"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fp")
        both, at = np.unique(pdf["fp"].to_numpy(np.int64), return_index=True)
        name = pdf["name"].to_numpy(np.int64)[at]
        places = [np.searchsorted(both, np.unique(pdf.loc[pdf[c], "fp"].to_numpy(np.int64))) for c in ("home", "ask")]
        own, asks = places
        label = np.arange(len(both))
        for q, d in near_pairs(both[own].view(np.uint64), both[asks].view(np.uint64), reach, np.random.default_rng(11)):
            label = unite(label, asks[q], own[d])
        linked = label != np.arange(len(both))
        return pd.DataFrame({"a": name[linked], "b": name[label[linked]]})

    dealt = cut_lineage(nodes.select("fp", "name").mapInArrow(deal, "shard int, fp long, name long, home boolean"))
    sizes = dealt.groupBy("shard").agg(F.ceil(F.count_if("home") / HOME_ROWS).cast("int").alias("parts"), F.ceil(F.count("*") / ASK_ROWS).cast("int").alias("turns"))
    placed = dealt.join(F.broadcast(sizes.where("parts > 0")), "shard")  # a row a shard; without home rows nothing can meet
    own = F.when(F.col("home"), F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    turn = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("turns")).cast("int")
    cells = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.transform(F.sequence(F.lit(0), F.col("turns") - 1), lambda t: F.struct(p.alias("part"), t.alias("turn"), F.coalesce(p == own, F.lit(False)).alias("home"), (t == turn).alias("ask"))))))
    blocks = placed.select("shard", "fp", "name", cells.alias("c")).where("c.home or c.ask").select("shard", "c.part", "c.turn", "fp", "name", "c.home", "c.ask")
    return blocks.groupBy("shard", "part", "turn").applyInPandas(join, "a long, b long")


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", width: int = 3, reach: int = 2) -> DataFrame:
    """doc_id, fp long, component_id (the smallest doc_id that links of ``reach`` bits or fewer lead to).

    Texts without words (null, empty) have fingerprint zero and link like any other. Each row is returned, repeated or null ids too;
    null ids are passed over as component_id unless a component has no other (then it is null). An empty table gives no rows.
    """
    rows = cut_lineage(fingerprint(docs, text=text, doc_id=doc_id, width=width))
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    found = components(links(nodes.select("fp", F.col("fp").alias("name")), reach))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = cut_lineage(rooted)
    roots = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("fps"))
    labelled = attach(rooted, roots, ["root"], "fps", max(1, rooted.count())).select("fp", "n", "component_id")
    return attach(rows, labelled, ["fp"], "n", max(1, rows.count())).select("doc_id", "fp", "component_id")


def simhash_report(docs: DataFrame) -> DataFrame:
    """The digest: doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
