"""Sharding by Karmarkar-Karp differencing.

Groups of equal texts are indivisible. A partial partition is a tuple of k sums; the two with the largest spread are combined in
opposite order until one is left. Over many groups this runs in levels: hashed buckets of about FAN items each become k bundles by
differencing, bundles are the items of the next level, and the last level runs over what is left together with all heavy groups, so
that a group larger than a shard's share still gets a shard of its own.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixkin.llm.common import attach, cut_lineage

FAN = 2048
#: A group of over this share of one shard's mean goes to the last level by itself: there are at most shards / LARGE of them.
LARGE = 1 / 256


def karmarkar_karp(sizes: list[int], k: int) -> list[int]:
    """The part, 0 to k - 1, of each item; ties are broken by the items' order."""
    heap = [(-s, i, (s,) + (0,) * (k - 1), [[i]] + [[] for _ in range(k - 1)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a, of_a = heapq.heappop(heap)
        _, _, b, of_b = heapq.heappop(heap)
        merged = []
        for x, y, p, q in zip(a, reversed(b), of_a, reversed(of_b)):
            if len(p) < len(q):
                p, q = q, p
            p.extend(q)
            merged.append((x + y, p))
        merged.sort(key=lambda m: -m[0])
        n += 1
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], n, tuple(m[0] for m in merged), [m[1] for m in merged]))
    part = [0] * len(sizes)
    for j, items in enumerate(heap[0][3] if heap else []):
        for i in items:
            part[i] = j
    return part


def bundle(items: DataFrame, k: int) -> DataFrame:
    """items: item binary, bytes long, bucket long. Adds part int."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "item"], ascending=[False, True], ignore_index=True)
        return pdf.assign(part=np.array(karmarkar_karp(pdf["bytes"].tolist(), k), dtype="int32"))

    return items.groupBy("bucket").applyInPandas(one, "item binary, bytes long, bucket long, part int")


def split_groups(groups: DataFrame, k: int) -> DataFrame:
    """groups: item binary (unique), bytes long. Returns item, shard. Each level runs in tasks of about FAN items; only the last is one task."""
    n, total = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    limit = total * LARGE / k
    large, items, level, links = groups.where(F.col("bytes") > limit), groups.where(F.col("bytes") <= limit), 0, []
    fan = max(FAN, 4 * k)  # each level must leave fewer items than it had
    if n <= fan:
        large, items = groups, groups.where("false")
    while n > fan:
        buckets = -(-n // fan)
        parts = cut_lineage(bundle(items.withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(buckets))), k))
        owner = F.unhex(F.md5(F.concat(F.lit(f"{level}:"), F.col("bucket").cast("string"), F.lit(":"), F.col("part").cast("string"))))
        parts = parts.withColumn("owner", owner)
        links.append(parts.select("item", "owner"))
        items = parts.groupBy("owner").agg(F.sum("bytes").alias("bytes")).withColumnRenamed("owner", "item")
        n, level = buckets * k, level + 1
    last = bundle(large.select("item", "bytes").unionByName(items.select("item", "bytes")).withColumn("bucket", F.lit(0).cast("long")), k)
    found = cut_lineage(last.select("item", F.col("part").alias("shard")))
    for link in reversed(links):  # from bundles back to their items; large groups stand in the last level only
        inner = link.join(found.withColumnRenamed("item", "owner"), "owner").select("item", "shard")
        found = inner.unionByName(found)
    return found


def shard_documents(docs: DataFrame, *, shards: int = 8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), text_crc32, law 'bytes', shard, slot (gapless from 0 in each shard), grown_shard (null).

    Rows of equal texts share a shard; a null text is an empty one. Null or repeated doc_ids keep their rows. An empty table gives
    no rows, fewer groups than shards leave shards empty.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.unhex(F.md5(body)).alias("item"))
    rows = cut_lineage(rows)
    groups = cut_lineage(rows.groupBy("item").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    total = rows.count()
    placed = groups.select("item", "n").join(split_groups(groups.select("item", "bytes"), shards), "item")
    placed = attach(rows, placed, ["item"], "n", total)
    # Slots: ranks within slices of a shard plus the rows of the slices before.
    slices = max(16, total // shards // 4096)
    placed = cut_lineage(placed.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slices)).alias("slice")))
    counts = placed.groupBy("shard", "slice").agg(F.count("*").alias("rows"))
    starts = counts.withColumn("start", F.sum("rows").over(Window.partitionBy("shard").orderBy("slice")) - F.col("rows")).drop("rows")
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "slice").orderBy("doc_id", "size", "text_crc32")))
    slot = (F.col("start") + F.col("rank") - 1).cast("long").alias("slot")
    return ranked.join(starts, ["shard", "slice"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot, F.lit(None).cast("int").alias("grown_shard"))
