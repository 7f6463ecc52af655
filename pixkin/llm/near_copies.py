"""One document of each group of near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Two searches propose pairs and an exact check of the whole sets decides. The vantage-point trees of the SimHash operator link
fingerprints of five-word shingles within REACH bits. At a similarity of 0.8 fingerprints lie about ten bits apart and up to twenty,
where no triangle bound prunes anything, so what lies beyond REACH is found by prefixes, without a missed pair: of two such sets each
holds a shingle of the other among its first fifth and one, in any order that all sets share (common shingles come last). Pairs are
bounded by their sizes and by sketches of SKETCH x 64 parities (the Hamming distance of two is never over the number of shingles that
one set has and the other lacks). Groups are the connected components of the links.

Members of a shingle are first checked against one hub, the member that meets most others, which joins most of a large group; only
members that are still apart are then compared pair by pair, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixkin.llm import simhash
from pixkin.llm.common import attach, cut_lineage, small_batches, unused
from pixkin.llm.simhash import majority, shingle_hashes
from pixkin.operators.graph import components, composed
from pixkin.operators.skew import release, scratch

WIDTH = 5
#: Bits within which the vantage-point trees link fingerprints.
REACH = 3
SKETCH = 8
#: Documents whose shingles are counted for the order, at least, and as a share of all. The order decides the work, never the result.
COUNTED_ROWS, COUNTED_SHARE = 20_000, 0.01
#: Common shingles that travel to the executors (3 MB).
COMMON_SHINGLES = 200_000
#: Bits of the filter of wanted sets (8 MB at most). Beyond, more sets are read than are wanted; the join drops them.
FILTER_BITS = 1 << 26
#: Members of a shingle that are compared at once, and checks that share a copy of a hub's set; larger ones are dealt out in blocks.
BLOCK, SHARED_CHECKS = 512, 512
#: Checks from which on they go in one more round, and the rounds at most: a round makes sets from all texts again, and saves disk.
ROUND_CHECKS, MOST_ROUNDS = 10_000, 4
#: Sets of more shingles fill the sketch, which then tells nothing of them: LONG_BITS parities of theirs are compared before they travel whole.
LONG_SET, LONG_BITS = 768, 1 << 14
BITS = [f"b{i}" for i in range(SKETCH)]


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, WIDTH), np.uint64))


def name_of(shingles: np.ndarray) -> int:
    """64 bits that stand for a set; two sets with equal bits count as equal."""
    return xxhash.xxh64_intdigest(shingles.tobytes()) - 2**63


def parities(shingles: np.ndarray, bits: int = 64 * SKETCH) -> np.ndarray:
    """Whether each of the sketch's bits is hit an odd number of times."""
    odd = np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def outline(shingles: np.ndarray) -> bytes:
    """A set's size, and of a long one LONG_BITS parities (2 KB, where such a set takes 6 KB and more)."""
    size = np.array([len(shingles)], np.int64)
    return (np.concatenate([size, parities(shingles, LONG_BITS)]) if len(shingles) > LONG_SET else size).tobytes()


def outlines_may_be_near(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether a similarity of 0.8 is possible: that many bits at most differ as one set has shingles that the other lacks."""
    return len(x) != len(y) or len(x) == 1 or 9 * int(np.bitwise_count(x[1:] ^ y[1:]).sum()) <= int(x[0] + y[0])


def sets_are_near(x: np.ndarray, y: np.ndarray) -> bool:
    return 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y))


def prefix(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first fifth and one of a set, as (shingles that aren't common, by their hashes; common ones, by their counts)."""
    n = len(shingles)
    if not n:
        return shingles, shingles
    weight = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        weight = np.where(common[at] == shingles, counts[at], 0)
    first = np.lexsort((shingles, weight))[: n // 5 + 1]
    rare = weight[first] == 0
    return shingles[first[rare]], shingles[first[~rare]]


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of the counted documents have, sorted, and how many of them do: the COMMON_SHINGLES most common."""
    share = max(COUNTED_SHARE, COUNTED_ROWS / max(1, docs.count()))
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(min(1.0, share) * 1_000_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py()).view(np.int64))], ["shingle"])

    found = sample.select("text").distinct().mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    rows = found.orderBy(F.desc("n"), "shingle").limit(COMMON_SHINGLES).toArrow()
    common, counts = rows["shingle"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(common)
    return common[order], counts[order]


def shapes(docs: DataFrame) -> DataFrame:
    """doc_id, digest, node (the name of the row's shingle set), size, fp (SimHash), the sketch's longs, rare and common (the prefix) of each row. docs: doc_id, digest, text.

    A task gives the prefix of a set that it has met before as empty.
    """
    order = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = order.value
        met: set[int] = set()
        nothing = np.zeros(0, np.uint64)
        for b in batches:
            names, sizes, fps, bits, rare, usual = [], [], [], [], [], []
            for t in b.column(2):
                hashes = np.array(shingle_hashes(t.as_py(), WIDTH), np.uint64)
                s = np.unique(hashes)
                names.append(name_of(s))
                sizes.append(len(s))
                fps.append(int(majority(hashes, np.zeros(1, np.int64)).view(np.int64)[0]) if len(hashes) else 0)
                bits.append(parities(s))
                first = (nothing, nothing) if names[-1] in met else prefix(s, common, counts)
                met.add(names[-1])
                rare.append(first[0].view(np.int64))
                usual.append(first[1].view(np.int64))
            bits = np.array(bits, np.int64).reshape(len(names), SKETCH)
            longs = [pa.array(x, pa.int64()) for x in (names, sizes, fps)] + [pa.array(np.ascontiguousarray(bits[:, i])) for i in range(SKETCH)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *longs, pa.array(rare, pa.list_(pa.int64())), pa.array(usual, pa.list_(pa.int64()))], ["doc_id", "digest", "node", "size", "fp", *BITS, "rare", "common"])

    return docs.mapInArrow(run, f"doc_id long, digest string, node long, size long, fp long, {', '.join(f'{c} long' for c in BITS)}, rare array<long>, common array<long>")


def shared_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (shingle, node) in order: the rows of shingles that two nodes or more have, each once, by a stream that holds one batch."""
    last = first = before = None
    shown = False  # the open run's first node has been given out
    for b in batches:
        s, n = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(s):
            continue
        new = np.append(s[0] != last, s[1:] != s[:-1])
        starts = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        heads = n[starts]
        head = np.where(run >= 0, heads[run] if len(heads) else n, n if first is None else first)
        other = n != head
        again = np.append(s[0] == last and n[0] == before, (s[1:] == s[:-1]) & (n[1:] == n[:-1]))
        late = np.unique(run[other])  # runs whose first node is to be shown
        out = [(s[other & ~again], n[other & ~again])]
        own = late[late >= 0]
        out.append((s[starts[own]], heads[own]))
        if len(late) and late[0] < 0 and not shown:
            out.append((np.array([last]), np.array([first])))
        if len(starts):
            shown = bool(len(late) and late[-1] == len(starts) - 1)
            first = heads[-1]
        else:
            shown = shown or bool(len(late))
        last, before = s[-1], n[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out]), pa.int64()) for i in (0, 1)], ["shingle", "node"])


def meeting(rows: DataFrame) -> DataFrame:
    """shingle, node: the prefixes' shingles that two sets or more share, each pair once.

    A shingle that isn't common met one of the counted documents at most, so few documents have it: those are dealt by shingle, sorted
    and streamed. Common ones may be hot: they are counted before they are shuffled, and their heads (COMMON_SHINGLES at most) travel.
    """
    dealt = rows.select(F.explode("rare").alias("shingle"), "node").repartition("shingle").sortWithinPartitions("shingle", "node")
    rare = dealt.mapInArrow(shared_runs, "shingle long, node long")
    usual = rows.select(F.explode("common").alias("shingle"), "node").distinct()
    several = usual.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").select("shingle")
    return rare.unionByName(usual.join(F.broadcast(several), "shingle"))


def may_be_near(x: str, y: str) -> Column:
    """Whether sizes and sketches leave room for a similarity of 0.8: shared shingles are 4/9 of both sizes or more."""
    c = lambda side, name: F.col(f"{side}{name}")
    apart = sum((F.bit_count(c(x, b).bitwiseXOR(c(y, b))) for b in BITS[1:]), F.bit_count(c(x, BITS[0]).bitwiseXOR(c(y, BITS[0]))))
    small, large = F.least(c(x, "size"), c(y, "size")), F.greatest(c(x, "size"), c(y, "size"))
    return (5 * small >= 4 * large) & (9 * apart <= small + large)


def facts(nodes: DataFrame, side: str, key: str) -> DataFrame:
    return nodes.select(F.col("node").alias(key), *(F.col(c).alias(f"{side}{c}") for c in ("size", *BITS)))


def plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (node, hub) that their sizes and sketches allow, each once. Hubs may have many pairs."""
    pairs = cut_lineage(pairs.where("node != hub").distinct())
    of_hub = pairs.groupBy("hub").agg(F.count("*").alias("n")).join(facts(nodes, "y_", "hub"), "hub")
    both = attach(pairs.join(facts(nodes, "x_", "node"), "node"), of_hub, ["hub"], "n", max(1, pairs.count()))
    return cut_lineage(both.where(may_be_near("x_", "y_")).select("node", "hub"))


def filter_of(nodes: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap that has the places of all wanted nodes, and its number of bits."""
    bits = int(min(FILTER_BITS, max(1 << 10, 1 << (256 * nodes.count()).bit_length())))
    place = F.pmod("node", F.lit(bits))
    words = nodes.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(node, {bits}) & 63 as int))")).alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy()] = words["mask"].to_numpy()
    return out.view(np.uint64), bits


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (node, hub; each once) whose whole sets have a similarity of 0.8 or more.

    The sketch's bits tell long sets nothing: unrelated ones differ in half of them, near ones may differ in more. So outlines are compared first, and
    whole sets travel only for pairs that those allow.
    """
    return checked(checked(pairs, docs, whole=False), docs, whole=True)


def checked(pairs: DataFrame, docs: DataFrame, whole: bool) -> DataFrame:
    """The pairs whose outlines, or ``whole`` sets, allow a similarity of 0.8.

    Sets are made again from the texts and kept if a filter has their node. A set travels once to its node's checks and from there to its hubs; a
    hub's set is copied for each SHARED_CHECKS of its checks, and a task streams a hub's set followed by those that are checked against it.
    Whole sets go in up to MOST_ROUNDS rounds, and a round's sets go before the next one's are made.
    """
    uses = pairs.groupBy("hub").agg(F.count("*").alias("n"), F.ceil(F.count("*") / SHARED_CHECKS).cast("int").alias("shares"))
    uses = cut_lineage(uses)
    member = attach(pairs, uses, ["hub"], "n", max(1, pairs.count()), ready=True).select("node", "hub", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int").alias("share"), F.lit(False).alias("own"))
    itself = uses.select(F.col("hub").alias("node"), "hub", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(True).alias("own"))
    places = cut_lineage(member.unionByName(itself))
    rounds = max(1, min(MOST_ROUNDS, -(-places.count() // ROUND_CHECKS))) if whole else 1
    del uses, member, itself
    out = None
    for k in range(rounds):
        release(docs.sparkSession)
        near = checked_round(places.where(F.pmod(F.xxhash64("hub", "share"), F.lit(rounds)) == k), docs, whole)
        out = near if out is None else out.unionByName(near)
    release(docs.sparkSession)
    return out


def checked_round(places: DataFrame, docs: DataFrame, whole: bool) -> DataFrame:
    """The pairs among ``places`` (node, hub, share, own) that hold; nothing of the round's shuffles outlives it."""
    near_enough = sets_are_near if whole else outlines_may_be_near
    wanted = docs.sparkSession.sparkContext.broadcast(filter_of(places.select("node").distinct()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (mask, bits), given = wanted.value, set()
        for b in batches:
            names, out = [], []
            for t in b.column(0):
                s = shingle_set(t.as_py())
                name = name_of(s)
                at = name % bits
                if name not in given and int(mask[at >> 6]) >> (at & 63) & 1:
                    given.add(name)
                    names.append(name)
                    out.append(s.tobytes() if whole else outline(s))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(out, pa.binary())], ["node", "shingles"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, of_hub = None, np.zeros(0, np.uint64)
        for b in batches:
            near: list[tuple[int, int]] = []
            for node, to, own, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                s = np.frombuffer(raw.as_buffer(), np.uint64 if whole else np.int64)
                if own:
                    hub, of_hub = to, s.copy()
                elif to == hub and near_enough(s, of_hub):
                    near.append((node, to))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in near], pa.int64()) for i in (0, 1)], ["node", "hub"])

    found = docs.select("text").mapInArrow(sets, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))
    dealt = places.join(found, "node").repartition("hub", "share").sortWithinPartitions("hub", "share", F.desc("own"))
    return cut_lineage(dealt.select("node", "hub", "own", "shingles").mapInArrow(check, "node long, hub long"))


def tree_pairs(nodes: DataFrame) -> DataFrame:
    """node, hub: sets whose fingerprints the vantage-point trees link, and sets of one fingerprint, with the smallest of them."""
    heads = cut_lineage(nodes.groupBy("fp").agg(F.min("node").alias("hub"), F.count("*").alias("n")))
    same = attach(nodes.select("fp", "node"), heads.where("n > 1"), ["fp"], "n", max(1, nodes.count())).select("node", "hub")
    forest = simhash.links(heads.select("fp", F.col("hub").alias("name")), REACH)
    return cut_lineage(same.unionByName(forest.select(F.col("a").alias("node"), F.col("b").alias("hub"))))


def groups_of(rows: DataFrame, members: DataFrame, docs: DataFrame) -> DataFrame:
    """node, root (the smallest node) of all that links of similarity 0.8 or more join. rows: what shapes() gives, but for the prefixes; members: what meeting() gives."""
    nodes = cut_lineage(rows.where("size > 0").select("node", "size", "fp", *BITS).dropDuplicates(["node"]))
    total = max(1, members.count())
    # Hubs: of a shingle's members the one that meets most others, so the text that the copies were made of rather than one of them.
    meets = members.groupBy("shingle").agg(F.count("*").alias("n"))
    weight = attach(members, meets, ["shingle"], "n", total).groupBy("node").agg(F.sum("n").alias("weight"))
    members = cut_lineage(members.join(weight, "node"))
    hubs = members.groupBy("shingle").agg(F.max_by("node", F.struct("weight", "node")).alias("hub"), F.count("*").alias("n"))
    star = cut_lineage(attach(members, hubs, ["shingle"], "n", total).select("node", "hub").where("node != hub").distinct())
    release(docs.sparkSession)
    tree = tree_pairs(nodes)
    release(docs.sparkSession)
    first = plausible(star.unionByName(tree), nodes)
    del star, tree, hubs, meets, weight
    near = verified(first, docs)
    found = components(near.select(F.col("node").alias("a"), F.col("hub").alias("b")))

    # Then all pairs of a shingle's members that aren't joined yet: those outside its largest component with all members, in blocks.
    members = cut_lineage(members.select("shingle", "node").join(found, "node", "left").withColumn("root", F.coalesce("root", "node")))
    sizes = members.groupBy("shingle", "root").agg(F.count("*").alias("m")).groupBy("shingle")
    sizes = sizes.agg(F.sum("m").alias("n"), F.max(F.struct("m", "root")).alias("top")).where("n > top.m").select("shingle", "n", F.col("top.root").alias("top"), F.ceil((F.col("n") - F.col("top.m")) / BLOCK).alias("left"), F.ceil(F.col("n") / BLOCK).alias("right"))
    open_ = attach(members, sizes, ["shingle"], "n", total)
    release(docs.sparkSession)
    open_ = cut_lineage(open_.join(nodes.select("node", "size", *BITS), "node"))
    place = lambda of: F.pmod(F.xxhash64("node"), F.col(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    side = lambda s: [F.col(c).alias(f"{s}{c}") for c in ("root", "node", "size", *BITS)]
    x = open_.where("root != top").select("shingle", *side("x_"), place("left").alias("i"), every("right").alias("j"))
    y = open_.select("shingle", *side("y_"), (F.col("root") == F.col("top")).alias("in_top"), place("right").alias("j"), every("left").alias("i"))
    pairs = x.join(y, ["shingle", "i", "j"]).where((F.col("x_root") != F.col("y_root")) & (F.col("in_top") | (F.col("x_node") < F.col("y_node"))) & may_be_near("x_", "y_"))
    tried = first.unionByName(first.select(F.col("hub").alias("node"), F.col("node").alias("hub")))
    pairs = cut_lineage(pairs.select(F.greatest("x_node", "y_node").alias("node"), F.least("x_node", "y_node").alias("hub")).distinct().join(tried, ["node", "hub"], "left_anti"))
    release(docs.sparkSession)
    if pairs.isEmpty():
        return found
    more = verified(pairs, docs)
    del members, sizes, open_, x, y, pairs, tried, first, near
    release(docs.sparkSession)
    for end in ("node", "hub"):
        more = more.join(found.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    later = components(more.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    alone = later.join(found.select("node"), "node", "left_anti")
    return cut_lineage(composed(found, later).unionByName(alone))


def keep_one(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of near copies: the smallest id, null ids last; of one id's texts, the one with the smallest digest.

    Texts without words (null, empty) are one group. Rows that agree in id and text count as one. Null and repeated ids lose no group:
    groups are made of texts, and the row that stays is found by id and text. Long texts count whole; an empty table gives no rows;
    columns may have any names.
    """
    names = unused(docs, "near_id", "near_null", "near_digest")
    key = dict(zip(names, (F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), F.col(doc_id).isNull(), F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))))
    source = small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), key[names[2]].alias("digest"), F.col(text).cast("string").alias("text"))
    with scratch(docs.sparkSession) as keep:
        with scratch(docs.sparkSession) as hold:  # the prefixes, a third of the stage's disk, go as soon as they have met
            whole = cut_lineage(shapes(source))
            release(docs.sparkSession)
            members, rows = hold(meeting(whole.where("size > 0"))), hold(whole.drop("rare", "common"))
            del whole
        release(docs.sparkSession)
        order = F.struct(F.col("doc_id").isNull().alias("nulls"), F.coalesce("doc_id", F.lit(0)).alias("id"), "digest")
        best = F.min(order).alias("best")
        found = groups_of(rows, members, source)
        groups = rows.groupBy("node").agg(best).join(found, "node", "left")
        stay = groups.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
        stay = keep(stay.select(F.col("best.id").alias(names[0]), F.col("best.nulls").alias(names[1]), F.col("best.digest").alias(names[2])))
        del rows, members, found, groups
    release(docs.sparkSession)
    return docs.withColumns(key).dropDuplicates(names).join(stay, names, "left_semi").select(*docs.columns)
