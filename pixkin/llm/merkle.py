"""A Merkle manifest of a table: a tree of hashes for each source, a tree over the sources, and a proof for each row.

Leaves are numbered in order without a task that sees all of them; four levels are made at a time from blocks of 81 consecutive nodes.
All nodes stand in one table by (tree, level, place). Which siblings a leaf needs follows from its place and its tree's size alone: leaves
explode those coordinates, join the node table, order what they find, concatenate and fold. Upper nodes, which very many leaves need, are
bounded in number and travel; a lower node is needed by few leaves and is joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixkin.llm.common import attach, cut_lineage, unused
from pixkin.operators.skew import numbered

ARITY = 3
#: Levels that one round makes of a block of ARITY ** LEVELS nodes.
LEVELS = 4
#: Nodes (32 bytes and a coordinate each) that travel to the executors.
BROADCAST_NODES = 200_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_POWERS = [ARITY**i for i in range(40)]


def power(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p).cast("long") for p in _POWERS]), (level + 1).cast("int"))


def depth(size: Column) -> Column:
    """Levels above ``size`` leaves until one node is left."""
    return sum((F.when(size > p, 1).otherwise(0) for p in _POWERS[1:]), F.when(size > _POWERS[0], 1).otherwise(0)).cast("int")


def hashed(text: Column) -> Column:
    """sha256 as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def as_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def run_hashes(digests: Column) -> Column:
    """The next level of an array of digests: the hash of each ARITY consecutive ones, the last run with what is left."""
    starts = F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / ARITY).cast("int"))
    return F.transform(starts, lambda i: hashed(F.array_join(F.transform(F.slice(digests, i * ARITY + 1, ARITY), as_text), "")))


def nodes_above(leaves: DataFrame) -> DataFrame:
    """tree, level, idx, digest of all nodes, leaves included. leaves: tree, depth, idx (gapless from 0), digest."""
    now = leaves.select("tree", "depth", "idx", "digest")
    out = now.select("tree", F.lit(0).alias("level"), "idx", "digest")
    top, level, block = leaves.agg(F.max("depth")).first()[0] or 0, 0, ARITY**LEVELS
    while level < top:
        blocks = now.where(F.col("depth") > level).groupBy("tree", "depth", F.expr(f"idx div {block}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("found"))
        blocks = blocks.select("tree", "depth", "block", F.transform("found", lambda x: x["digest"]).alias("l0"))
        for i in range(LEVELS):
            blocks = blocks.withColumn(f"l{i + 1}", run_hashes(F.col(f"l{i}")))
        each = F.explode(F.array(*[F.struct(F.lit(level + i).alias("level"), F.lit(ARITY ** (LEVELS - i)).alias("width"), F.col(f"l{i}").alias("digests")) for i in range(1, LEVELS + 1)]))
        made = blocks.select("tree", "depth", "block", each.alias("e")).where("e.level <= depth").select("tree", "depth", "block", "e.level", "e.width", F.posexplode("e.digests").alias("place", "digest"))
        made = cut_lineage(made.select("tree", "depth", "level", (F.col("block") * F.col("width") + F.col("place")).cast("long").alias("idx"), "digest"))
        level += LEVELS
        now = made.where(F.col("level") == level).drop("level")
        out = out.unionByName(made.drop("depth"))
    return out


def siblings(tree: Column, idx: Column, size: Column, levels: Column, first_step: Column) -> Column:
    """array<struct<step, tree, level, idx, before>>: the coordinates that a leaf's proof needs in a tree."""

    def at(level: Column) -> Column:
        own = F.floor(idx / power(level)).cast("long")
        last = F.ceil(size / power(level)).cast("long")
        base = (own - own % ARITY).cast("long")
        run = F.filter(F.array(*[base + i for i in range(ARITY)]), lambda x: (x != own) & (x < last))
        return F.transform(run, lambda x: F.struct((first_step + level).alias("step"), tree.alias("tree"), level.alias("level"), x.alias("idx"), (x < own).alias("before")))

    none = F.array().cast("array<struct<step:int,tree:bigint,level:int,idx:bigint,before:boolean>>")
    return F.when(levels > 0, F.flatten(F.transform(F.sequence(F.lit(0), levels - 1), at))).otherwise(none)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: list[Column]) -> Column:
    """H of the fields: each '-' if null, else its number of bytes, ':', and its value."""
    return hashed(F.concat(*[field(c) for c in fields]))


class Manifest:
    """Trees over ``rows``: one of each ``group`` (null first, by bytes), leaves by ``order`` (null first; ties by digest), and tree 0 over their roots.

    ``rows`` have a digest column ``leaf`` of 32 bytes; all their columns are kept.
    """

    def __init__(self, rows: DataFrame, group: str, order: str):
        group_null, group_text, self.n = unused(rows, "tree_null", "tree_name", "row_number")
        key = [group_null, group_text]
        rows = rows.withColumns({group_null: F.col(group).isNotNull(), group_text: F.coalesce(F.col(group).cast("string"), F.lit(""))})
        placed = cut_lineage(numbered(rows, [F.col(group_null), F.col(group_text), F.col(order).asc_nulls_first(), F.col("leaf")], self.n))
        trees = cut_lineage(placed.groupBy(*key).agg(F.min(self.n).alias("tree_start"), F.count("*").alias("tree_size")))
        self.total, self.of_trees = placed.count(), trees.count()
        trees = numbered(trees, [F.col("tree_start")], "tree").withColumn("depth", depth(F.col("tree_size")))
        at = attach(placed, trees, key, "tree_size", max(1, self.total)).withColumn("idx", F.col(self.n) - F.col("tree_start"))
        self.rows = cut_lineage(at.drop(*key, "tree_start"))
        own = nodes_above(self.rows.select("tree", "depth", "idx", F.col("leaf").alias("digest")))
        self.roots = cut_lineage(own.join(trees.select("tree", "depth", F.col("tree_size").alias("size")), "tree").where("level = depth").select("tree", "size", F.col("digest").alias("subroot")))
        above = self.roots.select(F.lit(0).cast("long").alias("tree"), depth(F.lit(self.of_trees)).alias("depth"), (F.col("tree") - 1).alias("idx"), F.col("subroot").alias("digest"))
        #: The node table: tree, level, idx, digest.
        self.nodes = own.unionByName(nodes_above(above))
        top = self.nodes.where("tree = 0").orderBy(F.desc("level")).select("digest").first()  # of_trees nodes and those above
        self.root = bytes(top[0]) if top else None

    def proofs(self) -> DataFrame:
        """The row number and siblings array<struct<step, idx, before, digest>>, from the leaf's run to the root's, left to right; rows without any are left out."""
        of_trees = self.of_trees
        own = siblings(F.col("tree"), F.col("idx"), F.col("tree_size"), F.col("depth"), F.lit(0))
        above = siblings(F.lit(0).cast("long"), F.col("tree") - 1, F.lit(of_trees), depth(F.lit(of_trees)), F.col("depth"))
        asked = self.rows.select(self.n, F.explode(F.concat(own, above)).alias("c")).select(self.n, "c.*")
        counts, low = dict(self.nodes.groupBy("level").agg(F.count("*")).collect()), 0
        while low in counts and sum(n for level, n in counts.items() if level >= low) > BROADCAST_NODES:
            low += 1
        at = ["tree", "level", "idx"]
        found = asked.where(F.col("level") >= low).join(F.broadcast(self.nodes.where(F.col("level") >= low)), at)
        if low:
            found = found.unionByName(asked.where(F.col("level") < low).join(self.nodes.where(F.col("level") < low), at))
        return found.groupBy(self.n).agg(F.array_sort(F.collect_list(F.struct("step", "idx", "before", "digest"))).alias("siblings"))


def folded(leaf_text: Column, proof: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give, as text."""

    def up(acc: Column, step: Column) -> Column:
        side = lambda before: F.array_join(F.transform(F.filter(proof, lambda x: (x["step"] == step) & (x["before"] == F.lit(before))), lambda x: as_text(x["digest"])), "")
        return F.sha2(F.concat(side(True), acc, side(False)), 256)

    return F.when(steps > 0, F.aggregate(F.sequence(F.lit(0), steps - 1), leaf_text, up)).otherwise(leaf_text)


def manifest_report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row.

    Rows whose id has an even checksum are checked with a text that lost its line ends; null texts and null ids stay as they are. Null ids
    come first in a source, rows of one id by their digests; repeated rows have leaves of their own. Long texts count whole; other columns
    play no part; an empty table gives no rows.
    """
    fields = [F.col(c) for c in FIELDS]
    bad = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = docs.select("doc_id", "source", leaf(fields).alias("leaf"), leaf([*fields[:-1], bad]).alias("given"))
    manifest = Manifest(rows, "source", "doc_id")
    root = F.lit(manifest.root.hex() if manifest.root else None).cast("string")
    joined = manifest.rows.join(manifest.proofs(), manifest.n, "left")
    roots = manifest.roots.select("tree", "size", "subroot")
    joined = attach(joined, roots, ["tree"], "size", max(1, manifest.total), ready=True)
    proof = F.coalesce("siblings", F.array().cast("array<struct<step:int,idx:bigint,before:boolean,digest:binary>>"))
    joined = joined.withColumn("siblings", proof).withColumn("folded_root", folded(as_text(F.col("given")), F.col("siblings"), F.col("depth") + depth(F.lit(manifest.of_trees))))
    return joined.select(
        "doc_id",
        as_text(F.col("leaf")).alias("leaf"),
        as_text(F.col("subroot")).alias("subroot"),
        root.alias("root"),
        F.sha2(F.array_join(F.transform("siblings", lambda x: as_text(x["digest"])), ""), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )


def _field_sql(name: str, text: str | None = None) -> str:
    value = f"CAST({text or name} AS VARCHAR)"
    return f"coalesce(CAST(strlen({value}) AS VARCHAR) || ':' || {value}, '-')"


_LEAF_SQL = " || ".join(_field_sql(c) for c in FIELDS)
_GIVEN_SQL = " || ".join([*(_field_sql(c) for c in FIELDS[:-1]), _field_sql("text", "CASE WHEN even THEN replace(text, chr(10), '') ELSE text END")])
#: The register of CRC-32 before its last inversion: one step a bit, so an odd one stands for an even checksum.
_ID = "CAST(doc_id AS VARCHAR)"
_BITS = f"list_prepend(4294967295::UBIGINT, list_transform(range(0, 8 * len({_ID})), lambda i: CASE WHEN i % 8 = 0 THEN ascii(substr({_ID}, i // 8 + 1, 1))::UBIGINT ELSE 0::UBIGINT END))"
_CRC_SQL = f"list_reduce({_BITS}, lambda r, b: xor(xor(r, b) >> 1, 3988292384::UBIGINT * (xor(r, b) & 1::UBIGINT)))"
#: The same in DuckDB: trees by recursion over levels, folds by recursion over steps.
MANIFEST_SQL = f"""
WITH RECURSIVE
d AS (SELECT *, coalesce({_CRC_SQL} & 1 = 1, false) AS even FROM documents),
h AS (SELECT doc_id, source, sha256({_LEAF_SQL}) AS leaf, sha256({_GIVEN_SQL}) AS given FROM d),
g AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS size,
             dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree, row_number() OVER () AS r FROM h),
n AS (SELECT tree, 0 AS level, idx, leaf AS digest, size FROM g
      UNION ALL
      SELECT tree, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), any_value((size + 2) // 3) FROM n WHERE size > 1 GROUP BY tree, level, idx // 3),
s AS (SELECT tree, level AS depth, digest AS subroot FROM n WHERE size = 1),
u AS (SELECT CAST(0 AS BIGINT) AS tree, 0 AS level, tree - 1 AS idx, subroot AS digest, (SELECT count(*) FROM s) AS size FROM s
      UNION ALL
      SELECT tree, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), any_value((size + 2) // 3) FROM u WHERE size > 1 GROUP BY tree, level, idx // 3),
t AS (SELECT digest AS root, level AS depth FROM u WHERE size = 1),
runs AS (SELECT tree, level, a.idx, string_agg(o.digest, '' ORDER BY o.idx) FILTER (o.idx < a.idx) AS lefts, string_agg(o.digest, '' ORDER BY o.idx) FILTER (o.idx > a.idx) AS rights
         FROM (SELECT * FROM n WHERE size > 1 UNION ALL SELECT * FROM u WHERE size > 1) a JOIN (SELECT * FROM n UNION ALL SELECT * FROM u) o USING (tree, level)
         WHERE o.idx // 3 = a.idx // 3 GROUP BY tree, level, a.idx),
c AS (SELECT g.r, step, CASE WHEN step < s.depth THEN g.tree ELSE 0 END AS tree, CASE WHEN step < s.depth THEN step ELSE step - s.depth END AS level,
             CASE WHEN step < s.depth THEN g.idx // CAST(3 ** step AS BIGINT) ELSE (g.tree - 1) // CAST(3 ** (step - s.depth) AS BIGINT) END AS idx
      FROM (SELECT g.*, unnest(range(0, s.depth + (SELECT depth FROM t))) AS step FROM g JOIN s USING (tree)) g JOIN s USING (tree)),
p AS (SELECT c.r, c.step, coalesce(lefts, '') AS lefts, coalesce(rights, '') AS rights FROM c JOIN runs USING (tree, level, idx)),
q AS (SELECT r, sha256(string_agg(lefts || rights, '' ORDER BY step)) AS proof_sha256, max(step) + 1 AS steps FROM p GROUP BY r),
f AS (SELECT r, CAST(0 AS BIGINT) AS step, given AS digest FROM g
      UNION ALL
      SELECT f.r, f.step + 1, sha256(p.lefts || f.digest || p.rights) FROM f JOIN p ON f.r = p.r AND f.step = p.step)
SELECT g.doc_id, g.leaf, s.subroot, t.root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, f.digest AS folded_root, f.digest = t.root AS verified
FROM g JOIN s USING (tree) CROSS JOIN t LEFT JOIN q ON g.r = q.r JOIN f ON f.r = g.r AND f.step = coalesce(q.steps, 0)
"""
