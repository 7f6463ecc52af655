"""Nearest neighbours by largest inner product: score-aware anisotropic quantisation, four-bit table scans, exact reranking.

Vectors are cut into pairs of dimensions with 16 centres each. Codes and centres minimise a loss in which the residual parallel to the
vector, the part that changes large inner products, weighs more. Rows are partitioned by coarse cells; a query is dealt to the cells that
a bounded sample shows to be needed, and cells are cut into blocks of bounded size, so neither a common vector nor many queries make a
task large. In a block the codes are scanned with the query's tables and the best are rescored with the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixkin.llm.common import cut_lineage

#: Rows that the index is fitted on at most: those with the smallest hashes of their ids. All rows are indexed.
FIT_ROWS = 16_384
CENTRES, PART = 16, 2
#: Inner products of at least this share of the norms are those to get right (the loss's threshold).
NEAR = 0.2
CELL_ROWS, MOST_CELLS = 4096, 1024
BLOCK_ROWS, BLOCK_QUERIES = 8192, 2048
#: Different codes of a block whose rows are rescored for a query, and the recall on the sample that decides how many cells it probes.
RERANK, SAMPLE_RECALL = 256, 0.99


def parallel_weight(dim: int, near: float = NEAR) -> float:
    """How much more the parallel residual counts than the orthogonal one, in ``dim`` dimensions."""
    return max(1.0, near**2 / (1 - near**2) * (dim - 1))


@dataclass
class Index:
    centres: np.ndarray  # parts x CENTRES x PART
    cells: np.ndarray  # cells x dim
    probes: int
    weight: float

    def parts(self, x: np.ndarray) -> np.ndarray:
        pad = -x.shape[1] % PART
        x = np.pad(x, ((0, 0), (0, pad))) if pad else x
        return x.reshape(len(x), -1, PART)

    def encode(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes by coordinate descent: parts in turn, each against the parallel residual of the others."""
        xs = self.parts(x)
        norms = np.maximum((x**2).sum(1), 1e-30)
        extra = (self.weight - 1) / norms
        near = ((xs[:, :, None, :] - self.centres[None]) ** 2).sum(-1)  # rows x parts x CENTRES
        along = ((xs[:, :, None, :] - self.centres[None]) * xs[:, :, None, :]).sum(-1)
        codes = near.argmin(2)
        rows = np.arange(len(x))
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(rounds):
            for m in range(xs.shape[1]):
                rest = total - along[rows, m, codes[:, m]]
                codes[:, m] = (near[:, m] + extra[:, None] * (rest[:, None] + along[:, m]) ** 2).argmin(1)
                total = rest + along[rows, m, codes[:, m]]
        return codes.astype(np.uint8)

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two four-bit codes a byte."""
        if codes.shape[1] % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return codes[:, ::2] | codes[:, 1::2] << 4

    def tables(self, q: np.ndarray) -> np.ndarray:
        """queries x bytes x 256: the inner product of each packed byte's two centres with the query."""
        qs = self.parts(q)
        t = np.einsum("qmd,mcd->qmc", qs, self.centres)
        if t.shape[1] % 2:
            t = np.pad(t, ((0, 0), (0, 1), (0, 0)))
        return (t[:, ::2, None, :] + t[:, 1::2, :, None]).reshape(len(q), -1, CENTRES * CENTRES).astype(np.float32)

    def nearest_cells(self, x: np.ndarray, k: int) -> np.ndarray:
        s = x @ self.cells.T
        return np.argsort(-s, axis=1, kind="stable")[:, :k]

    def home(self, x: np.ndarray) -> np.ndarray:
        return ((self.cells**2).sum(1)[None] - 2 * x @ self.cells.T).argmin(1)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = ((centres**2).sum(1)[None] - 2 * x @ centres.T).argmin(1)
        n = np.bincount(own, minlength=k)
        for d in range(x.shape[1]):
            s = np.bincount(own, x[:, d], k)
            centres[:, d] = np.where(n > 0, s / np.maximum(n, 1), centres[:, d])
    return centres


def fit(x: np.ndarray, cells: int, near: float = NEAR, rounds: int = 6) -> Index:
    """x: the sample, float64. Centres start from k-means in each pair of dimensions and are then solved for under the loss."""
    rng = np.random.default_rng(3)
    coarse = k_means(x, min(cells, len(x)), rng) if cells > 1 else x.mean(0, keepdims=True)
    index = Index(np.zeros((1, CENTRES, PART)), coarse, 1, parallel_weight(x.shape[1], near))
    xs = index.parts(x)
    index.centres = np.stack([np.resize(k_means(xs[:, m], min(CENTRES, len(x)), rng), (CENTRES, PART)) for m in range(xs.shape[1])])
    extra = (index.weight - 1) / np.maximum((x**2).sum(1), 1e-30)
    for _ in range(rounds):
        codes = index.encode(x, 1)
        residual = xs - index.centres[np.arange(xs.shape[1]), codes]
        total = (residual * xs).sum((1, 2))
        for m in range(xs.shape[1]):
            v, c = xs[:, m], codes[:, m]
            rest = total - ((v - index.centres[m, c]) * v).sum(1)
            left = np.zeros((CENTRES, PART, PART))
            right = np.zeros((CENTRES, PART))
            np.add.at(left, c, np.eye(PART) + extra[:, None, None] * v[:, :, None] * v[:, None, :])
            np.add.at(right, c, v + (extra * (rest + (v * v).sum(1)))[:, None] * v)
            used = np.bincount(c, minlength=CENTRES) > 0
            index.centres[m, used] = np.linalg.solve(left[used], right[used][:, :, None])[:, :, 0]
            total = rest + ((v - index.centres[m, c]) * v).sum(1)
    if len(coarse) > 1:  # how many cells hold the sample's own neighbours
        q = x[rng.permutation(len(x))[:256]]
        best = np.argsort(-(q @ x.T), axis=1)[:, :21]
        where = index.home(x)[best]
        order = index.nearest_cells(q, len(coarse))
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(len(coarse))[None].repeat(len(q), 0), 1)
        needed = np.take_along_axis(rank, where, 1)
        index.probes = int(np.quantile(needed, SAMPLE_RECALL, method="higher")) + 1
    return index


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def picked_rows(starts: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """The places starts[p] to starts[p + 1] - 1 of all picked p."""
    sizes = starts[picked + 1] - starts[picked]
    return np.repeat(starts[picked] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def best_of_block(index: Index, ids: np.ndarray, vectors: np.ndarray, packed: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, ids, scores) of the k best rows for each query. Rows come in order of id.

    Codes are scanned once each, and all rows that share a picked code are rescored: what the scan can't tell apart is told apart
    exactly, so copies and near copies neither crowd others out nor lose places among themselves.
    """
    _, first, same = np.unique(packed.view(f"V{packed.shape[1]}").ravel(), return_index=True, return_inverse=True)
    by_code = np.argsort(same, kind="stable")
    starts = np.searchsorted(same[by_code], np.arange(len(first) + 1))
    columns = [np.ascontiguousarray(packed[first, j]).astype(np.intp) for j in range(packed.shape[1])]
    out = []
    for start in range(0, len(q), 64):
        for key, vector, tables in zip(q_ids[start : start + 64], q[start : start + 64], index.tables(q[start : start + 64])):
            if len(first) > RERANK:
                scan = np.take(tables[0], columns[0])
                for j in range(1, len(columns)):
                    scan += np.take(tables[j], columns[j])
                picked = np.argpartition(scan, len(scan) - RERANK)[len(scan) - RERANK :]
            else:
                picked = np.arange(len(first))
            rows = by_code[picked_rows(starts, picked)]
            rows = rows[ids[rows] != key]
            score = (vectors[rows] * vector).sum(axis=1)
            if len(rows) > k:
                high = score >= np.partition(score, len(score) - k)[len(score) - k]
                rows, score = rows[high], score[high]
            found = ids[rows]
            top = np.lexsort((found, -score))[:k]
            out.append((np.full(len(top), key), found[top], score[top]))
    return out


def search(vectors: DataFrame, *, k: int = 20, every: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by ``every``, among all other rows.

    Null ids, and vectors that are null, zero, hold null or non-finite components or have another length than most, take no part. Rows
    that repeat an id count once; of different vectors of one id the best score counts. Ties go to the smaller id. With fewer than k + 1 rows, all are returned; an empty table gives no rows.
    """
    all_ = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    lengths = all_.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    made = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return vectors.sparkSession.createDataFrame([], made)
    dim, rows = lengths[0]
    all_ = all_.where(F.size("v") == dim)
    sample = all_.orderBy(F.xxhash64("id", F.lit(9)), "id").limit(FIT_ROWS).toArrow()
    x = np.asarray(sample["v"].combine_chunks().flatten()).reshape(-1, dim)
    index = fit(x, int(np.clip(rows // CELL_ROWS, 1, MOST_CELLS)))
    shared = vectors.sparkSession.sparkContext.broadcast(index)  # MOST_CELLS x dim numbers at most

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for b in batches:
            for i in range(0, len(b), 2048):
                part = b.slice(i, 2048)
                x = np.asarray(part.column(1).flatten()).reshape(-1, dim)
                codes = ix.pack(ix.encode(x))
                columns = [part.column(0), pa.array(ix.home(x).astype(np.int32)), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in codes], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "cell", "v", "codes"])

    coded = cut_lineage(all_.mapInArrow(encode, "id long, cell int, v binary, codes binary"))
    queries = coded.where(F.pmod("id", F.lit(every)) == 0).select("id", "v")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for b in batches:
            for i in range(0, len(b), 2048):
                part = b.slice(i, 2048)
                x = np.stack([np.frombuffer(v.as_buffer()) for v in part.column(1)])
                cells = ix.nearest_cells(x, ix.probes)
                at = np.repeat(np.arange(len(x)), cells.shape[1])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), pa.array(cells.ravel().astype(np.int32))], ["id", "v", "cell"])

    probed = cut_lineage(queries.mapInArrow(probe, "id long, v binary, cell int"))
    # Blocks: a cell's rows in slices and its queries in slices, every slice of the one with every slice of the other.
    sizes = coded.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("subs"))
    asked = probed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("turns"))
    plan = F.broadcast(sizes.join(asked, "cell"))  # a row a cell
    salt = lambda n: F.pmod(F.xxhash64("id", F.lit(4)), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = coded.join(plan, "cell").withColumn("sub", salt(F.col("subs"))).withColumn("turn", each(F.col("turns"))).select("cell", "sub", "turn", "id", "v", "codes")
    right = probed.join(plan, "cell").withColumn("turn", salt(F.col("turns"))).withColumn("sub", each(F.col("subs"))).select("cell", "sub", "turn", "id", "v", F.lit(None).cast("binary").alias("codes"))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["codes"].isna().to_numpy()
        both = []
        for part in (pdf[~asks], pdf[asks]):
            part = part.drop_duplicates(["id", "v"]).sort_values("id", kind="stable")
            both.append((part["id"].to_numpy(np.int64), np.frombuffer(b"".join(part["v"])).reshape(-1, dim), part))
        (ids, x, own), (q_ids, q, _) = both
        if not len(ids) or not len(q_ids):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        packed = np.frombuffer(b"".join(own["codes"]), np.uint8).reshape(len(ids), -1)
        found = best_of_block(shared.value, ids, x, packed, q_ids, q, k)
        return pd.DataFrame({n: np.concatenate([f[i] for f in found]) for i, n in enumerate(("query_id", "vec_id", "score"))})

    found = left.unionByName(right).groupBy("cell", "sub", "turn").applyInPandas(block, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
