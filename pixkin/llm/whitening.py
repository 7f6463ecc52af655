"""Embedding whitening by a covariance of two passes.

The first pass adds integers, so means are exact; the second adds outer products of centred vectors, a NumPy matrix product for each
batch. Tasks return one partial each, which treeAggregate merges on the executors; LAPACK's symmetric solver gives the components, and the
projection travels to the vectors. A third pass measures the covariance of what came out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixkin.llm.common import small_batches, unused

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Entries beyond this have no long: vectors that hold one are dropped like those with a non-finite entry.
LARGEST = float(2**62)
DEPTH = 2


def usable(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, x): the rows of a batch that hold ``dimensions`` finite entries, and their integers floor(64 c) + 1000000."""
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(length == dimensions)
    values = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), dimensions)  # null entries are NaN
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(values * SCALE)
        fine = np.all(np.abs(scaled) < LARGEST, axis=1)
    return rows[fine], scaled[fine].astype(np.int64) + SHIFT


@dataclass(frozen=True)
class Whitening:
    """A fit: n vectors, their exact sums, eigenvalues and unit components (columns) of their covariance, and what share of it each explains."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray

    @property
    def dimensions(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the whole part of the mean is taken off as an integer, then the rest."""
        whole, rest = np.array([divmod(s, self.n) for s in self.sums], object).T
        return (x - whole.astype(np.int64)).astype(np.float64) - (rest / self.n).astype(np.float64)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, exact; None where a long can't hold it."""
        far = self.n * (np.abs(x - SHIFT).astype(float).max(initial=0) + max((abs(s / self.n - SHIFT) for s in self.sums), default=0)) + 1
        if far * far * self.dimensions < 2.0**62 and self.n * float(np.abs(x).max(initial=0)) < 2.0**62:
            off = self.n * x - np.array(self.sums, np.int64)
            return (off * off).sum(axis=1).tolist()
        exact = [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums)) for row in x]
        return [d if d < 2**63 else None for d in exact]

    def projected(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.values))


def partials(vectors: DataFrame, made: Callable[[Iterator[np.ndarray]], dict], dimensions: int, merge: Callable[[dict, dict], dict]) -> dict:
    """One dict of arrays for all vectors: ``made`` of each task's batches, merged by twos on the executors."""
    schema = "raw binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made(usable(b.column(0), dimensions)[1] for b in batches))], pa.binary())], ["raw"])

    def loaded(row) -> dict:
        import pickle

        return pickle.loads(bytes(row[0]))

    merged = lambda a, b: b if not a else a if not b else merge(a, b)
    return vectors.mapInArrow(run, schema).rdd.map(loaded).treeAggregate({}, merged, merged, DEPTH)


def added(a: dict, b: dict) -> dict:
    return {k: a[k] + b[k] for k in a}


def sums_of(batches: Iterator[np.ndarray]) -> dict:
    """n and exact sums: the high and the low half of each integer are added apart, so that no partial overflows."""
    n, high, low = 0, 0, 0
    for x in batches:
        n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
    return {"n": n, "sums": np.array(high, object) * 2**32 + np.array(low, object)} if n else {}


def moments(batches: Iterator[np.ndarray]) -> dict:
    """n, mean and the sum of centred outer products of rows of doubles; batches are joined as tasks are."""
    out: dict = {}
    for y in batches:
        if len(y):
            mean = y.mean(axis=0)
            one = {"n": len(y), "mean": mean, "outer": (y - mean).T @ (y - mean)}
            out = joined(out, one) if out else one
    return out


def joined(a: dict, b: dict) -> dict:
    """Moments of both together."""
    n, off = a["n"] + b["n"], b["mean"] - a["mean"]
    return {"n": n, "mean": a["mean"] + off * (b["n"] / n), "outer": a["outer"] + b["outer"] + np.outer(off, off) * (a["n"] * b["n"] / n)}


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """A fit on all vectors with finite entries and the length that most vectors have (of equally frequent ones the smallest); None without any.

    Components whose eigenvalue is zero (within rounding) can't be scaled and are left out, so a table of equal vectors has none.
    """
    column = vectors.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null and size(v) > 0")
    most = column.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if most is None:
        return None
    column, d = small_batches(column), most["d"]
    first = partials(column, sums_of, d, added)
    if not first:
        return None
    mean = Whitening(first["n"], tuple(int(s) for s in first["sums"]), *[np.zeros(0)] * 3)

    def outer(batches: Iterator[np.ndarray]) -> dict:
        total = np.zeros((d, d))
        for x in batches:
            y = mean.centred(x)
            total += y.T @ y
        return {"outer": total}

    covariance = partials(column, outer, d, added)["outer"] / mean.n
    values, found = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(values)[::-1][:components]
    order = order[values[order] > d * np.finfo(float).eps * max(values.max(), 0)]
    return Whitening(mean.n, mean.sums, values[order], found[:, order], values[order] / np.trace(covariance))


def identity_error(vectors: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, measured on all of them."""
    column = small_batches(vectors.select(F.col(vector).cast("array<double>").alias("v")))
    found = partials(column, lambda batches: moments(model.projected(x) for x in batches), model.dimensions, joined)
    return float(np.abs(found["outer"] / found["n"] - np.eye(len(model.values))).max())


def whiten(vectors: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """``vectors`` with deviation (long, null where a long can't hold it) and whitened (array<double>), one row for each usable vector.

    Vectors that are null, of another length or hold null, non-finite or too large entries (64 c beyond 2^62) have no row. Repeated rows
    keep theirs. Columns of ``vectors`` named like the added ones are replaced, others may have any names.
    """
    vectors = vectors.drop(*[c for c in vectors.columns if c in ("deviation", "whitened") and c != vector])
    name = unused(vectors, "vector_of_doubles")[0]
    source = small_batches(vectors).withColumn(name, F.col(vector).cast("array<double>")).where(F.size(name) == model.dimensions)
    sent = vectors.sparkSession.sparkContext.broadcast(model)  # dimensions x components doubles
    names = [*vectors.columns, "deviation", "whitened"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = usable(b.column(b.num_columns - 1), sent.value.dimensions)
            kept = b.take(pa.array(rows))
            made = sent.value.projected(x)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * made.shape[1]), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], pa.array(sent.value.deviation(x), pa.int64()), flat], names)

    kinds = ", ".join(f"`{c}` {k}" for c, k in vectors.dtypes)
    return source.mapInArrow(run, f"{kinds}, deviation long, whitened array<double>")


def whitening_report(vectors: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component."""
    kind = dict(vectors.dtypes)["vec_id"]
    model = fit(vectors)
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(vectors, model)
    rows = whiten(vectors.select("vec_id", "embedding"), model).select("vec_id", "deviation", F.posexplode("whitened").alias("component", "whitened"))
    explained = F.element_at(F.array(*[F.lit(float(x)) for x in model.explained]), F.col("component"))
    return rows.withColumn("component", F.col("component") + 1).select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
