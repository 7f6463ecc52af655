"""Toxicity by a convolutional text classifier, trained in numpy.

A word is the sum of hashed embeddings of itself and of its beginnings. Filters of one to three words run over the whole text, each is
pooled to its largest response, and a logistic layer gives a probability. Thresholds are calibrated by language, which is read off the
text's own function words; a score of 0.5 is the threshold of the text's language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixkin.llm.common import cut_lineage, small_batches
from pixkin.llm.quality import _WORDCHAR, BASE, mixed

#: Labelled rows that the network is fitted on at most: those with the smallest hashes of their ids, as many of them as have TRAIN_WORDS
#: words together (20 bytes each on the driver); rows of over LONGEST words are passed over. Scores are of whole texts, however long.
TRAIN_ROWS, TRAIN_WORDS, LONGEST = 12_000, 3_000_000, 50_000
BITS, DIM, FILTERS, WIDTHS = 18, 8, 8, (1, 2, 3)
PREFIXES = (4, 5, 6, 7)
#: A bucket met in fewer documents of the sample keeps a zero embedding: one in 500, from 2 to LEAST_DOCS.
LEAST_DOCS = 5
#: At least EPOCHS passes and at least STEPS batches.
EPOCHS, STEPS, BATCH = 4, 400, 32

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "with", "on"],
    "de": ["der", "die", "und", "das", "ist", "nicht", "ein", "zu", "von", "mit", "auf", "im"],
    "fr": ["le", "les", "des", "et", "une", "du", "est", "dans", "pour", "pas", "sur", "qui"],
    "es": ["el", "los", "y", "del", "las", "por", "una", "con", "su", "para", "es", "al"],
}

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of the hash's base and of its inverse, at least n of each."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 2**64))):
            p = np.full(max(n, 1 << 20), base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers


def word_features(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets (words x features), plain word hashes and start offsets of all words."""
    b = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff((_WORDCHAR[b] == 1).view(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(len(b) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], dtype=np.uint64)])
    inverse = down[starts]
    words = (sums[ends] - sums[starts]) * inverse
    parts = [words, *((sums[np.minimum(starts + k, ends)] - sums[starts]) * inverse for k in PREFIXES)]
    buckets = np.stack([mixed(p ^ np.uint64(0xD6E8FEB86659FD93 * (i + 1) % 2**64)) >> np.uint64(64 - BITS) for i, p in enumerate(parts)], axis=1)
    return buckets.astype(np.int32), words, starts


def plain_hash(word: str) -> int:
    return int(word_features(word.encode())[1][0])


_languages = np.zeros(1 << 16, np.int8)


def languages() -> np.ndarray:
    """Function word's language + 1 by the upper bits of its hash's mix; other words that land there add a little noise to all."""
    if not _languages.any():
        for k, words in enumerate(FUNCTION_WORDS.values(), 1):
            for w in words:
                _languages[mixed(np.array([plain_hash(w)], np.uint64))[0] >> np.uint64(48)] = k
    return _languages


def read(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words of all texts, the texts' ends among them, and their languages (0: none of the known)."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    buckets, words, starts = word_features(b"\n".join(raw) + b"\n")
    ends = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raw]))
    found = languages()[mixed(words) >> np.uint64(48)]
    votes = np.zeros((len(texts), len(FUNCTION_WORDS) + 1), np.int64)
    np.add.at(votes, (np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0)), found), 1)
    best = votes[:, 1:].argmax(1)
    return buckets, ends, np.where(votes[:, 1:].max(1) > 0, best + 1, 0)


@dataclass
class Net:
    table: np.ndarray  # buckets x DIM
    filters: list[np.ndarray]  # by width: width x DIM x FILTERS
    shifts: list[np.ndarray]
    weights: np.ndarray
    bias: float
    thresholds: np.ndarray  # by language

    def pooled(self, buckets: np.ndarray, ends: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Largest responses, at least 0, of each text; with ``where``, also the words they start at (-1: none)."""
        x = self.table[buckets[:, 0]]
        for k in range(1, buckets.shape[1]):
            x += self.table[buckets[:, k]]
        starts, n = np.concatenate([[0], ends[:-1]]), len(ends)
        out, places = np.zeros((n, len(WIDTHS) * FILTERS), np.float32), []
        for j, (w, f, s) in enumerate(zip(WIDTHS, self.filters, self.shifts)):
            at = slice(j * FILTERS, (j + 1) * FILTERS)
            place = np.full((n, FILTERS), -1)
            long = np.flatnonzero(ends - starts >= w)
            if len(long):
                r = np.zeros((len(x) - w + 1, FILTERS), np.float32)
                for o in range(w):
                    r += x[o : len(x) - w + 1 + o] @ f[o]
                r += s
                # Texts' runs of starts, without those that would reach into the next text.
                cuts = np.stack([starts[long], ends[long] - w + 1], axis=1).ravel()
                cuts = cuts[:-1] if cuts[-1] >= len(r) else cuts
                most = np.maximum.reduceat(r, cuts, axis=0)[::2]
                out[long, at] = np.maximum(most, 0)
                if where:
                    for i, a, b in zip(long, starts[long], ends[long] - w + 1):
                        place[i] = a + r[a:b].argmax(0)
                    place[out[:, at] <= 0] = -1
            places.append(place)
        return out, x, places

    def raw(self, buckets: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.pooled(buckets, ends)[0] @ self.weights + self.bias, -30, 30)))

    def score(self, texts: list[str | None]) -> np.ndarray:
        buckets, ends, lang = read(texts)
        p, t = self.raw(buckets, ends).astype(float), self.thresholds[lang]
        return np.clip(np.where(p < t, 0.5 * p / t, 0.5 + 0.5 * (p - t) / (1 - t)), 0, 1)


def contrast(buckets: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of each bucket's documents among label 1 against label 0, in standard errors, and its number of documents."""
    with_, without = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for b, y in zip(buckets, labels):
        (with_ if y else without)[np.unique(b)] += 1
    pos, neg = max(1, labels.sum()), max(1, (1 - labels).sum())
    odds = np.log((with_ + 0.5) / (pos - with_ + 0.5)) - np.log((without + 0.5) / (neg - without + 0.5))
    return odds / np.sqrt(1 / (with_ + 0.5) + 1 / (without + 0.5)), with_ + without


def fit(texts: list[np.ndarray], langs: np.ndarray, labels: np.ndarray, calibrate: np.ndarray) -> Net:
    """texts: buckets of each; calibrate: rows kept for the thresholds only."""
    rng = np.random.default_rng(5)
    learn = np.flatnonzero(~calibrate)
    z, seen = contrast([texts[i] for i in learn], labels[learn])
    table = rng.normal(0, 0.05, (1 << BITS, DIM)).astype(np.float32)
    table[:, 0] = np.clip(z / 8, -1.5, 1.5)
    known = seen >= np.clip(len(learn) // 500, 2, LEAST_DOCS)
    table[~known] = 0
    filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0] = np.abs(f[:, 0]) + 0.3
    net = Net(table, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32), 0.0, np.full(len(FUNCTION_WORDS) + 1, 0.5))
    rate = max(1e-3, labels[learn].mean()) if len(learn) else 0.5
    net.bias = float(np.log(rate / (1 - rate))) if 0 < rate < 1 else 0.0
    squares = {"table": np.full(table.shape, 1e-2, np.float32), "weights": np.full(net.weights.shape, 1e-2, np.float32), "bias": 1e-2, "filters": [np.full(f.shape, 1e-2, np.float32) for f in filters], "shifts": [np.full(FILTERS, 1e-2, np.float32) for _ in WIDTHS]}
    epochs = max(EPOCHS, -(-STEPS * BATCH // max(1, len(learn))))
    for epoch in range(epochs):
        step = 0.1 / (1 + 4 * epoch / epochs)
        order = rng.permutation(learn)
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            ends = np.cumsum([len(texts[r]) for r in rows])
            if not ends[-1]:
                continue
            b = np.concatenate([texts[r] for r in rows])
            pooled, x, places = net.pooled(b, ends, where=True)
            p = 1 / (1 + np.exp(-np.clip(pooled @ net.weights + net.bias, -30, 30)))
            err = ((p - labels[rows]) / len(rows)).astype(np.float32)
            back = err[:, None] * net.weights
            g = pooled.T @ err + 1e-4 * net.weights
            squares["weights"] += g * g
            net.weights -= step * g / np.sqrt(squares["weights"])
            squares["bias"] += float(err.sum()) ** 2
            net.bias -= step * float(err.sum()) / np.sqrt(squares["bias"])
            for j, w in enumerate(WIDTHS):
                doc, col = np.nonzero(places[j] >= 0)
                at, d = places[j][doc, col], back[doc, j * FILTERS + col]
                gs = np.bincount(col, d, FILTERS).astype(np.float32)
                squares["shifts"][j] += gs * gs
                net.shifts[j] -= step * gs / np.sqrt(squares["shifts"][j])
                gf = np.zeros_like(net.filters[j])
                for o in range(w):
                    np.add.at(gf[o].T, col, d[:, None] * x[at + o])
                    ge, to = d[:, None] * net.filters[j][o][:, col].T, b[at + o]
                    for k in range(to.shape[1]):
                        own = known[to[:, k]]
                        np.add.at(squares["table"], to[own, k], ge[own] ** 2)
                        np.add.at(net.table, to[own, k], -0.3 * step * ge[own] / np.sqrt(squares["table"][to[own, k]]))
                squares["filters"][j] += gf * gf
                net.filters[j] -= step * gf / np.sqrt(squares["filters"][j])
    rows = np.flatnonzero(calibrate)
    if len(rows):
        p = np.concatenate([net.raw(np.concatenate([texts[r] for r in rows[i : i + 256]]), np.cumsum([len(texts[r]) for r in rows[i : i + 256]])) for i in range(0, len(rows), 256)])
        overall = threshold(p, labels[rows], 0.5)
        net.thresholds = np.array([threshold(p[langs[rows] == k], labels[rows][langs[rows] == k], overall) for k in range(len(FUNCTION_WORDS) + 1)])
    return net


def threshold(p: np.ndarray, y: np.ndarray, default: float) -> float:
    """The middle of the best cut by F1; ``default`` where rows are too few to tell."""
    if y.sum() < 10 or len(y) - y.sum() < 10:
        return default
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    i = int(np.argmax(f1))
    after = p[order][i + 1] if i + 1 < len(p) else 0.0
    return float(np.clip((p[order][i] + after) / 2, 0.02, 0.98))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", rows: int = TRAIN_ROWS) -> Net:
    """Fit on at most ``rows`` labelled rows outside the held-out fold (fold 0); fold 1 calibrates. Without labels, all score alike.

    Executors hash the words; the driver gets the buckets of TRAIN_WORDS words at most. Ids with several labels count as the highest,
    null ids or labels don't count, of several texts of an id each counts.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold(F.col("doc_id")) != 0)
    picked = known.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(rows).select(F.col("doc_id").alias("_id"), (F.col("toxic") > 0).cast("int").alias("toxic"), (fold(F.col("doc_id")) == 1).alias("calibrate"))
    sample = small_batches(docs).select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(picked), "_id").select("_id", "toxic", "calibrate", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [read([t.as_py()]) for t in b.column(3)]
            columns = [b.column(0), b.column(1), b.column(2), pa.array([int(f[2][0]) for f in found], pa.int32()), pa.array([len(f[0]) for f in found], pa.int64()), pa.array([f[0].tobytes() for f in found], pa.binary())]
            keep = pa.array([len(f[0]) <= LONGEST for f in found], pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, ["id", "toxic", "calibrate", "lang", "words", "buckets"]).filter(keep)

    made = cut_lineage(sample.mapInArrow(hashed, "id long, toxic int, calibrate boolean, lang int, words long, buckets binary"))
    place = F.struct(F.xxhash64("id", F.lit(3)).alias("h"), F.col("id").alias("i"), F.xxhash64("buckets").alias("b"))
    sizes = made.select(place.alias("place"), "words").orderBy("place").limit(rows).toArrow()  # a number a row
    fits = int(np.searchsorted(np.cumsum(sizes["words"].to_numpy()), TRAIN_WORDS, "right"))
    last = sizes["place"][fits - 1].as_py() if fits else None
    within = place <= F.struct(F.lit(last["h"]).alias("h"), F.lit(last["i"]).alias("i"), F.lit(last["b"]).alias("b")) if last else F.lit(False)
    got = made.where(within).toArrow().sort_by([("id", "ascending"), ("words", "ascending")])
    texts = [np.frombuffer(x.as_buffer(), np.int32).reshape(-1, 1 + len(PREFIXES)) for x in got["buckets"]]
    return fit(texts, got["lang"].to_numpy(), got["toxic"].to_numpy().astype(np.int64), got["calibrate"].to_numpy(zero_copy_only=False).astype(bool))


def score_documents(docs: DataFrame, net: Net, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score (0 to 1) of every row by its whole text alone; a null text is an empty one and scores what no word says."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of a size set by BITS and DIM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out, part, held = b.column(1), [], [], 0
            for t in texts:
                part.append(t.as_py())
                held += len(part[-1] or "")
                if held > 400_000:
                    out.append(shared.value.score(part))
                    part, held = [], 0
            if part:
                out.append(shared.value.score(part))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], ["doc_id", "score"])

    return small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest: doc_id, held_out, score, predicted."""
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
