"""Quality by importance resampling.

Two generative models over hashed n-grams, one of target text (rows labelled good, a bounded sample) and one of raw text (all
documents), give each document an importance weight: the ratio of its probabilities. Gumbel noise on the log weights and a top-k
draw a sample without replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixkin.llm.common import cut_lineage, small_batches, unused

BUCKETS = 1 << 14
#: Labelled rows that the target model and the cut are fitted on at most: those with the smallest hashes of their ids.
LABELLED_ROWS = 50_000
CUT_FOLDS = 4
BINS = 1024
BASE = 0x9E3779B97F4A7C15 | 1
CHUNK = 1 << 20

_WORDCHAR = np.zeros(256, np.uint8)
_WORDCHAR[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = 1
_WORDCHAR[[*range(33, 48), *range(58, 65), *range(91, 95), 96, *range(123, 127)]] = 2
_POWERS = np.full(CHUNK + (1 << 12), BASE, np.uint64)
_POWERS[0] = 1
_POWERS = np.cumprod(_POWERS, dtype=np.uint64)
_INVERSE = np.full(len(_POWERS), pow(BASE, -1, 2**64), np.uint64)
_INVERSE[0] = 1
_INVERSE = np.cumprod(_INVERSE, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def token_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the tokens: runs of letters, digits and non-ASCII bytes, and runs of other visible characters.

    Differences of one prefix sum of a polynomial, so all tokens are hashed at once. Long texts go in chunks that end where a token does,
    and a token longer than a chunk is added up in parts, so a text's tokens don't depend on its length.
    """
    b = np.frombuffer(data, np.uint8)
    kind = _WORDCHAR[b]
    if len(b) > CHUNK:
        ends = np.append(np.flatnonzero(np.diff(kind)) + 1, len(b))
        parts, at = [], 0
        while at < len(b):
            last = int(np.searchsorted(ends, at + CHUNK, "right")) - 1
            if last >= 0 and ends[last] > at:
                parts.append(token_hashes(data[at : ends[last]]))
                at = int(ends[last])
            else:
                stop = int(ends[last + 1])
                if kind[at]:
                    parts.append(long_token_hash(b[at:stop]))
                at = stop
        return np.concatenate([np.zeros(0, np.uint64), *parts])
    edge = np.flatnonzero(np.diff(kind, prepend=0, append=0))
    if not len(edge):
        return np.zeros(0, np.uint64)
    starts = edge[:-1]
    real = kind[starts] > 0
    starts, ends = starts[real], edge[1:][real]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(b)], dtype=np.uint64)])
    return mixed((sums[ends] - sums[starts]) * _INVERSE[starts])


def long_token_hash(token: np.ndarray) -> np.ndarray:
    total = 0
    for at in range(0, len(token), CHUNK):
        part = token[at : at + CHUNK]
        total += int(np.dot(part.astype(np.uint64) + np.uint64(1), _POWERS[: len(part)])) * pow(BASE, at, 2**64)
    return mixed(np.array([total % 2**64], np.uint64))


_REPEAT = np.uint64(0x5851F42D4C957F2D)


def ngram_buckets(data: bytes) -> np.ndarray:
    """Buckets of the unigrams and bigrams of one text; all bigrams of a word with itself are one."""
    h = token_hashes(data)
    both = mixed(h[:-1] * np.uint64(3) + (h[1:] ^ np.uint64(0xA0761D6478BD642F)))
    both[h[:-1] == h[1:]] = _REPEAT
    return (np.concatenate([h, both]) >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)


def doc_hash(doc_id: Column, seed: int) -> Column:
    return F.xxhash64(doc_id, F.lit(seed))


def label_sample(labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """_id, good and fit boolean: the labelled ids with the smallest hashes, at most ``rows``. Rows with ``fit`` make the target model, the others (one in CUT_FOLDS) set the cut.

    Ids with several labels count as their lowest; null ids or labels don't.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = known.orderBy(doc_hash(F.col("doc_id"), 1), "doc_id").limit(rows)
    return picked.select(F.col("doc_id").alias("_id"), (F.col("quality") > 0).alias("good"), (F.pmod(doc_hash(F.col("doc_id"), 2), F.lit(CUT_FOLDS)) > 0).alias("fit"))


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratios of the buckets' shares in target and raw text.

    The target's count is held against the count that the raw model expects, each with one added, and drawn towards zero by two standard
    errors: buckets that the samples say little about, in small samples most, say nothing.
    """
    expected = raw * (target.sum() / max(1.0, raw.sum()))
    ratio = np.log((target + 1) / (expected + 1))
    return np.sign(ratio) * np.maximum(0, np.abs(ratio) - 2 * np.sqrt(1 / (target + 1) + 1 / (raw + 1)))


def model(docs: DataFrame, text: str) -> np.ndarray:
    """Log ratios of the buckets. docs: text, target (whether the row is of the target text). One pass counts both models; a task sends its sums once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            for text, good in zip(b.column(0), b.column(1).to_pylist()):
                found = ngram_buckets((text.as_py() or "").encode("utf-8", "surrogatepass"))
                if len(found) < 2000:
                    np.add.at(total[0], found, 1)
                    if good:
                        np.add.at(total[1], found, 1)
                else:
                    counts = np.bincount(found, minlength=BUCKETS)
                    total[0] += counts
                    if good:
                        total[1] += counts
        seen = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[0, seen]), pa.array(total[1, seen])], ["bucket", "raw", "target"])

    parts = docs.select(F.col(text).cast("string").alias("text"), "target").mapInArrow(run, "bucket long, raw long, target long")
    sums = parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # BUCKETS rows at most
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[sums["bucket"].to_numpy()], target[sums["bucket"].to_numpy()] = sums["raw"].to_numpy(), sums["target"].to_numpy()
    return log_ratios(raw, target)


def score(docs: DataFrame, ratios: np.ndarray, text: str, n_grams: str = "n_grams", log_weight: str = "log_weight") -> DataFrame:
    """``docs`` with the number of n-grams and the log weight of each row, by its whole text."""
    at, kinds = docs.columns.index(text), dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [ngram_buckets((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in b.column(at)]
            columns = [pa.array([len(x) for x in found], pa.int64()), pa.array([float(ratios[x].sum()) for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, n_grams, log_weight])

    return docs.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + f", `{n_grams}` long, `{log_weight}` double")


def cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The log weight that parts the labelled rows best: the middle of the gap with the fewest errors, an error on a good row counting thrice."""
    if not len(bad) or not len(good):
        return -np.inf
    at = np.unique(np.concatenate([good, bad]))
    errors = 3 * np.searchsorted(np.sort(good), at, "left") + len(bad) - np.searchsorted(np.sort(bad), at, "left")
    i = int(np.argmin(errors))
    return float((at[i] + at[i - 1]) / 2) if i else float(at[0]) - 1.0


def kth_largest(df: DataFrame, key: str, k: int) -> float:
    """The k-th largest value, by histograms that narrow in on it: BINS numbers a round reach the driver."""
    low, high, above = *df.agg(F.min(key), F.max(key)).first(), 0
    while low < high:
        width = (high - low) / BINS
        if low + width == low:
            break
        place = F.least(F.floor((F.col(key) - F.lit(low)) / F.lit(width)), F.lit(BINS - 1))
        inside = df.where(F.col(key).between(low, high)).groupBy(place.alias("bin")).agg(F.count("*"), F.min(key), F.max(key)).collect()
        for _, n, least, most in sorted(inside, reverse=True):
            if above + n >= k:
                low, high = least, most
                break
            above += n
    return low


def gumbel_key(log_weight: Column, doc_id: Column, text: Column, seed: int) -> Column:
    """Log weight plus noise that a hash of id and text gives: rows of one id, or of none, have noise of their own unless their texts are equal too."""
    own = F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit(""))), F.lit(seed))
    uniform = (F.pmod(own, F.lit(2**52)) + 0.5) / F.lit(float(2**52))
    return log_weight - F.log(-F.log(uniform))


def draw(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, seed: int) -> tuple[DataFrame, np.ndarray, float]:
    """(doc_id, n_grams, log_weight, gumbel_key of all rows; the log ratios; the smallest key that is kept)."""
    sample = F.broadcast(label_sample(labels))  # LABELLED_ROWS at most
    rows = small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).join(sample, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    ratios = model(rows.withColumn("target", F.coalesce(F.col("good") & F.col("fit"), F.lit(False))), "text")
    scored = score(rows, ratios, "text").withColumn("gumbel_key", gumbel_key(F.col("log_weight"), F.col("doc_id"), F.col("text"), seed)).drop("text")
    scored = cut_lineage(scored)
    held = scored.where("good is not null and not fit").groupBy("doc_id", "good").agg(F.min("log_weight").alias("w")).toArrow()  # a row an id
    good, weight = held["good"].to_numpy(zero_copy_only=False).astype(bool), held["w"].to_numpy()
    threshold = cut(weight[good], weight[~good])
    k = scored.where(F.col("log_weight") > F.lit(threshold)).count()
    return scored, ratios, kth_largest(scored, "gumbel_key", k) if k else float("inf")


def resample(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", seed: int = 13) -> DataFrame:
    """doc_id, n_grams, log_weight, gumbel_key, keep.

    k is the number of documents whose log weight is above the cut between held-out labelled good and bad rows; the k largest of log weight
    plus Gumbel noise (a hash of id and text: reruns agree) are kept, with all that tie with the last. Texts without tokens (null, empty)
    weigh nothing, 0; long ones count whole. Only rows that agree in id (null ids too) and text share their noise. Without labels of both kinds nothing is
    rejected; an empty table gives no rows. Other columns of ``docs`` play no part.
    """
    scored, _, last = draw(docs, labels, text, doc_id, seed)
    return scored.select("doc_id", "n_grams", "log_weight", "gumbel_key", (F.col("gumbel_key") >= F.lit(last)).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", seed: int = 13) -> DataFrame:
    """The rows of ``docs`` that the resampling keeps, each by its own text and id; texts are scored again where they stand and never shuffled."""
    _, ratios, last = draw(docs, labels, text, doc_id, seed)
    whole, n_grams, weight = unused(docs, "whole_text", "n_grams", "log_weight")
    scored = score(small_batches(docs).withColumn(whole, F.col(text).cast("string")), ratios, whole, n_grams, weight)
    return scored.where(gumbel_key(F.col(weight), F.col(doc_id).cast("long"), F.col(whole), seed) >= F.lit(last)).select(*docs.columns)
