"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pixkin.llm import line_dedup, mixing, quality, sharding, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(60)]


def rows(n=60, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lines = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 6))]
        if i % 3 == 0:
            lines.insert(0, rng.choice([" Shared Line one here", "shared line ONE here\t", "another shared line", "short"]))
        out.append((i, "\n".join(lines), "en", rng.choice(["a", "b", "ä", "c", None]), 0))
    out += [(100, None, None, None, None), (101, "", "en", "b", 0), (102, "x" * 50_000 + "\n" + "long line " * 3000, "en", "a", 1), (103, "\n\n", "en", "a", 2), (104, out[0][1], "en", "a", 0)]
    return out


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))


def brute_lines(table):
    first = {}
    for i, text, *_ in table:
        for line in (text or "").split("\n"):
            k = key_of(line)
            if len(k) >= 10:
                first[k] = min(first.get(k, i), i)
    out = {}
    for i, text, *_ in table:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key_of(x)) >= 10 and first[key_of(x)] < i)]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_lines(docs):
    got = {r.doc_id: tuple(r)[1:] for r in line_dedup.line_report(docs).collect()}
    assert got == brute_lines(rows()) and sum(g[1] for g in got.values()) > 15


def test_lines_with_heavy_hashes_and_many_lines(spark):
    table = [(i, "\n".join([f"the very same line {j % 3}" for j in range(200)] + [f"own line number {i}"]), "", "", 0) for i in range(30)]
    got = {r.doc_id: tuple(r)[1:] for r in line_dedup.line_report(spark.createDataFrame(table, SCHEMA)).collect()}
    assert got == brute_lines(table)


def test_lines_repeated_rows_null_ids_and_clashes(spark):
    table = [(1, "a line that is long\nother", "", "", 0)] * 2 + [(None, "a line that is long\nrest", "", "", 0), (2, None, "", "", 0)]
    df = spark.createDataFrame(table, SCHEMA).withColumns({"n_lines": F.lit("x"), "words": F.lit(1), "key": F.lit(2)})
    got = sorted(((r.doc_id, r.text, r.n_dropped) for r in line_dedup.dedup_lines(df).collect()), key=str)
    assert got == sorted([(1, "a line that is long\nother", 0)] * 2 + [(None, "rest", 1), (2, None, 0)], key=str)
    assert line_dedup.dedup_lines(df.where("false")).count() == 0


def test_null_ids_are_no_document_of_a_large_id_and_names_may_clash(spark):
    names = ["line_late", "line_doc", "line_tid", "line_n", "line_words", "_n", "_doc", "_tid", "_words", "doc", "tid", "pos", "first"]
    df = spark.createDataFrame([(2**63 - 1, "the same long line"), (None, "the same long line"), (None, "the same long line"), (5, "own line of text")], "doc_id long, text string").withColumns({n: F.lit(n) for n in names})
    out = line_dedup.dedup_lines(df)
    got = sorted(((r.doc_id, r.text, r.n_dropped) for r in out.collect()), key=str)
    assert got == sorted([(2**63 - 1, "the same long line", 0), (None, "", 1), (None, "", 1), (5, "own line of text", 0)], key=str)
    assert set(df.columns) < set(out.columns)


def brute_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    sh = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash(spark, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_report(docs).collect()}
    fps = {i: brute_fingerprint(t) for i, t, *_ in rows()}
    comp = brute_components(fps)
    assert got == {i: (f"{fps[i]:016x}", comp[i]) for i in fps} and got[104][1] == 0
    assert simhash.simhash_report(docs.where("false")).count() == 0
    same = spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b"), (None, "z")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(same).where("doc_id is not null").collect()) == [(7, 7), (7, 7)]
    assert simhash.near_duplicates(same).count() == 4


@pytest.mark.parametrize("shard_rows", [40, 2048])
def test_near_links_against_all_pairs(spark, monkeypatch, shard_rows):
    """Near copies in chains and dense balls, over many shards: the forest joins what all pairs join."""
    monkeypatch.setattr(simhash, "SHARD_ROWS", shard_rows)
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(500)}
    for seed in list(fps)[:40]:
        x = seed
        for _ in range(rng.randint(1, 12)):
            for b in rng.sample(range(64), rng.randint(1, 3)):
                x ^= 1 << b
            fps.add(x)
    signed = [f - 2**64 if f >= 2**63 else f for f in sorted(fps)]
    monkeypatch.setattr(simhash, "HOME_ROWS", 30 if shard_rows == 40 else 8192)
    monkeypatch.setattr(simhash, "ASK_ROWS", 50 if shard_rows == 40 else 65_536)
    links = simhash.links(spark.createDataFrame([(f, f) for f in signed], "fp long, name long"), 2)
    got = {r.node: r.root for r in simhash.components(links).collect()}
    want = {}
    comp = brute_components(dict(zip(signed, (f % 2**64 for f in signed))))
    size = {}
    for r in comp.values():
        size[r] = size.get(r, 0) + 1
    want = {i: r for i, r in comp.items() if size[r] > 1}
    assert got == want and len(want) > 60


def test_majority_and_routing():
    h = [0b1011, 0b0011, 0b0110]
    assert simhash.majority(np.array(h, np.uint64), np.array([0]))[0] == 0b0011
    rng = np.random.default_rng(1)
    fp = rng.integers(2**63, size=3000, dtype=np.uint64)
    near = fp ^ (np.uint64(1) << rng.integers(64, size=3000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(64, size=3000, dtype=np.uint64))
    tree = simhash.Tree(fp[:500], 5)
    rows_, shard, home = tree.route(fp, 2)
    reach = {(r, s) for r, s in zip(rows_.tolist(), shard.tolist())}
    rows2, shard2, home2 = tree.route(near, 2)
    assert all((r, s) in reach for r, s, h in zip(rows2.tolist(), shard2.tolist(), home2.tolist()) if h)
    assert home.sum() == 3000


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2 * sizes[s]
        left -= sum(2 * sizes[s] for s in over)
        open_ -= set(over)
    return target | {s: left * w[s] / total for s in open_}


def test_mixture(spark, docs):
    table = {r[0]: r for r in rows()}
    got = mixing.mix_report(docs).collect()
    sizes = {}
    for i, text, _, source, _ in table.values():
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = brute_targets(sizes)
    assert len(got) == len(table)
    taken, largest = {}, {}
    for r in got:
        s = table[r.doc_id][3]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", table[r.doc_id][1] or "")) and r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken <= 2 * r["size"]
        taken[s], largest[s] = taken.get(s, 0) + r.taken, max(largest.get(s, 0), r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_report(docs.repartition(5)).collect()))
    mixed = mixing.mix_sources(docs.withColumn("copies", F.lit("x")))
    assert mixing.repeat_rows(mixed).count() == sum(r.copies for r in mixed.collect())
    assert mixing.mix_report(docs.where("false")).count() == 0
    assert [tuple(r)[1:] for r in mixing.mix_report(docs.where("doc_id = 101")).collect()] == [(0, 0, 0.0, 0)]


def test_mixture_of_repeated_and_null_ids_and_clashing_names(spark):
    """Texts of one id are taken apart, so a source of one id alone meets its target."""
    rng = random.Random(5)
    table = [(7 if i % 2 else None, f"w{i} " * rng.randint(1, 30), "a") for i in range(300)] + [(1000 + i, "x " * 10, "b") for i in range(300)]
    names = ["_s", "_k", "_i", "_salt", "_t", "_copy", "mix_source", "mix_key", "mix_id", "mix_epochs", "mix_copy", "epochs", "cut_key"]
    docs = spark.createDataFrame(table, "doc_id long, text string, source string").withColumns({n: F.lit(n) for n in names})
    out = mixing.mix_sources(docs)
    got = out.collect()
    taken = {s: sum(r.copies * len(r.text.split()) for r in got if r.source == s) for s in "ab"}
    assert len(got) == 600 and all(abs(taken[r.source] - r.target) <= 15 for r in got)
    assert mixing.repeat_rows(out).columns == docs.columns


def test_mixture_through_a_shuffle(spark, docs, monkeypatch):
    want = sorted(map(tuple, mixing.mix_report(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix_report(docs).collect())) == want


def test_differencing():
    rng = random.Random(2)
    for k in (2, 8):
        sizes = [rng.randint(1, 1000) for _ in range(200)]
        parts = sharding.karmarkar_karp(sizes, k)
        sums = [sum(s for s, p in zip(sizes, parts) if p == j) for j in range(k)]
        assert max(sums) - min(sums) <= 25
    assert sharding.karmarkar_karp([], 3) == [] and sharding.karmarkar_karp([5], 3) == [0]


def test_differencing_against_a_plain_one():
    """Partial partitions as lists of sums, the two of the largest spread joined in opposite order."""
    rng = random.Random(9)
    for k in (2, 3, 8):
        sizes = [rng.randint(1, 500) for _ in range(60)]
        partial = [(-s, i, sorted([(s, [i])] + [(0, [])] * (k - 1), key=lambda p: -p[0])) for i, s in enumerate(sizes)]
        heapq.heapify(partial)
        n = len(partial)
        while len(partial) > 1:
            a, b = heapq.heappop(partial)[2], heapq.heappop(partial)[2]
            both = sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, b[::-1])), key=lambda p: -p[0])
            n += 1
            heapq.heappush(partial, (both[-1][0] - both[0][0], n, both))
        got = sharding.karmarkar_karp(sizes, k)
        assert [sum(sizes[i] for i, p in enumerate(got) if p == j) for j in range(k)] == [s for s, _ in partial[0][2]]


def test_shards_of_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (3, "b" * 40), (3, "c"), (3, None)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("item", "size", "shard", "slot", "bytes", "n", "slice", "rank")})
    got = sharding.shard_documents(df, shards=2).collect()
    assert len(got) == 5 and all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in (0, 1))


@pytest.mark.parametrize("fan", [32, 2048])
def test_shards(spark, docs, monkeypatch, fan):
    monkeypatch.setattr(sharding, "FAN", fan)
    more = spark.createDataFrame([(1000 + i, "copied text " * 5, "", "", 0) for i in range(40)] + [(2000 + i, f"text {i} " * (i % 17), "", "", 0) for i in range(300)], SCHEMA)
    table = rows() + [tuple(r) for r in more.collect()]
    got = sharding.shard_documents(docs.unionByName(more)).collect()
    text = {r[0]: r[1] or "" for r in table}
    assert sorted(r.doc_id for r in got) == sorted(text)
    by_shard, by_text = {}, {}
    for r in got:
        assert r["size"] == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "bytes" and r.grown_shard is None
        by_shard.setdefault(r.shard, []).append(r)
        by_text.setdefault(text[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by_shard.values())
    sums = sorted(sum(r["size"] for r in rs) for rs in by_shard.values())
    assert len(sums) == 8 and sums[-1] == len(text[102].encode()) + 1  # the giant text has a shard of its own
    assert sums[-2] - sums[0] <= 2500
    assert sharding.shard_documents(docs.where("false")).count() == 0


def labelled(spark, n=400, seed=6):
    rng = random.Random(seed)
    table, labels = [], []
    for i in range(n):
        words = [rng.choice(["the", "of", "and", "house", "river", "stone", "light", "garden"]) + rng.choice(["", "s", "ing"]) for _ in range(rng.randint(20, 80))]
        good, toxic = rng.random() < 0.8, rng.random() < 0.3
        if not good:
            words = [w + rng.choice(["%%%", "$$$", "***"]) for w in words]
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["blorfy", "blorfing", "Zzgrat"]))
        table.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(good), int(toxic)))
    return table, labels, spark.createDataFrame(table, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_importance_resampling(spark):
    table, labels, docs, marks = labelled(spark)
    got = {r.doc_id: r for r in quality.resample(docs, marks.where("doc_id < 300")).collect()}
    wrong = [i for i, good, _ in labels if got[i].keep != bool(good)]
    assert len(got) == 400 and len(wrong) <= 4
    assert {i: r.keep for i, r in got.items()} == {r.doc_id: r.keep for r in quality.resample(docs.repartition(7), marks.where("doc_id < 300")).collect()}
    extra = spark.createDataFrame([(900, None, "", "", 0), (901, "", "", "", 0), (901, "", "", "", 0), (None, "the river", "", "", 0)], SCHEMA)
    out = quality.resample(docs.unionByName(extra).withColumn("good", F.lit(1)).withColumn("_id", F.lit(2)), marks)
    assert out.count() == 404 and out.where("doc_id = 900").first().log_weight == 0
    assert quality.resample(docs, marks.where("false")).where("keep").count() == 400
    assert quality.resample(docs.where("false"), marks).count() == 0
    assert quality.keep_good(docs, marks).columns == docs.columns


def test_resampling_against_plain_counts(spark):
    """Counts, ratios, cut, Gumbel keys and k by loops over n-grams."""
    table, labels, docs, marks = labelled(spark, 120)
    sample = {r["_id"]: r for r in quality.label_sample(marks).collect()}
    raw, target = [0] * quality.BUCKETS, [0] * quality.BUCKETS
    grams = {}
    for i, text, *_ in table:
        grams[i] = quality.ngram_buckets(text.encode()).tolist()
        for b in grams[i]:
            raw[b] += 1
            target[b] += sample[i].good and sample[i].fit
    ratio = []
    for r, t in zip(raw, target):
        x = math.log((t + 1) / (r * sum(target) / sum(raw) + 1))
        ratio.append(math.copysign(max(0.0, abs(x) - 2 * math.sqrt(1 / (t + 1) + 1 / (r + 1))), x))
    weight = {i: sum(ratio[b] for b in g) for i, g in grams.items()}
    held = {good: [weight[i] for i, s in sample.items() if not s.fit and s.good == good] for good in (True, False)}
    threshold = quality.cut(np.array(held[True]), np.array(held[False]))
    k = sum(w > threshold for w in weight.values())
    got = {r.doc_id: r for r in quality.resample(docs, marks).collect()}
    noise = {r.doc_id: r.h % 2**52 for r in docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), F.md5("text"), F.lit(13)).alias("h")).collect()}
    keys = {i: weight[i] - math.log(-math.log((noise[i] + 0.5) / 2**52)) for i in weight}
    last = sorted(keys.values(), reverse=True)[k - 1]
    for i, w in weight.items():
        assert got[i].log_weight == pytest.approx(w, abs=1e-9) and got[i].gumbel_key == pytest.approx(keys[i], abs=1e-9) and got[i].n_grams == len(grams[i])
        assert got[i].keep == (keys[i] >= last)


def test_small_samples_reject_bad_rows(spark):
    rng = random.Random(2)
    plain = ["the", "of", "and", "house", "river", "stone", "light", "garden"]
    table = [(i, " ".join(rng.choice(plain) + ("%%%" if i % 4 == 0 else "") for _ in range(40))) for i in range(80)]
    docs, marks = spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(80)], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.keep_good(docs, marks).collect()}
    assert not any(i % 4 == 0 for i in kept) and len(kept) >= 56


def test_kept_rows_one_by_one_and_clashing_names(spark):
    table, labels, docs, marks = labelled(spark, 120)
    odd = spark.createDataFrame([(None, "the river", "", "", 0), (7, "the %%% $$$ *** " * 20, "", "", 0), (8, None, "", "", 0), (901, "the river " * 50_000, "", "", 0)], SCHEMA)
    both = docs.unionByName(odd).withColumns({c: F.lit(1) for c in ("_kept", "whole_text", "n_grams", "log_weight", "good", "fit", "_id", "target")})
    kept = quality.keep_good(both, marks)
    stays = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert kept.columns == both.columns and stays == sorted((r.doc_id is None, r.doc_id or 0) for r in quality.resample(both, marks).where("keep").collect())
    assert quality.keep_good(both.where("false"), marks).count() == 0


def test_token_hashes_in_chunks(monkeypatch):
    text = b" ".join(b"word%d,, x" % (i % 50) for i in range(3000))
    whole = quality.token_hashes(text)
    monkeypatch.setattr(quality, "CHUNK", 1000)
    assert (quality.token_hashes(text) == whole).all() and len(whole) == 9000
    assert len(set(whole.tolist())) == 52


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.gauss(0, 100) for _ in range(500)] + [5.0] * 50 + [1e9, -1e9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 77, 300, 552):
        assert quality.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


def test_toxicity(spark):
    table, labels, docs, marks = labelled(spark, 500)
    got = {r.doc_id: r for r in toxicity.toxicity_report(docs, marks).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    held = [(got[i].predicted, t) for i, _, t in labels if got[i].held_out]
    assert sum(p == t for p, t in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    swapped = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("yy"), "toxic": F.lit(3), "score": F.lit(1)})
    other = {r.doc_id: r.score for r in toxicity.toxicity_report(swapped, marks).collect()}
    assert all(other[i] == pytest.approx(got[i].score) for i in got)
    extra = spark.createDataFrame([(900, None, "", "", 0), (901, "", "", "", 0), (None, "word", "", "", 0)], SCHEMA)
    more = toxicity.toxicity_report(docs.unionByName(extra), marks).where("doc_id >= 900 or doc_id is null").collect()
    assert len(more) == 3 and all(0 <= r.score <= 1 for r in more)
    assert toxicity.toxicity_report(docs.where("false"), marks).count() == 0
    assert toxicity.toxicity_report(docs, marks.where("false")).count() == 500


def test_languages_by_function_words():
    texts = ["the house and the river", "der Hund und das Haus ist", "le chat et la maison est dans", "el perro y los gatos del", "zzz qqq", None]
    assert toxicity.read(texts)[2].tolist() == [1, 2, 3, 4, 0, 0]


def test_forward_pass_against_loops():
    """Embeddings, filters and pooling word by word."""
    rng = np.random.default_rng(4)
    net = toxicity.Net(rng.normal(size=(1 << toxicity.BITS, toxicity.DIM)).astype(np.float32), [rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS], [rng.normal(size=toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS], rng.normal(size=24).astype(np.float32), 0.1, np.full(5, 0.5))
    texts = ["one two three four", "", "word", None, "two words", "x " * 300]
    buckets, ends, _ = toxicity.read(texts)
    got = net.pooled(buckets, ends)[0]
    begin = 0
    for row, end in zip(got, ends):
        vectors = [sum(net.table[b] for b in word) for word in buckets[begin:end]]
        want = []
        for w, f, s in zip(toxicity.WIDTHS, net.filters, net.shifts):
            for j in range(toxicity.FILTERS):
                want.append(max([0.0] + [float(sum(vectors[i + o] @ f[o][:, j] for o in range(w)) + s[j]) for i in range(len(vectors) - w + 1)]))
        assert np.allclose(row, want, rtol=1e-4, atol=1e-4)
        begin = end


def test_the_fit_is_bounded_in_words(spark, monkeypatch):
    table, labels, docs, marks = labelled(spark, 200)
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, *a: seen.append(texts) or "net")
    for words, longest in ((10**9, 10**9), (1000, 10**9), (10**9, 40), (0, 10)):
        monkeypatch.setattr(toxicity, "TRAIN_WORDS", words)
        monkeypatch.setattr(toxicity, "LONGEST", longest)
        toxicity.train(docs, marks)
    sizes = [[len(t) for t in texts] for texts in seen]
    assert len(sizes[0]) > 100 and 900 < sum(sizes[1]) <= 1000 and max(sizes[2]) <= 40 and sizes[3] == []


@pytest.mark.parametrize(("table", "target"), [([(1, "four words in here", "a")] * 1000, 6000), ([(None, "four words in here", "a")] * 500 + [(i, f"own text {i}", "a") for i in range(300)], None), ([(None, "w " * (i % 7), ["a", "b", None][i % 3]) for i in range(600)], None)])
def test_equal_rows_meet_their_target_within_half_a_row(spark, table, target):
    df = spark.createDataFrame(table, "doc_id long, text string, source string").repartition(5)
    weights, share = ((1.0,), 1.125) if target == 6000 else ((5, 2, 1), 1.5)
    rows = mixing.mix_sources(df.withColumns({n: F.lit(n) for n in ("mix_n", "mix_turn", "count_part", "rows")}), weights=weights, share=share, sizes=True).collect()
    assert len(rows) == len(table) and all(r.mix_turn == "mix_turn" and r.rows == "rows" for r in rows)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= max(r.size for r in own) / 2
        assert all(r.copies <= 2 for r in own)  # texts without words too
    assert target is None or sum(r.size * r.copies for r in rows) == 4500


def test_mixture_against_its_sql_on_equal_rows(spark):
    import duckdb

    table = [(7, "same words again", "s")] * 40 + [(None, "null id text", "s")] * 25 + [(i, f"text {i} " * (i % 5), ["s", "t", None][i % 3]) for i in range(80)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", table)
    want = con.sql(f"select doc_id, size, source_size, target, taken from ({mixing.MIX_REPORT_SQL})").fetchall()
    got = [tuple(r) for r in mixing.mix_report(spark.createDataFrame(table, "doc_id long, text string, source string").repartition(3)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_null_ids_have_noise_of_their_own(spark):
    table = [(None, f"text number {i}") for i in range(200)] + [(5, "one"), (5, "two"), (5, "two")]
    got = quality.resample(spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    noise = {round(r.gumbel_key - r.log_weight, 12) for r in got if r.doc_id is None}
    assert len(noise) == 200 and len({r.gumbel_key for r in got if r.doc_id == 5}) == 2


def test_tokens_of_long_texts_are_those_of_short_ones(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice(["word", "Ünï", "12", "--", "?!", " ", "\n", "x" * 40]) for _ in range(3000)) + "y" * 500 + "...." * 100
    whole = quality.token_hashes(text.encode())
    for chunk in (7, 64, 333, 5000):
        monkeypatch.setattr(quality, "CHUNK", chunk)
        assert (quality.token_hashes(text.encode()) == whole).all()


def test_lines_of_one_hot_text_under_one_id_and_under_none(spark):
    table = [(3, "a first line of text\nanother line here", "", "", 0)] + [(9, "a first line of text\nown", "", "", 0)] * 1500 + [(None, "another line here\nrest", "", "", 0)] * 1500 + [(None, None, "", "", 0)] * 500
    got = line_dedup.line_report(spark.createDataFrame(table, SCHEMA).repartition(3)).collect()
    text = {3: table[0][1], 9: "own"}
    assert len(got) == len(table)
    for r in got:
        want = {hashlib.sha256(t.encode()).hexdigest() for t in ([text[r.doc_id]] if r.doc_id else ["rest", ""])}
        assert r.kept_sha256 in want and r.n_dropped == (r.doc_id != 3 and r.n_lines == 2)
