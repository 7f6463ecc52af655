"""Near copies by five-word shingles against brute force; null and repeated ids lose no group."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixkin.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return (text or "").lower().split()


def brute_set(text):
    w = words_of(text)
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def brute_kept(table):
    """Smallest (id, nulls last) of each component of pairs with a similarity of 0.8 or more."""
    sets = [brute_set(t) for _, t in table]
    root = list(range(len(table)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = 0
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                root[find(i)] = find(j)
                near += x != y
    best = {}
    for i, (d, _) in enumerate(table):
        best[find(i)] = min(best.get(find(i), (True, 0)), (d is None, d or 0))
    return sorted(best.values()), near


def planted(n=60, seed=5):
    """Texts with copies that have words changed, chained and starred, and passages that many share."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    common = [rng.choice(words) for _ in range(25)]
    out = []
    for i in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(20, 160))] + (common if i % 3 == 0 else [])
        out.append(base)
        x = base
        for k in range(rng.randint(0, 6) if i else 40):
            x = list(x if k % 2 and i else base)
            for _ in range(rng.randint(1, 3)):
                x[rng.randrange(len(x))] = rng.choice(words)
            out.append(x)
    rng.shuffle(out)
    return [(i, " ".join(x)) for i, x in enumerate(out)] + [(9001, None), (9002, ""), (9003, "a b"), (9004, "A  b"), (9005, "a b c d e")]


@pytest.mark.parametrize(("block", "checks", "common", "bits", "n"), [(512, 512, 200_000, 1 << 26, 60), (16, 3, 20, 1 << 10, 25)])
def test_stage_keeps_one_of_planted_near_copies(spark, monkeypatch, block, checks, common, bits, n):
    for name, value in (("BLOCK", block), ("SHARED_CHECKS", checks), ("COMMON_SHINGLES", common), ("FILTER_BITS", bits)):
        monkeypatch.setattr(near_copies, name, value)
    table = planted(n)
    want, near = brute_kept(table)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in table], SCHEMA).repartition(3)
    got = corpus_pipeline.one_of_a_kind(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((False, r.doc_id) for r in got.collect()) == want and near > 60 and len(want) < len(table) - 40
    assert corpus_pipeline.one_of_a_kind(spark, docs.where("false"), "").count() == 0


def test_no_group_is_lost_by_null_or_repeated_ids(spark):
    table = [(None, "a b"), (7, "a b"), (7, "a b"), (None, "z"), (7, "quite another text without a copy"), (3, "one more text"), (9, "one more text"), (9, "only here")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in table], SCHEMA)
    got = corpus_pipeline.one_of_a_kind(spark, docs, "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(7, "a b"), (None, "z"), (7, "quite another text without a copy"), (3, "one more text"), (9, "only here")], key=str)


def test_runs_of_shared_shingles():
    rng = random.Random(8)
    for size in (1, 2, 7, 1000):
        pairs = sorted((rng.randrange(40), rng.randrange(6)) for _ in range(150))
        nodes: dict[int, set[int]] = {}
        for s, n in pairs:
            nodes.setdefault(s, set()).add(n)
        parts = [pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs[k : k + size]], pa.int64()) for i in (0, 1)], ["shingle", "node"]) for k in range(0, len(pairs), size)]
        got = [tuple(r) for b in near_copies.shared_runs(iter([parts[0].slice(0, 0), *parts])) for r in zip(*(c.to_pylist() for c in b.columns))]
        assert sorted(got) == sorted((s, n) for s, ns in nodes.items() if len(ns) > 1 for n in ns)


def test_columns_that_clash_and_odd_rows(spark):
    table = [(1, "a b c d e f"), (2, "A b c d e  f"), (3, None), (4, ""), (None, None), (5, "x " * 60_000), (6, "x " * 60_000)]
    names = ["near_id", "near_null", "near_digest", "digest", "node", "size", "fp", "prefix", "shingle", "root", "hub", "best"]
    docs = spark.createDataFrame(table, "doc_id long, text string").withColumns({n: F.lit(n) for n in names})
    got = near_copies.keep_one(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 3, 5]
    assert near_copies.keep_one(docs.where("text is null")).count() == 1


def test_fingerprints_never_part_near_sets():
    rng = np.random.default_rng(2)
    for n in (1, 5, 80, 700, 5000):
        x = np.unique(rng.integers(2**63, size=n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: max(1, n * 8 // 9)], rng.integers(2**63, size=n // 9, dtype=np.uint64)]))
        apart = sum(int(b).bit_count() for b in (near_copies.parities(x) ^ near_copies.parities(y)).view(np.uint64))
        assert apart <= len(set(x.tolist()) ^ set(y.tolist()))


def test_checks_go_in_rounds(spark, monkeypatch):
    texts = [" ".join(f"w{(i // 4) * 50 + j}" for j in range(40)) + f" end{i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = sorted(r.doc_id for r in near_copies.keep_one(docs).collect())
    made = []
    count = near_copies.filter_of
    monkeypatch.setattr(near_copies, "filter_of", lambda nodes: made.append(0) or count(nodes))
    monkeypatch.setattr(near_copies, "ROUND_CHECKS", 5)
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == whole == list(range(0, 40, 4))
    assert len(made) >= near_copies.MOST_ROUNDS


def test_long_sets_travel_whole_only_if_their_outlines_allow_it(spark, monkeypatch):
    """Long texts that share passages and no more are told apart by outlines, near ones are found, and whole sets of the others never travel."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(50_000)]
    base = [rng.choice(words) for _ in range(3000)]
    near = [*base[:2900], *(rng.choice(words) for _ in range(100))]
    far = [[rng.choice(words) for _ in range(2600)] + base[:300] for _ in range(4)]
    texts = [" ".join(t) for t in (base, near, *far)]
    names = [near_copies.name_of(near_copies.shingle_set(t)) for t in texts]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    pairs = spark.createDataFrame([(n, names[0]) for n in names[1:]], "node long, hub long")
    met, real = [], near_copies.checked
    monkeypatch.setattr(near_copies, "checked", lambda p, d, whole: (met.append((whole, p.count())), real(p, d, whole))[1])
    assert [tuple(r) for r in near_copies.verified(pairs, docs).collect()] == [(names[1], names[0])]
    assert met == [(False, 5), (True, 1)]
    sets = [near_copies.shingle_set(t) for t in texts]
    for x in sets:
        for y in sets:
            apart = [np.frombuffer(near_copies.outline(s), np.int64) for s in (x, y)]
            assert near_copies.outlines_may_be_near(*apart) or not near_copies.sets_are_near(x, y)
