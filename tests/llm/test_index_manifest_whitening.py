"""The positional index, the Merkle manifest and whitening against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixkin.llm import decontaminate, merkle, whitening

ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(ASCII_LOWER))


def marks(text, items, width=10):
    w, hit, ids = words(text), set(), set()
    for item, body in items:
        v = words(body)
        n = min(width, len(v))
        for s in range(len(v) - n + 1 if n else 0):
            for at in range(len(w) - n + 1):
                if w[at : at + n] == v[s : s + n]:
                    hit.update(range(at, at + n))
                    ids.add(item)
    ids = sorted(str(i) for i in ids if i is not None)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


def corpus():
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("aa bb Cc dd ee ÉE straße x1 9 zz".split()) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 10, 11, 25]))) for i in range(12)] + [(3, "some other item of three"), (None, "nameless item here"), (50, None), (51, "..."), (52, "the " * 14), (53, "never-seen words")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)]
    for i in range(12):  # copies with other case and gaps, one of them at a text's very start and end
        body = items[i][1].upper().replace(" ", " -- ")
        docs.append((100 + i, f"{text(5) if i % 2 else ''}{'; ' if i % 2 else ''}{body}{', ' + text(4) if i % 3 else ''}"))
    docs += [(200, None), (201, ""), (202, "--- ..."), (203, "the " * 30), (204, "x" * 30_000 + " " + items[4][1] + " end" * 5000), (None, "a nameless item here"), (205, "Nameless  ITEM\nhere"), (206, "some other\titem of three!")]
    return docs + [docs[0], docs[45], (301, docs[45][1])] * 3, items


@pytest.fixture(scope="module")
def both(spark):
    docs, items = corpus()
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


def test_windows_against_brute_force(both):
    docs, items = corpus()
    got = sorted((tuple(r) for r in decontaminate.contamination_report(*both).collect()), key=str)
    assert got == sorted(((i, *marks(t, items)) for i, t in docs), key=str)
    assert sum(g[2] > 0 for g in got) > 10


def test_tables_too_large_to_travel_give_the_same(both, monkeypatch):
    want = sorted((tuple(r) for r in decontaminate.contamination_report(*both).collect()), key=str)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert sorted((tuple(r) for r in decontaminate.contamination_report(*both).collect()), key=str) == want


def test_decontaminate_clashing_columns_and_empty_tables(both):
    docs, items = both
    odd = docs.withColumns({c: F.lit("own") for c in ("n_hit", "item_ids", "contaminated", "k1", "k2", "pos", "term", "text_k1", "text_salt", "N_WORDS2")})
    out = decontaminate.decontaminate(odd, items.withColumn("term", F.lit(1)))
    assert out.columns == ["doc_id", "text", "k1", "k2", "pos", "term", "text_k1", "text_salt", "N_WORDS2", "n_words", "n_hit", "item_ids", "contaminated"]
    assert out.where("contaminated").count() > 10 and out.where("k1 = 'own' and text_salt = 'own'").count() == docs.count()
    assert decontaminate.contamination_report(docs.where("false"), items).count() == 0
    assert decontaminate.contamination_report(docs, items.where("false")).where("n_hit > 0 or n_items > 0 or contaminated").count() == 0


def test_proximity_against_brute_force(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("ab bc cd de ef fg gh".split()) for _ in range(n))
    docs = [(i, text(rng.randint(0, 25))) for i in range(60)] + [(99, "rare one two x three y four")]
    items = [(i, text(rng.choice([1, 2, 4, 6]))) for i in range(6)] + [(7, "four three two one rare"), (8, "one five")]
    count = {}
    for _, t in docs:
        for w in words(t):
            count[w] = count.get(w, 0) + 1
    for reach in (2, 6):
        got = {tuple(r) for r in decontaminate.near_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), reach=reach, width=4).collect()}
        want = set()
        for i, t in docs:
            w = words(t)
            for item, body in items:
                v = words(body)
                for s in range(max(1, len(v) - 3)):
                    window = v[s : s + 4]
                    if all(count.get(x) for x in window):
                        least = min(count[x] for x in window)
                        rare = next(x for x in window if count[x] == least)
                        if any(x == rare and set(window) <= set(w[max(0, p - reach) : p + reach + 1]) for p, x in enumerate(w)):
                            want.add((i, str(item)))
        assert got == want and want


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(docs):
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf_of = lambda r: H(*map(value, r))

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            run = level[i // 3 * 3 : i // 3 * 3 + 3]
            out.append((run[: i % 3], run[i % 3 + 1 :]))
            i //= 3
        return out

    first = lambda x: (x is not None, x if isinstance(x, int) else (x or "").encode())
    groups = {}
    for d_id, text, lang, source, n in docs:
        r = (d_id, source, lang, n, text)
        groups.setdefault(source, []).append((leaf_of(r), r))
    names = sorted(groups, key=first)
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: ((x[1][0] is not None, x[1][0] or 0), x[0]))
        trees[s] = tree([x[0] for x in groups[s]])
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        for i, (leaf, r) in enumerate(groups[s]):
            steps = path(trees[s], i) + path(top, j)
            text = r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
            now = leaf_of((*r[:4], text))
            for before, after in steps:
                now = H(*before, now, *after)
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], H(*(x for before, after in steps for x in before + after)), now, now == top[-1][0]))
    return sorted(out, key=str)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(n, sources):
    rng = random.Random(n)
    return [(i, rng.choice([f"text {i}\nmore", f"één {i}", "x\n\ny", "", None]), rng.choice(["en", None]), rng.choice(sources), rng.choice([i, None])) for i in rng.sample(range(1000), n)]


@pytest.mark.parametrize("nodes", [0, 200_000])
@pytest.mark.parametrize("n, sources", [(1, ["a"]), (2, [None]), (7, ["a", "b", None]), (300, ["a", "a", "a", "é", "Z", "z", "", None]), (90, [f"s{i}" for i in range(60)])])
def test_manifest_against_brute_force(spark, monkeypatch, n, sources, nodes):
    monkeypatch.setattr(merkle, "BROADCAST_NODES", nodes)
    docs = documents(n, sources)
    if n == 300:
        docs += [docs[0], docs[0], (None, "a\nb", None, "a", 1), (None, "a\nb", None, "a", 1), (docs[5][0], "another\ntext of one id", "en", docs[5][3], 2), (5000, "long line\n" * 20_000, "en", "a", 3)]
    got = sorted((tuple(r) for r in merkle.manifest_report(spark.createDataFrame(docs, SCHEMA).repartition(3).withColumns({"leaf": F.lit(1), "tree": F.lit(2), "idx": F.lit(3)})).collect()), key=str)
    assert got == brute_manifest(docs)
    assert n < 300 or 0 < sum(g[-1] for g in got) < len(got)


def test_manifest_sql_and_empty_table(spark):
    docs = documents(120, ["a", "a", "b", None, "c"])
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", docs)
    rows = con.sql(f"select doc_id, leaf, subroot, root, proof_sha256, folded_root, verified from ({merkle.MANIFEST_SQL})").fetchall()
    assert sorted(rows, key=str) == brute_manifest(docs)
    assert merkle.manifest_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_manifest_proves_every_row_that_was_not_changed(spark):
    rows = spark.createDataFrame(documents(100, ["a", "b"]), SCHEMA).withColumn("leaf", merkle.leaf([F.col(c) for c in merkle.FIELDS]))
    manifest = merkle.Manifest(rows, "source", "doc_id")
    proved = manifest.rows.join(manifest.proofs(), manifest.n).select(merkle.folded(merkle.as_text(F.col("leaf")), F.col("siblings"), F.col("depth") + merkle.depth(F.lit(manifest.of_trees))).alias("root"))
    assert {r.root for r in proved.collect()} == {manifest.root.hex()} and proved.count() == 100


def vectors(n=200, d=6, seed=5):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + rng.normal(size=d) * 30).astype(np.float32)


def brute_whitening(v):
    x = np.floor(v.astype(float) * 64).astype(np.int64) + 1_000_000
    n, s = len(x), [int(c) for c in x.sum(axis=0)]
    y = x - np.array(s) / n
    e, w = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(e)[::-1][:32]
    return [sum((n * int(c) - t) ** 2 for c, t in zip(row, s)) for row in x], y @ w[:, order] / np.sqrt(e[order]), e[order] / e.sum(), n


def test_whitening_against_brute_force(spark):
    v = vectors()
    odd = [(900, None), (901, [float("nan")] * 6), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [float("inf")] + [0.0] * 5), (904, [1.0, 2.0]), (905, []), (None, v[0].tolist()), (3, v[3].tolist())]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + odd, "vec_id long, embedding array<float>").repartition(5)
    rows = whitening.whitening_report(df.withColumns({"whitened": F.lit("x"), "deviation": F.lit("y")})).collect()
    deviation, white, explained, n = brute_whitening(np.vstack([v, v[:1], v[3:4]]))
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, []).append(r)
    assert set(by) == {*range(200), None} and len(by[3]) == 12 and len(by[None]) == 6 and len(rows) == 202 * 6
    signs = [np.sign(white[7, c] * next(r.whitened for r in by[7] if r.component == c + 1)) for c in range(6)]
    for i in [*range(200), None]:
        for r in by[i]:
            j = 0 if i is None else i
            assert r.n == n and r.deviation == deviation[j] and r.identity_error < 1e-9
            assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
            assert abs(r.whitened * signs[r.component - 1] - white[j, r.component - 1]) < 1e-8


def test_whitening_keeps_rows_and_names_and_takes_flat_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>, whitened string, vector_of_doubles string"
    df = spark.createDataFrame([(i, x.tolist(), "w", "own") for i, x in enumerate(vectors(50))] + [(99, None, "w", "own")], schema)
    out = whitening.whiten(df, whitening.fit(df, components=2))
    assert out.columns == ["vec_id", "embedding", "vector_of_doubles", "deviation", "whitened"] and out.where("vector_of_doubles = 'own' and size(whitened) = 2").count() == 50
    flat = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "vec_id long, embedding array<float>")
    for none in (flat, flat.where("false"), flat.limit(1), flat.withColumn("embedding", F.lit(None).cast("array<float>"))):
        assert whitening.whitening_report(none).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(40)], "vec_id long, embedding array<float>")
    assert {r.component for r in whitening.whitening_report(line).collect()} == {1}


def test_deviations_stay_exact_beyond_doubles_and_are_null_beyond_longs():
    model = lambda x: whitening.Whitening(len(x), tuple(int(s) for s in x.astype(object).sum(axis=0)), *[np.zeros(0)] * 3)
    big = np.array([[2**40, 5], [2**40 + 3, 9], [2**40 - 1, 2]], np.int64)
    s = [int(c) for c in big.astype(object).sum(axis=0)]
    assert model(big).deviation(big) == [sum((3 * int(c) - t) ** 2 for c, t in zip(r, s)) for r in big]
    far = np.array([[0, 0], [2**50, 1]], np.int64)
    assert model(far).deviation(far) == [None, None]
    parts = whitening.sums_of(iter([np.full((4, 2), 2**61, np.int64), np.full((3, 2), -(2**61), np.int64)]))
    assert parts["n"] == 7 and list(parts["sums"]) == [2**61] * 2
