"""The pipeline against brute force, and the queries' schemas."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_documents import SCHEMA, brute_components, brute_fingerprint, brute_lines, key_of

from pixkin.llm import catalog, mixing, quality

DATA = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(80)]
    table = [(i, "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(4)), "en", f"s{i % 3}", 0) for i in range(90)]
    table = [(i, t, lang, s, len(t)) for i, t, lang, s, _ in table]
    table += [(200 + i, table[i][1], "en", "s0", len(table[i][1])) for i in range(5)]  # copies
    table += [(300 + i, " ".join(f"{rng.choice(words)}%%%" for _ in range(40)), "en", "s1", 1) for i in range(20)]  # junk
    labels = [(i, int(i < 300), 0) for i, *_ in table]
    spark.createDataFrame(table, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        made[name] = docs
    good, lines, kinds, mix, ids = made.values()
    assert {r.doc_id for r in good.collect()} == {r[0] for r in table if r[0] < 300}
    assert all(m.columns == ["doc_id", "text", "lang", "source", "n_chars"] for m in (good, lines, kinds, mix))
    kept = [tuple(r) for r in good.collect()]
    want = brute_lines(kept)
    first = {}
    for i, text, *_ in kept:
        for line in text.split("\n"):
            first[key_of(line)] = min(first.get(key_of(line), i), i)
    texts = {r.doc_id: r.text for r in lines.collect()}
    assert texts == {i: "\n".join(x for x in t.split("\n") if len(key_of(x)) < 10 or first[key_of(x)] == i) for i, t, *_ in kept} and len(want) == len(texts)
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    comp = brute_components({i: brute_fingerprint(t) for i, t in texts.items()})
    assert sorted(r.doc_id for r in kinds.collect()) == sorted({c for c in comp.values()})
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(kinds).collect()}
    assert sorted(r.doc_id for r in mix.collect()) == sorted(i for i, n in copies.items() for _ in range(n))
    assert ids.count() == mix.count() and ids.where("n_tokens < 2").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == ids.count()


def test_stages_take_odd_rows_and_names(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, clashing names, and an empty table."""
    rng = random.Random(4)
    words = [f"word{i}" for i in range(60)]
    text = lambda n: "\n".join(" ".join(rng.choice(words) for _ in range(9)) for _ in range(n))
    table = [(i, text(3), "en", "s", 1) for i in range(40)]
    table += [(None, text(3), None, None, None), (None, None, None, None, None), (3, None, "en", "s", 0), (4, "", "en", None, 0), (5, text(4000), "en", "s", 9), *[(6, "the same line of words twice", "en", "s", 1)] * 2, (None, text(2), "en", "s", 1)]
    spark.createDataFrame([(i, int(i % 9 > 0), 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(table, SCHEMA).withColumns({c: F.lit(c) for c in ("target", "copies", "n_lines", "key", "node", "_id", "good", "log_weight", "size", "digest")})
    for docs in (docs, docs.where("false")):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before = docs
            path = str(tmp_path / f"{docs.isEmpty()}{k}")
            stage(spark, docs, str(tmp_path)).write.parquet(path)
            docs = spark.read.parquet(path)
            if k < 4:
                assert docs.columns == before.columns
                assert before.isEmpty() or docs.where("doc_id is null").count() > 0 or k == 3


def test_keep_good_holds_clean_documents(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in quality.keep_good(docs, labels).select("doc_id").collect()}
    marks = {r.doc_id: r.quality for r in labels.collect()}
    good = [i for i, q in marks.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good)


@pytest.mark.parametrize(("name", "columns"), [
    ("op2_sentencepiece", ["doc_id:bigint", "n_tokens:bigint", "ids_sha256:string", "decoded_sha256:string"]),
    ("op3_shard_documents", ["doc_id:bigint", "size:bigint", "text_crc32:bigint", "law:string", "shard:int", "slot:bigint", "grown_shard:int"]),
    ("op4_progressive_jpeg", ["doc_id:bigint", "n_bytes:bigint", "payload_bytes:bigint", "payload_sha256:string", "tail_crc32:bigint", "media_bytes:bigint", "media_sha256:string", "feature:string"]),
    ("op5_line_dedup", ["doc_id:bigint", "n_lines:bigint", "n_dropped:bigint", "kept_sha256:string"]),
    ("op6_simhash_vp_tree", ["doc_id:bigint", "fingerprint:string", "component_id:bigint"]),
    ("op7_mix_sources", ["doc_id:bigint", "size:bigint", "source_size:bigint", "target:double", "taken:bigint"]),
    ("op8_toxicity_cnn", ["doc_id:bigint", "held_out:boolean", "score:double", "predicted:int"]),
    ("op9_anisotropic_search", ["query_id:bigint", "rank:int", "vec_id:bigint", "score:double"]),
    ("op10_site_templates", ["page_id:bigint", "url:string", "text:string", "n_chars:bigint"]),
])
def test_schemas(spark, name, columns):
    df = catalog.queries()[name](spark, DATA)
    assert [f"{n}:{t}" for n, t in df.dtypes][: len(columns)] == columns
    table = {"op9": "embeddings", "op10": "pages"}.get(name.split("_")[0], "documents")
    if table != "embeddings":
        assert df.select(F.count("*")).first()[0] == spark.read.parquet(f"{DATA}/{table}.parquet").count()
