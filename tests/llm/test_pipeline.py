"""The corpus pipeline: each stage takes effect on what its predecessor kept."""

import random

import corpus_pipeline
import pytest
from pyspark.sql.functions import lit as pyspark_lit
from verdance.llm import rules, simhash

from .test_ops import DOC, WORDS, brute_cut, sentence

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    good = [sentence(rng, rng.randint(60, 160)) + "." for _ in range(120)]
    passage = sentence(rng, 60)
    bad = [" ".join(w.upper() + "!!" for w in sentence(rng, 40).split()) for _ in range(30)] + [(rng.choice(WORDS) + " ") * 70 for _ in range(30)]
    copies = [good[0]] * 5 + [sentence(rng, 50) + " " + passage + " " + sentence(rng, 50) for _ in range(4)]
    texts = good + bad + copies + ["", None, "short text"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOC).write.parquet(path + "/documents.parquet")
    marks = [(i, int(i < 120), 0) for i in range(180)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(path + "/labels.parquet")
    return path


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(sf_dir + "/documents.parquet")
    kept = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
        if name != "pattern_packing":
            assert docs.columns == COLUMNS
        kept.append(docs.collect())
    start, good, ruled, single, cut, packed = kept
    ids = [{r["doc_id"] for r in k} for k in kept]
    assert ids[1] < ids[0] and len(ids[1] & set(range(120))) >= 115 and len(ids[1] & set(range(120, 180))) <= 3
    verdicts = {r["doc_id"]: r["kept"] for r in rules.op9(spark.createDataFrame(good, DOC)).collect()}
    assert ids[2] == {i for i in ids[1] if verdicts[i]} and not ids[2] & {189, 190, 191}
    prints = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op1(spark.createDataFrame(ruled, DOC)).collect()}
    assert ids[3] == {c for _, c in prints.values()} and len(single) == len(ids[3])
    copies = ids[2] & {0, *range(180, 185)}
    assert len(copies) > 1 and len(ids[3] & copies) <= 1
    want = {r[0]: r[1] - r[2] for r in brute_cut([tuple(r) for r in single])}
    assert ids[4] == ids[3] and {str(r["doc_id"]): len(r["text"].encode()) for r in cut} == want
    assert {r["doc_id"] for r in packed} == ids[4]
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(r["doc_id"] for r in packed)


def test_edges(spark, sf_dir, tmp_path):
    """Null and repeated ids, empty and very long texts, rows of nulls, an extra column; and an empty table."""
    rng = random.Random(13)
    docs = spark.read.parquet(sf_dir + "/documents.parquet")
    long = sentence(rng, 40_000) + "."
    odd = [(None, sentence(rng, 90) + ".", "en", "s", 1), (5, sentence(rng, 80) + ".", None, None, None), (5, sentence(rng, 80) + ".", "en", "s", 1), (900, long, "en", "s", len(long)), (901, "", "en", "s", 0), (None, None, None, None, None)]
    odd += [odd[0]] * 3
    both = docs.unionByName(spark.createDataFrame(odd, DOC)).withColumn("tag", pyspark_lit("x"))
    for rows, name in ((both, "odd"), (docs.limit(0), "none")):
        path = str(tmp_path / name)
        rows.write.parquet(path + "/documents.parquet")
        spark.read.parquet(sf_dir + "/labels.parquet").write.parquet(path + "/labels.parquet")
        out = corpus_pipeline.run(spark, path).collect()
        if name == "none":
            assert out == []
            continue
        pieces = {(r["doc_id"], r["piece"]) for r in out}
        assert sum(r["length"] for r in out if r["doc_id"] == 900) > 40_000 and (900, 20) in pieces
        assert sum(r["doc_id"] is None and r["piece"] == 0 for r in out) == 1 and sum(r["doc_id"] == 5 and r["piece"] == 0 for r in out) == 3
        by = {}
        for r in out:
            by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert all(max(o + n for o, n in places) == sum(n for _, n in places) <= 2048 for places in by.values())


def test_contract(spark):
    assert [n for n, _ in corpus_pipeline.STAGES][:3] == ["quality_classifier", "quality_rules", "simhash_near_dedup"] and corpus_pipeline.ORACLE_SQL is None
    from verdance.llm import catalog

    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in catalog.QUERIES} and set(catalog.ORACLES) <= set(catalog.QUERIES)
