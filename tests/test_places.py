"""Physical order: lines of files read in many blocks, rows of Parquet files, repair of logs, manifests."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from verdance.operators import runs, sampling
from verdance.sources.places import read_lines, read_rows, write_lines
from verdance.sources.tables import SAMPLE_LOG


@pytest.fixture
def small_blocks(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "50", "spark.sql.files.minPartitionNum": "3"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k in keys:
        spark.conf.unset(k)


def test_lines_keep_their_numbers(small_blocks, tmp_path):
    spark, rng, want = small_blocks, random.Random(3), set()
    for f in ("a b+c.jsonl", "b.jsonl", "empty.jsonl", "long.jsonl"):
        lines = [] if f == "empty.jsonl" else ["x" * 5000, "", "y" * 3000] if f == "long.jsonl" else [rng.choice(["", "  ", "z" * rng.randrange(1, 90) + str(i)]) for i in range(400)]
        (tmp_path / f).write_text("\n".join(lines) + ("\n" if f == "b.jsonl" else ""))
        entries = [(i, v) for i, v in enumerate(lines) if v.strip()]
        want |= {(f, i, n, v) for n, (i, v) in enumerate(entries)}
    df = read_lines(spark, str(tmp_path))
    assert df.select(F.spark_partition_id()).rdd.getNumPartitions() >= 3
    assert {(r["log"].split("/")[-1], r["line"], r["entry"], r["value"]) for r in df.collect()} == want


def test_files_of_a_folder_are_one_log(small_blocks, tmp_path):
    rows = small_blocks.range(3000).select((F.col("id") % 3).cast("string").alias("log"), F.col("id"), F.concat(F.lit("line "), "id").alias("v")).orderBy(F.rand(1))
    write_lines(rows, str(tmp_path / "out"), "v", ["id"], "log")
    for g in range(3):
        got = read_lines(small_blocks, f"{tmp_path}/out/log={g}", folders=True).orderBy("line").collect()
        assert [r["value"] for r in got] == [f"line {i}" for i in range(g, 3000, 3)] and [r["line"] for r in got] == [r["entry"] for r in got] == list(range(1000))
    assert read_lines(small_blocks, str(tmp_path / "out"), folders=True).select("log").distinct().count() == 3


def checks(k):
    return {
        "truncated JSON": F.col("e._corrupt").isNull() & F.col("e").isNotNull(),
        "duplicate or gap": F.col("e.item_id") == F.col("entry"),
        "different source text": F.col("e.content_sha256") == F.sha2(F.col("entry").cast("string"), 256),
        "samples": F.size("e.raw_samples") == k,
        "seed": F.col("e.seed") == F.col("entry") * 7,
    }


def sequential(lines, k):
    """The rule itself: one line after another."""
    kept = []
    for n, line in enumerate(lines):
        if not line.strip():
            continue
        i = len(kept)
        try:
            e = json.loads(line)
        except json.JSONDecodeError:
            return kept, n, "truncated JSON"
        for name, ok in {"duplicate or gap": e["item_id"] == i, "different source text": e["content_sha256"] == hashlib.sha256(str(i).encode()).hexdigest(), "samples": len(e["raw_samples"]) == k, "seed": e["seed"] == i * 7}.items():
            if not ok:
                return kept, n, name
        kept.append(e)
    return kept, None, None


def test_repair_equals_a_sequential_reading(small_blocks, tmp_path):
    spark, rng, want = small_blocks, random.Random(5), {}
    for f in ("sound", "torn", "twice", "gap", "hash", "few", "seed", "all"):
        lines = []
        for i in range(120):
            e = {"item_id": i, "temperature": 0.7, "seed": i * 7, "content_sha256": hashlib.sha256(str(i).encode()).hexdigest(), "raw_samples": ["s"] * 4}
            at = i == 77 or f == "all" and i > 20
            e |= {"gap": {"item_id": i + 1}, "hash": {"content_sha256": "0"}, "few": {"raw_samples": ["s"]}, "seed": {"seed": 1}}.get(f, {}) if at else {}
            e |= rng.choice([{"seed": 0}, {"raw_samples": []}, {}]) if at and f == "all" else {}
            lines += [json.dumps(e)] + ([json.dumps(e)] if at and f == "twice" else []) + rng.choice([[], [], ["", " "]])
        if f == "torn":
            lines = lines[:-1] if not lines[-1].strip() else lines
            lines[-1] = json.dumps({"item_id": 119})[:-4]
        (tmp_path / f"{f}.jsonl").write_text("\n".join(lines))
        want[f] = sequential(lines, 4)
    entries = read_lines(spark, str(tmp_path)).withColumn("e", F.from_json("value", f"{SAMPLE_LOG}, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"}))
    told = {r["log"].split("/")[-1].split(".")[0]: r for r in runs.log_damage(entries, checks(4)).collect()}
    assert {f: (r["n_kept"], r["line"], r["damage"]) for f, r in told.items()} == {f: (len(k), n, d) for f, (k, n, d) in want.items()}
    assert {d for _, _, d in want.values()} == {None, *checks(4)}
    kept = runs.log_prefix(entries, checks(4)).select(F.regexp_extract("log", r"([a-z]+)\.jsonl$", 1).alias("run"), "entry", "value")
    write_lines(kept, str(tmp_path / "repaired"), "value", ["entry"], "run")
    for f, (k, _, _) in want.items():
        again = read_lines(spark, f"{tmp_path}/repaired/run={f}", folders=True).orderBy("line").collect()
        assert [json.loads(r["value"]) for r in again] == k


def test_rows_keep_their_numbers(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(3):
        spark.range(i * 100, i * 100 + 70 + i).selectExpr("id", "id % 7 as g").coalesce(1).write.mode("append").parquet(path)
    files = sorted(r[0] for r in spark.read.parquet(path).select("_metadata.file_path").distinct().collect())
    order = [r["id"] for f in files for r in spark.read.parquet(f).collect()]
    got = {r["id"]: r["source_row_index"] for r in read_rows(spark, path).filter("g <> 3").collect()}
    assert got == {v: n for n, v in enumerate(order) if v % 7 != 3}


def test_samples_and_manifests_locate_their_source(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(200).select("id", (F.col("id") % 4 == 0).alias("bad"), F.concat(F.lit("q"), F.col("id") % 9).alias("q")).write.parquet(path)
    source = read_rows(spark, path)
    picked = sampling.balanced(source, "bad", 40, 1, "id", whole=True)
    assert picked.count() == 40
    assert tuple(runs.source_alignment(picked, source, "source_row_index", ["q"]).first()) == ("VERIFIED", 40, 40)
    moved = picked.withColumn("source_row_index", F.col("source_row_index") + F.when(F.col("review_order") == 0, 1000).otherwise(0))
    assert tuple(runs.source_alignment(moved, source, "source_row_index", ["q"]).first()) == ("FAILED", 39, 40)
    assert runs.source_alignment(picked.limit(0), source, "source_row_index", ["q"]).first()[0] == "FAILED"
    with pytest.raises(Exception, match="can't supply"):
        sampling.balanced(source, "bad", 150, 1, "id", whole=True).collect()
    hashed = {"q_sha256": F.sha2("q", 256)}
    sets = spark.createDataFrame([(4, "spot")], "item long, audit_set string")
    public, private = runs.manifests(picked, "id", ["source_row_index"], hashed, ["q"], sets)
    assert set(public.columns) == {"id", "source_row_index", "q_sha256", "in_audit_union", "audit_sources"} and private.columns == ["id", "q"]
    assert tuple(runs.manifests_agree(public, private, "id", hashed).first()) == (40, 40, 40, True)
    other = private.withColumn("q", F.when(F.col("id") % 8 == 0, "else").otherwise(F.col("q"))).filter("id % 3 > 0")
    r = runs.manifests_agree(public, other, "id", hashed).first()
    assert r["verified"] is False and r["n_public"] == 40 and r["n_agree"] < r["n_private"] < 40
    with pytest.raises(ValueError, match="private columns"):
        runs.manifests(picked, "id", ["q"], hashed, ["q"], sets)
