"""What the third review found, on small tables."""

import hashlib
import re

from pyspark.sql import functions as F

import __spark_entry__
from verdance.functions import scans, text
from verdance.operators import cases, profile, ranking, sheets, votes


def against_sql(spark, d, name, *tables):
    """Rows of a query and of its SQL over the Parquet files in d, as sorted texts."""
    import duckdb

    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    rel = con.sql(__spark_entry__.oracle_sql()[name])
    df = __spark_entry__.queries()[name](spark, str(d))
    assert sorted(df.columns) == sorted(rel.columns)
    return sorted(str(tuple(r)) for r in df.select(*rel.columns).collect()), sorted(str(tuple(r)) for r in rel.fetchall())


def test_sheet_problems_where_a_wrong_id_is_another_customers(spark, tmp_path):
    k = F.col("id")
    spark.range(9, 101_000, 100).select(k.alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    got, want = against_sql(spark, tmp_path, "sheet_problems", "customer")
    assert got == want and any("100009" in r for r in got)


def test_hashed_cells_make_each_hash_once(spark):
    df = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 7).alias("c"))
    cells = ranking.hashed_cells(df, "k", ["c"], 5)
    assert cells._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 1
    want = {}
    for k in range(300):
        for rep in range(5):
            number = int(hashlib.sha256(f"0|{rep}|{k}".encode()).hexdigest()[:8], 16)
            want[k % 7, rep] = want.get((k % 7, rep), 0) + sum(t <= number for t in ranking.POISSON)
    assert {(r["c"], r["rep"]): r["weight"] for r in cells.collect()} == want
    drawn = ranking.hashed_weights(df, "k", 5).groupBy("c", "rep").agg(F.sum("weight").alias("weight"))
    assert {(r["c"], r["rep"]): r["weight"] for r in drawn.collect()} == want


def poll(spark):
    say = F.concat(F.lit("**Answer:** $x="), (F.col("id") % 11).cast("string"), F.lit("$"))
    samples = spark.range(400).select((F.col("id") % 80).alias("item_id"), F.floor(F.col("id") / 80).alias("pos"), F.when(F.col("id") % 13 == 0, "none").otherwise(say).alias("response"))
    truths = spark.range(80).select(F.col("id").alias("item_id"), F.lit("Find x?").alias("question"), F.concat(F.lit("$x="), (F.col("id") % 3).cast("string"), F.lit("$")).alias("truth"))
    return samples, truths


def test_once_labels_rare_values_where_they_stand(spark, monkeypatch):
    samples, _ = poll(spark)
    rows = votes.fields(samples, ["item_id"])
    want = sorted(map(str, scans.with_labels(rows, "_field").collect()))
    for common in (0, 2, 10_000):
        monkeypatch.setattr(votes, "COMMON", common)
        got = votes.once(rows, "_field", lambda forms: scans.with_labels(forms, "_field"), ["item_id"], apart=common == 2)
        assert sorted(map(str, got.collect())) == want


def test_votes_move_rows_only_by_item(spark):
    samples, truths = poll(spark)
    samples = samples.repartition("item_id")
    for df in (votes.score_rules(samples, truths, ["item_id"]), votes.attributed(samples, truths, ["item_id"]), sheets.span_scores(samples, truths, ["item_id"]), profile.failures(samples, truths, ["item_id"]), cases.trace(samples, truths, ["item_id"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
        other = [line for line in moved if not re.search(r"hashpartitioning\((item_id#\d+L, (_field#\d+, )?\d|_?field#\d+, \d|pmod|_truth|truth_field#\d+, \d)", line)]
        assert not other, other


def test_responses_are_parsed_alike_whether_common_or_rare(spark, monkeypatch):
    samples, _ = poll(spark)
    samples = samples.union(spark.createDataFrame([(7, 9, None), (8, 9, "**Answer:** ")], "item_id long, pos long, response string"))
    want = sorted(map(str, samples.select("item_id", "pos", text.parse_answer(F.col("response")).alias("field")).collect()))
    for common in (0, 2, 10_000):
        monkeypatch.setattr(votes, "COMMON", common)
        assert sorted(map(str, votes.parsed(samples, ["item_id"]).collect())) == want


def test_a_question_is_scanned_once_for_all_flags(spark):
    samples, truths = poll(spark)
    sheet = sheets.audit_sheet(sheets.risk_sheet(sheets.span_scores(samples, truths, ["item_id"]), "item_id"), "item_id")
    assert sheet._jdf.queryExecution().optimizedPlan().toString().count(text.PAREN_LETTERS) == 1


def test_flag_bits_are_the_flags(spark):
    rows = [(None, "", None), ("Option B", "option b", "text:option b"), ("1, 2, 3", "1,2,3", "text:1"), ("a", "a", "text:a"), ("x=1, y=2", "x=1,y=2", "text:x=1, y=2"), ("", "", "text:")]
    df = spark.createDataFrame(rows, "final string, norm string, label string").withColumn("field", F.col("final")).withColumn("label", F.coalesce("label", F.lit(text.SENTINEL.lower())))
    marked = sheets._flagged(df, "field", "final", F.col("norm"), "label")
    for name, choice in (("_free", False), ("_choice", True)):
        flags = text.answer_flags(F.coalesce("final", F.lit("")), F.col("norm"), F.col("label"), F.lit(choice))
        got = marked.select(*(F.struct(up.alias("got"), F.coalesce(flags[f], F.lit(False)).alias("want")).alias(f) for f, up in sheets.raised(F.col(name)).items())).collect()
        assert all(r[f]["got"] == r[f]["want"] for r in got for f in sheets.FLAGS) and any(r[f]["got"] for r in got for f in sheets.FLAGS)
