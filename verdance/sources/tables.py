"""Readers with fixed schemas, and bindings of generic tables to evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RAW_LOG = (
    "item STRUCT<orig_q: STRING, pert_a: STRING, has_error: BOOLEAN, handwriting_style: BOOLEAN, image_quality: BOOLEAN>, transcription_samples_raw ARRAY<STRING>, grading_samples_raw ARRAY<STRING>, "
    "transcription_temp0_raw ARRAY<STRING>, grading_temp0_raw ARRAY<STRING>"
)
SAMPLE_LOG = "item_id INT, temperature DOUBLE, seed BIGINT, content_sha256 STRING, raw_samples ARRAY<STRING>, elapsed_seconds DOUBLE"
SCORED_RUN = (
    "orig_q STRING, pert_a STRING, has_error BOOLEAN, handwriting_style BOOLEAN, image_quality BOOLEAN, perception_entropy DOUBLE, reasoning_entropy DOUBLE, temp0_entropy_transcription DOUBLE, "
    "temp0_entropy_grading DOUBLE, transcription_correct BOOLEAN, grading_correct BOOLEAN, n_transcription_parse_failures INT, n_grading_parse_failures INT, model_id STRING, n_items INT, k_transcription INT, "
    "k_grading INT, target_error_frac DOUBLE, latex_parser_available BOOLEAN, sympy_version STRING"
)
AUDIT_SHEET = "item BIGINT, final_label STRING, confidence STRING, note STRING"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Missing or reordered columns are an error, not nulls."""
    return spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").schema(schema).csv(path)


def read_log(spark: SparkSession, path: str, schema: str = RAW_LOG) -> DataFrame:
    """JSON lines; lines that don't parse have null in every field and their text in _corrupt."""
    return spark.read.option("columnNameOfCorruptRecord", "_corrupt").schema(f"{schema}, _corrupt STRING").json(path)


def read_tree(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """case_id (the folder's name, without what a partitioned write puts before it) and case (the whole file) of every file in a tree of folders."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    folder = F.url_decode(F.regexp_replace(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1), r"\+", "%2B"))
    return files.select(F.regexp_replace(folder, "^case_id=", "").alias("case_id"), F.col("value").alias("case"))


def write_tree(bundles: DataFrame, item: str, path: str, case: str = "case") -> None:
    """One folder and file a bundle."""
    bundles.select(F.col(item).cast("string").alias("case_id"), F.col(case)).write.partitionBy("case_id").text(path)


def numbered(df: DataFrame, by: str, order: list[Column], name: str = "pos") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)


# ---- bindings ----


def event_votes(spark: SparkSession, d: str, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(item_id, pos, label) of each user's first k events, and (item_id, truth) from the one after them."""
    rows = numbered(table(spark, d, "events").select(F.col("user_id").alias("item_id"), F.col("event_type").alias("label"), "ts", "event_id"), "item_id", [F.col("ts"), F.col("event_id")]).drop("ts", "event_id")
    # one pass: the truth rides along, and both sides come from the same ranked rows
    return rows.filter(F.col("pos") < k), rows.filter(F.col("pos") == k).select("item_id", F.col("label").alias("truth"))


def event_run(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    """The scored run of event votes: item_id, k, n_distinct, entropy, majority..., correct, stratum."""
    from ..operators.votes import votes

    samples, truths = event_votes(spark, d, k)
    return votes(samples, ["item_id"]).join(truths, "item_id").withColumns({"correct": F.col("majority") == F.col("truth"), "stratum": F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd")})


def responses(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Answer texts in eight forms of markup, one a line item (item_id, pos, response), and each order's reference answer (item_id, question, truth)."""
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax")]
    items = numbered(table(spark, d, "lineitem"), "l_orderkey", order)
    v = F.col("l_quantity").cast("int") % 4
    form, s = (F.col("l_partkey") + F.col("pos")) % 8, v.cast("string")
    text = (
        F.when(form == 0, F.concat(F.lit("**Answer:** $x="), s, F.lit("$"))).when(form == 1, F.concat(F.lit("**Answer:** The value is "), s, F.lit(".5 cm.")))
        .when(form == 2, F.concat(F.lit("\\textbf{Answer: Option "), F.char(v + 65), F.lit("}"))).when(form == 3, F.concat(F.lit("Working\nAnswer: \\boxed{"), s, F.lit("}")))
        .when(form == 4, F.concat(F.lit("**Answer:** \\[ \\text{x} = "), s, F.lit(" \\]"))).when(form == 5, F.concat(F.lit("no marker "), s))
        .when(form == 6, F.concat(F.lit("**Answer:** {2}\\,"), s, F.lit(" + y; z, $ 5."))).otherwise(F.concat(F.lit("**Answer:** Option "), F.char(v + 97), F.lit(" ``` junk")))
    )
    t, tf = F.col("o_orderkey") % 4, F.col("o_custkey") % 4
    truth = F.when(tf == 0, F.concat(F.lit("$x="), t.cast("string"), F.lit("$"))).when(tf == 1, F.concat(F.lit("The value is "), t.cast("string"), F.lit(".5 cm"))).when(tf == 2, F.concat(F.lit("Option "), F.char(t + 65))).otherwise(F.concat(F.lit("\\boxed{"), t.cast("string"), F.lit("}")))
    asked = F.element_at(F.array(*(F.lit(x) for x in ("Which option holds for ", "What is x for ", "Is it (a) more or (b) less of ", "Match \\item x with ", "Find y for "))), (F.col("o_custkey") % 5 + 1).cast("int"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), F.concat(asked, "o_orderpriority", F.lit("?")).alias("question"), truth.alias("truth"), (F.col("o_orderstatus") == "F").alias("has_error"))
    return items.select(F.col("l_orderkey").alias("item_id"), "pos", text.alias("response")), orders


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as items: item_id, score (length), h (an entropy-like level), fails, correct (quality), toxic, lang, source."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("n_chars").cast("double").alias("score"), "n_chars", "lang", "source")
    marks = table(spark, d, "labels").select(F.col("doc_id").alias("item_id"), (F.col("quality") == 1).alias("correct"), (F.col("toxic") == 1).alias("toxic"))
    # The seven entropies of five votes, to six places, spread over the documents by length.
    level = F.element_at(F.array(*(F.lit(x) for x in (0.0, 0.500402, 0.673012, 0.950271, 1.05492, 1.332179, 1.609438))), (F.col("n_chars") % 7 + 1).cast("int"))
    return docs.join(marks, "item_id").withColumns({"h": level, "fails": (F.col("n_chars") % 5 == 0).cast("int")})
