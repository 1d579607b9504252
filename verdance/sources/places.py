"""Rows of files in their physical order, which is no column: numbered without a sort, and without a pass through one task.

Text is read in blocks. A block's lines lie together in one task, in order, so a row's place in its block is the distance of
its running number from the block's first; places before it are running totals over the blocks (a row a block, of 128 MB by
default). Parquet tells a row's place in its file, so there the totals go over the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

TASK = 1 << 33  # what a running number grows by from one task to the next


def _ahead(counted: str, order: str, *by: str) -> Column:
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(counted).over(before), F.lit(0))


def read_lines(spark: SparkSession, path: str, folders: bool = False) -> DataFrame:
    """log, line, entry, value of every line that isn't blank: its file, its number among the file's lines and among those that aren't blank (both from 0).

    folders: all files of a folder are one log, in the order of their names (as an ordered write leaves them). Lines end with \\n.
    The blocks are counted in one reading and the lines numbered in another; should Spark have cut the files otherwise in
    between (it may for files of less than a block a core, when executors come or go), the job fails and no number is wrong.
    """
    read = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    lines = read.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    said = F.coalesce(text.strip(F.col("value")) != "", F.lit(False))
    log = F.regexp_extract("_file", r"^(.*)/[^/]*$", 1) if folders else F.col("_file")
    blocks = lines.groupBy("_file", "_start").agg(F.count("*").alias("_lines"), F.count_if(said).alias("_entries"), F.min("_at").alias("_first"))
    blocks = blocks.withColumns({"_log": log, "_order": F.struct("_file", "_start"), "_task": F.floor(F.col("_first") / TASK)})
    blocks = blocks.withColumn("_first_entry", F.col("_task") * TASK + _ahead("_entries", "_first", "_task"))
    blocks = blocks.withColumns({"_lines_ahead": _ahead("_lines", "_order", "_log"), "_entries_ahead": _ahead("_entries", "_order", "_log")})
    counted = blocks.select(F.col("_file").alias("_f"), F.col("_start").alias("_s"), "_log", "_lines", "_entries", "_first", "_first_entry", "_lines_ahead", "_entries_ahead")
    numbered = lines.filter(said).withColumn("_nth", F.monotonically_increasing_id())  # the filter leaves gaps in _at, none in _nth
    line, entry = F.col("_at") - F.col("_first"), F.col("_nth") - F.col("_first_entry")
    same_cut = F.coalesce((line >= 0) & (line < F.col("_lines")) & (entry >= 0) & (entry < F.col("_entries")), F.lit(False))
    sound = F.when(same_cut, True).otherwise(F.raise_error(F.lit("files were cut into other blocks in the second reading: set spark.sql.files.minPartitionNum")).cast("boolean"))
    out = numbered.join(counted, (F.col("_file") == F.col("_f")) & (F.col("_start") == F.col("_s")), "left").filter(sound)
    return out.select(F.url_decode(F.regexp_replace("_log", r"\+", "%2B")).alias("log"), (line + F.col("_lines_ahead")).alias("line"), (entry + F.col("_entries_ahead")).alias("entry"), "value")


def write_lines(df: DataFrame, path: str, value: str, order: list[str], log: str | None = None) -> None:
    """Values as lines, in that order: ranges of it, each sorted, in files whose names follow it; with log, a folder for each of its values."""
    keys = [log, *order] if log else order
    sorted_ = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    writer = sorted_.select(*([log] if log else []), F.col(value).alias("value")).write
    (writer.partitionBy(log) if log else writer).text(path)


def read_rows(spark: SparkSession, path: str, name: str = "source_row_index") -> DataFrame:
    """A Parquet table with each row's number in it, from 0: files in the order of their paths, rows as they lie in them.

    The same however Spark cuts the files, and under filters. The totals take a row a file.
    """
    df = spark.read.parquet(path)
    file = F.col("_metadata.file_path")
    sizes = df.select(file.alias("_f")).groupBy("_f").agg(F.count("*").alias("_n"))
    ahead = sizes.select("_f", _ahead("_n", "_f").alias("_ahead"))
    placed = df.select("*", file.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return placed.join(ahead, F.col("_file") == F.col("_f")).withColumn(name, F.col("_ahead") + F.col("_row")).select(*df.columns, name)
