"""What the fourth review found, on small tables."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from verdance.operators import ranking

POINTS = {"low": 0.025, "mid": 0.5, "high": 0.975, "least": 0.0, "most": 1.0}


def percentile(df, by):
    whole = df.groupBy(*by).agg(*(F.percentile("v", F.lit(q)).alias(n) for n, q in POINTS.items()))
    return sorted(map(str, whole.collect()))


@pytest.mark.parametrize("ranges", [4, 1024])
def test_quantiles_are_those_of_all_values(spark, monkeypatch, ranges):
    monkeypatch.setattr(ranking, "PLACE_RANGES", ranges)
    odd = [("one", 5.0), ("two", 1.0), ("two", 2.0), ("void", None), ("void", None), (None, 3.0), (None, None), (None, 4.5), ("far", float("inf")), ("far", 1.0), ("far", float("-inf")), ("nan", float("nan")), ("nan", 7.0), ("nan", 8.0)]
    i = F.col("id")
    even = spark.range(3000).select(F.when(i % 7 == 0, "A").when(i % 7 < 3, "N").otherwise("R").alias("g"), ((i * 7919) % 2003 / 100.0).alias("v"))
    tied = spark.range(2000).select(F.lit("tied").alias("g"), F.when(i % 50 > 0, 41.5).otherwise(i).cast("double").alias("v"))
    apart = spark.range(500).select(F.concat(F.lit("g"), i % 125).alias("g"), (F.pow(F.lit(-3.0), i % 125) + i).alias("v"))
    df = spark.createDataFrame(odd, "g string, v double").union(even).union(tied).union(apart).repartition(5).cache()
    assert sorted(map(str, ranking.quantiles(df, "v", POINTS, ["g"]).collect())) == percentile(df, ["g"])
    finite = df.filter("g not in ('far', 'nan')")
    assert sorted(map(str, ranking.quantiles(finite, "v", POINTS).collect())) == percentile(finite, [])
    void = df.filter("g = 'void'")
    assert sorted(map(str, ranking.quantiles(void, "v", POINTS, ["g"]).collect())) == percentile(void, ["g"])
    empty = df.filter("g = 'none'")
    assert ranking.quantiles(empty, "v", POINTS, ["g"]).count() == 0 and sorted(map(str, ranking.quantiles(empty, "v", POINTS).collect())) == percentile(empty, [])


def test_percentiles_equal_their_sql_with_nulls_and_ties(spark, tmp_path):
    import duckdb

    i = F.col("id")
    flag = F.when(i % 11 == 0, None).when(i % 11 < 5, "A").when(i % 11 == 6, "X").otherwise("R")
    price = F.when((i % 13 == 0) | (i % 11 == 6), None).when(i % 3 == 0, 1000.01).otherwise((i * 7919) % 5003 / 100.0)
    spark.range(4000).select(flag.alias("l_returnflag"), price.cast("double").alias("l_extendedprice")).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()["percentiles"]).fetchall()
    got = __spark_entry__.queries()["percentiles"](spark, str(tmp_path)).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want)) and len(want) == 4


SMALL_HEAP = """
import sys
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

d = sys.argv[1]
s = SparkSession.builder.master("local[2]").config("spark.driver.memory", "512m").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.warehouse.dir", d + "/warehouse").getOrCreate()
s.sparkContext.setLogLevel("OFF")
n = 4_000_000
s.range(n).select(F.lit("A").alias("l_returnflag"), ((F.col("id") * 7_919_123) % n / 4.0).alias("l_extendedprice")).write.parquet(d + "/lineitem.parquet")
import __spark_entry__

r = __spark_entry__.queries()["percentiles"](s, d).collect()
assert [tuple(x) for x in r] == [("A", 0.025 * (n - 1) / 4, (n - 1) / 8, 0.975 * (n - 1) / 4)], r
print("right")
"""


def test_percentiles_of_more_values_than_the_heap_holds(tmp_path):
    home = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    env = {k: v for k, v in os.environ.items() if k != "PYSPARK_GATEWAY_PORT" and k != "PYSPARK_GATEWAY_SECRET"} | {"PYTHONPATH": home + os.pathsep + os.environ.get("PYTHONPATH", "")}
    run = subprocess.run([sys.executable, "-c", SMALL_HEAP, str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0 and run.stdout.strip().endswith("right"), run.stderr[-2000:]
