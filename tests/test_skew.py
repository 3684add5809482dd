"""Heavy keys: the spread variants give what the plain ones give."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import skew
from foliant.session import union_all


def test_numbering_of_a_key_with_most_rows(spark):
    df = spark.range(5000).select((F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id"))).alias("k"), F.xxhash64("id").alias("o"))
    got = skew.number_rows(df, ["k"], ["o"]).orderBy("k", "o").collect()
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("o"))).orderBy("k", "o").collect()
    assert [(r.k, r.o, r.n) for r in got] == [(r.k, r.o, r.n) for r in want]


def test_salted_join_equals_the_plain_join(spark):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("zz", 4)], "k string, v int")
    counts = big.groupBy("k").agg(F.count("*").alias("n"))
    assert skew.heavy_keys(counts, "k", min_rows=100) == [("hot", 10)]
    got = skew.salted_join(big, small, "k", F.col("id"), counts, min_rows=100).select("k", "id", "v").collect()
    want = big.join(small, "k").select("k", "id", "v").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_top_k_is_cut_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("q"), F.col("id").alias("s"))
    top = skew.top_k(df, "q", [F.desc("s")], 3)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.q, r.s, r["rank"]) for r in top.collect()) == [(0, 94, 3), (0, 96, 2), (0, 98, 1), (1, 95, 3), (1, 97, 2), (1, 99, 1)]


def test_aggregates_over_a_reused_union(spark):
    left = spark.range(40).select((F.col("id") % 7).alias("k"), F.lit("a").alias("c")).groupBy("k", "c").count()
    right = spark.range(60).select((F.col("id") % 5).alias("k"), F.lit("b").alias("c")).groupBy("k", "c").count()
    both = union_all(left, right).groupBy("k").agg(F.sum("count").alias("n"))
    joined = both.join(both.withColumnRenamed("n", "m"), "k").collect()
    assert len(joined) == 7 and all(r.n == r.m for r in joined)
