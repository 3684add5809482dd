"""Dear inputs that several steps read are computed once."""

from pyspark.sql import functions as F

from foliant.operators import lexical, preview as H
from foliant.plans import ingest as I
from test_ingest import MODEL, docs


def counting(spark):
    """(accumulator, column function that gives its argument back and counts the rows)."""
    seen = spark.sparkContext.accumulator(0)

    def same(text):
        seen.add(1)
        return text

    return seen, F.udf(same, "string")


def test_queries_are_parsed_once(spark):
    seen, same = counting(spark)
    postings = spark.createDataFrame(
        [("red", "c1", "s", [(1, "B")]), ("fox", "c1", "s", [(2, "B")]), ("red", "c2", "s", [(1, "B")])],
        "term string, chunk_id string, source_id string, positions array<struct<pos:int,w:string>>")
    queries = spark.createDataFrame([("1", "red fox"), ("2", "red"), ("3", "fox or red"), ("4", "or fox or or or red")], "query_id string, query string")
    hits = lexical.lexical_search(queries.select("query_id", same("query").alias("query")), postings, 5)
    assert sorted((r.query_id, r.chunk_id) for r in hits.collect()) == [
        ("1", "c1"), ("2", "c1"), ("2", "c2"), ("3", "c1"), ("3", "c2")]
    assert seen.value == 4


def test_samples_are_made_once(spark):
    seen, same = counting(spark)
    base = I.in_memory_base(docs(spark, ("s1", "a.txt", "red fox runs"), ("s1", "b.txt", "red fox runs")), MODEL)
    samples = spark.createDataFrame([("d", 0, "red fox"), ("e", 0, "runs")], "document_id string, sample_index int, sample string")
    found = H.similar_materials(samples.withColumn("sample", same("sample")), base, MODEL, spark.createDataFrame([("s1",)], "source_id string"))
    assert {(r.for_document_id, r.method) for r in found.collect()} >= {("d", "LEXICAL"), ("e", "LEXICAL"), ("d", "SEMANTIC")}
    assert seen.value == 2
