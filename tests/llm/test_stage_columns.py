"""Pipeline stages keep columns of any name and type, and samples are drawn without gathering a language."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import language

NAMES = ["_id", "_null", "_hash", "_copy", "_key", "_row", "_n", "_first", "node", "fingerprint", "component_id", "id", "lang_pred", "score"]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(11)
    words = ["".join(r.choices("abcdefgh", k=6)) for _ in range(300)]
    texts = [" ".join(r.choices(words, k=80)) for _ in range(12)]
    texts[5] = texts[4]
    texts[7] = texts[6] + " one"
    rows = [(i, t, "en", "s", len(t), {"k": str(i), "j": "x"}, *[f"{n}{i}" for n in NAMES]) for i, t in enumerate(texts)]
    rows += [rows[3], (None, "a text without an id", "en", "s", 20, None, *[None] * len(NAMES)), (20, None, None, None, None, {}, *["x"] * len(NAMES))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra map<string,string>, " + ", ".join(f"{n} string" for n in NAMES))


def as_text(df):
    return sorted(str([r[c] for c in df.columns]) for r in df.collect())


def test_near_dedup_keeps_columns(spark, docs):
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and kept.schema["extra"].dataType == docs.schema["extra"].dataType
    want = docs.where(F.col("doc_id").isNull() | ~F.col("doc_id").isin(5, 7)).dropDuplicates([c for c in docs.columns if c != "extra"])
    assert as_text(kept) == as_text(want)


def test_language_stage_keeps_columns(spark, docs):
    kept = corpus_pipeline.language_id(spark, docs, "")
    assert kept.columns == docs.columns and as_text(kept) == as_text(docs.where("text is not null"))


def test_training_rows_of_a_large_language(spark):
    """One text repeated most of the time counts once; a share of the hashes that holds too few texts is widened."""
    same = spark.range(4000).select(F.lit(1).alias("doc_id"), F.lit("the same text").alias("text"), F.lit("en").alias("lang"))
    others = spark.range(60).select((F.col("id") + 2).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") < 50, "en").otherwise("de").alias("lang"))
    docs = same.unionByName(others)
    for rows in (3, 40, 100):
        chosen = language.training_rows(docs, F.lit(True), rows)
        got = sorted((r.lang, r.text) for r in chosen.collect())
        want = []
        for lang in ("de", "en"):
            distinct = docs.where(F.col("lang") == lang).select("text", F.xxhash64("doc_id", "text").alias("h")).distinct().orderBy("h").limit(rows)
            want += [(lang, r.text) for r in distinct.collect()]
        assert got == sorted(want)
