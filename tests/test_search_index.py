"""Published search tables against searches over the store itself, and the plans they give."""

import re

import pytest
from pyspark.sql import functions as F

from foliant.operators import lexical
from foliant.operators.postings import term_stats
from foliant.plans import ingest as I, retrieve as R
from foliant.plans.search_index import SearchIndex
from foliant.plans.store import Store
from test_ingest import MODEL, docs, sources  # noqa: F401

WORDS = "red green blue apple pear plum tree house river stone".split()


def text(seed, n=60):
    return "\n\n".join(" ".join(WORDS[(seed * 7 + i * i + i * j * (seed + 1)) % len(WORDS)] for j in range(6)) for i in range(n // 6))


@pytest.fixture(scope="module")
def filled(spark, sources, tmp_path_factory):  # noqa: F811
    """Two batches, a publication after each: some documents are new, some replaced."""
    root = tmp_path_factory.mktemp("index")
    store = Store(spark, str(root / "kb"))
    index = SearchIndex(spark, str(root / "search"), buckets=16, slice_rows=15)  # the common words are cut into slices
    assert index.publish(store) is None and index.base().chunks.count() == 0
    first = docs(spark, *[("s1", f"{i}.txt", text(i)) for i in range(6)], ("s2", "keep.txt", "only kept words stay here"), ("s1", "old.md", "# Old title\n\nformer zebra text"))
    I.ingest_batch(store, first, sources, MODEL)
    assert index.publish(store) == 1
    second = docs(spark, *[("s1", f"{i}.txt", text(i + 20)) for i in range(3)], ("s1", "old.md", "# New title\n\nlater quagga text"), ("s1", "new.txt", text(50)))
    I.ingest_batch(store, second, sources, MODEL)
    assert index.publish(store) == 2
    return store, index


QUERIES = [("a", "red apple"), ("b", '"green pear"'), ("c", "zebra"), ("d", "quagga"), ("e", "-red -blue"), ("f", "house or river -stone"), ("g", "title"), ("h", "kept"), ("i", "the unknown"),
           ("j", '"blue tree" or plum green'), ("k", "red green blue apple pear plum tree house river stone")]


def rows(df, *columns):
    return sorted(tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in columns) for r in df.collect())


def test_search_equals_search_over_the_store(spark, filled):
    store, index = filled
    queries = spark.createDataFrame([(q, t, None if i % 3 else ["s1"]) for i, (q, t) in enumerate(QUERIES)], "query_id string, query string, source_ids array<string>")
    plain = I.knowledge_base(store).active()
    want = rows(lexical.lexical_search(queries, plain.postings, 4, None, plain.chunks), "query_id", "rank", "chunk_id", "score")
    found = rows(index.text_search(queries, 4), "query_id", "rank", "chunk_id", "score")
    assert found == want
    assert {f[0] for f in found} >= set("abdefghj") and not {f[0] for f in found} & set("ci")  # a replaced text is gone, its successor is found


def test_profiles_equal_those_over_the_store(spark, filled):
    store, index = filled
    queries = spark.createDataFrame([("a", "red apple"), ("d", "quagga")], "query_id string, query string")
    want = R.retrieve(queries, I.knowledge_base(store), MODEL, "HYBRID", None, 5, 0.1)
    assert rows(R.retrieve(queries, index.base(), MODEL, "HYBRID", None, 5, 0.1), *want.columns) == rows(want, *want.columns)


def test_live_tables_equal_the_store(filled):
    store, index = filled
    plain = I.knowledge_base(store).active()
    for table, want in (("section", plain.sections), ("chunk", plain.chunks), ("posting", plain.postings)):
        key = [c for c in ("section_id", "chunk_id", "term") if c in want.columns]
        assert rows(index.active(table), *key) == rows(want, *key)
    some = store.versions().where("version_number = 2")
    assert rows(index.read_version("chunk", some), "chunk_id", "content") == rows(store.read_version("chunk", some), "chunk_id", "content")


def test_term_counts_are_kept(filled):
    store, index = filled
    assert rows(index.term_counts(), "term", "n") == rows(term_stats(I.knowledge_base(store).active().postings), "term", "n")
    files = index.term_counts().inputFiles()
    assert files and not any("posting" in f for f in files)


def exchanges_above(plan, scan):
    """Names of the operators between a scan of a table and the join above it, in a formatted-as-text tree."""
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if re.search(rf"Scan parquet .*{scan}", line))
    depth = re.search(r"[A-Z]", lines[at]).start()
    found = []
    for line in reversed(lines[:at]):
        begin = re.search(r"\w", line)
        if begin and begin.start() < depth:
            depth = begin.start()
            found.append(line.strip(" +-:*()0123456789"))
            if "Join" in line:
                break
    return found


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_live_rows_are_not_moved(spark, filled):
    _, index = filled
    with_small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for table in ("embedding", "chunk", "section"):
            plan = executed(index.active(table))
            assert "ShuffledHashJoin" in plan and "Exchange" not in plan, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_small)


def test_buckets_are_pruned_and_postings_stay(spark, filled, monkeypatch):
    _, index = filled
    plans = []
    from foliant.plans import search_index

    cut = search_index.cut_lineage
    monkeypatch.setattr(search_index, "cut_lineage", lambda df: plans.append(executed(df)) or cut(df))
    with_small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index.matches(lexical._asked(spark.createDataFrame([("1", "kept words")], "query_id string, query string"))).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_small)
    scans = [p for p in plans if "_posting" in p]
    assert len(scans) == 2
    for plan in scans:
        chosen = re.search(r"_posting.*SelectedBucketsCount: (\d+) out of 16", plan)
        assert chosen and int(chosen[1]) <= 2, plan
        above = exchanges_above(plan, r"\S*_posting")
        assert "ShuffledHashJoin" in above[-1] and not any("Exchange" in a for a in above), plan


def test_publications_are_whole_or_invisible(spark, sources, tmp_path):  # noqa: F811
    store = Store(spark, str(tmp_path / "kb"))
    index = SearchIndex(spark, str(tmp_path / "search"), buckets=4)
    I.ingest_batch(store, docs(spark, ("s1", "a.txt", "first words"), ("s1", "b.txt", "other words")), sources, MODEL)
    index.publish(store)
    I.ingest_batch(store, docs(spark, ("s1", "a.txt", "second words")), sources, MODEL)

    class Stopped(SearchIndex):
        def _write(self, table, df, number):
            if table == "live":
                raise RuntimeError("executor lost")
            super()._write(table, df, number)

    with pytest.raises(RuntimeError, match="executor lost"):
        Stopped(spark, str(tmp_path / "search"), buckets=4).publish(store)
    assert rows(index.active("chunk"), "content") == [("first words",), ("other words",)]
    assert rows(index.term_counts(), "term", "n") == [("first", 1), ("other", 1), ("words", 2)]
    assert index.publish(store) == 2 == index.publish(store)
    assert rows(index.active("chunk"), "content") == [("other words",), ("second words",)]
    assert rows(index.term_counts(), "term", "n") == [("other", 1), ("second", 1), ("words", 2)]
    # Another session finds the tables by their folder.
    for table in ("section", "chunk", "embedding", "posting", "term_count", "live"):
        spark.sql(f"DROP TABLE {index.name(table)}")
    again = SearchIndex(spark, str(tmp_path / "search"), buckets=4)
    assert again.publications() == [1, 2] and rows(again.active("chunk"), "content") == [("other words",), ("second words",)]


def test_versions_written_again_count_once(spark, sources, tmp_path):  # noqa: F811
    store = Store(spark, str(tmp_path / "kb"))
    index = SearchIndex(spark, str(tmp_path / "search"), buckets=4)
    code = "```\nabcdefgh\n"
    I.ingest_batch(store, docs(spark, ("s1", "a.txt", "plain")), sources, MODEL)
    index.publish(store)
    I.ingest_batch(store, docs(spark, ("s1", "a.txt", code)), sources, MODEL, n=12)  # fails: nothing changes
    index.publish(store)
    assert rows(index.active("chunk"), "content") == [("plain",)]
    I.resume_versions(store, store.versions().where("status = 'FAILED'"), MODEL)
    index.publish(store)
    assert rows(index.active("chunk"), "content") == [(code,)] and rows(index.term_counts(), "term", "n") == [("abcdefgh", 1)]
    queries = spark.createDataFrame([("1", "abcdefgh"), ("2", "plain"), ("3", "-plain")], "query_id string, query string")
    assert rows(index.text_search(queries, 5), "query_id", "rank") == [("1", 1), ("3", 1)]
