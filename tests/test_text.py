"""Sectioning and chunking on literal texts, against plain Python walks."""

import random
import re

from pyspark.sql import functions as F

from foliant.functions import ids, text as T
from foliant.operators import chunks as D, sections as C
from foliant.params import Limits
from foliant.plans.ingest import parse_documents

MD = (
    "intro\n\n# A\n\ntext a\n\n```py\n# not\n\n```\nafter\n## B ##\nb\n### C\n# A\n## Root\n# Root\n####\n~~~\n# x\n```\n~~~~  \n\n# Ⅷ ﬁ Über\nlast\n\n")


def markdown(spark, *texts):
    rows = [("s", f"d{i}", "MARKDOWN", t.encode(), "h", f"doc{i}", f"v{i}") for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "source_id string, external_document_id string, format string, content binary, content_hash string, document_id string, document_version_id string")


def section_list(spark, text):
    return C.section_rows(parse_documents(markdown(spark, text))).orderBy("section_order").collect()


def test_outline_and_keys(spark):
    rows = section_list(spark, MD)
    assert [r.stable_key for r in rows] == ["root", "a", "a/b", "a/b/c", "a#2", "a#2/root", "root#2", "root#2/section", "viii-fi-über"]
    by_key = {r.stable_key: r for r in rows}
    assert by_key["a/b/c"].parent_id == by_key["a/b"].section_id
    assert by_key["root#2/section"].level == 4 and by_key["root#2/section"].content == "~~~\n# x\n```\n~~~~  "
    assert by_key["a"].content == "text a\n\n```py\n# not\n\n```\nafter"
    assert by_key["a/b"].title == "B" and by_key["a/b"].title_path == ["A", "B"]
    assert by_key["root"].content == "intro" and by_key["root"].parent_id is None


def test_byte_order_mark_and_line_ends(spark):
    rows = section_list(spark, "﻿# One\r\ntext\rmore\r\n")
    assert [(r.stable_key, r.content) for r in rows] == [("root", ""), ("one", "text\nmore")]


def walk(text):
    """Stable keys by a plain walk over lines."""
    fence, keys, counts, last = None, ["root"], {"root": 1}, {}
    for line in text.split("\n"):
        mark = re.match(r" {0,3}(`{3,}|~{3,})(.*)$", line)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not mark[2].strip():
                fence = None
            continue
        if mark:
            fence = mark[1]
            continue
        head = re.match(r"[ \t]{0,3}(#{1,6})(?:[ \t]+|$)(.*)$", line)
        if not head:
            continue
        level = len(head[1])
        title = re.sub(r"\s+#+\s*$", "", head[2]).strip()
        above = [last[n] for n in range(level - 1, 0, -1) if n in last]
        slug = re.sub(r"[^a-z0-9]+", "-", title.lower()).strip("-") or "section"
        base = f"{above[0]}/{slug}" if above else slug
        counts[base] = counts.get(base, 0) + 1
        key = base if counts[base] == 1 else f"{base}#{counts[base]}"
        last = {n: k for n, k in last.items() if n < level} | {level: key}
        keys.append(key)
    return keys


def test_random_outlines_match_a_walk(spark):
    rng = random.Random(7)
    pieces = ["# a", "## a", "### b", "## root", "# root", "###### deep", "text", "", "```", "~~~", "````", "  ~~~~", "# b ##", "#no", "    # code"]
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(150)]
    got = {}
    for r in C.section_rows(parse_documents(markdown(spark, *texts))).orderBy("section_order").collect():
        got.setdefault(int(r.external_document_id[1:]), []).append(r.stable_key)
    for i, text in enumerate(texts):
        assert got[i] == walk(text), text


def test_too_many_sections_are_not_folded(spark):
    text = "\n".join(f"# h{i}" for i in range(12))
    row = parse_documents(markdown(spark, text), Limits(max_sections=10)).first()
    assert row.section_count == 13 and row.sections is None


def chunk_lists(spark, texts, n):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, c string").select("i", T.chunk_texts(F.col("c"), n).alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


def test_chunk_cases(spark):
    small = chunk_lists(spark, ["alpha beta gamma delta", "One two. Three four. Five.", "a\nb\n\nc   d \t e"], 12)
    assert small == [["alpha beta", "gamma delta"], ["One two.", "Three four.", "Five."], ["a b", "c d e"]]
    code = "before\n```\nx  \n\ny\n```\nafter\n```bad`info\nstill text"
    assert chunk_lists(spark, [code], 100) == [["before", "```\nx  \n\ny\n```", "after ```bad`info still text"]]
    assert chunk_lists(spark, ["~~~\nabcdefghij"], 5) == [["~~~\na", "bcdef", "ghij"]]
    assert chunk_lists(spark, ["", "  \n ", "x"], 5) == [[], [], ["x"]]


def test_edit_stays_local(spark):
    before, after = chunk_lists(spark, ["p one\n\np two\n\np three", "p one\n\nnew\n\np two\n\np three"], 2400)
    assert [c for c in after if c not in before] == ["new"]


def test_chunks_rejoin_to_the_normalised_text(spark):
    rng = random.Random(3)
    words = ["aa", "Bbb.", "cccc!", "D?", "eeeeeeeeeeeeeeeeeeeeeeeee", "f", "Gg", "1.", "(h)", "\"Ii.\""]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    for n in (10, 17, 40):
        for text, parts in zip(texts, chunk_lists(spark, texts, n)):
            assert all(0 < len(p) <= n for p in parts)
            assert "".join(parts).replace(" ", "") == text.replace(" ", "")


def python_hard_split(s, n):
    out, at = [], 0
    while at < len(s):
        end = min(at + n, len(s))
        if end < len(s):
            cut = s.rfind(" ", at + 1, end)
            end = cut if cut > at else end
        if s[at:end].strip():
            out.append(s[at:end].strip())
        at = end
        while at < len(s) and s[at] == " ":
            at += 1
    return out


def test_hard_split_matches_a_loop(spark):
    rng = random.Random(5)
    texts = [" ".join("x" * rng.randint(1, 20) for _ in range(rng.randint(1, 12))) for _ in range(200)]
    for n in (12, 40):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, c string").select("i", T.hard_split(F.col("c"), n).alias("x")).collect()
        for r in rows:
            assert r.x == python_hard_split(texts[r.i], n)


def test_sentence_rule_against_the_jdk(spark):
    text = ("He said \"Stop!\" Then he left. \"No.\" He ran (fast.) Yes wow!yes a.b c? d e.g. foo. 3 apples. 4 Bananas... and so. "
            "(Then) more. [x] Y. - Foo. «Bar» z! End")
    iterator = spark._jvm.java.text.BreakIterator.getSentenceInstance(spark._jvm.java.util.Locale.ROOT)
    iterator.setText(text)
    want, start, end = [], iterator.first(), iterator.next()
    while end != -1:
        want.append(text[start:end].strip())
        start, end = end, iterator.next()
    got = spark.createDataFrame([(text,)], "t string").select(F.split(T.mark_sentences(F.col("t")), "\x00")).first()[0]
    assert [s.strip() for s in got] == want


def test_name_based_uuid_matches_the_jdk(spark):
    jvm = spark._jvm
    for parts in (("section", "v", "root"), ("chunk", "ü", "0")):
        text = "\n".join(parts)
        want = jvm.java.util.UUID.nameUUIDFromBytes(text.encode()).toString()
        assert spark.range(1).select(ids.name_uuid(*parts)).first()[0] == want


def test_markdown_lines_flag_fences(spark):
    df = C.decode_text(markdown(spark, MD))
    lines = C.markdown_lines(df).orderBy("line_no").collect()
    assert [r.line for r in lines] == MD.split("\n")
    assert [r.line for r in lines if r.in_fence] == ["```py", "# not", "", "```", "~~~", "# x", "```", "~~~~  "]


def test_section_and_chunk_checks(spark):
    sections = spark.createDataFrame(
        [("v", "s1", "a", None), ("v", "s2", "a", "s1"), ("v", "s3", " ", "s3"), ("w", "s4", "b", "s1"), ("w", "s5", "c", "zz")],
        "document_version_id string, section_id string, stable_key string, parent_id string")
    found = {(r.section_id, r.violation) for r in C.check_sections(sections).collect()}
    assert found == {("s1", "repeated stable key"), ("s3", "blank stable key"), ("s3", "section is its own parent"),
                     ("s4", "parent section in another version"), ("s5", "parent section missing")}
    chunks = spark.createDataFrame(
        [("v", "c1", "s1", 0), ("v", "c1", "s2", 0), ("v", "c2", "s1", 0), ("v", "c3", "s1", -1), ("v", "c4", "s4", 0)],
        "document_version_id string, chunk_id string, section_id string, chunk_index int")
    versions = spark.createDataFrame([("v",), ("w",)], "document_version_id string")
    found = {(r.chunk_id, r.violation) for r in D.check_chunks(chunks, sections, versions).collect()}
    assert found == {("c1", "repeated chunk id"), ("c1", "repeated chunk index"), ("c3", "negative chunk index"),
                     ("c4", "section not in version"), (None, "version without chunks")}
