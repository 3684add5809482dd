"""Language, quality, near-duplicates, sketches, top-k, archives and the pipeline against brute force and held-out data."""

import base64
import gzip
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from check import rows_of
from foliant.llm import language, quality, simhash, sketches, warc
from foliant.llm.components import components
from foliant.llm.pivot_topk import huge_search, topk
from foliant.llm.queries import ORACLES, QUERIES

SYLLABLES = {"en": "th er on and ing of to st", "fr": "eau ou é aux ment le que", "de": "sch ei ung ver ß ge en"}
JUNK = ["%%%", "###", "&&&"]


def prose(lang: str, seed: int, n: int = 60) -> str:
    r = random.Random(f"{lang}{seed}")
    own = SYLLABLES[lang].split()
    return " ".join("".join(r.choices(own, k=r.randint(1, 3))) for _ in range(n)).capitalize() + "."


def odd_documents(spark, texts, **more):
    rows = [(i, t, None, "s", 0, 1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fingerprint double")


# Language


@pytest.fixture(scope="module")
def talk(spark):
    rows = [(i, prose(lang, i), lang, "s", 0) for i in range(120) for lang in SYLLABLES]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    rows += [(1000, None, "en", "s", 0), (1001, "123 456 !", "en", "s", 0), (1002, "", "fr", None, 0), (1003, prose("en", 5) * 40, None, "s", 0), (None, prose("de", 1), "de", "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="module")
def model(talk):
    return language.train(talk, ~language.held_out())


def test_languages_of_held_out_texts(talk, model):
    got = language.identify(talk, model).join(talk.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.doc_id < 1000 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 40 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    for i in (1000, 1001, 1002):
        assert (by[i].lang_pred, by[i].score, by[i].bits_per_byte) == ("und", 0.0, None)
    assert by[1003].lang_pred == "en"
    assert language.identify(talk, model).where("doc_id is null").first().lang_pred == "de"


def test_code_lengths_equal_plain_ppm(talk, model):
    import pyarrow as pa

    texts = [prose("en", 500), prose("fr", 501, 400), "Ж unseen\x00 bytes", "a", ""]
    bits, sizes = language.code_lengths(model, pa.array(texts))
    training = language.training_rows(talk, ~language.held_out()).collect()
    for k, lang in enumerate(model.languages):
        counts = defaultdict(Counter)
        for row in training:
            if row.lang == lang:
                data = b"\n" * 4 + row.text.encode()
                for p in range(4, len(data)):
                    for order in range(5):
                        counts[data[p - order:p]][data[p]] += 1
        for text, found, size in zip(texts, bits[:, k], sizes):
            data, total = b"\n" * 4 + text.encode(), 0.0
            for p in range(4, len(data)):
                for order in range(4, -1, -1):
                    seen = counts.get(data[p - order:p])
                    if not seen or order and sum(seen.values()) < language.MIN_COUNT:
                        continue
                    n, different = sum(seen.values()), len(seen)
                    if seen[data[p]]:
                        total -= math.log2(seen[data[p]] / (n + different))
                        break
                    total -= math.log2(different / (n + different))
                else:
                    total += 8
            assert abs(total - found) < 1e-3 + 1e-5 * size


def test_training_reads_neither_held_out_nor_unlabelled_texts(spark, talk):
    rows = language.training_rows(talk, ~language.held_out()).collect()
    allowed = {r.text for r in talk.collect() if r.lang and r.text and (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5)}
    assert {r.text for r in rows} <= allowed and len(rows) > 250
    few = language.training_rows(talk, ~language.held_out(), rows=10).groupBy("lang").count().collect()
    assert {r["count"] for r in few} == {10}


def test_no_language_learned(spark):
    docs = odd_documents(spark, ["some text", None])
    model = language.train(docs, ~language.held_out())
    assert [r.lang_pred for r in language.identify(docs, model).collect()] == ["und", "und"]
    assert language.identify(docs.limit(0), model).count() == 0


# Quality


def graded(seed: int) -> tuple[int, str]:
    r = random.Random(seed)
    kind, text = r.choice([0, 1, 2, 2, 2]), prose("en", seed)
    if kind == 0:
        text = " ".join(w + r.choice(JUNK) for w in text.split())
    elif kind == 1:
        words = text.split()
        for _ in range(3):
            words.insert(r.randrange(len(words)), r.choice(["idiot", "scum", "moron"]))
        text = " ".join(words)
    return kind, text


def test_quality_on_held_out_texts(spark):
    rows = [(i, *graded(i)) for i in range(900)]
    docs = spark.createDataFrame([(i, t) for i, _, t in rows] + [(5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k > 0), int(k == 1)) for i, k, _ in rows if i < 600] + [(0, None, 1), (9999, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, quality.grade(F.col("quality"), F.col("toxic")))
    assert model.thresholds[0] < model.thresholds[1]
    got = {r.doc_id: r for r in quality.rate(docs, model).collect()}
    held = [(k, got[i]) for i, k, _ in rows if i >= 600]
    assert sum((r.p_best >= 0.5) == (k == 2) for k, r in held) / len(held) > 0.95
    means = [np.mean([r.expected_grade for k, r in held if k == g]) for g in range(3)]
    assert means[0] < means[1] < means[2]
    assert (got[5000].expected_grade, got[5000].p_best) == (got[5001].expected_grade, got[5001].p_best)
    again = quality.train(docs.repartition(5), labels.repartition(4), quality.grade(F.col("quality"), F.col("toxic")))
    assert np.array_equal(model.weights, again.weights)


def test_quality_without_labels(spark):
    docs = odd_documents(spark, ["text", None])
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), quality.grade(F.col("quality"), F.col("toxic")))
    assert not model.weights.any()
    assert quality.rate(docs, model).count() == 2 and quality.rate(docs.limit(0), model).count() == 0


def test_ordinal_slopes():
    """Fitted grades follow the features; slopes are held against differences in test_quality_brute_force."""
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 3, 400)
    flat = np.concatenate([np.sort(np.unique(np.append(rng.integers(0, 40, 6), 100 + g))) for g in grades])
    counts = np.array([len(np.sort(np.unique(x))) for x in np.split(flat, np.flatnonzero(np.diff(flat) < 0) + 1)])
    model = quality.fit(grades, flat, counts, 3)
    standing = np.add.reduceat(model.weights[flat], np.cumsum(counts) - counts)
    assert (((model.tails(standing) > 0.5).sum(axis=1)) == grades).mean() > 0.97


# Near-duplicates


def slow_fingerprint(text: str | None, width: int = 3) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + width]), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fingerprints: dict) -> dict:
    parent = {i: i for i in fingerprints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in fingerprints:
        for j in fingerprints:
            if i < j and (fingerprints[i] ^ fingerprints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in fingerprints}


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 16)  # so that keys of copies are cut into parts
    texts = [None, "", "One", "one", "A b", "É b C d"]
    for seed in range(12):
        base = prose("en", seed, 80).split()
        texts.append(" ".join(base))
        for k in range(12):
            r = random.Random(seed * 100 + k)
            edited = list(base)
            for _ in range(r.randint(0, 3)):
                edited[r.randrange(len(edited))] = r.choice(["x", "yy", "zzz"])
            texts.append("\t".join(edited))
    docs = odd_documents(spark, texts)
    want = {i: slow_fingerprint(t) for i, t in enumerate(texts)}
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == want
    assert {i: r.component_id for i, r in got.items()} == slow_components(want)
    assert got[0].component_id == got[1].component_id == 0


def test_every_link_shares_a_key():
    r = random.Random(2)
    for _ in range(300):
        x = y = r.getrandbits(64)
        for _ in range(r.randint(0, 3)):
            y ^= 1 << r.randrange(64)
        agreeing = sum((x >> s) % (1 << n) == (y >> s) % (1 << n) for s, n in simhash.blocks_of(3))
        assert agreeing >= 3
    assert sum(n for _, n in simhash.blocks_of(3)) == sum(n for _, n in simhash.blocks_of(5)) == 64


def test_similar_texts_link_beyond_the_radius(spark):
    base = prose("en", 77, 120).split()
    texts = [" ".join(base)]
    for k in range(40):  # two to four words changed: most five-word shingles stay
        r = random.Random(k)
        edited = list(base)
        for _ in range(r.randint(2, 4)):
            edited[r.randrange(len(edited))] = r.choice(["x", "yy", "zzz"])
        texts.append(" ".join(edited))
    texts += [" ".join(base[:60] + prose("en", s, 60).split()) for s in range(5)] + [None, "", "x"]
    docs = odd_documents(spark, texts)
    plain = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    wide = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, similarity=0.8).collect()}
    assert all(wide[i] == wide[plain[i]] for i in plain)  # links are only added
    prints = [slow_fingerprint(t) for t in texts]
    sets = [slow_shingles(t or "") for t in texts]
    for i in range(1, 41):
        apart = (prints[0] ^ prints[i]).bit_count()
        if apart <= simhash.WIDE_RADIUS and len(sets[0] & sets[i]) / len(sets[0] | sets[i]) >= 0.8:
            assert wide[i] == 0 or apart > 3
    assert sum(wide[i] == 0 for i in range(1, 41)) > sum(plain[i] == 0 for i in range(1, 41))
    assert all(wide[i] == plain[i] for i in range(41, len(texts)))


def crowded(monkeypatch, shared=False):
    """Texts of three families whose given fingerprints all lie under the same keys, the smallest belonging to a text of its own,
    and how many bits and which shingles two of them share."""
    r, texts, prints = random.Random(3), [prose("de", 900, 60)], [0]
    for k in range(60):
        words = prose("en", 800 + k % 3, 60).split()
        for _ in range(r.randint(0, 2)):
            words[r.randrange(60)] = r.choice(["x", "yy", "zzz"])
        texts.append(" ".join([*words, f"w{k}"]))  # equal texts would have equal fingerprints
        prints.append(sum(1 << b for b in r.sample(range(24), 4)))
    if shared:  # equal fingerprints of equal and of other texts
        texts, prints = texts + [texts[0] + " x", texts[1], prose("fr", 7)], prints + [prints[1], prints[1], prints[2]]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, width, id_column, text_column: docs.select(F.col(id_column), F.expr(
        f"element_at(array({', '.join(map(str, prints))}), int({'_named.id' if id_column == '_named' else id_column}) + 1)").cast("long").alias("fingerprint")))
    sets = [slow_shingles(t) for t in texts]
    apart = lambda i, j: (prints[i] ^ prints[j]).bit_count()
    alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8
    return texts, apart, alike


def slow_groups(n: int, linked) -> dict:
    group = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j) and group[i] != group[j]:
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    return dict(enumerate(group))


@pytest.mark.parametrize("part", [8, 1024])
def test_every_pair_of_a_large_key_is_judged(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    texts, apart, alike = crowded(monkeypatch)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(odd_documents(spark, texts), similarity=0.8).collect()}
    assert got == slow_groups(len(texts), lambda i, j: apart(i, j) <= 3 or apart(i, j) <= 5 and alike(i, j))


@pytest.mark.parametrize("part", [8, 1024])
def test_verified_links(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    texts, apart, alike = crowded(monkeypatch, shared=True)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(odd_documents(spark, texts), similarity=0.8, verified=True).collect()}
    assert got == slow_groups(len(texts), lambda i, j: apart(i, j) <= 5 and alike(i, j))


def test_stage_keeps_texts_that_are_near_by_fingerprint_only(spark, tmp_path):
    base = prose("en", 3, 120).split()
    texts = [" ".join(base)]
    for k in range(300):
        r, edited = random.Random(k), list(base)
        for i in r.sample(range(10, 110, 10), 4):
            edited[i] = r.choice(["x", "yy", "zzz"])
        texts.append(" ".join(edited))
    sets = [slow_shingles(t) for t in texts]
    prints = [slow_fingerprint(t) for t in texts]
    i, j = next((i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3 and len(sets[i] & sets[j]) < 0.8 * len(sets[i] | sets[j]))
    docs = odd_documents(spark, [texts[i], texts[j], "", None, texts[i]])
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, str(tmp_path)).collect()) == [0, 1, 2]


@pytest.mark.parametrize("n", [2, 10, 40, 400])
def test_links_inside_a_key(n):
    r = random.Random(n)
    base, values = [r.getrandbits(64) for _ in range(max(1, n // 8))], set()
    while len(values) < n:
        x = r.choice(base)
        for _ in range(r.randint(0, 4)):
            x ^= 1 << r.randrange(64)
        values.add(x)
    values = np.array(sorted(values), np.uint64)
    i, j = simhash.linked_pairs(values)
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if int(values[a] ^ values[b]).bit_count() <= 3}
    assert set(zip(i.tolist(), j.tolist())) == want
    edges = simhash.group_edges(values.view(np.int64).copy(), np.array([0, n]))
    assert n <= simhash.SMALL or len(edges) < n


def test_near_duplicates_of_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(5, "same words here"), (5, "same words here"), (None, "same words here"), (None, "all alone")], "doc_id long, text string")
    got = sorted(((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == [("5", 5), ("5", 5), ("None", 5), ("None", None)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(4)
    pairs = [(i, i + 1) for i in range(40)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(50)] + [(200, 200), (7, None), (301, 300), (300, 301)]
    parent = {x: x for p in pairs if None not in p and p[0] != p[1] for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a in parent and b in parent:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Sketches


def slow_shingles(text: str) -> set:
    words = [w for w in text.lower().replace("\n", " ").replace("\t", " ").split(" ") if w]
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_edited_fingerprints(spark):
    texts = [prose("en", s, 30 + 20 * s) for s in range(12)] + [None, "", "Äö\tz", "x", prose("fr", 3, 90), prose("fr", 3, 90)]
    docs = odd_documents(spark, texts)
    rows = {r.doc_id: r for r in sketches.edited_fingerprints(docs).withColumn("near", sketches.resemblance(F.col("sketch"), F.col("edited_sketch"))).withColumn(
        "near_next", sketches.resemblance(F.col("sketch"), F.col("next_sketch"))).collect()}
    clean = [t or "" for t in texts]
    for i, text in enumerate(clean):
        after = clean[i - 1]
        m = len(text) // 3
        edited = text[:len(text) - m] + after[:m]
        assert (rows[i].n_chars, rows[i].edited) == (len(text), edited)
        for got, other in ((rows[i].near, edited), (rows[i].near_next, after)):
            a, b = slow_shingles(text), slow_shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(got - true) < (1e-9 if len(a | b) <= sketches.K else 0.2)
    assert rows[16].sketch == rows[17].sketch and len(rows[11].sketch) == sketches.K


def test_merged_sketches_and_estimates(spark):
    a, b = prose("en", 1, 900), prose("de", 2, 900)
    df = spark.createDataFrame([(a, b, a + " " + b)], "a string, b string, both string")
    for name in ("a", "b", "both"):
        df = sketches.with_sketch(df, F.col(name), f"s_{name}")
    row = df.select(
        sketches.resemblance(sketches.merge(F.col("s_a"), F.col("s_b")), F.col("s_both")).alias("same"), sketches.distinct_shingles(F.col("s_a")).alias("n"),
        sketches.containment(F.col("s_a"), F.col("s_both")).alias("inside"), sketches.containment(F.col("s_both"), F.col("s_a")).alias("half")).first()
    assert row.same > 0.9 and row.inside > 0.8 and 0.25 < row.half < 0.75
    assert abs(row.n / len(slow_shingles(a)) - 1) < 0.4


def test_sketches_of_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(2, "aaa bbb"), (2, "aaa bbb"), (1, "ccc ddd"), (None, "eee fff")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.edited) for r in sketches.edited_fingerprints(docs).collect())
    assert got == [("1", "ccc deee"[:5] + "ee"), ("2", "aaa bcc"), ("2", "aaa bcc"), ("None", "eee faa")]
    assert sketches.edited_fingerprints(docs.limit(0)).count() == 0
    alone = sketches.edited_fingerprints(docs.where("doc_id = 1")).first()
    assert alone.edited == "ccc dcc"


# Top-k


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(700, 8)) / 3
    vectors[50:60] = vectors[0]  # ties
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(vectors)]
    rows += [(700, None, 1), (750, [1.0, None], 1), (800, [float("nan")] * 8, 1), (850, [float("inf")] * 8, 1), (None, [1.0] * 8, 1),
             (900, [0.5, 0.5], 1), (901, [0.25, 0.125], 1), (902, [], 1), (1000, [1e9] * 3, 1), (1001, [-1e9, 1e12, 3.0], 1), (3, [float(x) for x in vectors[3]], 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").repartition(4)
    got = sorted(tuple(r) for r in topk(table, F.col("vec_id") % 50 == 0, 5).collect())
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in sorted({i: v for i, v in sound if i % 50 == 0}.items()):
        scores = sorted((-sum(a * b for a, b in zip(v, x)), i) for i, x in sound if i != q and len(x) == len(v))[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert got == sorted((q, n, i, max(-(1 << 63), min((1 << 63) - 1, s))) for q, n, i, s in want)


def test_topk_of_few_rows(spark):
    table = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk(table, F.col("vec_id") % 50 == 0, 5).collect()] == [(0, 1, 1, 131072)]
    assert topk(table.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0
    assert huge_search([1], [[1 << 40]], [0], [[1 << 40]], 5) == [(0, 1, (1 << 63) - 1)]


# Archives


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_archives_round_trip(spark):
    htmls = [None, "", "<p>é</p>", "ends\r\n\r\n", "\r\n\r\nstarts", "a\r\n\r\n\r\n\r\nb\r\n", "WARC/1.1\r\n\r\n", "\r\n", "x" * 200_000, "<p>é</p>", "<p>é</p>", "ends\r\n"]
    rows = [(i + 10, f"http://h/{i} \n" if i else None, h, "x") for i, h in enumerate(htmls)] + [(21, "http://h/again", htmls[-1], "x"), (None, "u", "<p>é</p>", "x"), (None, None, "own", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)
    index = warc.archive_pages(pages)
    got = warc.read_records(index).withColumns({"page_id": warc.page_of(F.col("record_id")), "to": warc.page_of(F.col("refers_to"))}).collect()
    by_payload: dict = {}
    for i, _, h, _ in rows:
        if i is not None:
            by_payload[h or ""] = min(i, by_payload.get(h or "", i))
    want = []
    for i, _, h, _ in rows:
        data, first = (h or "").encode(), by_payload.get(h or "")
        revisit = first is not None and i != first
        want.append((str(i), "revisit" if revisit else "response", len(data), sha1_32(data), str(first) if revisit else "None", None if revisit else data))
    found = [(str(r.page_id), r.record_type, r.payload_length, r.payload_digest, str(r.to), None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    for r in index.collect():  # every member stands alone
        with open(r.archive.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            record = gzip.decompress(f.read(r.length))
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and r.record_id.encode() in record
    total = {r.archive: sum(x.length for x in index.collect() if x.archive == r.archive) for r in index.collect()}
    assert all(len(gzip.open(a.removeprefix("file://")).read()) and n for a, n in total.items())


def test_least_bytes(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = {r.record_id: r.record_type for r in warc.read_records(warc.archive_pages(pages, least_bytes=3)).collect()}
    assert [got[f"<urn:x-page:{i}>"] for i in (1, 2, 3, 4)] == ["response", "response", "response", "revisit"]
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_records_in_any_pieces():
    one = b"WARC/1.1\r\nContent-Length: 6\r\n\r\nab\r\n\r\n\r\n\r\n"
    stream = one * 3
    for step in (1, 2, 3, 7, 1000):
        records = warc.Records()
        found = [r for i in range(0, len(stream), step) for r in records.feed(stream[i:i + step])]
        records.close()
        assert found == [one[:-4]] * 3
    broken = warc.Records()
    broken.feed(one[:-10])
    with pytest.raises(ValueError):
        broken.close()


# Queries and pipeline


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    df = QUERIES[name](spark, sf)
    result = con.execute(ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in result.description], result.fetchall())


def test_pipeline_stages(spark, tmp_path):
    rows = [(i, *graded(i)) for i in range(400)]
    docs = [(i, t, "en", "s", len(t)) for i, _, t in rows]
    docs += [(1000 + i, docs[i][1], "en", "s", 0) for i in range(40)] + [(2000, None, "en", "s", 0), (2001, "12 34", "en", "s", 0), (2002, "", None, None, None), docs[2], docs[2]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(k > 0), int(k == 1)) for i, k, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, ids = kept.columns, []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/stage{n}")
        kept = spark.read.parquet(f"{tmp_path}/stage{n}")
        assert kept.columns == columns, name
        ids.append([r.doc_id for r in kept.select("doc_id").collect()])
    clean = [i for i, k, _ in rows if k == 2]
    assert not {2000, 2001, 2002} & set(ids[0]) and len(ids[0]) == len(docs) - 3
    assert len(set(clean) & set(ids[1])) > 0.97 * len(clean)
    assert sum(k == 0 for i, k, _ in rows if i in ids[1]) < 5
    assert len(ids[2]) == len(set(ids[2])) and not [i for i in ids[2] if i >= 1000]
    want = slow_components({i: slow_fingerprint(t) for i, t, *_ in docs if i in set(ids[1])})
    assert sorted(ids[2]) == sorted(set(want.values()))
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == set(ids[2])
    run = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32").collect()
    assert sorted({r.doc_id for r in run}) == sorted(ids[2])


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
