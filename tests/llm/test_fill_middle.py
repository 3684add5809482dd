"""Seekable frames and the fill-in-the-middle transformation against plain strings."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from foliant.llm import fill_middle as fim
from foliant.llm import frames


def plain(doc_id, text, seed=7, rate=100, spm_rate=50):
    """The transformation as its rule reads, on whole strings."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in fim.MARKERS) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm_rate:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def odd_text(r: random.Random, length: int) -> str:
    return "".join(r.choice(["a", "bc ", "é", "中", "👍", "\n", "\n\n", "\r\n", "<", "<P", "<S", "M>", "P>", "x" * r.randint(1, 40)]) for _ in range(length))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    rows = [(i, odd_text(r, r.randint(0, 120))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "\n"), (1003, "no feed"), (1004, "\n\n\n"), (1005, "has <P> in it\nline"), (1006, "<M>"), (1007, "中" * 3000),
             (1008, "\n".join(odd_text(r, 30) for _ in range(3000))), (1009, "tail\n"), (None, "null id\nwith lines\n"), (3, rows[3][1]), (3, rows[3][1])]
    return rows


@pytest.mark.parametrize("frame_bytes", [16, 100, frames.FRAME_BYTES])
def test_fill_middle_equals_plain(spark, texts, frame_bytes):
    docs = spark.createDataFrame([(i, t, 1, "mine", "theirs") for i, t in texts], "doc_id long, text string, n int, form string, frames string").repartition(3)
    made = fim.fill_middle_documents(docs, frame_bytes=frame_bytes, rate=90).persist()
    want = sorted((str(i), *plain(i, t, rate=90)) for i, t in texts)
    got = [(str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, frames.text_of(r.output)) for r in made.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    whole = {str(i): t or "" for i, t in texts}
    for r in fim.with_digests(made).collect():
        assert r.restored_sha256 == hashlib.sha256(whole[str(r.doc_id)].encode()).hexdigest()
    assert sorted((str(r.doc_id), r.output_sha256) for r in fim.with_digests(made).collect()) == sorted((w[0], hashlib.sha256(w[-1].encode()).hexdigest()) for w in want)
    made.unpersist()


def test_only_cut_frames_are_inflated(monkeypatch):
    data = "".join(f"line {i} of a text\n" for i in range(5000)).encode()
    ends = frames.frame_ends(data, 1000)
    stored, feeds, chars, first = [], [0], [0], 0
    for end in ends:
        stored.append(frames.compress(data[first:end]))
        feeds.append(feeds[-1] + data[first:end].count(b"\n"))
        chars.append(chars[-1] + end - first)
        first = end
    opened = []
    inflate = frames.inflate
    monkeypatch.setattr(frames, "inflate", lambda frame: opened.append(frame) or inflate(frame))
    output, prefix, middle = fim.composed(frames.Framed(stored, feeds, chars, 5000), 1234, 4321, "psm")
    assert len(opened) == 2 and len(stored) > 80
    assert len(set(output) & set(stored)) >= len(stored) - 2  # all other frames are handed on as they are
    lines = data.decode().splitlines(keepends=True)
    assert (prefix, middle) == (len("".join(lines[:1234])), len("".join(lines[1234:4321])))
    monkeypatch.undo()
    assert frames.text_of(output) == "<P>" + "".join(lines[:1234]) + "<S>" + "".join(lines[4321:]) + "<M>" + "".join(lines[1234:4321])


def test_markers_across_frames():
    pieces = [b"<", b"P", b">ab", b"c<S", b">de", b"f<", b"M>gh", b"<M"]
    output = [frames.compress(p) for p in pieces]
    assert list(fim.marker_places(iter(pieces), "psm")) == [0, 6, 12]
    whole, back = fim.digests_of(output, "psm")
    assert whole == hashlib.sha256(b"".join(pieces)).hexdigest() and back == hashlib.sha256(b"abcgh<Mdef").hexdigest()


def test_frames_are_bounded_and_cut_between_characters():
    for text in ("é" * 500, "中👍" * 300, "a\n" * 400, "x" * 999):
        data = text.encode()
        first = 0
        for end in frames.frame_ends(data, 64):
            assert 0 < end - first <= 64
            data[first:end].decode()
            first = end
        assert first == len(data)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fim.with_digests(fim.fill_middle_documents(docs)).collect() == []


def test_invalid_bytes_survive(spark):
    docs = spark.createDataFrame([(1, bytearray(b"a\xff\xfe\nb\x80\nc"))], "doc_id long, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"))
    made = fim.with_digests(fim.fill_middle_documents(docs)).first()
    assert made.restored_sha256 == hashlib.sha256(b"a\xff\xfe\nb\x80\nc").hexdigest()
