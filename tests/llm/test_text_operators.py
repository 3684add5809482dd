"""Tokenisation, packing and training order against plain library calls and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.llm import chunk_bpe, packing, training_order
from foliant.llm.queries import tokenizer_path
from foliant.llm.token_counts import piece_counts, split_long, token_counts
from foliant.llm.words import WordEncoder, encode_texts, word_encoder

WORDS = tokenizer_path("word_bpe_49k.json")
PIECES = tokenizer_path("piece_bpe_32k.model")
ODD = [*"abAB 'sé́\n\t<|>.,!?1²中İΣς  \x1c\x85ﬁ👍*#$&%ẞſ×÷\x0b\r▁", "<|endoftext|>", "<|startoftext|>", " it's", "'LL ", "don't ", "word ", "Äpfel, "]


def odd_texts(n: int, length: int = 60, seed: int = 1) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choices(ODD, k=r.randint(0, length))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with those of results."""
    texts = [None, "", " \n ", *odd_texts(60), "same text twice", "same text twice", "x" * 3000, " ".join(odd_texts(400, seed=2)),
             "plain words and more of them " * 900]
    rows = [(i if t != "x" * 3000 else None, t, "ids", i * 1.5) for i, t in enumerate(texts)] + [(3, texts[3], "ids", 4.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n_tokens double").repartition(3)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def test_word_encoder_equals_library(library):
    texts = odd_texts(4000)
    ids, ends = encode_texts(WordEncoder(WORDS), texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == want


def test_chunks_and_decoding_equal_library(library):
    texts = odd_texts(1500, 200)
    encoder = chunk_bpe.ChunkEncoder(WordEncoder(WORDS))
    ids, ends = chunk_bpe.encode_batch(encoder, pa.array([*texts, None]), mean=8)
    want = [e.ids for e in library.encode_batch([*texts, ""], add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == want
    decoded = chunk_bpe.decode(chunk_bpe.lists(ids, ends), pa.array(encoder.words.names)).to_pylist()
    assert decoded == library.decode_batch(want, skip_special_tokens=False)


def test_copies_share_chunks():
    encoder = chunk_bpe.ChunkEncoder(WordEncoder(WORDS))
    r = random.Random(9)
    shared = " ".join("".join(r.choices("aeiourstn", k=r.randint(2, 9))) for _ in range(300))
    chunk_bpe.encode_batch(encoder, pa.array([shared]), 64)
    before = len(encoder.known)
    chunk_bpe.encode_batch(encoder, pa.array(["Another beginning. " + shared, shared + " Another end."]), 64)
    assert before > 5 and len(encoder.known) - before <= 6


def test_encode_documents(docs, library):
    got = chunk_bpe.encode_documents(docs, WORDS, mean=64).collect()
    want = sorted((str(r.doc_id), library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect())
    assert sorted((str(r.doc_id), r.ids) for r in got) == want
    assert all(r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in got)


def test_long_texts_are_split_exactly():
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [" ".join(odd_texts(300, seed=s)) for s in range(20)] + odd_texts(500) + ["", "x" * 500]
    for text in texts:
        parts = split_long(text, 50)
        assert sum(map(len, processor.encode(parts))) == len(processor.encode(text))
    assert len(split_long(texts[0], 50)) > 1
    assert piece_counts(processor, texts).tolist() == [len(x) for x in processor.encode(texts)]


def test_token_counts(docs):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_counts(docs, PIECES, 4096)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = []
    for r in docs.collect():
        n = len(processor.encode(r.text or ""))
        want.append((str(r.doc_id), len((r.text or "").encode()), n, n > 4096))
    assert sorted((str(r.doc_id), *r[1:]) for r in got.collect()) == sorted(want)
    assert any(r.over_limit for r in got.collect())


def test_differencing_spreads_all_items_evenly():
    r = random.Random(5)
    sizes = [r.randint(1, 256) for _ in range(200)]
    windows = packing.differencing(sizes, 12)
    assert sorted(i for w in windows for i in w) == list(range(200))
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert len(sums) == 12 and max(sums) - min(sums) <= 3
    assert packing.differencing([], 3) == []


def test_more_windows_when_over_capacity():
    windows = packing.pack_group([1500, 1500, 1500], 2048)
    assert sorted(windows) == [[0], [1], [2]]  # 4,500 would fit three windows only whole by whole
    assert all(len(w) == 1 for w in packing.pack_group([1100] * 6, 2048))


def test_pack_documents(docs, library):
    pieces = packing.pack_documents(docs, WORDS, end_id=1, capacity=256, piece=32).collect()
    by_sequence: dict = {}
    for p in pieces:
        assert zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 and len(p.ids) == p.length > 0
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
        assert sum(p.length for p in own) <= 256
    # Repeated rows cannot be told apart, so pieces are compared as a whole.
    want = []
    for r in docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        want += [(str(r.doc_id), i, x, len(ids)) for i, x in enumerate(ids)]
    got = [(str(p.doc_id), p.start + i, x, p.doc_tokens) for p in pieces for i, x in enumerate(p.ids)]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_permutation(n):
    numbers = np.arange(n)
    slots = training_order.permute(numbers, n, key=7)
    assert sorted(slots.tolist()) == numbers.tolist()
    assert training_order.permute(slots, n, key=7, back=True).tolist() == numbers.tolist()
    if n >= 1000:
        assert slots.tolist() != training_order.permute(numbers, n, key=8).tolist()
        assert abs(np.corrcoef(numbers, slots)[0, 1]) < 0.1


def test_training_order(spark, docs, library, tmp_path):
    sequences = training_order.token_sequences(docs, WORDS, end_id=1, length=64)
    sequences.write.parquet(f"{tmp_path}/sequences")
    sequences = spark.read.parquet(f"{tmp_path}/sequences")
    shards = training_order.materialise(sequences, f"{tmp_path}/shards", key=3, length=64, shard_bytes=132 * 20)
    total = sequences.count()
    assert sorted((s.first_slot, s.records) for s in shards.collect()) == [(i, min(20, total - i)) for i in range(0, total, 20)]
    for s in shards.collect():  # fixed stride
        data = open(s.path, "rb").read()
        assert len(data) == s.records * 132
    rows = training_order.read_shards(shards, 3).collect()
    assert sorted(r.slot for r in rows) == list(range(total))
    given = {}
    offset = 0
    for part in sorted({r.part for r in sequences.collect()}):
        own = sorted((r.row, bytes(r.ids)) for r in sequences.where(F.col("part") == part).collect())
        given |= {offset + row: ids for row, ids in own}
        offset += len(own)
    assert {r.number: bytes(r.ids) for r in rows} == given
    tokens = sorted(x for ids in given.values() for x in np.frombuffer(ids, "<u2").tolist())
    assert tokens == sorted(x for r in docs.collect() for x in [*library.encode(r.text or "", add_special_tokens=False).ids, 1])
    resumed = training_order.read_shards(shards, 3, from_slot=25).collect()
    assert sorted(r.slot for r in resumed) == list(range(25, total))


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert chunk_bpe.encode_documents(none, WORDS).count() == 0
    assert token_counts(none, PIECES, 4096).count() == 0
    assert packing.pack_documents(none, WORDS, 1).count() == 0
    training_order.token_sequences(none, WORDS, 1, 64).write.parquet(f"{tmp_path}/s")
    shards = training_order.materialise(spark.read.schema("part int, row long, n int, ids binary").parquet(f"{tmp_path}/s"), f"{tmp_path}/out", 1, 64)
    assert training_order.read_shards(shards, 1).count() == 0


def test_word_table_starts_afresh(monkeypatch, library):
    import foliant.llm.words as words

    monkeypatch.setattr(words, "MAX_WORDS", 50)
    texts = odd_texts(300)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = []
    for i in range(0, 300, 30):
        ids, ends = encode_texts(word_encoder(WORDS), texts[i:i + 30])
        got += [x.tolist() for x in np.split(ids, ends[:-1])]
    assert got == want


def test_digests_of_the_query(spark, library, tmp_path):
    from foliant.llm.queries import QUERIES

    spark.createDataFrame([(1, "Grün is the word. it's 12"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in QUERIES["op4_chunk_bpe"](spark, str(tmp_path)).collect()}
    ids = library.encode("Grün is the word. it's 12", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert rows[1][1:] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert rows[2][1:] == (0, sha(""), sha(""))
