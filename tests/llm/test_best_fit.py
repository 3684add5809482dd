"""Vector best fit against plain library calls and a plain search over all sequences."""

import random
import zlib

import numpy as np
import pytest

from foliant.llm import best_fit as bf
from foliant.llm.queries import tokenizer_path

WORDS = tokenizer_path("word_bpe_49k.json")


def slow_place(lengths, capacities):
    """The rule on lists: every open sequence is scored for every piece."""
    limits, weights = [int(x) for x in capacities.limits()], capacities.weights
    bins, found = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        demand = (lengths[i], 1, lengths[i] ** 2)
        best = None
        for b, (left, used) in enumerate(bins):
            if all(x >= d for x, d in zip(left, demand)):
                if capacities.rule == "dot":
                    score = -sum(w * (x / c) * (d / c) for w, x, d, c in zip(weights, left, demand, limits))
                else:
                    score = sum(w * ((x - d) / c) ** 2 for w, x, d, c in zip(weights, left, demand, limits))
                if best is None or score < best[0] - 1e-12:
                    best = (score, b)
        b = best[1] if best else len(bins)
        if best is None:
            bins.append((limits, 0))
        left, used = bins[b]
        found[i] = (b, used)
        bins[b] = ([x - d for x, d in zip(left, demand)], used + lengths[i])
    return [found[i] for i in range(len(lengths))], len(bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(100, None, None), (100, 4, None), (100, 6, 4000), (64, 64, 1500)])
def test_placement_equals_plain_search(rule, limits):
    r = random.Random(4)
    capacities = bf.Capacities(*limits, weights=(1.0, 0.3, 0.2), rule=rule)
    for _ in range(20):
        lengths = np.array([r.randint(1, capacities.longest()) if r.random() < 0.7 else 1 for _ in range(r.randint(0, 80))], np.int64)
        bins = bf.Bins(capacities)
        assert (bf.pack_lengths(lengths, bins), bins.made) == slow_place(lengths.tolist(), capacities)


def test_unusable_capacities():
    with pytest.raises(ValueError, match="positive"):
        bf.Bins(bf.Capacities(0))
    with pytest.raises(ValueError, match="rule"):
        bf.Bins(bf.Capacities(rule="other"))


def packed_well(rows, docs, library, capacities):
    """Every id in one piece, pieces in order, sequences gapless and within every capacity; returns the number of sequences."""
    want = sorted((str(i), [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in docs)
    pieces = {}
    for row in rows:
        assert row.length == len(row.ids) and row.ids_crc32 == zlib.crc32(np.array(row.ids, "<u4").tobytes())
        pieces.setdefault((str(row.doc_id), row.piece), []).append(row)
    whole = []
    for key in sorted({k[0] for k in pieces}):
        copies = len(pieces[key, 0])
        ids = [[] for _ in range(copies)]
        for piece in range(sum(k[0] == key for k in pieces)):
            own = pieces[key, piece]
            assert len(own) == copies
            for n, row in enumerate(sorted(own, key=lambda row: row.ids)):
                assert row.start == len(ids[n]) == piece * capacities.longest()
                ids[n] += row.ids
        whole += [(key, x) for x in ids]
    assert sorted(whole) == want
    sequences = {}
    for row in rows:
        sequences.setdefault(row.sequence_id, []).append((row.offset, row.length))
    limits = capacities.limits()
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= limits[0] and len(own) <= limits[1] and sum(x * x for _, x in own) <= limits[2]
    return len(sequences)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


@pytest.mark.parametrize("limits", [(4096, None, None), (64, 3, None), (200, None, 9000)])
def test_documents_are_packed(spark, library, limits):
    r = random.Random(8)
    docs = [(i, " ".join(r.choices(["word", "Äpfel", "it's", "12", "<|endoftext|>", "中"], k=int(r.paretovariate(0.7)) % 3000))) for i in range(150)]
    docs += [(500, None), (501, ""), (502, " \n"), (503, "long words " * 5000), (None, "no id")] + [(504, "a repeated row")] * 2
    table = spark.createDataFrame([(i, t, "x", 5) for i, t in docs], "doc_id long, text string, ids string, piece int").repartition(2)
    capacities = bf.Capacities(*limits)
    rows = bf.best_fit(table, WORDS, 1, capacities, group_tokens=5000).collect()
    made = packed_well(rows, docs, library, capacities)
    if limits == (4096, None, None):
        assert made <= -(-sum(row.length for row in rows) // 4096) + 2  # one open sequence a task
        assert all(row.length == 4096 for row in rows if any(o.doc_id == row.doc_id and o.piece > row.piece for o in rows))


def test_empty_table(spark):
    assert bf.best_fit(spark.createDataFrame([], "doc_id long, text string"), WORDS, 1).collect() == []


def test_open_sequences_are_bounded():
    bins = bf.Bins(bf.Capacities(100))
    bf.pack_lengths(np.full(3000, 60), bins)
    assert bins.n == 3000
    bins.close(512)
    assert bins.n == 512
    bf.pack_lengths(np.full(512, 40), bins)
    assert bins.n == 0 and bins.made == 3000
