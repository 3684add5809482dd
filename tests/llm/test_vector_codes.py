"""Vector codes against plain integer k-means."""

import hashlib
import math
import random

import numpy as np
import pytest

from foliant.llm import vector_codes as vc


def brute(rows, parts, entries, rounds, scale=256):
    """Codes, errors and codebooks by the rule, with Python's integers. rows: (id, vector, label), sound vectors of one length."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v], label) for i, v, label in rows]
    width = -(-len(kept[0][1]) // parts)
    kept = [(i, v + [0] * (parts * width - len(v)), label) for i, v, label in kept]
    split = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[split[k][p] for k in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = [[] for _ in books[p]]
            for s in split:
                held[nearest(s[p], books[p])[1]].append(s[p])
            books[p] = [[sum(column) // len(own) for column in zip(*own)] if own else c for own, c in zip(held, books[p])]
    found, sums = [], {}
    for (i, _, label), s in zip(kept, split):
        near = [nearest(s[p], books[p]) for p in range(parts)]
        found.append((i, "".join(f"{e:02x}" for _, e in near), sum(d for d, _ in near), label))
        sums[label] = sums.get(label, 0) + found[-1][2]
    text = ",".join(str(x) for book in books for c in book for x in c)
    return [(i, code, error, sums[label]) for i, code, error, label in found], hashlib.sha256(text.encode()).hexdigest()


def compare(spark, rows, extra=(), **options):
    table = spark.createDataFrame([(*r, 7, "x") for r in [*rows, *extra]], "vec_id long, embedding array<float>, label int, error int, code string").repartition(3)
    want, digest = brute(rows, options.get("parts", 16), options.get("entries", 64), options.get("rounds", 2))
    got = vc.vector_codes(table, **options).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == sorted(want, key=str)
    assert {r.codebooks_sha256 for r in got} == {digest}


def vectors(n, size, seed, spread=1.0, step=None):
    r = random.Random(seed)
    return [[r.uniform(-spread, spread) if step is None else r.randint(-3, 3) * step for _ in range(size)] for _ in range(n)]


def test_codes_equal_brute_force(spark):
    rows = [(i, v, r) for i, v, r in zip(range(300), vectors(300, 32, 1), [None, 1, 2, 2, 5] * 60)]
    out = [(900, None, 1), (901, [0.1] * 31 + [None], 1), (902, [float("nan")] * 32, 2), (903, [float("inf")] * 32, 2), (904, [0.5] * 16, 2), (905, [], None)]
    compare(spark, rows, out)


def test_ties_repeats_and_null_ids(spark):
    some = vectors(40, 32, 2, step=0.01)
    rows = [(i % 30, v, i % 3) for i, v in enumerate(some)] + [(None, some[0], None), (None, some[1], 1)] + [(7, some[5], 2)] * 50
    compare(spark, rows, entries=16)


def test_fewer_vectors_than_entries_and_odd_lengths(spark):
    compare(spark, [(i, v, None) for i, v in enumerate(vectors(5, 19, 3))], parts=4)
    compare(spark, [(3, [0.25, -0.25], 1)], parts=16)


def test_huge_components_are_exact(spark):
    compare(spark, [(i, v, i) for i, v in enumerate(vectors(60, 8, 4, spread=2e6))], parts=2, entries=8)
    # beyond 64 bits errors stop at the end
    rows = [(i, [x * 1e30 for x in v], 1) for i, v in enumerate(vectors(20, 8, 5))]
    got = vc.vector_codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), parts=2, entries=3).collect()
    assert len(got) == 20 and max(r.error for r in got) == (1 << 63) - 1 == got[0].label_error


def test_empty_table(spark):
    assert vc.vector_codes(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
    assert vc.vector_codes(spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")).collect() == []


@pytest.mark.parametrize("subtree", [1, 7, 4096])
def test_trie_walk_equals_distances(monkeypatch, subtree):
    monkeypatch.setattr(vc, "SUBTREE", subtree)
    r = np.random.default_rng(3)
    for width, high in ((1, 5), (3, 4), (4, 200), (5, 2)):
        rows = r.integers(-high, high, (700, width))
        parts, weights, places = vc.distinct_parts(rows)
        assert (parts[places] == rows).all() and weights.sum() == len(rows) and len(np.unique(parts, axis=0)) == len(parts)
        entries = r.integers(-high, high, (9, width))
        seen = []
        for first, last, sums in vc.leaves(parts, entries):
            assert (sums == ((parts[first:last, None] - entries[None]) ** 2).sum(axis=2)).all()
            seen += range(first, last)
        assert seen == list(range(len(parts)))  # in lexicographic order, each once


def test_prefixes_are_shared():
    """A node's distances are computed once, however many leaves lie below it."""
    made = []

    class Counted(np.ndarray):
        def __pow__(self, other):
            made.append(self.size)
            return super().__pow__(other)

    parts = np.array([[a, b, c] for a in range(4) for b in range(5) for c in range(6)])
    entries = np.zeros((8, 3), np.int64)
    list(vc.leaves(parts.view(Counted), entries))
    assert sum(made) == 8 * (4 + 4 * 5 + 4 * 5 * 6)
