"""Ordinal regression against a slow restatement: features by definition, slopes by differences of the likelihood."""

import math
import random
import zlib

import numpy as np

from foliant.llm import quality
from foliant.llm.quality import BUCKETS, MIN_SHIFT, MIN_TEXTS, PENALTY, STEPS, Buckets, features


def slow_features(text: str) -> set[int]:
    bucket = lambda s: zlib.crc32(s.encode()) % BUCKETS
    words, size = text.lower().split(), len(text.encode())
    bare = {w.strip(".,;:!?*#%&$|()[]{}\"'") for w in words}

    def share(name, part, whole):
        x = part / whole if whole else 0.0
        if x >= 0.5:
            return bucket(f"\0{name} {int(x * 10) + 10}")
        return bucket(f"\0{name} {max(-8, math.floor(math.log2(x))) if x > 0 else -9}")

    among = lambda kind: sum(c in kind for c in text)
    return {bucket(w) for w in bare} | {bucket("\1" + w[:4]) for w in bare} | {
        share("capitals", among("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), size), share("digits", among("0123456789"), size),
        share("symbols", among("!#$%&*+/<=>@\\^_|~"), size), share("repeated", len(words) - len(set(words)), len(words)), share("words", len(words), size)}


def test_features_equal_their_definition():
    rng = random.Random(3)
    texts = ["", " ", "One", "one ONE one", "É!! 12 <b> x", "(word) word, *word* " * 5000, "\U0001f600 ok", "a" * 100_000]
    texts += [" ".join(rng.choice(["Alpha", "beta,", "12", "$$$", "ünder", "the"]) for _ in range(rng.randint(1, 60))) for _ in range(50)]
    for text in texts:
        assert features(text, Buckets()).tolist() == sorted(slow_features(text))


def likelihood(theta, rows, used, grades, levels):
    """Penalised mean log likelihood of the grades, one row at a time."""
    place = {f: i for i, f in enumerate(used)}
    w = len(used)
    thresholds = [theta[w]]
    for step in theta[w + 1:]:
        thresholds.append(thresholds[-1] + math.exp(step))
    total = 0.0
    for row, grade in zip(rows, grades):
        standing = sum(theta[place[f]] for f in row if f in place)
        tails = [1.0, *[1 / (1 + math.exp(t - standing)) for t in thresholds], 0.0]
        total += math.log(max(tails[grade] - tails[grade + 1], 1e-9))
    return total / len(rows) - PENALTY / 2 * sum(x * x for x in theta[:w])


def rated_rows(n=160):
    """Rows of features whose grade shows in feature 100 + grade, one in ten of them wrong."""
    rng = random.Random(5)
    grades = [rng.choice([0, 1, 2, 2]) for _ in range(n)]
    rows = [sorted({rng.randrange(30), rng.randrange(30), 100 + (g if rng.random() < 0.9 else rng.randrange(3))}) for g in grades]
    return rows, grades


def slow_fit(rows, grades, levels):
    """Screen, start and steps as documented; every slope is a difference quotient."""
    used = []
    for f in sorted({f for row in rows for f in row}):
        have = [g for row, g in zip(rows, grades) if f in row]
        shift = 0.0
        for k in range(1, levels):
            p = sum(g >= k for g in grades) / len(grades)
            shift = max(shift, abs(sum((g >= k) - p for g in have)) / math.sqrt(len(have) * p * (1 - p)))
        if len(have) >= MIN_TEXTS and shift >= MIN_SHIFT:
            used.append(f)
    reached = [sum(g >= k for g in grades) / len(grades) for k in range(1, levels)]
    start = [-math.log(p / (1 - p)) for p in reached]
    theta = np.array([0.0] * len(used) + [start[0]] + [math.log(max(b - a, 0.1)) for a, b in zip(start, start[1:])])
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        slope = np.zeros_like(theta)
        for i in range(len(theta)):
            up, down = theta.copy(), theta.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            slope[i] = (likelihood(up, rows, used, grades, levels) - likelihood(down, rows, used, grades, levels)) / 2e-5
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope ** 2
        theta = theta + 0.05 * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return used, theta


def test_fit_equals_slopes_by_differences():
    rows, grades = rated_rows()
    model = quality.fit(np.array(grades), np.concatenate(rows), np.array([len(r) for r in rows]), 3)
    used, theta = slow_fit(rows, grades, 3)
    assert set(np.flatnonzero(model.weights)) == set(used) and len(used) >= 2
    np.testing.assert_allclose(model.weights[used], theta[:len(used)], atol=1e-3)
    first = theta[len(used)]
    np.testing.assert_allclose(model.thresholds, [first, first + math.exp(theta[-1])], atol=1e-3)


def test_ties_and_repeated_rows_have_equal_ratings():
    rows, grades = rated_rows()
    model = quality.fit(np.array(grades * 2), np.concatenate(rows * 2), np.array([len(r) for r in rows * 2]), 3)
    standing = np.array([model.weights[r].sum() for r in rows * 2])
    tails = model.tails(standing)
    assert np.array_equal(tails[:len(rows)], tails[len(rows):])
    assert (tails[:, 0] >= tails[:, 1]).all()
