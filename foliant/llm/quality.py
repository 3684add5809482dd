"""Quality by ordinal regression on graded ratings.

A text is a set of hashed features: its words, and coarse shares of capitals, digits, symbols and repetition. One weight per
feature, shared by all grades, sums up to the text's standing; ordered thresholds cut standings into grades by
P(grade >= k) = 1 / (1 + exp(threshold_k - standing)). The expected grade and the tail probability of the best grade come
from the same standing.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.arrow import sized, texts_of

#: Weights; a power of two.
BUCKETS = 1 << 20
#: Labelled rows used for training, at most; those with the smallest hash of their id.
TRAINING_ROWS = 8000
#: Characters of a word's beginning that make a feature of their own.
STEM = 4
#: A feature counts if so many training texts have it, and if some grade is reached more or less often among them than among all,
#: by so many standard errors; the many words that tell nothing would add up to noise in long texts.
MIN_TEXTS = 10
MIN_SHIFT = 7.0
STEPS = 150
PENALTY = 3e-4
#: Texts whose chance of the best grade is below this are rejected.
KEEP = 0.5
BATCH_BYTES = 2 << 20
MAX_WORDS = 150_000
_CAPITALS = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = b"!#$%&*+/<=>@\\^_|~"
_STRIPPED = ".,;:!?*#%&$|()[]{}\"'"


def grade(quality: Column, toxic: Column) -> Column:
    """0 for low quality, 1 for good but toxic texts, 2 for good clean ones; null without both labels."""
    return F.when(quality.isNull() | toxic.isNull(), None).when(quality == 0, 0).when(toxic != 0, 1).otherwise(2)


class Buckets(dict):
    """word -> buckets of the word and of its beginning, kept once computed."""

    def __missing__(self, word: str) -> tuple[int, int]:
        bare = word.strip(_STRIPPED)
        value = self[word] = zlib.crc32(bare.encode()) & (BUCKETS - 1), zlib.crc32(b"\1" + bare[:STEM].encode()) & (BUCKETS - 1)
        return value


def _share(name: str, part: int, whole: int) -> int:
    """Bucket of a share on a coarse scale: by powers of two below one half, then by tenths."""
    x = part / whole if whole else 0.0
    level = int(x * 10) + 10 if x >= 0.5 else int(max(-8, np.floor(np.log2(x)))) if x > 0 else -9
    return zlib.crc32(f"\0{name} {level}".encode()) & (BUCKETS - 1)


def features(text: str, buckets: Buckets) -> np.ndarray:
    """Sorted buckets of a text."""
    words = text.lower().split()
    own = set(words)
    raw = text.encode()
    count = lambda kind: len(raw) - len(raw.translate(None, kind))
    found = set(chain.from_iterable(map(buckets.__getitem__, own)))
    found |= {_share("capitals", count(_CAPITALS), len(raw)), _share("digits", count(_DIGITS), len(raw)),
              _share("symbols", count(_SYMBOLS), len(raw)), _share("repeated", len(words) - len(own), len(words)),
              _share("words", len(words), len(raw))}
    return np.sort(np.fromiter(found, np.int32, len(found)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # rising; grade k needs a standing around thresholds[k - 1]

    def tails(self, standing: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, one column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - standing[:, None], -500, 500)))


def fit(grades: np.ndarray, flat: np.ndarray, counts: np.ndarray, levels: int) -> Model:
    """Maximum likelihood with a small penalty on weights, by Adam over all rows at once. flat: the rows' features after one
    another."""
    texts = np.bincount(flat, minlength=BUCKETS)
    row = np.repeat(np.arange(len(grades)), counts)
    shift = np.zeros(BUCKETS)
    for k in range(1, levels):
        reached = grades >= k
        apart = reached - (reached.mean() if len(grades) else 0.0)
        deviation = max(apart.std() if len(grades) else 0.0, 1e-9)
        shift = np.maximum(shift, np.abs(np.bincount(flat, apart[row], BUCKETS)) / (np.sqrt(np.maximum(texts, 1)) * deviation))
    kept = ((texts >= MIN_TEXTS) & (shift >= MIN_SHIFT))[flat]
    row = row[kept]
    used, column = np.unique(flat[kept], return_inverse=True)
    n = max(len(grades), 1)
    reached = np.clip(np.array([(grades >= k).sum() for k in range(1, levels)]), 0.5, n - 0.5) / n
    start = -np.log(reached / (1 - reached))
    # theta: the weights, the first threshold, and the logarithms of the steps to the next ones, which keeps them in order.
    theta = np.concatenate([np.zeros(len(used)), start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    mean, square, w = np.zeros_like(theta), np.zeros_like(theta), len(used)
    for step in range(1, STEPS + 1):
        thresholds = theta[w] + np.concatenate([[0.0], np.cumsum(np.exp(theta[w + 1:]))])
        standing = np.bincount(row, theta[:w][column], len(grades))
        tails = np.column_stack([np.ones(len(grades)), 1 / (1 + np.exp(np.clip(thresholds - standing[:, None], -500, 500))), np.zeros(len(grades))])
        slopes = tails * (1 - tails)
        at = np.arange(len(grades))
        chance = np.maximum(tails[at, grades] - tails[at, grades + 1], 1e-9)
        d_low, d_high = slopes[at, grades] / chance, slopes[at, grades + 1] / chance
        d_standing = d_low - d_high
        d_threshold = np.array([(d_high[grades == k - 1]).sum() - (d_low[grades == k]).sum() for k in range(1, levels)])
        slope = np.concatenate([
            np.bincount(column, d_standing[row], w) - PENALTY * n * theta[:w], d_threshold.sum(keepdims=True),
            np.exp(theta[w + 1:]) * d_threshold[::-1].cumsum()[::-1][1:]]) / n
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope ** 2
        theta = theta + 0.05 * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[used] = theta[:w]
    return Model(weights, theta[w] + np.concatenate([[0.0], np.cumsum(np.exp(theta[w + 1:]))]))


def train(docs: DataFrame, labels: DataFrame, grades: Column, levels: int = 3, rows: int = TRAINING_ROWS) -> Model:
    """Fit on the labelled documents with the smallest hashed ids, ``rows`` at most; only their features come to the driver.

    labels: doc_id and what ``grades`` reads. Rows with a null grade or no document are left out; without any row the weights
    are zero. A document that is labelled twice counts twice.
    """
    chosen = labels.select("doc_id", grades.cast("int").alias("_grade")).where("_grade is not null").orderBy(
        F.xxhash64("doc_id"), "doc_id", "_grade").limit(rows)
    # Bounded by ``rows``, so it is sent to the tasks whole and the texts are not moved.
    rated = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("_grade", "text")

    def featured(batches):
        buckets = Buckets()
        for batch in sized(batches, "text", BATCH_BYTES):
            found = [features(text, buckets) for text in texts_of(batch)]
            yield pa.record_batch([batch.column("_grade"), pa.array(found, pa.list_(pa.int32()))], ["grade", "features"])

    got = rated.mapInArrow(featured, "grade int, features array<int>").toArrow()
    # The order in which rows arrive is not fixed, and sums of floats depend on it.
    lists = [x.values.to_numpy() for x in got["features"]]
    rated = sorted(zip(got["grade"].to_pylist(), lists), key=lambda r: (r[0], r[1].tobytes()))
    flat = np.concatenate([np.zeros(0, np.int32), *[x for _, x in rated]])
    return fit(np.array([g for g, _ in rated], np.int64), flat, np.array([len(x) for _, x in rated], np.int64), levels)


def rate(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id, expected_grade (from 0 to the best grade) and p_best (chance of the best grade) of every row.

    A null or empty text is rated by the features of an empty text. Repeated rows are rated each; a null id stays null; other
    columns are not read. Tasks hold a batch of 2 MiB of text, or the longest single text.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))  # arrays only: executors need no copy of this package

    def score(batches):
        model, buckets = Model(*shared.value), Buckets()
        for batch in sized(batches, "text", BATCH_BYTES):
            if len(buckets) > MAX_WORDS:
                buckets.clear()
            standing = np.array([model.weights[features(text, buckets)].sum() for text in texts_of(batch)])
            tails = model.tails(standing)
            yield pa.record_batch([batch.column("id"), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])], ["id", "expected_grade", "p_best"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(score, f"id {kind}, expected_grade double, p_best double").withColumnRenamed("id", id_column)
