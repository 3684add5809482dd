"""Packing of whole documents into sequences by vector best fit.

A sequence has three capacities: tokens, documents, and attention cost (the squares of its pieces' lengths). A document asks for some of
each. Pieces are placed in falling order of their demand: of the open sequences that can take a piece under every capacity, the one
is chosen whose weighted residual after it has the smallest norm, or whose residual has the largest weighted product with the demand;
where none can, a new sequence begins.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.arrow import sized, texts_of
from foliant.llm.words import encode_texts, word_encoder

BATCH_BYTES = 2 << 20
#: Tokens that are placed together, in falling order, and sequences that stay open from one such group to the next.
GROUP_TOKENS = 1 << 21
OPEN = 512
_SHIFT = 33


@dataclass(frozen=True)
class Capacities:
    """What a sequence may hold, and the weight of each dimension in the choice. By default only tokens bind: no sequence of ``tokens``
    ids can hold more documents, or cost more, than the other two allow."""

    tokens: int = 4096
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4)
    rule: str = "norm"

    def limits(self) -> np.ndarray:
        tokens = self.tokens
        found = np.array([tokens, tokens if self.documents is None else self.documents, tokens * tokens if self.attention is None else self.attention], np.int64)
        if (found < 1).any():
            raise ValueError("capacities must be positive")
        if self.rule not in ("norm", "dot"):
            raise ValueError(f"unknown rule: {self.rule}")
        return found

    def longest(self) -> int:
        """Tokens of the longest piece that an empty sequence can take."""
        return min(self.tokens, math.isqrt(int(self.limits()[2])))


class Bins:
    """Open sequences by what is left of their capacities."""

    def __init__(self, capacities: Capacities) -> None:
        self.limits = capacities.limits()
        self.scale = np.sqrt(np.array(capacities.weights)) / self.limits
        self.dot = capacities.rule == "dot"
        self.left, self.numbers, self.used, self.n, self.made = np.zeros((3, 64), np.int64), np.zeros(64, np.int64), np.zeros(64, np.int64), 0, 0

    def choose(self, demand: np.ndarray) -> int:
        """Place of the open sequence for a demand, -1 if none has room; ties go to the one opened first."""
        left = self.left[:, :self.n]
        fits = np.flatnonzero((left[0] >= demand[0]) & (left[1] >= demand[1]) & (left[2] >= demand[2]))
        if not len(fits):
            return -1
        if self.dot:
            scores = -((left[:, fits] * self.scale[:, None]).T @ (demand * self.scale))
        else:
            scores = (((left[:, fits] - demand[:, None]) * self.scale[:, None]) ** 2).sum(axis=0)
        return int(fits[scores.argmin()])

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece of so many tokens."""
        demand = np.array([length, 1, length * length], np.int64)
        at = self.choose(demand)
        if at < 0:
            if self.n == len(self.numbers):
                self.left, self.numbers, self.used = np.concatenate([self.left, self.left], axis=1), np.tile(self.numbers, 2), np.tile(self.used, 2)
            at, self.n = self.n, self.n + 1
            self.left[:, at], self.numbers[at], self.used[at] = self.limits, self.made, 0
            self.made += 1
        offset = int(self.used[at])
        self.left[:, at] -= demand
        self.used[at] += length
        found = int(self.numbers[at]), offset
        if not self.left[:, at].all():  # full in one dimension
            self._keep(np.delete(np.arange(self.n), at))
        return found

    def _keep(self, places: np.ndarray) -> None:
        self.n = len(places)
        self.left[:, :self.n], self.numbers[:self.n], self.used[:self.n] = self.left[:, places], self.numbers[places], self.used[places]

    def close(self, most: int) -> None:
        """Keeps so many open sequences, those with most tokens left."""
        if self.n > most:
            self._keep(np.sort(np.argsort(-self.left[0, :self.n], kind="stable")[:most]))


def pack_lengths(lengths: np.ndarray, bins: Bins) -> list[tuple[int, int]]:
    """(sequence, offset) of each piece; placed in falling order, equal ones in their own."""
    found = [(0, 0)] * len(lengths)
    for i in np.argsort(-lengths, kind="stable").tolist():
        found[i] = bins.place(int(lengths[i]))
    return found


def best_fit(
    docs: DataFrame, path: str, end_id: int, capacities: Capacities = Capacities(), group_tokens: int = GROUP_TOKENS,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per piece: id, piece, start and length (in its document's ids), ids (array<int>), ids_crc32, sequence_id, offset.

    Every document gives its ids and ``end_id``, so a null or empty text gives that one id. Only documents longer than an empty sequence can
    take are cut, into pieces of that length and a shorter last one. The pieces of a sequence lie one after another from offset 0, and no
    sequence exceeds a capacity. Repeated rows are packed each; a null id stays null; other columns are not read; an empty table gives no
    rows. Each task packs its own rows, by groups of ``group_tokens`` tokens, and keeps open sequences from group to group, so nothing is
    shuffled and a task leaves some sequences open only at its end. Sequence ids are the number of the task, shifted, plus a count.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    longest = capacities.longest()

    def pack(batches):
        from pyspark import TaskContext

        bins, first_sequence = Bins(capacities), TaskContext.get().partitionId() << _SHIFT
        group: list[tuple] = []  # (id, piece, start, ids)
        filled, id_type = 0, None

        def placed() -> pa.RecordBatch:
            ids = [p[3] for p in group]
            lengths = np.array([len(x) for x in ids], np.int64)
            where = pack_lengths(lengths, bins)
            bins.close(OPEN)
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            return pa.record_batch([
                pa.array([p[0] for p in group], id_type), pa.array([p[1] for p in group], pa.int32()), pa.array([p[2] for p in group], pa.int64()), pa.array(lengths),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                pa.array([first_sequence + s for s, _ in where], pa.int64()), pa.array([o for _, o in where], pa.int64())],
                ["id", "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset"])

        for batch in sized(batches, "text", BATCH_BYTES):
            id_type = batch.schema.field("id").type
            flat, ends = encode_texts(word_encoder(path), texts_of(batch))
            first = 0
            for key, end in zip(batch.column("id").to_pylist(), ends.tolist()):
                ids = np.append(flat[first:end], np.int32(end_id))
                first = end
                for piece, start in enumerate(range(0, len(ids), longest)):
                    part = ids[start:start + longest]
                    if group and filled + len(part) > group_tokens:
                        yield placed()
                        group, filled = [], 0
                    group.append((key, piece, start, part))
                    filled += len(part)
        if group:
            yield placed()

    packed = rows.mapInArrow(pack, f"id {kind}, piece int, start long, length long, ids array<int>, ids_crc32 long, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_column)
