"""Compression of vectors to codes of a few bytes: every part of a vector becomes the number of its nearest codebook entry.

The distinct parts of a block of vectors form a trie, one component a level, in lexicographic order. It is walked depth first: a node
holds the distances of its prefix to all entries of the codebook, so parts that begin alike share the sums of their common components,
and a leaf, the whole part, has its distances complete: their least place is its code, and the part counts with its number of copies
in the sum of that entry. Tasks pass on sums and counts only, whose number is that of the codebooks' components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.pivot_topk import quantised
from foliant.session import cut_lineage

PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Vectors whose parts form a trie together, and leaves of a subtree that is expanded at once.
BLOCK_ROWS = 65_536
SUBTREE = 2048
_MOST = (1 << 63) - 1


def distinct_parts(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, how often each occurs, and the place of every row among them."""
    order = np.lexsort(parts.T[::-1]) if parts.shape[1] else np.arange(len(parts))
    ordered = parts[order]
    new = np.ones(len(parts), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    starts = np.flatnonzero(new)
    places = np.empty(len(parts), np.int64)
    places[order] = np.cumsum(new) - 1
    return ordered[starts], np.diff(starts, append=len(parts)), places


def leaves(parts: np.ndarray, entries: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, last, distances): squared distances of the parts first .. last - 1, distinct ones in order, to all entries.

    Large nodes are walked depth first, so the stack holds one path and its siblings; a subtree of up to SUBTREE leaves is expanded
    level by level, each distinct prefix once.
    """
    width = parts.shape[1]
    stack = [(0, len(parts), 0, np.zeros(len(entries), parts.dtype))]
    while stack:
        first, last, depth, above = stack.pop()
        if last - first > SUBTREE and depth < width:
            column = parts[first:last, depth]
            starts = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
            ends = np.append(starts[1:], len(column))
            for a, b in zip(starts[::-1].tolist(), ends[::-1].tolist()):
                stack.append((first + a, first + b, depth + 1, above + (column[a] - entries[:, depth]) ** 2))
            continue
        sums, parent = above[None], np.zeros(last - first, np.int64)
        new = np.zeros(last - first, bool)
        new[0] = True
        for level in range(depth, width):
            column = parts[first:last, level]
            new[1:] |= column[1:] != column[:-1]
            starts = np.flatnonzero(new)
            sums = sums[parent[starts]] + (column[starts, None] - entries[None, :, level]) ** 2
            parent = np.cumsum(new) - 1
        yield first, last, sums[parent] if len(sums) < last - first else sums


def assigned(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of every distinct part, ties to the lower number, and its squared distance."""
    codes, errors = np.zeros(len(parts), np.int64), np.zeros(len(parts), parts.dtype)
    for first, last, sums in leaves(parts, entries):
        codes[first:last] = sums.argmin(axis=1)
        errors[first:last] = np.take_along_axis(sums, codes[first:last, None], axis=1)[:, 0]
    return codes, errors


def exact(dimensions: int, *arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as they are where neither a squared distance of whole vectors nor the sum of a block's components reaches 2^62, else as
    exact Python integers."""
    largest = max((max(abs(int(a.max())), abs(int(a.min()))) for a in arrays if a.size), default=0)
    return list(arrays) if max(4 * largest * largest * dimensions, largest * BLOCK_ROWS) < 1 << 62 else [a.astype(object) for a in arrays]


def blocks(batches, extra: tuple[str, ...], dimensions: int) -> Iterator[tuple[np.ndarray, list]]:
    """Vectors of up to BLOCK_ROWS rows as one array, and their other columns."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def block():
        table = pa.Table.from_batches(held).combine_chunks()
        vectors = table.column("q").combine_chunks()
        flat = vectors.flatten().to_numpy().astype(np.int64)
        return flat.reshape(-1, dimensions), [table.column(c).combine_chunks() for c in extra]

    for batch in batches:
        if rows and rows + batch.num_rows > BLOCK_ROWS:
            yield block()
            held, rows = [], 0
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
    if rows:
        yield block()


def part_of(vectors: np.ndarray, place: int, parts: int) -> np.ndarray:
    width = vectors.shape[1] // parts
    return vectors[:, place * width:(place + 1) * width]


def next_codebooks(vectors: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Codebooks whose entries are the componentwise floor of the mean of the parts nearest to them; an entry without parts stays."""
    parts, entries, width = codebooks.shape
    dimensions = parts * width

    def sum_up(batches):
        sums = np.zeros(codebooks.shape, object)
        counts = np.zeros((parts, entries), np.int64)
        for rows, _ in blocks(batches, (), dimensions):
            for place in range(parts):
                distinct, weights, _ = distinct_parts(part_of(rows, place, parts))
                distinct, book = exact(dimensions, distinct, codebooks[place])
                codes, _ = assigned(distinct, book)
                own = np.zeros(book.shape, distinct.dtype)
                np.add.at(own, codes, distinct * weights.astype(distinct.dtype)[:, None])
                sums[place] += own.astype(object)
                counts[place] += np.bincount(codes, weights, entries).astype(np.int64)
        used = np.argwhere(counts)
        yield pa.record_batch([
            pa.array(used[:, 0], pa.int32()), pa.array(used[:, 1], pa.int32()), pa.array(counts[used[:, 0], used[:, 1]]),
            pa.array([[Decimal(int(x)) for x in sums[p, e]] for p, e in used], pa.list_(pa.decimal128(38, 0)))], ["part", "entry", "count", "sums"])

    partial = vectors.select("q").mapInArrow(sum_up, "part int, entry int, count long, sums array<decimal(38,0)>")
    totals = partial.groupBy("part", "entry").agg(
        F.sum("count").alias("count"), *[F.sum(F.col("sums")[i]).cast("decimal(38,0)").alias(f"_{i}") for i in range(width)])
    made = codebooks.copy()
    for row in totals.collect():  # as many rows as the codebooks have entries, at most
        made[row["part"], row["entry"]] = [int(row[f"_{i}"]) // row["count"] for i in range(width)]
    return made


def encode(vectors: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(id, label, code, error): two hexadecimal digits for every part, and the squared distances summed, at most 2^63 - 1."""
    parts, entries, width = codebooks.shape

    def code(batches):
        for rows, (ids, labels) in blocks(batches, ("id", "label"), parts * width):
            codes, total = np.zeros((len(rows), parts), np.uint8), np.zeros(len(rows), object)
            for place in range(parts):
                distinct, _, places = distinct_parts(part_of(rows, place, parts))
                distinct, book = exact(parts * width, distinct, codebooks[place])
                own, errors = assigned(distinct, book)
                codes[:, place] = own[places]
                total = total + errors[places]
            digits = codes.tobytes().hex()
            step = 2 * parts
            yield pa.record_batch([ids, labels, pa.array([digits[i * step:(i + 1) * step] for i in range(len(rows))]),
                                   pa.array([min(int(e), _MOST) for e in total], pa.int64())], ["id", "label", "code", "error"])

    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("id", "label")}
    return vectors.select("id", "label", "q").mapInArrow(code, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def first_codebooks(vectors: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The parts of the vectors with the smallest ids, so many that every codebook gets ``entries`` of them, if there are as many."""
    chosen = [row["q"] for row in vectors.orderBy(F.asc_nulls_last("id"), "q").limit(entries).select("q").collect()]
    return np.array(chosen, np.int64).reshape(len(chosen), parts, -1).transpose(1, 0, 2).copy()


def codebooks_text(codebooks: np.ndarray) -> str:
    return ",".join(map(str, codebooks.ravel().tolist()))


def vector_codes(
    table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = 256,
    id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
) -> DataFrame:
    """Id, code, error, label_error and codebooks_sha256 of every vector that takes part.

    Components become floor(scale * component), within 64 bits. Vectors that are null, empty or hold a null or non-finite component take no
    part, nor do vectors of another length than the one with the smallest id. A length that ``parts`` does not divide is filled up with zeros.
    Codebooks begin with the vectors of the smallest ids (null ids last, equal ids by vector); with fewer vectors they are shorter.
    Repeated rows count and are returned each; null labels are one label; other columns are not read; an empty table gives no rows.
    Sums beyond 64 bits stop at their end.

    The quantised vectors are written once, and each round reads them without moving any: only codebooks (parts * entries * width numbers)
    pass the driver. At most 256 entries, as a code has two digits.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be between 1 and 256")
    rows = table.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"), quantised(F.col(vector_column), scale).alias("q")).where("size(q) > 0")
    head = rows.orderBy(F.asc_nulls_last("id"), "q").limit(1).select(F.size("q")).first()
    size = head[0] if head else parts
    padding = -size % parts
    full = F.concat("q", F.array_repeat(F.lit(0).cast("long"), padding)) if padding else F.col("q")
    vectors = cut_lineage(rows.where(F.size("q") == size).select("id", "label", full.alias("q")))
    codebooks = first_codebooks(vectors, parts, entries) if head else np.zeros((parts, 0, 1), np.int64)
    for _ in range(rounds if head else 0):
        codebooks = next_codebooks(vectors, codebooks)
    coded = cut_lineage(encode(vectors, codebooks))
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST)).cast("long").alias("label_error"))
    digest = hashlib.sha256(codebooks_text(codebooks).encode()).hexdigest()
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select(F.col("id").alias(id_column), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
