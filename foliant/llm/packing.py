"""Packing of token ids into fixed windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into pieces: whole windows first, the rest into small pieces. Groups of small pieces are spread over
as few windows as could hold them: every piece begins as a partition of its own with all other windows empty; the two
partitions with the largest imbalance are merged again and again, the fullest windows of one with the emptiest of the other,
until one is left, whose windows are nearly equal. If one of them is over capacity, the group is spread anew over one window
more.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.arrow import sized, texts_of
from foliant.llm.words import encode_texts, word_encoder

BATCH_BYTES = 2 << 20
#: Longest small piece, and windows that a group is meant to fill.
PIECE = 256
GROUP_WINDOWS = 64
#: A group is full when it fills its windows up to this share, which leaves room for their imbalance.
FILL = 0.99
_SHIFT = 33


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Item numbers of each window after multiway differencing of the sizes over so many windows."""
    # A partition is its non-empty windows as (sum, tree of items), largest first.
    heap = [(-size, i, [(size, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = len(a) + len(b) - windows
        if both > 0:  # the smallest windows of a take the smallest of b, the lowest of a the highest among these
            kept_a, low_a, kept_b, low_b = a[:len(a) - both], a[len(a) - both:], b[:len(b) - both], b[len(b) - both:]
            joined = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(low_a, reversed(low_b))]
        else:
            kept_a, kept_b, joined = a, b, []
        merged = sorted(kept_a + kept_b + joined, key=lambda w: -w[0])
        low = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (low - merged[0][0], made, merged))
        made += 1
    found = []
    for _, tree in heap[0][2] if heap else []:
        items, open_nodes = [], [tree]
        while open_nodes:
            node = open_nodes.pop()
            if isinstance(node, tuple):
                open_nodes += node
            else:
                items.append(node)
        found.append(sorted(items))
    return found


def pack_group(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of item numbers, none over capacity, in as few windows as differencing manages. No item is over capacity."""
    windows = -(-sum(sizes) // capacity)
    while True:
        found = differencing(sizes, windows)
        if all(sum(sizes[i] for i in items) <= capacity for items in found):
            return found
        windows += 1


def pack_documents(
    docs: DataFrame, path: str, end_id: int, capacity: int = 2048, piece: int = PIECE, id_column: str = "doc_id", text_column: str = "text",
    words: int | None = None,
) -> DataFrame:
    """One row per piece: id, start and length (in its document's ids), ids (array<int>), doc_tokens, sequence_id, offset.

    Every document gives its ids and ``end_id``, so a null or empty text gives that one id. Each id lies in exactly one piece,
    and the pieces of a sequence lie one after another from offset 0, at most ``capacity`` ids in all. Repeated rows are
    packed each; a null id stays null; other columns are not read. Groups form in the order of a task's rows, so nothing is
    shuffled, and a task holds one batch of 2 MiB of text and one open group. Sequence ids are the number of the task, shifted,
    plus a count; a task that runs again packs the same rows alike. ``words``: how many encoded words a worker keeps (see `word_encoder`).
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    room = int(GROUP_WINDOWS * capacity * FILL)

    def pack(batches):
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << _SHIFT
        group: list[tuple] = []  # (id, start, ids, doc_tokens) of small pieces
        filled = 0
        out: list[tuple] = []

        def close() -> None:
            nonlocal sequence, filled
            for items in pack_group([len(p[2]) for p in group], capacity):
                offset = 0
                for i in items:
                    out.append((*group[i], sequence, offset))
                    offset += len(group[i][2])
                sequence += 1
            group.clear()
            filled = 0

        def drain():
            ids = [p[2] for p in out]
            columns = list(zip(*out)) if out else [[]] * 6
            ends = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
            batch = pa.record_batch([
                pa.array(columns[0], id_type), pa.array(columns[1], pa.int64()), pa.array(np.diff(ends).astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))),
                pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.int64())],
                ["id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            out.clear()
            return batch

        id_type = None
        for batch in sized(batches, "text", BATCH_BYTES):
            id_type = batch.schema.field("id").type
            encoder = word_encoder(path, words)
            flat, ends = encode_texts(encoder, texts_of(batch))
            first = 0
            for key, end in zip(batch.column("id").to_pylist(), ends.tolist()):
                ids = np.append(flat[first:end], np.int32(end_id))
                first, total, start = end, len(ids), 0
                while total - start >= capacity:
                    out.append((key, start, ids[start:start + capacity], total, sequence, 0))
                    sequence += 1
                    start += capacity
                while start < total:  # the last piece may have any length, which is what evens the windows out
                    stop = min(start + piece, total)
                    if filled + stop - start > room:
                        close()
                    group.append((key, start, ids[start:stop], total))
                    filled += stop - start
                    start = stop
            yield drain()
        if group:
            close()
            yield drain()

    packed = rows.mapInArrow(pack, f"id {kind}, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_column)
