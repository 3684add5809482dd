"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last 32 bytes cuts a text into chunks, wherever the cut falls, so texts that share a passage share
the chunks inside it. Each distinct chunk is encoded once per task: of a chunk's tokens those between its first and its
last white space are final, because no token reaches across white space. At a join the open end of one chunk and the open
start of the next are put together, over further chunks as long as these have no white space, and encoded again; that is
where both sides agree with the whole text exactly.

Rows travel to tasks by range of (smallest chunk hash, id): texts that share most of their chunks mostly share the smallest,
so copies meet in one task, and a group of copies of any size is spread over as many ranges as its rows fill.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.arrow import lists, sized, texts_of
from foliant.llm.words import WordEncoder, word_encoder, words_of

MEAN_CHUNK = 1024
BATCH_BYTES = 2 << 20
#: Chunks that a task keeps before it starts afresh.
MAX_CHUNKS = 10_000


def _gear() -> np.ndarray:
    """A random 32-bit number for every byte value."""
    return np.random.default_rng(20240229).integers(0, 1 << 32, 256, np.uint32)


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """At each byte the hash of it and the 31 before it: their gear numbers, each shifted by its distance."""
    total = _gear()[data]
    for width in (1, 2, 4, 8, 16):
        total[width:] += total[:-width] << np.uint32(width)
    return total


def chunk_starts(data: np.ndarray, offsets: np.ndarray, mean: int = MEAN_CHUNK) -> np.ndarray:
    """Where chunks begin in the UTF-8 bytes of texts: after a hash whose top bits are zero, moved on to the start of a
    character. The first 32 bytes of a text, whose hashes would reach into the text before it, hold no cut."""
    cuts = np.flatnonzero(rolling_hash(data) < (1 << 32) // mean) + 1
    for _ in range(3):  # a character has at most three bytes behind its first
        cuts = cuts[cuts < len(data)]
        cuts = cuts + ((data[cuts] & 0xC0) == 0x80)
    own = offsets[np.searchsorted(offsets, cuts, "right") - 1]
    return np.unique(cuts[cuts - own > 32])


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column, and where each text begins in them, with the end as last."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


class ChunkEncoder:
    """Word numbers of texts by way of their chunks."""

    def __init__(self, words: WordEncoder) -> None:
        self.words, self.known, self.cleared = words, {}, words.cleared

    def make_room(self) -> None:
        """To be called between batches. Word numbers end with the encoder's table."""
        self.words.make_room()
        if len(self.known) > MAX_CHUNKS or self.cleared != self.words.cleared:
            self.known, self.cleared = {}, self.words.cleared

    def _chunk(self, chunk: str) -> tuple:
        """(open start, word numbers between, open end); without white space all is open and the last two are None."""
        found = self.known.get(chunk)
        if found is None:
            parts = words_of(chunk)
            if len(parts) > 1:
                found = parts[0], self.words.numbers_of(parts[1:-1]), parts[-1]
            else:
                found = chunk, None, None
            self.known[chunk] = found
        return found

    def numbers(self, chunks: list[str]) -> list[np.ndarray]:
        """Word numbers of the text that the chunks make up, in pieces."""
        pieces, open_end = [], ""
        for chunk in chunks:
            start, between, end = self._chunk(chunk)
            open_end += start
            if between is not None:
                pieces.append(np.array([self.words.number(open_end)], np.int32))
                pieces.append(between)
                open_end = end
        pieces.append(np.array([self.words.number(open_end)], np.int32))
        return pieces


def encode_batch(chunked: ChunkEncoder, column: pa.Array, mean: int = MEAN_CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of the texts of a column, and the end of each text in them."""
    data, offsets = _bytes_of(column)
    edges = np.unique(np.concatenate([offsets, chunk_starts(data, offsets, mean)]))
    first = np.searchsorted(edges, offsets)
    raw, edges, chunked_pieces, counts = data.tobytes(), edges.tolist(), [], np.zeros(len(column), np.int64)
    for row in range(len(column)):
        own = edges[first[row]:first[row + 1] + 1]
        found = chunked.numbers([raw[a:b].decode() for a, b in zip(own, own[1:])])
        counts[row] = sum(map(len, found))
        chunked_pieces += found
    numbers = np.concatenate(chunked_pieces) if chunked_pieces else np.zeros(0, np.int32)
    ids, lengths = chunked.words.ids(numbers)
    return ids, np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts)]


def decode(ids: pa.ListArray, names: pa.Array) -> pa.Array:
    """Texts of id lists as the library's decode makes them where a vocabulary has no decoder: names joined by a space."""
    return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, names.take(ids.values)), " ")


def with_route(docs: DataFrame, mean: int = MEAN_CHUNK) -> DataFrame:
    """Rows (id, text) with ``route``: the smallest hash at which a chunk of the text ends, or of all if none does."""

    def route(batches):
        for batch in sized(batches, "text", BATCH_BYTES):
            data, offsets = _bytes_of(batch.column("text"))
            values, hashes = np.zeros(batch.num_rows, np.int64), rolling_hash(data)
            long = np.flatnonzero(np.diff(offsets) > 32)
            if len(long):  # the first 31 hashes of a text reach into the one before it
                spans = np.stack([offsets[long] + 31, offsets[long + 1]], axis=1).ravel()
                values[long] = np.minimum.reduceat(np.append(hashes, 0), spans)[::2]
            yield pa.record_batch([*batch.columns, pa.array(values)], [*batch.schema.names, "route"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(route, f"id {kind}, text string, route long")


def encode_documents(
    docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", mean: int = MEAN_CHUNK,
) -> DataFrame:
    """Id, ``ids`` (array<int>) and ``decoded`` (string) of every row.

    A null text counts as empty and gives no ids; a null id stays null; repeated rows are encoded each; other columns are
    not read. Tasks hold one batch of 2 MiB of text, or the longest single text.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))

    def encode(batches):
        chunked = ChunkEncoder(word_encoder(path))
        names = pa.array(chunked.words.names)
        for batch in sized(batches, "text", BATCH_BYTES):
            chunked.make_room()
            listed = lists(*encode_batch(chunked, batch.column("text"), mean))
            yield pa.record_batch([batch.column("id"), listed, decode(listed, names)], ["id", "ids", "decoded"])

    kind = rows.schema["id"].dataType.simpleString()
    near = with_route(rows, mean).repartitionByRange(F.col("route"), F.col("id")).drop("route")
    return near.mapInArrow(encode, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_column)
