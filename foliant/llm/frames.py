"""Texts as independent zstandard frames that can be entered at any unit.

A text is stored as frames of a bounded size, each of which decompresses alone, with the units (lines) and code points that lie
before every frame. A reader finds the frame of a unit by these counts and decompresses that frame only; one that needs all of a
text takes the frames one after another and never holds more than one of them decompressed.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.arrow import per_process, sized

FRAME_BYTES = 1 << 16
LEVEL = 3
BATCH_BYTES = 4 << 20


def code_points(data: bytes) -> int:
    """Bytes that begin a character of UTF-8."""
    return len(data) if data.isascii() else int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def frame_ends(data: bytes, limit: int) -> list[int]:
    """Ends of pieces of at most ``limit`` bytes: behind the last line feed of the piece if it has one, else between two characters."""
    ends, first = [], 0
    while len(data) - first > limit:
        end = data.rfind(b"\n", first, first + limit) + 1
        if not end:
            end = first + limit
            while end > first + limit - 4 and data[end] & 0xC0 == 0x80:
                end -= 1
        ends.append(end)
        first = end
    return ends + [len(data)] if data else []


def compress(data: bytes) -> bytes:
    import zstandard

    return per_process("zstd", lambda: zstandard.ZstdCompressor(level=LEVEL)).compress(data)


def inflate(frame) -> bytes:
    import zstandard

    return per_process("unzstd", zstandard.ZstdDecompressor).decompress(frame)


def text_of(frames: Iterable) -> str:
    """The whole text of its frames."""
    return b"".join(inflate(f) for f in frames).decode()


class Framed:
    """A stored text: its frames, and the line feeds and code points before each frame and after the last one."""

    def __init__(self, frames: list, feeds: list[int], chars: list[int], n: int) -> None:
        self.frames, self.feeds, self.chars, self.n = frames, feeds, chars, n
        self._held: dict[int, bytes] = {}  # frames that hold a cut

    def frame(self, number: int) -> bytes:
        if number not in self._held:
            self._held[number] = inflate(self.frames[number])
        return self._held[number]

    def seek(self, unit: int) -> tuple[int, int, int]:
        """(frame, byte in it, code points before) of the place behind so many units; only the frame of the place is decompressed."""
        if unit <= 0:
            return 0, 0, 0
        if unit >= self.n:
            return len(self.frames), 0, self.chars[-1]
        number = bisect_left(self.feeds, unit) - 1
        data = self.frame(number)
        place = -1
        for _ in range(unit - self.feeds[number]):
            place = data.index(b"\n", place + 1)
        return number, place + 1, self.chars[number] + code_points(data[:place + 1])

    def between(self, start: tuple[int, int, int], end: tuple[int, int, int]) -> Iterator[tuple[bool, bytes]]:
        """(whole, bytes) of what lies between two places: whole frames as they are stored, cut ones as decompressed parts."""
        (first, a, _), (last, b, _) = start, end
        if first == last:
            if a < b:
                yield False, self.frame(first)[a:b]
            return
        if a:
            yield False, self.frame(first)[a:]
            first += 1
        for number in range(first, last):
            yield True, self.frames[number]
        if b:
            yield False, self.frame(last)[:b]


class FrameWriter:
    """Strings frames and loose bytes together; loose bytes are compressed into frames of their own."""

    def __init__(self, limit: int = FRAME_BYTES) -> None:
        self.limit, self.frames, self._loose, self._size = limit, [], [], 0

    def add(self, whole: bool, data: bytes) -> None:
        if whole:
            self._flush()
            self.frames.append(data)
        else:
            self._loose.append(data)
            self._size += len(data)
            if self._size >= self.limit:
                self._flush()

    def _flush(self) -> None:
        if self._size:
            self.frames.append(compress(b"".join(self._loose)))
        self._loose, self._size = [], 0

    def done(self) -> list[bytes]:
        self._flush()
        return self.frames


def binaries(values: list[list]) -> pa.Array:
    """A column of lists of byte strings."""
    return pa.array(values, pa.list_(pa.binary()))


def frame_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """One row per document: id, n (units), feeds and chars (line feeds and code points before every frame, and in all), frames.

    A unit is a line with its line feed, or what follows the last line feed. A null text is stored like an empty one: no frames, no
    units. Rows are independent of each other: repeated rows are stored each, a null id stays null, other columns are not read, and an
    empty table gives an empty one. A task holds one batch of 4 MiB of text, or one longer text.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text"))

    def store(batches):
        for batch in sized(batches, "text", BATCH_BYTES):
            n, feeds, chars, frames = [], [], [], []
            for data in batch.column("text").to_pylist():
                first, at, lines, points = 0, [0], [0], [0]
                own = []
                for end in frame_ends(data, frame_bytes):
                    piece = data if end - first == len(data) else data[first:end]
                    own.append(compress(piece))
                    lines.append(lines[-1] + piece.count(b"\n"))
                    points.append(points[-1] + code_points(piece))
                    at.append(end)
                    first = end
                n.append(lines[-1] + (bool(data) and data[-1] != 0x0A))
                feeds.append(lines)
                chars.append(points)
                frames.append(own)
            yield pa.record_batch([batch.column("id"), pa.array(n, pa.int64()), pa.array(feeds, pa.list_(pa.int64())), pa.array(chars, pa.list_(pa.int64())), binaries(frames)],
                                  ["id", "n", "feeds", "chars", "frames"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(store, f"id {kind}, n long, feeds array<long>, chars array<long>, frames array<binary>").withColumnRenamed("id", id_column)
