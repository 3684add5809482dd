"""Fill-in-the-middle transformation over texts stored as seekable frames.

A document is cut at two unit boundaries drawn from a hash of its id. Only the frames that hold a cut are decompressed; the output
is strung together from the stored frames as they are, the parts of the cut ones, and the markers. Digests, and the text rebuilt
from an output, are streamed through its frames in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.frames import FRAME_BYTES, FrameWriter, Framed, binaries, inflate

#: Markers of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Parts in the order of the output, as places of MARKERS.
_ORDER = {PSM: (0, 1, 2), SPM: (1, 0, 2)}


def draws(id_column: str, seed: int, count: int = 4) -> list[Column]:
    """Numbers of 32 bits drawn for a row: groups of eight digits of a hash of seed and id. A null id draws like an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(count)]


def has_marker(text: Column) -> Column:
    found = F.lit(False)
    for marker in MARKERS:
        found = found | F.contains(text, F.lit(marker))
    return F.coalesce(found, F.lit(False))


def planned(stored: DataFrame, id_column: str, seed: int, rate: int, spm_rate: int) -> DataFrame:
    """Adds first and last, the units before the two cuts, and form."""
    h1, h2, h3, h4 = draws(id_column, seed)
    a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    form = F.when((F.col("n") == 0) | F.col("marked") | (h3 % 100 >= rate), PLAIN).when(h4 % 100 < spm_rate, SPM).otherwise(PSM)
    return stored.withColumns({"first": F.least(a, b), "last": F.greatest(a, b), "form": form})


def composed(text: Framed, first: int, last: int, form: str) -> tuple[list, int, int]:
    """Frames of the output, and the code points of prefix and middle."""
    start, one, two, end = text.seek(0), text.seek(first), text.seek(last), text.seek(text.n)
    parts = ((start, one), (two, end), (one, two))
    out = FrameWriter()
    for place in _ORDER[form]:
        out.add(False, MARKERS[place].encode())
        for whole, data in text.between(*parts[place]):
            out.add(whole, data)
    return out.done(), one[2], two[2] - one[2]


def marker_places(output: Iterator[bytes], form: str) -> Iterator[int]:
    """Bytes before each marker of a streamed output. Markers may lie across frames; none is in a part."""
    wanted = [MARKERS[place].encode() for place in _ORDER[form]]
    tail, before = b"", 0  # bytes that a marker could have begun with, and bytes before them
    for data in output:
        window, at = tail + data, 0
        while wanted and (found := window.find(wanted[0], at)) >= 0:
            yield before + found
            at = found + len(wanted.pop(0))
        kept = max(at, len(window) - max(map(len, MARKERS)) + 1)
        tail, before = window[kept:], before + kept


def digests_of(frames: list, form: str) -> tuple[str, str]:
    """Hexadecimal sha256 of an output, and of the text that output and form give back, both streamed."""
    whole, ends = hashlib.sha256(), [0]
    held = (-1, b"")

    def read(number: int) -> bytes:
        nonlocal held
        if held[0] != number:
            held = (number, inflate(frames[number]))
        return held[1]

    def stream() -> Iterator[bytes]:
        for number in range(len(frames)):
            data = read(number)
            whole.update(data)
            ends.append(ends[-1] + len(data))
            yield data

    if form == PLAIN:
        for _ in stream():
            pass
        return whole.hexdigest(), whole.hexdigest()
    places = list(marker_places(stream(), form))
    spans = {}
    for place, (at, until) in zip(_ORDER[form], pairwise([*places, ends[-1]])):
        spans[place] = (at + len(MARKERS[place].encode()), until)
    back = hashlib.sha256()
    for place in (0, 2, 1):  # prefix, middle, suffix
        first, last = spans[place]
        for number, (a, b) in enumerate(pairwise(ends)):
            if a < last and b > first:
                back.update(memoryview(read(number))[max(first - a, 0):last - a])
    return whole.hexdigest(), back.hexdigest()


def fill_middle(stored: DataFrame, id_column: str = "doc_id", seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """Id, n, form, prefix_chars, middle_chars and output (frames) of every stored text.

    stored: as ``frames.frame_texts`` gives them, with a boolean ``marked`` that is true for texts that hold a marker. A text without units
    or with a marker stays plain, as does one that the draw leaves out (``rate`` of a hundred are taken); of the others ``spm_rate`` of a
    hundred put the suffix first. A plain output is the stored frames themselves, and its counts are null. A null id draws like an empty one;
    rows with equal ids and texts come out equal; other columns are not read; an empty table gives an empty one.
    """
    rows = planned(stored, id_column, seed, rate, spm_rate).select(F.col(id_column).alias("id"), "n", "first", "last", "form", "feeds", "chars", "frames")

    def compose(batches):
        for batch in batches:
            outputs, prefixes, middles = [], [], []
            for n, first, last, form, feeds, chars, frames in zip(*[batch.column(c).to_pylist() for c in ("n", "first", "last", "form", "feeds", "chars", "frames")]):
                output, prefix, middle = (frames, None, None) if form == PLAIN else composed(Framed(frames, feeds, chars, n), first, last, form)
                outputs.append(output)
                prefixes.append(prefix)
                middles.append(middle)
            yield pa.record_batch([*(batch.column(c) for c in ("id", "n", "form")), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), binaries(outputs)],
                                  ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(compose, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output array<binary>")
    return made.withColumnRenamed("id", id_column)


def with_digests(made: DataFrame) -> DataFrame:
    """The rows of ``fill_middle`` with output_sha256 and restored_sha256 (of the text rebuilt from output and form) instead of the output."""
    kept = [c for c in made.columns if c != "output"]

    def digest(batches):
        for batch in batches:
            found = [digests_of(frames, form) for frames, form in zip(batch.column("output").to_pylist(), batch.column("form").to_pylist())]
            yield pa.record_batch([*(batch.column(c) for c in kept), *(pa.array([f[k] for f in found], pa.string()) for k in (0, 1))],
                                  [*kept, "output_sha256", "restored_sha256"])

    fields = ", ".join(f"`{c}` {made.schema[c].dataType.simpleString()}" for c in kept)
    return made.mapInArrow(digest, f"{fields}, output_sha256 string, restored_sha256 string")


def fill_middle_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", frame_bytes: int = FRAME_BYTES, **options) -> DataFrame:
    """``fill_middle`` of a table of texts: stores its frames as a table in the shared folder and transforms that."""
    from foliant.llm.frames import frame_texts
    from foliant.session import cut_lineage

    marked = docs.select(F.struct(F.col(id_column).alias("id"), has_marker(F.col(text_column)).alias("marked")).alias("_key"), F.col(text_column).alias("text"))
    stored = cut_lineage(frame_texts(marked, "_key", "text", frame_bytes).select(F.col("_key.id").alias(id_column), "_key.marked", "n", "feeds", "chars", "frames"))
    return fill_middle(stored, id_column, **options)
