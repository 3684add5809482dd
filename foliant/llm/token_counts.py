"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.arrow import per_process, sized, texts_of

BATCH_BYTES = 1 << 20
LONG_CHARS = 16_384
# One space between ASCII letters or digits. The model puts its own mark for a space before each text, no piece of its
# vocabulary holds that mark behind another character, and nothing is normalised, so the part behind the space, encoded
# alone, gives the tokens it gives inside the text.
_SAFE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


def split_long(text: str, limit: int = LONG_CHARS) -> list[str]:
    """Parts of a text of about ``limit`` characters, cut at safe spaces, which are left out. A stretch without a safe
    space stays whole."""
    parts, start = [], 0
    while len(text) - start > limit:
        cut = _SAFE.search(text, start + limit)
        if cut is None:
            break
        parts.append(text[start:cut.start()])
        start = cut.end()
    parts.append(text[start:])
    return parts


def piece_counts(processor, texts: list[str]) -> np.ndarray:
    """Tokens of each text."""
    parts = [split_long(text) for text in texts]
    lengths = np.fromiter(map(len, processor.encode([p for ps in parts for p in ps], num_threads=1)), np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return np.diff(ends[np.cumsum([0] + [len(p) for p in parts])])


def token_counts(docs: DataFrame, model_path: str, limit: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id, n_bytes (UTF-8), n_tokens and over_limit of every row.

    A null text counts as empty: no bytes, no tokens. Repeated rows are counted each; a null id stays null; other columns are
    not read. Tasks regroup their rows into batches of at most 1 MiB of text, so a task's memory does not depend on how
    long its texts are, but for the longest single one.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))

    def count(batches):
        def load():
            import sentencepiece

            return sentencepiece.SentencePieceProcessor(model_file=model_path)

        processor = per_process(f"pieces:{model_path}", load)
        for batch in sized(batches, "text", BATCH_BYTES):
            texts = texts_of(batch)
            n_bytes = np.array([len(t) if t.isascii() else len(t.encode()) for t in texts], np.int64)
            n_tokens = piece_counts(processor, texts)
            yield pa.record_batch([batch.column("id"), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)],
                                  ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return counted.withColumnRenamed("id", id_column)
