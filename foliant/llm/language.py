"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to ``ORDER`` bytes holds how often each byte followed. A byte's code length is
that of its count under escape method C in the longest context known, plus the escapes of the contexts that never saw it,
down to one in 256. Statistics are frozen after training, so a tree is a machine of few states: the state is the longest
known context, and a table gives, by state and byte, the code length and the next state. Because a state depends on the last
``ORDER`` bytes only, a long text is coded in segments that each first read those bytes, all segments of a batch in step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.arrow import sized
from foliant.session import cut_lineage, union_all

ORDER = 4
#: Rows of each language used for training, at most; those with the smallest hash of their id and text.
TRAINING_ROWS = 1000
#: A context is kept if it was seen this often.
MIN_COUNT = 12
UNDETERMINED = "und"
BATCH_BYTES = 2 << 20
SEGMENT = 512
_UNIT = 1 << 20  # code lengths are whole numbers of 1/2^20 bit
_MOST = 2 ** 63 - 1  # the largest hash
_START = 0x0A  # every text is read as if line feeds went before it


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def training_rows(docs: DataFrame, allowed: Column, rows: int = TRAINING_ROWS) -> DataFrame:
    """(lang, text): for each language the allowed rows with the smallest hashes of id and text, ``rows`` at most. Rows that repeat id
    and text count once.

    Languages are counted first; then only rows whose hash lies in the share that holds some four times as many as wanted go on, so
    that no task gets a language's rows. A language for which that share holds too few different rows is looked at whole.
    """
    known = docs.where(allowed & F.col("lang").isNotNull() & has_letter(F.col("text"))).select(
        "lang", "text", F.xxhash64("doc_id", "text").alias("_hash"))

    def smallest(limits: dict[str, int]) -> DataFrame:
        last = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col("lang")]
        few = known.where(F.col("_hash") <= last).groupBy("lang", "_hash").agg(F.min("text").alias("text"))
        place = F.row_number().over(Window.partitionBy("lang").orderBy("_hash"))
        return few.withColumn("_n", place).where(F.col("_n") <= rows).select("lang", "text")

    counts = {row["lang"]: row["n"] for row in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return known.select("lang", "text").limit(0)
    share = {lang: min(1.0, 4 * rows / n) for lang, n in counts.items()}
    limits = {lang: min(_MOST, int(part * 2 ** 64) - 2 ** 63) for lang, part in share.items()}
    found = cut_lineage(smallest(limits))
    enough = {row["lang"]: row["n"] for row in found.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    short = [lang for lang in counts if limits[lang] < _MOST and enough.get(lang, 0) < rows]
    if not short:
        return found
    return union_all(found.where(~F.col("lang").isin(short)), smallest({lang: _MOST for lang in short}))


def _grams(text: str) -> np.ndarray:
    """Every byte of a text with the ORDER bytes before it, as one number."""
    data = np.frombuffer(bytes([_START] * ORDER) + text.encode(), np.uint8).astype(np.uint64)
    total = np.zeros(len(data) - ORDER, np.uint64)
    for i in range(ORDER + 1):
        total = (total << np.uint64(8)) | data[i:len(data) - ORDER + i]
    return total


def context_counts(rows: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, order, context, bytes, counts): the contexts of up to ORDER bytes that all training rows together hold ``min_count`` times or
    more, with the bytes that followed and how often. The empty context is always there. Counts are summed inside tasks first."""

    def count(batches):
        for batch in batches:
            by_lang: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by_lang.setdefault(lang, []).append(_grams(text))
            for lang, grams in by_lang.items():
                whole, counts = np.unique(np.concatenate(grams), return_counts=True)
                for order in range(ORDER + 1):
                    codes, place = np.unique(whole & np.uint64((1 << (8 * (order + 1))) - 1), return_inverse=True)
                    yield pa.record_batch([
                        pa.array([lang] * len(codes), pa.string()), pa.array(np.full(len(codes), order, np.int32)), pa.array((codes >> np.uint64(8)).astype(np.int64)),
                        pa.array((codes & np.uint64(255)).astype(np.int32)), pa.array(np.bincount(place, counts).astype(np.int64))], ["lang", "order", "context", "byte", "n"])

    # One shuffle by context serves both groupings.
    counted = rows.mapInArrow(count, "lang string, order int, context long, byte int, n long").repartition("lang", "order", "context")
    followed = counted.groupBy("lang", "order", "context", "byte").agg(F.sum("n").alias("n")).groupBy("lang", "order", "context").agg(
        F.sum("n").alias("_total"), F.sort_array(F.collect_list(F.struct("byte", "n"))).alias("_next"))  # 256 at most
    return followed.where((F.col("_total") >= min_count) | (F.col("order") == 0)).select(
        "lang", "order", "context", F.col("_next.byte").alias("bytes"), F.col("_next.n").alias("counts"))


@dataclass
class Machine:
    """One language: ``table[state + class of byte]`` is code length << 32 | next state, states being row offsets."""

    table: np.ndarray
    start: int


@dataclass
class Model:
    languages: list[str]
    classes: np.ndarray
    machines: list[Machine]


def build_machine(contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], classes: np.ndarray) -> Machine:
    """The table of one language. contexts: by order the names of the known contexts, rising, and for each byte seen behind one its place
    among them, the byte and the count."""
    width = int(classes.max()) + 1  # class 0 holds all bytes that no language saw
    rows, next_rows, base = [], [], 0
    for order, (names, owner, byte, n) in enumerate(contexts):
        table = np.zeros((len(names), width), np.int64)
        table[owner, classes[byte]] = n
        if order:
            below = contexts[order - 1][0]
            shorter = np.searchsorted(below, names & np.uint64((1 << (8 * (order - 1))) - 1))
            lower = rows[order - 1][shorter]
        else:
            lower = np.full((1, width), 1 / 256)
        total, different = table.sum(axis=1, keepdims=True), (table > 0).sum(axis=1, keepdims=True)
        rows.append(np.where(table > 0, table / (total + different), different / (total + different) * lower))
        if order:
            # A context and a byte lead to the context of both together where it is known, else to where the context
            # without its first byte leads.
            prefix = names >> np.uint64(8)
            at = np.minimum(np.searchsorted(below, prefix), len(below) - 1)
            both = np.flatnonzero(below[at] == prefix)
            last = classes[(names & np.uint64(255)).astype(np.int64)]
            next_rows[order - 1][at[both], last[both]] = base + both
            next_rows.append(next_rows[order - 1][shorter])
        else:
            next_rows.append(np.zeros((1, width), np.int64))
        base += len(names)
    # The next state of an order-ORDER context was taken from the order below when that was complete.
    parts = [(np.round(-np.log2(chances) * _UNIT).astype(np.int64) << 32) | (following * width) for chances, following in zip(rows, next_rows)]
    table = np.concatenate(parts).ravel()
    state = 0
    for _ in range(ORDER):
        state = int(table[state + classes[_START]] & 0xFFFFFFFF)
    return Machine(table, state)


def train(docs: DataFrame, allowed: Column, rows: int = TRAINING_ROWS, min_count: int = MIN_COUNT) -> Model:
    """Trees of every language that an allowed row names. Only counts of contexts that are kept come to the driver; ``rows`` bounds the
    texts they are taken from, and so their number."""
    found = context_counts(training_rows(docs, allowed, rows), min_count).toArrow().sort_by([("lang", "ascending"), ("order", "ascending"), ("context", "ascending")])
    seen = np.zeros(256, bool)
    seen[pc.unique(pc.list_flatten(found["bytes"])).to_numpy()] = True
    seen[_START] = True
    classes = np.where(seen, np.cumsum(seen), 0)
    languages = pc.unique(found["lang"]).to_pylist()
    machines = []
    for lang in languages:
        own = found.filter(pc.equal(found["lang"], lang))
        contexts = []
        for order in range(ORDER + 1):
            part = own.filter(pc.equal(own["order"], order))
            sizes = pc.list_value_length(part["bytes"]).to_numpy()
            contexts.append((part["context"].to_numpy().astype(np.uint64), np.repeat(np.arange(part.num_rows), sizes),
                             pc.list_flatten(part["bytes"]).to_numpy(), pc.list_flatten(part["counts"]).to_numpy()))
        machines.append(build_machine(contexts, classes))
    return Model(languages, classes, machines)


def code_lengths(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bits of every text under every language, and bytes of every text."""
    column = pa.concat_arrays([pc.fill_null(column.cast(pa.large_string()), "")])
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = model.classes[np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]].astype(np.int32)
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    pieces = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(column)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = offsets[owner] + number * SEGMENT
    length = np.minimum(sizes[owner] - number * SEGMENT, SEGMENT)
    order = np.argsort(-length, kind="stable")
    owner, number, begin, length = owner[order], number[order], begin[order], length[order]
    active = np.searchsorted(-length, -np.arange(SEGMENT), "left")  # segments longer than so many bytes
    inner = number > 0
    bits = np.zeros((len(column), len(model.languages)), np.int64)
    for k, machine in enumerate(model.machines):
        table, low = machine.table, 0xFFFFFFFF
        state = np.where(inner, 0, machine.start)
        for back in range(ORDER, 0, -1):  # inside a text, read the bytes before the segment
            state[inner] = table[state[inner] + data[begin[inner] - back]] & low
        total = np.zeros(len(owner), np.int64)
        for step in range(SEGMENT):
            n = active[step]
            if not n:
                break
            found = table[state[:n] + data[begin[:n] + step]]
            total[:n] += found >> 32
            state[:n] = found & low
        np.add.at(bits[:, k], owner, total)
    return bits / _UNIT, sizes


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id, lang_pred, score and bits_per_byte of every row.

    lang_pred is the language with the shortest code, ties going to the first by name, and score its share when each language
    weighs 2^-bits. A text that is null or has no letter gets ``und``, score 0 and null bits; so do all texts if no language was learned.
    Empty texts have no letter. Repeated rows are scored each; a null id stays null; other columns are not read. Tasks hold
    a batch of 2 MiB of text, or the longest single text.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.when(has_letter(F.col(text_column)), F.col(text_column)).alias("text"))
    # Arrays only: executors need no copy of this package.
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.classes, [(m.table, m.start) for m in model.machines]))

    def score(batches):
        languages, classes, machines = shared.value
        model = Model(languages, classes, [Machine(*m) for m in machines])
        for batch in sized(batches, "text", BATCH_BYTES):
            known = pc.is_valid(batch.column("text")).to_numpy(zero_copy_only=False)
            if model.languages:
                bits, sizes = code_lengths(model, batch.column("text"))
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(bits)), best]
                share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                names, rate = np.array(model.languages, object)[best], least / np.maximum(sizes, 1)
            else:
                known &= False
                names, share, rate = np.full(len(known), "", object), np.zeros(len(known)), np.zeros(len(known))
            yield pa.record_batch([
                batch.column("id"), pa.array(np.where(known, names, UNDETERMINED), pa.string()), pa.array(np.where(known, share, 0.0)),
                pa.array(rate, mask=~known)], ["id", "lang_pred", "score", "bits_per_byte"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(score, f"id {kind}, lang_pred string, score double, bits_per_byte double").withColumnRenamed("id", id_column)


def held_out(id_column: str = "doc_id") -> Column:
    """Rows that training leaves out: one in five by the checksum of their id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
