"""Training order written out: every sequence at the slot that a keyed permutation gives it.

A Feistel network permutes the numbers below the next power of four, and a number that falls outside the table is permuted again
until it falls inside (cycle-walking), so the slots of n sequences are a permutation of 0 .. n - 1 that any task can compute, in
both directions. Shards are ranges of slots: a slot's shard and place in it follow from the slot, a reader takes shards one
after another, and resumes anywhere without an index.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.arrow import sized, texts_of
from foliant.llm.files import attempt_name, new_folder, open_place
from foliant.llm.words import encode_texts, word_encoder

ROUNDS = 6
BATCH_BYTES = 2 << 20
SHARD_BYTES = 32 << 20
_HEAD = 4  # bytes before the ids of a record: how many ids are not padding
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    """A mixing of 64-bit numbers: shifts and multiplications by fixed odd numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _round_keys(key: int) -> np.ndarray:
    return _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (1 << 64) - 1))


def _network(x: np.ndarray, half: int, keys: np.ndarray, back: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for key in keys[::-1] if back else keys:
        if back:
            left, right = right ^ (_mix(left ^ key) & mask), left
        else:
            left, right = right, left ^ (_mix(right ^ key) & mask)
    return (left << shift) | right


def permute(x: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """Slots of the numbers x below n, or the numbers of slots."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    keys, found = _round_keys(key), x.astype(np.uint64)
    with np.errstate(over="ignore"):
        found = _network(found, half, keys, back)
        outside = np.flatnonzero(found >= n)
        while len(outside):
            found[outside] = _network(found[outside], half, keys, back)
            outside = outside[found[outside] >= n]
    return found.astype(np.int64)


def token_sequences(docs: DataFrame, path: str, end_id: int, length: int, text_column: str = "text") -> DataFrame:
    """(part, row, n, ids): the ids of the documents of a task, each followed by ``end_id``, cut every ``length`` ids. ``ids`` are
    little-endian 16-bit numbers, n of them; part and row number the sequences of a task from 0. A null text counts as empty."""
    rows = docs.select(F.col(text_column).alias("text"))

    def cut(batches):
        from pyspark import TaskContext

        part, row = TaskContext.get().partitionId(), 0
        held = np.zeros(0, np.uint16)

        def drain(sequences: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal row
            row += len(sequences)
            return pa.record_batch([
                pa.array([part] * len(sequences), pa.int32()), pa.array(np.arange(row - len(sequences), row)), pa.array([len(s) for s in sequences], pa.int32()),
                pa.array([s.tobytes() for s in sequences], pa.binary())], ["part", "row", "n", "ids"])

        for batch in sized(batches, "text", BATCH_BYTES):
            encoder = word_encoder(path)
            if len(encoder.names) > 1 << 16:
                raise ValueError("ids of this vocabulary do not fit 16 bits")
            ids, ends = encode_texts(encoder, texts_of(batch))
            held = np.concatenate([held, np.insert(ids, ends, end_id).astype(np.uint16)])
            whole = len(held) // length * length
            yield drain(list(held[:whole].reshape(-1, length)))
            held = held[whole:].copy()
        if len(held):
            yield drain([held])

    return rows.mapInArrow(cut, "part int, row long, n int, ids binary")


def materialise(sequences: DataFrame, folder: str, key: int, length: int, pad_id: int = 0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the sequences in training order and returns one row per shard: shard, path, first_slot, records, stride, total.

    sequences: as ``token_sequences`` gives them, read from storage: a lost task must find the same part and row again. Every
    record has the same size: the number of ids as a little-endian 32-bit number, the ids, and ``pad_id`` up to ``length``. Repeated
    sequences are records of their own; an empty table gives no shards.
    """
    counts = sequences.groupBy("part").agg(F.count("*").alias("count"))
    # One row per task that made sequences: small enough to be numbered in one place.
    before = counts.withColumn("before", F.coalesce(F.sum("count").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    total = counts.agg(F.sum("count")).first()[0] or 0
    stride = _HEAD + 2 * length
    per_shard = max(1, shard_bytes // stride)
    shards = max(1, -(-total // per_shard))

    def place_rows(batches):
        import zstandard

        compressor = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            slots = permute(batch.column("number").to_numpy(), total, key)
            packed = [compressor.compress(x.as_py()) for x in batch.column("ids")]
            yield pa.record_batch([pa.array(slots), pa.array((slots // per_shard).astype(np.int32)), batch.column("n"), pa.array(packed, pa.binary())],
                                  ["slot", "shard", "n", "ids"])

    def write(batches):
        import zstandard

        inflater = zstandard.ZstdDecompressor()
        place, path = open_place(folder)
        shard = out = name = None
        first = records = 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.record_batch([pa.array([shard], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([first], pa.int64()), pa.array([records], pa.int64())],
                                   ["shard", "path", "first_slot", "records"])

        for batch in batches:
            for slot, number, n, ids in zip(*[batch.column(c).to_pylist() for c in ("slot", "shard", "n", "ids")]):
                if number != shard:
                    if out:
                        yield close()
                    shard, first, records = number, slot, 0
                    name = attempt_name(f"shard-{shard:06d}", ".bin")
                    out = place.open_output_stream(f"{path}/{name}", compression=None)
                data = inflater.decompress(ids)
                out.write(n.to_bytes(4, "little") + data + np.full(length - n, pad_id, "<u2").tobytes())
                records += 1
        if out:
            yield close()

    numbered = sequences.join(F.broadcast(before), "part").select((F.col("before") + F.col("row")).alias("number"), "n", "ids")
    placed = numbered.mapInArrow(place_rows, "slot long, shard int, n int, ids binary")
    place, path = open_place(folder)
    place.create_dir(path, recursive=True)
    written = placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot").mapInArrow(
        write, "shard int, path string, first_slot long, records long")
    written.withColumns({"stride": F.lit(stride), "total": F.lit(total).cast("long")}).write.parquet(f"{folder}/shards")
    return sequences.sparkSession.read.parquet(f"{folder}/shards")


def read_shards(shards: DataFrame, key: int, from_slot: int = 0) -> DataFrame:
    """(slot, number, shard, position, n, ids_crc32, ids): the records from a slot on, shard by shard in the order of slots. ``number`` is
    the sequence the permutation put there."""
    wanted = shards.where(F.col("first_slot") + F.col("records") > from_slot).repartition(F.col("shard"))

    def read(batches):
        for batch in batches:
            for shard, path, first, records, stride, total in zip(*[batch.column(c).to_pylist() for c in ("shard", "path", "first_slot", "records", "stride", "total")]):
                folder, _, name = path.rpartition("/")
                place, inside = open_place(folder)
                skipped = max(0, from_slot - first)
                step = max(1, BATCH_BYTES // stride)
                with place.open_input_file(f"{inside}/{name}") as source:
                    for start in range(skipped, records, step):
                        count = min(step, records - start)
                        data = source.read_at(count * stride, start * stride)
                        ids = [data[i * stride + _HEAD:i * stride + _HEAD + 2 * int.from_bytes(data[i * stride:i * stride + 4], "little")] for i in range(count)]
                        slots = np.arange(first + start, first + start + count)
                        yield pa.record_batch([
                            pa.array(slots), pa.array(permute(slots, total, key, back=True)), pa.array([shard] * count, pa.int32()), pa.array(slots - first),
                            pa.array([len(x) // 2 for x in ids], pa.int32()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                            ["slot", "number", "shard", "position", "n", "ids_crc32", "ids"])

    return wanted.mapInArrow(read, "slot long, number long, shard int, position long, n int, ids_crc32 long, ids binary")


def training_order(docs: DataFrame, path: str, end_id: int, key: int, length: int = 2048) -> DataFrame:
    """Tokenises documents, writes their sequences in training order to a folder below the shared one, and returns the shards."""
    spark: SparkSession = docs.sparkSession
    folder = new_folder(spark, "training-order")
    token_sequences(docs, path, end_id, length).write.option("compression", "zstd").parquet(f"{folder}/sequences")
    sequences = spark.read.parquet(f"{folder}/sequences")
    return materialise(sequences, f"{folder}/shards", key, length)
