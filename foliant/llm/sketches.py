"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions alone.

A sketch is the k smallest distinct 31-bit hashes of a text's five-word shingles, as a sorted array. The k smallest of the union
of two sketches are the sketch of both texts together, so sketches of parts can be merged; the share of those that lie in
both sketches estimates resemblance, and the largest of them the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.skew import number_rows

K = 128
WIDTH = 5
_BITS = 31
_WHITE = r"[\x09-\x0D\x20]+"


def _hash(*values: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*values), 64 - _BITS).cast("int")


def with_sketch(df: DataFrame, text: Column, name: str = "sketch", k: int = K, width: int = WIDTH) -> DataFrame:
    """``df`` with the sketch of a text: of its lower-cased words between ASCII white space, of all words together if there
    are fewer than ``width``, empty if there is none. A null text counts as empty."""
    words, hashes = f"_{name}_words", f"_{name}_hashes"
    w, n = F.col(words), F.size(words)
    split = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _WHITE), lambda x: x != "")
    # Words are a column of their own: the functions below look them up again and again.
    every = F.transform(F.sequence(F.lit(0), n - width), lambda i: _hash(*[F.get(w, i + d) for d in range(width)]))
    few = F.when(n > 0, F.array(_hash(F.array_join(w, " ")))).otherwise(F.array().cast("array<int>"))
    return (
        df.withColumn(words, split)
        .withColumn(hashes, F.when(n >= width, every).otherwise(few))
        .withColumn(name, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k))
        .drop(words, hashes)
    )


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all of both texts; 1 if both have none."""
    both = merge(a, b, k)
    common = F.size(F.array_intersect(F.array_intersect(a, b), both))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k."""
    size = F.size(a)
    largest = F.element_at(a, -1).cast("double")
    return F.when(size < k, size.cast("double")).otherwise((k - 1) * float(1 << _BITS) / (largest + 1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of a that b has, at most 1; 1 if a has none."""
    union = distinct_shingles(merge(a, b, k), k)
    own = distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / own))


def sketch_text(a: Column) -> Column:
    """A sketch as hexadecimal digits, eight for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def following(rows: DataFrame) -> DataFrame:
    """For every distinct (_id, _key, _chars) the key of the row before it in descending order of ids and that row's length:
    (_id, _key) and (_for_id, _for_key, _for_chars). Before the first comes the last. Null ids come last, equal ids in the order of keys."""
    numbered = number_rows(rows.select(F.col("_null").alias("_a"), F.bitwise_not("_id").alias("_b"), "_id", "_key", "_chars").distinct(),
                           [], ["_a", "_b", "_key"], "_n")
    total = numbered.count()
    ahead = numbered.select(F.when(F.col("_n") == total, F.lit(1)).otherwise(F.col("_n") + 1).cast("long").alias("_n"),
                            F.col("_id").alias("_for_id"), F.col("_key").alias("_for_key"), F.col("_chars").alias("_for_chars"))
    return numbered.select("_n", "_id", "_key").join(ahead, "_n").drop("_n")


def edited_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id, n_chars, sketch, edited (text), edited_sketch, next_id and next_sketch of every row.

    The edited text is the text with its last third of code points (rounded down) replaced by as many from the start of the
    next document, or all it has. Documents follow one another by descending id (a whole number), after the last the first;
    null ids come last; of one id, texts follow in a fixed order of their hashes, and equal rows count as one document, each getting its results.
    A single document follows itself. Null texts count as empty. Other columns are not read.

    Whole texts are shuffled once, by their key, together with their sketches; beginnings of texts travel to the
    document before theirs, which has the same partitioning.
    """
    clean = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(
        F.col(id_column).cast("long").alias("_given"), F.col(id_column).isNull().alias("_null"), F.coalesce(F.col(id_column).cast("long"), F.lit(0)).alias("_id"),
        F.xxhash64(F.col(id_column).isNull(), id_column, clean).alias("_key"), clean.alias("_text"))
    order = following(rows.select("_null", "_id", "_key", F.length("_text").alias("_chars")))
    sketched = with_sketch(rows, F.col("_text"), "_sketch").select("_given", "_id", "_key", "_text", "_sketch")
    # Copies of one row send the same beginning; one is enough.
    starts = (
        sketched.join(order, ["_id", "_key"])
        .select(F.col("_for_id").alias("_id"), F.col("_for_key").alias("_key"), F.struct(
            F.expr("substring(_text, 1, cast(floor(_for_chars / 3) as int))").alias("start"), F.col("_sketch").alias("sketch"), F.col("_given").alias("id")).alias("_next"))
        .groupBy("_id", "_key").agg(F.max("_next").alias("_next"))
    )
    chars = F.length("_text")
    joined = sketched.join(starts, ["_id", "_key"]).withColumn("_chars", chars).withColumn(
        "_edited", F.concat(F.expr("substring(_text, 1, cast(_chars - floor(_chars / 3) as int))"), F.col("_next.start")))
    return with_sketch(joined, F.col("_edited"), "_edited_sketch").select(
        F.col("_given").alias(id_column), F.col("_chars").cast("long").alias("n_chars"), F.col("_sketch").alias("sketch"), F.col("_edited").alias("edited"),
        F.col("_edited_sketch").alias("edited_sketch"), F.col("_next.id").alias("next_id"), F.col("_next.sketch").alias("next_sketch"))
