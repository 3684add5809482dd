"""SimHash near-duplicates with pivot distance tables.

Fingerprints link at ``RADIUS`` or fewer differing bits. Each of 20 keys is three of six blocks of bits: two fingerprints that
differ in three bits or fewer agree on at least one key whole, so every link is met under some key. Distances alone cannot find
partners without meeting all pairs: a random fingerprint's distance to a pivot is 32 give or take 4, so one coordinate with a
margin of 3 keeps 46 % of random pairs, and a grid over coordinates costs 1.75 copies to halve a cell. What a key brings
together is then judged by the table: the Hamming distances of every fingerprint to many reference fingerprints are computed
once, a pair whose distances to any reference differ by more than the radius is thrown away (the triangle inequality), and
survivors are verified. A task passes on the edges of a spanning forest of each key, never its pairs.
"""

from __future__ import annotations

from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.arrow import sized, texts_of
from foliant.llm.components import components
from foliant.llm.sketches import with_sketch
from foliant.session import cut_lineage, union_all

RADIUS = 3
#: Differing bits up to which pairs are looked at when the similarity of the texts decides, and the words of its shingles.
WIDE_RADIUS = 5
WIDTH = 5
#: Blocks of a key. With three more blocks than the radius, a link leaves at least so many alone.
AGREEING = 3
PIVOTS = 24
#: Fingerprints of one key that are compared in one piece; a larger key is cut into parts that are compared by twos.
PART = 1024
#: Shingles of the texts that are judged in one piece.
SET_HASHES = 1 << 20
#: Shingles of partners that are looked up together.
SLICE_HASHES = 1 << 17
#: Groups up to this size pass on their links, larger ones a forest.
SMALL = 16
BATCH_BYTES = 2 << 20


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed random ones."""
    return np.random.default_rng(64).integers(0, 1 << 64, n, np.uint64, endpoint=False)


def fingerprint(text: str, width: int, hash64) -> int:
    """A bit is 1 if it is set in over half the hashes of the text's word shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: only A-Z, and the six ASCII white space characters
    if not words:
        return 0
    if len(words) <= width:
        return hash64(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    hashes = np.fromiter((hash64(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[width - 1:].tolist())), np.uint64, n)
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint) of every row, the fingerprint as a signed 64-bit number. Null texts have no words: zero."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))

    def make(batches):
        import xxhash

        for batch in sized(batches, "text", BATCH_BYTES):
            values = np.array([fingerprint(t, width, xxhash.xxh64_intdigest) for t in texts_of(batch)], np.uint64)
            yield pa.record_batch([batch.column("id"), pa.array(values.view(np.int64))], ["id", "fingerprint"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(make, f"id {kind}, fingerprint long").withColumnRenamed("id", id_column)


def blocks_of(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of blocks of nearly equal size that cover a fingerprint."""
    edges = [64 * i // (radius + AGREEING) for i in range(radius + AGREEING + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _key(value: Column, number: int, blocks: tuple[tuple[int, int], ...]) -> Column:
    """The bits of some blocks side by side, under the number of their choice."""
    total = F.lit(number).cast("long")
    for shift, bits in blocks:
        total = F.shiftleft(total, bits).bitwiseOR(F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long")))
    return total


def keyed(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(key, fingerprint): every fingerprint under each of its keys, 20 of them for the radius of links."""
    choices = list(combinations(blocks_of(radius), AGREEING))
    keys = F.array(*[_key(F.col("fingerprint"), n, c) for n, c in enumerate(choices)])
    return distinct.select("fingerprint", F.explode(keys).alias("key"))


def distance_table(values: np.ndarray) -> np.ndarray:
    """One row per fingerprint: its Hamming distances to the references."""
    return np.bitwise_count(values[:, None] ^ pivots()).astype(np.int8)


def near(values: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) within the radius: those whose table rows differ by more in any coordinate go, the rest are verified."""
    for p in range(table.shape[1]):
        kept = np.abs(table[i, p] - table[j, p]) <= radius
        i, j = i[kept], j[kept]
    kept = np.bitwise_count(values[i] ^ values[j]) <= radius
    return i[kept], j[kept]


def linked_pairs(values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Places (i < j) of all pairs of a group within the radius. In the order of the first coordinate, partners are close by."""
    table = distance_table(values)
    order = np.argsort(table[:, 0], kind="stable")
    first = table[order, 0]
    until = np.searchsorted(first, first + radius, "right")  # partners of place k lie in k + 1 .. until[k] - 1
    found = []
    step = max(1, (1 << 21) // max(1, len(values)))
    for a in range(0, len(values), step):
        counts = until[a:a + step] - np.arange(a, min(a + step, len(values))) - 1
        i = np.repeat(np.arange(a, a + len(counts)), counts)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)
        found.append(near(values, table, order[i], order[j], radius))
    i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    return np.minimum(i, j), np.maximum(i, j)


def forest(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the links (places in ``values``) connect, each to the first of its tree."""
    parent = np.arange(len(values))
    while True:  # the smaller root is handed on along links until nothing changes
        low = np.minimum(parent[left], parent[right])
        before = parent.copy()
        np.minimum.at(parent, left, low)
        np.minimum.at(parent, right, low)
        parent = parent[parent]
        if (parent == before).all():
            break
    children = np.flatnonzero(parent != np.arange(len(values)))
    return [(int(values[c]), int(values[parent[c]])) for c in children]


def group_edges(values: np.ndarray, edges: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges inside groups of fingerprints that lie between consecutive ``edges``: all links of small groups, which are looked
    at together; of larger ones spanning forests."""
    sizes = np.diff(edges)
    group, unsigned = np.repeat(np.arange(len(sizes)), sizes), values.view(np.uint64)
    found = []
    small = np.flatnonzero(sizes[group] <= SMALL)
    if len(small):
        own, of_group = unsigned[small], group[small]
        table = distance_table(own)
        for gap in range(1, SMALL):
            i = np.flatnonzero(of_group[:-gap] == of_group[gap:])
            i, j = near(own, table, i, i + gap, radius)
            found += zip(values[small[i]].tolist(), values[small[j]].tolist())
    for k in np.flatnonzero(sizes > SMALL).tolist():
        one = values[edges[k]:edges[k + 1]]
        found += forest(one, *linked_pairs(one.view(np.uint64), radius))
    return found


def edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): edges between distinct fingerprints whose components are those of all links within the radius.

    A key of more than PART fingerprints is cut by their hash into parts, and each two parts meet in a group of their own: no
    task gets more than two parts, and no pair is left out.
    """
    rows = keyed(distinct, radius)  # cheap to compute twice, and not worth a copy
    # Only keys to be cut are looked up: they hold over PART rows each, so there are few of them.
    large = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > PART).select(
        "key", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    met = rows.join(large, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn(
        "part", F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int"))
    # The group (x, y), x <= y, gets the parts x and y; a fingerprint of part p goes into all groups that name p.
    groups = met.select("key", "fingerprint", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_other")).select(
        "key", "fingerprint", F.least("part", "_other").alias("x"), F.greatest("part", "_other").alias("y"))

    def join(batches):
        held = np.zeros((0, 4), np.int64)  # key, x, y and fingerprint of a group that the next batch may go on with
        for batch in chain(batches, [None]):
            if batch is not None:
                held = np.concatenate([held, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)])
            changes = np.flatnonzero((held[1:, :3] != held[:-1, :3]).any(axis=1)) + 1
            whole = len(held) if batch is None else int(changes[-1]) if len(changes) else 0
            done, held = held[:whole], held[whole:]
            yield edge_batch(group_edges(done[:, 3].copy(), np.concatenate([[0], changes[changes < whole], [whole]]), radius))

    return groups.repartition("key", "x", "y").select("key", "x", "y", "fingerprint").sortWithinPartitions("key", "x", "y", "fingerprint").mapInArrow(
        join, "a long, b long").distinct()


def judged_edges(
    values: np.ndarray, part: np.ndarray, sets: list[np.ndarray], across: bool, similarity: float, radius: int = WIDE_RADIUS,
) -> list[tuple[int, int]]:
    """Places of a spanning forest of all pairs within the radius whose sets share the similarity: of pairs between two parts if
    ``across``, of all pairs otherwise. A pair is judged unless its ends are already connected."""
    tree, edges = np.arange(len(values)), []
    flat = np.concatenate([np.zeros(0, np.int32), *sets])
    names, codes = np.unique(flat, return_inverse=True)
    codes = codes.astype(np.int32)
    sizes = np.array([len(x) for x in sets], np.int64)
    ends = np.cumsum(sizes)
    marked = np.zeros(len(names), bool)
    for i in range(len(values) - 1):
        near = np.bitwise_count(values[i + 1:] ^ values[i]) <= radius
        near &= tree[i + 1:] != tree[i]
        if across:
            near &= part[i + 1:] != part[i]
        j = np.flatnonzero(near) + i + 1
        # No more than the smaller set can be common.
        j = j[np.minimum(sizes[j], sizes[i]) >= similarity * np.maximum(sizes[j], sizes[i]) * (1 - 1e-9)]
        if not len(j):
            continue
        own = codes[ends[i] - sizes[i]:ends[i]]
        marked[own] = True
        common = np.zeros(len(j), np.int64)
        slices = (np.cumsum(sizes[j]) - sizes[j]) // SLICE_HASHES
        for part_of in np.split(np.arange(len(j)), np.flatnonzero(np.diff(slices)) + 1):
            some = j[part_of]
            before = np.cumsum(sizes[some]) - sizes[some]
            places = np.arange(int(sizes[some].sum())) + np.repeat(ends[some] - sizes[some] - before, sizes[some])
            held = np.concatenate([[0], np.cumsum(marked[codes[places]])])
            common[part_of] = held[before + sizes[some]] - held[before]
        marked[own] = False
        union = sizes[i] + sizes[j] - common
        for k in j[np.where(union == 0, 1.0, common / np.maximum(union, 1)) >= similarity].tolist():
            if tree[k] != tree[i]:
                tree[tree == tree[k]] = tree[i]
                edges.append((i, k))
    return edges


def judged(rows: DataFrame, clusters: DataFrame, docs: DataFrame, id_column: str, text_column: str, similarity: float) -> DataFrame:
    """(a, b): edges between nodes whose components are those of all pairs that lie within the wide radius and share so much of their
    distinct five-word shingles.

    rows: node, fingerprint and _first, the id of the node's text; no null id. clusters: (node, component) of the fingerprints that links
    within the wide radius connect, so each such pair lies in one cluster. Only the texts of clusters with several nodes are read.
    A cluster is cut by hash into parts of PART nodes and SET_HASHES shingles on average, and each two parts meet in a group.
    """
    of = rows.join(clusters.select(F.col("node").alias("_f"), "component"), F.col("fingerprint") == F.col("_f"), "left").select(
        "node", "fingerprint", "_first", F.coalesce("component", "fingerprint").alias("cluster"))
    several = of.groupBy("cluster").agg(F.count("*").alias("_n")).where("_n > 1").select("cluster")
    wanted = cut_lineage(of.join(several, "cluster"))
    texts = docs.select(F.col(id_column).alias("_first"), F.col(text_column).alias("_text")).join(
        wanted.select("_first").distinct().hint("merge"), "_first", "left_semi")  # grows with the table, so it is not broadcast however small it is
    sets = with_sketch(texts, F.col("_text"), "_set", 1 << 30, WIDTH).select("_first", "_set").dropDuplicates(["_first"])
    held = cut_lineage(wanted.join(sets, "_first").select("cluster", "node", "fingerprint", "_set"))
    sizes = held.groupBy("cluster").agg(F.count("*").alias("_n"), F.sum(F.size("_set")).alias("_hashes"))
    large = sizes.select("cluster", F.greatest(F.ceil(F.col("_n") / PART), F.ceil(F.col("_hashes") / SET_HASHES)).cast("int").alias("parts")).where("parts > 1")
    met = held.join(large, "cluster", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn(
        "part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    groups = met.select("cluster", "node", "fingerprint", "_set", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_other")).select(
        "cluster", F.least("part", "_other").alias("x"), F.greatest("part", "_other").alias("y"), "part", "fingerprint", "node", "_set")

    def judge(batches):
        held = None  # rows of a group that the next batch may go on with
        for batch in chain(batches, [None]):
            if batch is not None:
                more = pa.Table.from_batches([batch])
                held = more if held is None else pa.concat_tables([held, more])
            if held is None or not held.num_rows:
                continue
            names = np.stack([held.column(k).to_numpy().astype(np.int64) for k in range(3)], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1, [len(names)]]).tolist()
            whole = cuts if batch is None else cuts[:-1]
            left, right = [], []
            for first, last in zip(whole, whole[1:]):
                group = held.slice(first, last - first).combine_chunks()
                lists = group.column("_set").combine_chunks()
                flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
                shingles = [flat[s:e] for s, e in zip(offsets, offsets[1:])]
                prints, part = (group.column(c).to_numpy() for c in ("fingerprint", "part"))
                edges = judged_edges(prints.view(np.uint64), part, shingles, bool(names[first, 1] != names[first, 2]), similarity)
                nodes = group.column("node").combine_chunks()
                left.append(nodes.take(pa.array([e[0] for e in edges], pa.int64())))
                right.append(nodes.take(pa.array([e[1] for e in edges], pa.int64())))
            held = held.slice(whole[-1])
            if left:
                yield pa.record_batch([pa.concat_arrays(left), pa.concat_arrays(right)], ["a", "b"])

    kind = rows.schema["node"].dataType.simpleString()
    return groups.repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y", "fingerprint", "node").mapInArrow(
        judge, f"a {kind}, b {kind}").distinct()


def near_duplicates(
    docs: DataFrame, width: int = 3, id_column: str = "doc_id", text_column: str = "text", similarity: float | None = None,
    verified: bool = False,
) -> DataFrame:
    """Id, fingerprint (16 hexadecimal digits) and component_id of every row.

    With ``similarity``, texts within the wider radius link as well if they share that part of their five-word shingles; an id then has to
    belong to one text, and of rows with one fingerprint the first is judged. If ``verified``, texts of other fingerprints or the same link only
    so, whatever the distance within the wider radius, and equal texts; ids must not be null.

    component_id is the smallest id of all rows whose fingerprints are reachable over links; the row's own is among them.
    Repeated rows and equal texts share a fingerprint and so a component; null and empty texts have fingerprint zero and are
    linked like any other. A null id gets a component like any row but never names one, unless all ids of it are null.
    Other columns are not read.
    """
    if verified and similarity is None:
        raise ValueError("links are verified by a similarity")
    if verified:  # nodes are texts
        named = docs.select(F.struct(F.col(id_column).alias("id"), F.md5(F.coalesce(text_column, F.lit(""))).alias("node")).alias("_named"), F.col(text_column).alias("text"))
        made = fingerprints(named, width, "_named", "text").select(F.col("_named.id").alias(id_column), "_named.node", "fingerprint")
    else:
        made = fingerprints(docs, width, id_column, text_column).withColumn("node", F.col("fingerprint"))
    made = cut_lineage(made)
    distinct = cut_lineage(made.groupBy("node").agg(F.min(id_column).alias("_first"), F.min("fingerprint").alias("fingerprint")))
    prints = distinct.select("fingerprint")
    prints = prints.distinct() if verified else prints
    edges = None if verified else links(prints)
    if similarity is not None:
        clusters = components(links(prints, WIDE_RADIUS))
        near = judged(distinct.where("_first is not null"), clusters, docs, id_column, text_column, similarity)
        edges = near if edges is None else union_all(edges, near)
    found = components(edges).select(F.col("node").alias("_node"), "component")
    joined = distinct.join(found, F.col("node") == F.col("_node"), "left").select("node", "_first", F.coalesce("component", "node").alias("_c"))
    linked = cut_lineage(joined)
    names = linked.groupBy("_c").agg(F.min("_first").alias("component_id"))
    by_node = linked.join(names, "_c").select("node", "component_id")
    # One node may hold a third of all rows; an adaptive join splits its rows.
    return made.join(by_node, "node").select(
        id_column, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
