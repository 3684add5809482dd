"""Exact top-k by inner product with a pivot table.

For integer vectors q and x, 2 q.x = |q|^2 + |x|^2 - |q - x|^2, and by the triangle inequality |q - x| is at least the largest
difference of their distances to any pivot. So distances to the pivots, computed once for every vector, bound each score from
above; candidates are scored in the order of their bounds until the next bound is below the k-th best score found.

Candidates are dealt evenly into slots of a bounded size and every query meets each slot once; a task holds one slot and a block
of queries, and passes on k rows per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.skew import top_k

PIVOTS = 48
#: Candidates of a slot, candidates and queries whose bounds are computed together, and candidates scored before the next look at the bounds.
SLOT_ROWS = 65_536
BLOCK_ROWS = 8192
QUERY_ROWS = 64
ROUND = 256
#: Products of components below this add up exactly in doubles for up to 2^13 dimensions; beyond it Python's integers are used.
EXACT = 1 << 20
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def quantised(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * component) of every component in double precision; null for vectors that are null or hold null or non-finite
    components."""
    sound = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(sound, F.lit(False)), F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)))


class Slot:
    """Candidates of one slot and dimension with their distances to the pivots, blocks by blocks."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.pivots = ids[order], vectors[order], pivots
        self.norms = (self.vectors ** 2).sum(axis=1)
        self.table = distances(self.vectors, self.norms, pivots)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, known: np.ndarray) -> list[tuple[int, int, int]]:
        """(query_id, vec_id, score) of each query's k best here, those below ``known`` (a score that k candidates reach) left out."""
        best: list[list[tuple[float, int]]] = [[] for _ in query_ids]
        floor = known.copy()
        norms = (queries ** 2).sum(axis=1)
        table = distances(queries, norms, self.pivots)
        for first in range(0, len(self.ids), BLOCK_ROWS):
            rows = slice(first, first + BLOCK_ROWS)
            apart = np.zeros((len(queries), len(self.ids[rows])))
            for p in range(self.table.shape[1]):
                np.maximum(apart, np.abs(table[:, p, None] - self.table[None, rows, p]), out=apart)
            # Distances are rounded: a little less, and a little more in the bound, keep it a bound.
            apart = np.maximum(apart - 1e-6 * (1 + apart), 0)
            bounds = (norms[:, None] + self.norms[None, rows] - apart ** 2) / 2 + 1
            for i, query in enumerate(queries):
                left = np.flatnonzero(bounds[i] >= floor[i])
                left = left[np.argsort(-bounds[i, left], kind="stable")]
                for start in range(0, len(left), ROUND):
                    if bounds[i, left[start]] < floor[i]:
                        break
                    part = first + left[start:start + ROUND]
                    part = part[self.ids[part] != query_ids[i]]
                    scores = self.vectors[part] @ query
                    good = np.flatnonzero(scores >= floor[i])
                    best[i] = sorted(best[i] + [(-s, v) for s, v in zip(scores[good].tolist(), self.ids[part[good]].tolist())])[:k]
                    if len(best[i]) == k:
                        floor[i] = max(floor[i], -best[i][-1][0])
        return [(int(q), v, int(-s)) for q, found in zip(query_ids, best) for s, v in found]


def distances(vectors: np.ndarray, norms: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = norms[:, None] + (pivots ** 2).sum(axis=1)[None] - 2 * (vectors @ pivots.T)
    return np.sqrt(np.maximum(squares, 0))


def huge_search(ids: list[int], vectors: list[list[int]], query_ids: list[int], queries: list[list[int]], k: int) -> list[tuple[int, int, int]]:
    """The same for components too large for doubles: exact integers, every candidate. Scores stop at the ends of 64 bits."""
    found = []
    for qid, query in zip(query_ids, queries):
        scores = [(-sum(a * b for a, b in zip(query, x)), v) for v, x in zip(ids, vectors) if v != qid]
        found += [(qid, v, max(_LEAST, min(_MOST, -s))) for s, v in sorted(scores)[:k]]
    return found


def pivot_rows(rows: DataFrame, count: int = PIVOTS) -> list[tuple[int, list[int]]]:
    """The vectors with the smallest hashes as pivots; at most ``count``, so they fit the driver. Only hashes are shuffled: the vectors
    of the chosen ones are picked up by a second scan."""
    hashed = rows.select("id", "q", F.xxhash64("id", "q").alias("_h"))
    least = [row["_h"] for row in hashed.select("_h").distinct().orderBy("_h").limit(count).collect()]
    chosen = hashed.where(F.col("_h").isin(least)).dropDuplicates(["id", "q"]).orderBy("_h", "id").limit(count)
    return [(row["id"], row["q"]) for row in chosen.collect()]


def topk(vectors: DataFrame, is_query: Column, k: int, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products of quantised vectors, ties to the smaller id.

    Queries are the rows for which ``is_query`` holds; candidates are all rows but those with the query's own id, repeated rows
    each. Of rows that share a query's id the smallest vector asks. Rows with a null id, a null vector, or a component that is null or not
    finite take no part, nor do pairs of different length. Without queries or candidates there are no rows. Scores beyond 64 bits
    stop at their ends.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), quantised(F.col(vector_column), scale).alias("q"), is_query.alias("asks")).where(
        "id is not null and q is not null")
    pivots = pivot_rows(rows)
    total = rows.count()
    # Small tables are cut finer, to give every core a slot.
    slots = max(1, -(-total // SLOT_ROWS), min(vectors.sparkSession.sparkContext.defaultParallelism, -(-total // BLOCK_ROWS)))
    # The position of a row deals candidates out evenly, whatever their ids.
    dealt = rows.select(F.pmod(F.monotonically_increasing_id(), F.lit(slots)).cast("int").alias("slot"), F.lit(0).alias("kind"), "id", "q")
    asking = rows.where("asks").groupBy("id").agg(F.min("q").alias("q")).select(
        F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), F.lit(1).alias("kind"), "id", "q")

    def search(batches):
        held: dict[int, list] = {}
        ready: dict[int, Slot | None] = {}
        queries: list[tuple[int, list[int]]] = []
        slot = None

        def answer():
            found = []
            for size in {len(q) for _, q in queries}:
                if size not in held:
                    continue
                own = [(i, q) for i, q in queries if len(q) == size]
                marks = [(i, p) for i, p in pivots if len(p) == size]
                ids, rows = held[size]
                largest = max(abs(x) for q in (*rows, *(q for _, q in own), *(p for _, p in marks)) for x in (max(q, default=0), min(q, default=0)))
                if largest >= EXACT or not size or not marks:
                    found += huge_search(ids, rows, [i for i, _ in own], [q for _, q in own], k)
                    continue
                if size not in ready:
                    ready[size] = Slot(np.array(ids), np.array(rows, np.float64), np.array([p for _, p in marks], np.float64))
                asked, of_pivots = np.array([q for _, q in own], np.float64), np.array([p for _, p in marks], np.float64)
                # Pivots are candidates too: the k-th best of their scores is reached by k candidates.
                scores = np.where(np.array([i for i, _ in own])[:, None] == np.array([i for i, _ in marks])[None], -np.inf, asked @ of_pivots.T)
                known = np.sort(scores, axis=1)[:, -k] if len(marks) >= k else np.full(len(own), -np.inf)
                found += ready[size].search(np.array([i for i, _ in own]), asked, k, known)
            queries.clear()
            return pa.record_batch([pa.array([f[c] for f in found], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

        for batch in batches:
            for s, kind, i, q in zip(*[batch.column(c).to_pylist() for c in ("slot", "kind", "id", "q")]):
                if s != slot:
                    if queries:
                        yield answer()
                    held, ready, slot = {}, {}, s
                if kind == 0:
                    ids, found = held.setdefault(len(q), ([], []))
                    ids.append(i)
                    found.append(q)
                else:
                    queries.append((i, q))
                    if len(queries) == QUERY_ROWS:
                        yield answer()
        if queries:
            yield answer()

    met = dealt.unionByName(asking).repartitionById(slots, "slot").sortWithinPartitions("slot", "kind", "id")
    found = met.mapInArrow(search, "query_id long, vec_id long, score long")
    return top_k(found, "query_id", [F.desc("score"), F.asc("vec_id")], k).select("query_id", "rank", "vec_id", "score")
