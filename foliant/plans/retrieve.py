"""Operators I7, I12, I15, J6: retrieval over a knowledge base, composed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import context, fusion, lexical, semantic, versions as V
from foliant.operators.embeddings import Embedder
from foliant.operators.routing import query_scope
from foliant.params import DEFAULT_LIMIT, MIN_SCORE, NEIGHBOUR_DISTANCE, SMALL_SECTION_MAX_CHARACTERS, check_limit
from foliant.session import cut_lineage, union_all

HIT_COLUMNS = [
    "document_id", "document_version_id", "section_id", "source_id", "external_document_id", "section_title", "content",
]
PROFILES = ("SIMPLE", "HYBRID", "ADVANCED")
STRATEGIES = ("CHUNK_ONLY", "SECTION_IF_SMALL", "NEIGHBOR_CHUNKS")


@dataclass(frozen=True)
class KnowledgeBase:
    """The tables a search reads. ``versions`` is None when the tables hold ACTIVE versions only. ``text_search`` finds the k best
    chunks of queries in another way than by ``postings``, over the same chunks."""

    sections: DataFrame
    chunks: DataFrame
    embeddings: DataFrame
    postings: DataFrame
    versions: DataFrame | None = None
    stats: DataFrame | None = None
    text_search: Callable[[DataFrame, int], DataFrame] | None = None

    def active(self) -> "KnowledgeBase":
        """Only rows of ACTIVE versions. Every table carries the version id, so each needs one semi-join."""
        if self.versions is None:
            return self
        ids = V.active_versions(self.versions).select("document_version_id")
        keep = lambda df: df.join(ids, "document_version_id", "left_semi")
        return replace(self, sections=keep(self.sections), chunks=keep(self.chunks), embeddings=keep(self.embeddings),
                       postings=keep(self.postings), versions=None, stats=None, text_search=None)

    def within_sources(self, sources: DataFrame) -> "KnowledgeBase":
        """Only rows of the given sources, for searches over all configured sources."""
        keep = lambda df: df.join(sources.select("source_id").distinct(), "source_id", "left_semi")
        return replace(self, chunks=keep(self.chunks), embeddings=keep(self.embeddings), postings=keep(self.postings), stats=None, text_search=None)


def attach(hits: DataFrame, chunks: DataFrame, *extra: str) -> DataFrame:
    """Put the document fields of the few surviving hits in; the join comes after every limit. A hit whose chunk is gone keeps its place
    with empty fields: `context_violations` finds it. The hits are written and so of known size, and only the chunks they name travel."""
    hits = cut_lineage(hits)
    named = chunks.select("chunk_id", *HIT_COLUMNS).join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return hits.join(named, "chunk_id", "left").select(
        "query_id", "rank", "chunk_id", *HIT_COLUMNS, "score", *extra)


def _semantic(queries: DataFrame, kb: KnowledgeBase, embedder: Embedder, k: int, min_score: float) -> DataFrame:
    embedded, _ = semantic.embed_queries(queries, embedder)
    return semantic.semantic_search(embedded, kb.embeddings.where(semantic.model_filter(embedder)), k, min_score)


def hybrid_ids(queries: DataFrame, kb: KnowledgeBase, embedder: Embedder, k: int, min_score: float = MIN_SCORE) -> DataFrame:
    """Semantic and lexical search with the same limit, fused; ids only."""
    vector = _semantic(queries, kb, embedder, k, min_score)
    text = kb.text_search(queries, k) if kb.text_search else lexical.lexical_search(queries, kb.postings, k, kb.stats, kb.chunks)
    return fusion.rrf_fuse([vector.select("query_id", "chunk_id", "rank"), text.select("query_id", "chunk_id", "rank")], k)


def _retrieve_one(
    queries: DataFrame, kb: KnowledgeBase, profile: str, embedder: Embedder, scorer: fusion.Scorer | None, k: int, min_score: float,
) -> DataFrame:
    if profile == "SIMPLE":
        return attach(_semantic(queries, kb, embedder, k, min_score), kb.chunks)
    if profile == "HYBRID":
        return attach(hybrid_ids(queries, kb, embedder, k, min_score), kb.chunks)
    if scorer is None:
        raise ValueError("profile ADVANCED needs a scorer")
    wide = fusion.candidate_count(k)
    candidates = attach(hybrid_ids(queries, kb, embedder, wide, min_score), kb.chunks).fillna("", ["content"])
    return fusion.rerank(queries, candidates, scorer, k).select("query_id", "rank", "chunk_id", *HIT_COLUMNS, "score")


def retrieve(
    queries: DataFrame, kb: KnowledgeBase, embedder: Embedder, profile: str | None = "SIMPLE",
    scorer: fusion.Scorer | None = None, k: int = DEFAULT_LIMIT, min_score: float = MIN_SCORE,
) -> DataFrame:
    """Hits of every query by profile. ``profile=None`` takes the profile from a column of the query table, null being SIMPLE;
    an unknown profile, or ADVANCED without a scorer, is an error.

    ``queries``: query_id, query, optionally source_ids (I9). SIMPLE searches vectors, HYBRID fuses vectors and text,
    ADVANCED reranks a wider hybrid result.
    """
    check_limit(k)
    active = kb.active()
    queries = queries.withColumn("query_id", F.col("query_id").cast("string"))
    if profile is not None:
        if profile not in PROFILES:
            raise ValueError(f"unknown profile {profile}")
        return _retrieve_one(queries, active, profile, embedder, scorer, k, min_score)
    wanted = [p for p in PROFILES if p != "ADVANCED" or scorer is not None]
    named = F.coalesce("profile", F.lit("SIMPLE"))
    chosen = queries.withColumn("profile", F.when(named.isin(wanted), named).otherwise(
        F.raise_error(F.concat(F.lit("profile unknown or without a scorer: "), named))))
    return union_all(*[
        _retrieve_one(chosen.where(F.col("profile") == p), active, p, embedder, scorer, k, min_score) for p in wanted])


def expand(
    hits: DataFrame, kb: KnowledgeBase, strategy: str, small: int = SMALL_SECTION_MAX_CHARACTERS, distance: int = NEIGHBOUR_DISTANCE,
) -> DataFrame:
    """J1-J4 by strategy; one row per context, best first."""
    if strategy == "CHUNK_ONLY":
        expanded = context.expand_chunk(hits)
    elif strategy == "SECTION_IF_SMALL":
        expanded = context.expand_section(hits, kb.sections, small)
    elif strategy == "NEIGHBOR_CHUNKS":
        expanded = context.expand_neighbours(hits, kb.chunks, distance)
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return context.dedupe_contexts(expanded)


def checked_context(
    queries: DataFrame, kb: KnowledgeBase, embedder: Embedder, profile: str | None = "SIMPLE", strategy: str = "CHUNK_ONLY",
    scorer: fusion.Scorer | None = None, k: int = DEFAULT_LIMIT, min_score: float = MIN_SCORE,
) -> tuple[DataFrame, DataFrame]:
    """(contexts, violations): retrieve, then expand every hit of every query by joins, then merge equal contexts.

    A query with a hit whose chunk or section is missing or belongs elsewhere has no contexts; its hits of that kind are the violations
    (query_id, chunk_id, violation).
    """
    active = kb.active()
    hits = cut_lineage(retrieve(queries, active, embedder, profile, scorer, k, min_score))
    broken = cut_lineage(context.context_violations(hits, active.sections, active.chunks))
    sound = hits.join(broken.select("query_id").distinct(), "query_id", "left_anti")
    # Texts of other sections than the hits' stay where they are.
    near = hits.select("section_id").distinct()
    within = replace(active, sections=active.sections.join(near, "section_id", "left_semi"), chunks=active.chunks.join(near, "section_id", "left_semi"))
    return expand(sound, within, strategy), broken


def retrieve_context(
    queries: DataFrame, kb: KnowledgeBase, embedder: Embedder, profile: str = "SIMPLE", strategy: str = "CHUNK_ONLY",
    scorer: fusion.Scorer | None = None, k: int = DEFAULT_LIMIT, min_score: float = MIN_SCORE,
) -> DataFrame:
    """The contexts of `checked_context`."""
    return checked_context(queries, kb, embedder, profile, strategy, scorer, k, min_score)[0]


def answer(
    queries: DataFrame, sources: DataFrame, kb: KnowledgeBase, embedder: Embedder, profile: str | None = "SIMPLE", strategy: str = "CHUNK_ONLY",
    scorer: fusion.Scorer | None = None, k: int = DEFAULT_LIMIT, min_score: float = MIN_SCORE, routing: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(contexts, violations) of queries as users ask them: query_id, query, optionally search_source_id.

    I9 and I8 limit each query to its explicit source, or else to the sources it is routed to, before J6 runs. Every query that is not
    searched for is among the violations (query_id, violation): blank query, blank source, unknown source; so is one that has no contexts
    because what it found breaks a rule (J5).
    """
    queries = queries.withColumn("query_id", F.col("query_id").cast("string"))
    blank = T.is_blank(F.coalesce("query", F.lit("")))
    scoped, refused = query_scope(queries.where(~blank), sources, routing)
    scoped = cut_lineage(scoped)
    found, broken = checked_context(scoped, kb, embedder, profile, strategy, scorer, k, min_score)
    violations = union_all(
        queries.where(blank).select("query_id", F.lit("blank query").alias("violation")), refused.select("query_id", "violation"),
        broken.select("query_id", "violation").distinct())
    return found, violations
