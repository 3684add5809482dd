"""Operators I4-I6: boolean text search with cover-density ranking for a table of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions.rows import unnest
from foliant.functions.skew import number_rows, salted_join, top_k
from foliant.operators.postings import term_stats
from foliant.session import cut_lineage, union_all

# One over the rank weight of title (A) and content (B) positions.
INVERSE_WEIGHTS = {"A": 1.0, "B": 2.5}
#: Proposed chunks that a look-up names to every task, by 8 bytes each.
NAMED_CHUNKS = 1 << 18
#: Next rarest words of an alternative that a proposed chunk has to hold before its other terms are looked up.
GUARDS = 3


def parse_query(query: Column) -> Column:
    """I4 inside the row: array of atoms (grp, atom, negated, terms) of a web-search style query.

    Words are AND-ed, ``or`` between two operands starts a new alternative (AND binds tighter), ``-`` negates, quotes
    make a phrase. A word that tokenises into several terms is a phrase, too.
    """
    tokens = F.regexp_extract_all(query, F.lit(r'-?"[^"]*"?|[^\s"]+'), 0)

    def flags(ts: Column) -> Column:
        """1 where a token is the operator ``or``: between two tokens, and not right after another ``or``."""
        lower = F.transform(ts, F.lower)
        return F.transform(lower, lambda t, i: ((t == "or") & (i > 0) & (i < F.size(lower) - 1) & (F.get(lower, i - 1) != "or")).cast("int"))

    def atoms(both: Column) -> Column:
        parsed = F.transform(both["ts"], lambda t, i: F.struct(
            F.size(F.filter(both["at"], lambda place: place <= i)).alias("grp"),
            t.startswith("-").alias("negated"),
            F.when(F.get(both["ors"], i) == 1, F.array().cast("array<string>")).otherwise(T.words(t)).alias("terms"),
        ))
        return F.array_distinct(F.filter(parsed, lambda a: F.size(a["terms"]) > 0))

    # One-element transforms bind a value that is used several times; array_distinct drops repeated words.
    bound = F.transform(F.array(tokens), lambda ts: F.struct(ts.alias("ts"), flags(ts).alias("ors")))
    # Operators are few, so each token counts those before it among their places, not among all tokens.
    placed = F.transform(bound, lambda b: F.struct(b["ts"].alias("ts"), b["ors"].alias("ors"), F.filter(
        F.transform(b["ors"], lambda o, i: F.when(o == 1, i)), lambda p: p.isNotNull()).alias("at")))
    numbered = F.flatten(F.transform(placed, atoms))
    return F.transform(numbered, lambda a, i: F.struct(
        a["grp"].alias("grp"), i.alias("atom"), a["negated"].alias("negated"), a["terms"].alias("terms")))


def lexical_terms(queries: DataFrame) -> DataFrame:
    """I4: one row per query term: (query_id, grp, atom, negated, n_terms, offset, term)."""
    atoms = unnest(queries, ["query_id"], parse_query(F.col("query")), "a")
    return unnest(
        atoms, ["query_id", "a.grp", "a.atom", "a.negated", F.size("a.terms").alias("n_terms")], F.col("a.terms"), "term", "offset")


def lexical_matches(queries: DataFrame, postings: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """I5 without the limit: every (query_id, chunk_id) that satisfies an alternative with a positive term, with its cover-density score.

    ``queries``: query_id, query, optionally source_ids. For each alternative of a query only the postings of its rarest
    positive term propose chunks, and those that lack one of its next rarest terms are out. The postings that a chunk then has of all
    query terms meet the queries that propose it in one row. The first join spreads frequent terms by salting, the later ones go by chunk id.
    Alternatives without a positive term match nothing here; `lexical_search` adds them.
    """
    return _matches(_asked(queries), postings, stats)


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select(
        F.col("query_id").cast("string").alias("query_id"), parse_query(T.strip(F.col("query"))).alias("atoms"),
        (F.col("source_ids") if "source_ids" in queries.columns else F.lit(None).cast("array<string>")).alias("source_ids"))


def query_terms(asked: DataFrame) -> DataFrame:
    """(query_id, grp, negated, single, term): every term of the asked queries, and whether it is an atom of its own."""
    return unnest(
        unnest(asked, ["query_id"], F.col("atoms"), "a"), ["query_id", "a.grp", "a.negated", (F.size("a.terms") == 1).alias("single")], F.col("a.terms"), "term")


def driving_terms(terms: DataFrame, counts: DataFrame) -> DataFrame:
    """(query_id, term): the rarest positive term of each alternative, by ``counts`` (term, n); unknown terms are the rarest."""
    return terms.where(~F.col("negated")).join(counts, "term", "left").groupBy("query_id", "grp").agg(
        F.min_by("term", F.struct(F.coalesce("n", F.lit(0)), F.col("term"))).alias("term")).select("query_id", "term").distinct()


def in_scope() -> Column:
    """The row's source is one that its query asks for."""
    return F.coalesce(F.size("source_ids") <= 0, F.lit(True)) | F.array_contains("source_ids", F.col("source_id"))


def probes(proposed: DataFrame, *keep: str) -> DataFrame:
    """One row per proposed (query_id, chunk_id) and query term, to be looked up among the postings."""
    return unnest(
        unnest(proposed, ["query_id", "chunk_id", *keep], F.col("atoms"), "a"),
        ["query_id", "chunk_id", *keep, "a.grp", "a.atom", "a.negated", F.size("a.terms").alias("n_terms")], F.col("a.terms"), "term", "offset")


def rarest_terms(terms: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """(query_id, grp, term, place): the rarest positive term of each alternative, as `driving_terms` orders them, at place 1, and the k
    rarest of those that are atoms of their own, which a chunk has to hold in any case."""
    rarity = [F.coalesce("n", F.lit(0)), F.col("term")]
    held = terms.where(~F.col("negated")).groupBy("query_id", "grp", "term").agg(F.max("single").alias("single")).join(counts, "term", "left")
    placed = held.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "grp").orderBy(*rarity))).withColumn(
        "_nth", F.row_number().over(Window.partitionBy("query_id", "grp", "single").orderBy(*rarity)))
    return placed.where((F.col("place") == 1) | (F.col("single") & (F.col("_nth") <= k))).select("query_id", "grp", "term", "place")


def _in_chunks(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Where ``chunks`` are few, their rows and hardly any others: chunks are named to every task by a hash of 8 bytes, so another one may pass.
    Where they are many, all rows."""
    few = cut_lineage(chunks.select(F.xxhash64("chunk_id").alias("_chunk")).distinct())
    if few.count() > NAMED_CHUNKS:
        return rows
    return rows.join(F.broadcast(few), F.xxhash64("chunk_id") == F.col("_chunk"), "left_semi")


def _matches(asked: DataFrame, postings: DataFrame, stats: DataFrame | None) -> DataFrame:
    terms = query_terms(asked)
    used = terms.select("term").distinct()
    relevant = postings.join(used, "term", "left_semi")
    # Written and so of known size: the postings of other terms than the rare ones stay where they are.
    counts = cut_lineage(term_stats(relevant) if stats is None else stats.join(used, "term", "left_semi"))
    rare = cut_lineage(rarest_terms(terms, counts, 1 + GUARDS))
    driving = rare.where("place = 1").select("query_id", "grp", "term")
    driven = driving.select("term").distinct()
    met = salted_join(
        relevant.join(driven, "term", "left_semi").select("term", "chunk_id", "source_id"), driving.join(asked.select("query_id", "source_ids"), "query_id"), "term",
        F.col("chunk_id"), counts.join(driven, "term", "left_semi")
    ).where(in_scope()).select("query_id", "grp", "chunk_id").dropDuplicates()
    # A chunk without the next rarest words is out before anything else is looked up.
    guards = rare.where("place > 1").groupBy("query_id", "grp").agg(F.collect_list("term").alias("_guards"))
    held = relevant.join(rare.where("place > 1").select("term").distinct(), "term", "left_semi").groupBy("chunk_id").agg(F.collect_set("term").alias("_held"))
    guarded = met.join(guards, ["query_id", "grp"], "left").join(held, "chunk_id", "left")
    proposed = cut_lineage(guarded.where(F.coalesce(F.forall("_guards", lambda g: F.array_contains("_held", g)), F.col("_guards").isNull())).select(
        "query_id", "chunk_id").dropDuplicates())
    # The postings of a chunk travel together, and each query that proposes it finds its terms among them inside the row.
    codes = F.transform("positions", lambda e: e["pos"] * 2 + (e["w"] == "A").cast("int"))
    has = _in_chunks(relevant.select("term", "chunk_id", "positions"), proposed).groupBy("chunk_id").agg(
        F.collect_list(F.struct("term", codes.alias("codes"))).alias("_has")).select(
        "chunk_id", "_has", F.col("_has.term").alias("_terms"), (F.size(F.array_distinct("_has.term")) < F.size("_has")).alias("_repeated"))
    both = proposed.join(asked.select("query_id", "atoms"), "query_id").join(has, "chunk_id")
    needed = F.filter("atoms", lambda a: ~a["negated"])["grp"].alias("_needed")
    # As rows, so that a filter on what is found does not find it twice.
    return _rank(unnest(both, ["query_id", "chunk_id", needed], F.array(_found()), "found"))


def _found() -> Column:
    """The atoms of a query of which a term is among the postings of a chunk."""
    def located(a: Column) -> Column:
        def places(term: Column, offset: Column) -> Column:
            one = F.get("_has", (F.array_position("_terms", term) - 1).cast("int"))
            every = F.when(F.col("_repeated"), F.filter("_has", lambda h: h["term"] == term)).otherwise(F.filter(F.array(one), lambda h: h.isNotNull()))
            return F.transform(every, lambda h: F.struct(offset.alias("offset"), h["codes"].alias("codes")))

        return F.flatten(F.transform(a["terms"], places))

    def judged(a: Column, parts: Column) -> Column:
        codes = F.flatten(parts["codes"])
        shifted = F.transform(parts, lambda p: F.transform(p["codes"], lambda c: F.shiftright(c, 1) - p["offset"]))
        return F.struct(
            a["grp"].alias("grp"), a["atom"].alias("atom"), a["negated"].alias("negated"), F.size(a["terms"]).alias("n_terms"),
            _starts(shifted, F.size(parts), F.size(a["terms"])).alias("starts"), codes.alias("codes"))

    # One-element transforms bind the parts of an atom.
    return F.flatten(F.transform("atoms", lambda a: F.transform(
        F.filter(F.array(located(a)), lambda parts: F.size(parts) > 0), lambda parts: judged(a, parts))))


def _starts(shifted: Column, found: Column, n_terms: Column) -> Column:
    """Where an atom begins, from the positions of its terms less their offsets."""
    together = F.aggregate(shifted, F.get(shifted, F.lit(0)), lambda a, b: F.array_intersect(a, b))
    return F.when(found < n_terms, F.array().cast("array<int>")).when(n_terms == 1, F.get(shifted, F.lit(0))).otherwise(together)


def score_located(found: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score) of the proposed pairs in which an alternative holds. ``found``: probes with the positions of their
    terms in the chunk."""
    # One shuffle by (query, chunk) serves both groupings below.
    located = found.repartition("query_id", "chunk_id")
    atoms = located.groupBy("query_id", "chunk_id", "grp", "atom", "negated", "n_terms").agg(
        F.collect_list(F.struct("offset", "positions")).alias("parts"))
    shifted = F.transform("parts", lambda p: F.transform(p["positions"], lambda e: e["pos"] - p["offset"]))
    starts = _starts(shifted, F.size("parts"), F.col("n_terms"))
    # A position and its weight class in one number, so that sets and sorting stay on plain integers.
    coded = F.transform(F.flatten("parts.positions"), lambda e: e["pos"] * 2 + (e["w"] == "A").cast("int"))
    placed = atoms.select("query_id", "chunk_id", F.struct(
        "grp", "atom", "negated", "n_terms", starts.alias("starts"), coded.alias("codes")).alias("a"))
    together = placed.groupBy("query_id", "chunk_id").agg(F.collect_list("a").alias("found"))
    needed = asked.select("query_id", F.filter("atoms", lambda a: ~a["negated"])["grp"].alias("_needed"))
    return _rank(together.join(needed, "query_id"))


def _rank(found: DataFrame) -> DataFrame:
    """Keep the (query, chunk) rows in which an alternative holds, and score them."""
    present = F.filter("found", lambda a: F.size(a["starts"]) > 0)
    positive = F.filter("_present", lambda a: ~a["negated"])

    def holds(grp: Column) -> Column:
        have = F.size(F.filter(F.col("_positive.grp"), lambda g: g == grp))
        wanted = F.size(F.filter("_needed", lambda g: g == grp))
        barred = F.exists("_present", lambda a: (a["grp"] == grp) & a["negated"])
        return (have == wanted) & ~barred

    matched = (
        found.withColumn("_present", present)
        .withColumn("_positive", positive)
        .withColumn("_live", F.filter(F.array_distinct(F.col("_positive.grp")), holds))
        .where(F.size("_live") > 0)
        .withColumn("_codes", F.sort_array(F.array_distinct(F.flatten("found.codes"))))
        .withColumn("_groups", F.transform("_live", lambda g: F.filter("_positive", lambda a: a["grp"] == g)))
    )
    density = cover_density(F.col("_codes"), F.col("_groups"))
    return matched.withColumn("_d", density).select("query_id", "chunk_id", (F.col("_d") / (F.col("_d") + 1)).alias("score"))


def cover_density(codes: Column, groups: Column) -> Column:
    """Sum over minimal covers of (harmonic mean weight) / (1 + noise words).

    A cover is a shortest span of positions in which an alternative is complete. Walking the atoms' occurrences by their
    end, the latest start of a complete span is, per alternative, the earliest of its atoms' latest starts; a span is a
    new minimal cover when that start has moved. ``codes`` are the sorted query-term positions times two, plus one for title
    positions, which all come before the content's. Published basis: Clarke, Cormack and Tudhope, "Relevance ranking for
    one to three term queries".
    """
    positions = F.transform(codes, lambda c: F.shiftright(c, 1))
    titles = F.size(F.filter(codes, lambda c: c.bitwiseAND(1) == 1))
    atoms = F.flatten(groups)
    sizes = F.transform(groups, lambda g: F.size(g))
    slots = F.transform(sizes, lambda n, i: F.struct(
        (F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, b: a + b) + 1).alias("at"), n.alias("n")))
    events = F.array_sort(F.flatten(F.transform(atoms, lambda a, i: F.transform(a["starts"], lambda s: F.struct(
        (s + a["n_terms"] - 1).alias("end"), i.alias("slot"), s.alias("start"))))))

    def walk(given: Column) -> Column:
        def step(acc: Column, e: Column) -> Column:
            latest = F.concat(F.slice(acc["latest"], F.lit(1), e["slot"]), F.array(F.greatest(e["start"], F.get(acc["latest"], e["slot"]))), F.slice(
                acc["latest"], e["slot"] + 2, F.greatest(F.size(acc["latest"]) - e["slot"] - 1, F.lit(0))))
            begin = F.array_max(F.transform(given["slots"], lambda g: F.array_min(F.slice(acc["latest"], g["at"], g["n"]))))
            # The span of the events so far is judged when the next one comes, so that events with one end count together.
            fresh = (begin > acc["last"]) & (e["end"] > acc["end"])
            return F.struct(
                latest.alias("latest"), F.when(fresh, begin).otherwise(acc["last"]).alias("last"), e["end"].alias("end"),
                F.when(fresh, plus(acc["total"], gain(begin, acc["end"]))).otherwise(acc["total"]).alias("total"))

        def plus(total: Column, value: Column) -> Column:
            # With what rounding takes from the sum, so that equal covers give one score in whatever order they stand, and ids break the tie.
            so_far = total["sum"]
            return F.get(F.transform(F.array(value), lambda v: F.struct((so_far + v).alias("sum"), (total["rest"] + F.when(
                so_far >= v, so_far - (so_far + v) + v).otherwise(v - (so_far + v) + so_far)).alias("rest"))), F.lit(0))

        def gain(begin: Column, end: Column) -> Column:
            first, last = F.array_position(given["positions"], begin), F.array_position(given["positions"], end)
            count = last - first + 1
            in_title = F.least(last, given["titles"]) - F.least(first - 1, given["titles"])
            weight = in_title * INVERSE_WEIGHTS["A"] + (count - in_title) * INVERSE_WEIGHTS["B"]
            return count / weight / (1 + F.greatest(end - begin - (count - 1), F.lit(0)))

        start = F.struct(
            F.transform(given["events"], lambda _: F.lit(0)).alias("latest"), F.lit(0).alias("last"), F.lit(0).alias("end"),
            F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("rest")).alias("total"))
        closing = F.array(F.struct(F.lit(2**31 - 2).alias("end"), F.lit(0).alias("slot"), F.lit(0).alias("start")))
        return F.aggregate(F.concat(given["events"], closing), start, step, lambda acc: acc["total"]["sum"] + acc["total"]["rest"])

    # A one-element transform binds the prepared arrays.
    prepared = F.array(F.struct(
        positions.alias("positions"), titles.alias("titles"), slots.alias("slots"), events.alias("events")))
    return F.get(F.transform(prepared, walk), F.lit(0))


# Stands for the chunks of every source together; no source id holds a NUL.
_EVERYWHERE = "\0"
_SPAN = 4096


def _open_matches(asked: DataFrame, matcher: Callable[[DataFrame], DataFrame], named: DataFrame, k: int) -> DataFrame | None:
    """Matches of alternatives that only negate: the k lowest chunk ids without the negated atoms, at score 0.

    Chunks are numbered by id within their source, and once more over all sources for queries without a restriction. If m
    chunks of a source are excluded for a query, its first k others lie among the source's first k + m, so only those
    numbers are joined. ``named``: chunk_id and source_id of all chunks, once or more often.
    """
    negative = unnest(asked, ["query_id", "source_ids", "atoms"], F.array_distinct("atoms.grp"), "grp").where(
        ~F.exists("atoms", lambda a: (a["grp"] == F.col("grp")) & ~a["negated"]))
    if negative.isEmpty():
        return None
    barred = F.transform(F.filter("atoms", lambda a: a["grp"] == F.col("grp")), lambda a, i: F.struct(
        i.alias("grp"), i.alias("atom"), F.lit(False).alias("negated"), a["terms"].alias("terms")))
    open_queries = negative.select(
        F.concat_ws("\n", "query_id", F.col("grp").cast("string")).alias("query_id"), F.col("query_id").alias("_asker"), "source_ids", barred.alias("atoms"))
    named = named.select("chunk_id", "source_id").distinct()
    numbered = number_rows(union_all(named, named.withColumn("source_id", F.lit(_EVERYWHERE))), ["source_id"], ["chunk_id"], "_n")
    excluded = cut_lineage(matcher(open_queries.select("query_id", "atoms", "source_ids")).select("query_id", "chunk_id"))
    sizes = numbered.groupBy("source_id").agg(F.max("_n").alias("_size"))
    scope = F.when(F.size("source_ids") > 0, F.array_distinct("source_ids")).otherwise(F.array(F.lit(_EVERYWHERE)))
    wanted = unnest(open_queries, ["query_id", "_asker"], scope, "source_id").join(sizes, "source_id")
    # Exclusions of a query over all its sources bound those in each.
    counts = excluded.groupBy("query_id").agg(F.count("*").alias("_m"))
    reach = F.least(F.col("_size"), F.coalesce("_m", F.lit(0)) + k)
    spans = unnest(wanted.join(counts, "query_id", "left"), ["query_id", "_asker", "source_id", reach.alias("_reach")],
                   F.sequence(F.lit(1).cast("long"), reach, F.lit(_SPAN).cast("long")), "_first")
    rows = unnest(spans, ["query_id", "_asker", "source_id"], F.sequence(F.col("_first"), F.least(F.col("_first") + (_SPAN - 1), F.col("_reach"))), "_n")
    free = rows.join(numbered, ["source_id", "_n"]).join(excluded, ["query_id", "chunk_id"], "left_anti")
    return top_k(free, "query_id", [F.asc("chunk_id")], k).select(F.col("_asker").alias("query_id"), "chunk_id", F.lit(0.0).alias("score"))


def lexical_search(queries: DataFrame, postings: DataFrame, k: int, stats: DataFrame | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """The k best matches per query by score, then chunk id, with their rank. ``chunks`` names the chunks that queries which only
    negate may find; without it chunks that hold no token are unknown."""
    return best_matches(queries, lambda asked: _matches(asked, postings, stats), postings if chunks is None else chunks, k)


def best_matches(queries: DataFrame, matcher: Callable[[DataFrame], DataFrame], named: DataFrame, k: int) -> DataFrame:
    """The k best of all matches. ``matcher`` gives (query_id, chunk_id, score) of asked queries, however it finds them."""
    # Written, as parsing a long query costs far more than reading its atoms, and they are read for terms, drivers, scopes and ranks.
    asked = cut_lineage(_asked(queries))
    matches = matcher(asked)
    negative = _open_matches(asked, matcher, named, k)
    if negative is not None:
        matches = union_all(matches, negative).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    hits = top_k(matches, "query_id", [F.desc("score"), F.asc("chunk_id")], k)
    if "k" in queries.columns:
        limits = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("k").alias("_k"))
        hits = hits.join(limits, "query_id").where(F.col("rank") <= F.col("_k")).drop("_k")
    return hits
