"""Retrieval: exact vector search, hybrid ranking, evidence filters, document scope and citations."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestone.functions import normalize as N
from lodestone.functions.text import among, found, lookup, strip
from lodestone.operators.facts import one_per
from lodestone.sources.cut import ensure_checkpoints

# Words that a question doesn't ask with, names that count by themselves, names of organisations, words of metrics, and what speaks for tables.
STOP_WORDS = ("a", "an", "the", "and", "or", "of", "in", "on", "for", "to", "was", "were", "is", "are", "did", "do", "does", "how", "much", "what", "which", "when", "year", "from", "with", "by")
NAMES = ("nlcil", "neyveli", "lignite", "sccl", "singareni", "bailadila", "ntpl")
ORGANISATIONS = {
    "nlcil": ("nlcil", "nlc india", "neyveli"),
    "sccl": ("sccl", "singareni"),
    "ntpl": ("ntpl",),
    "bailadila": ("bailadila",),
}
METRIC_WORDS = ("production", "produced", "produce", "coal", "lignite", "overburden", "output", "tonnage", "fy24", "fy25")
PRODUCTION_ASKS = ("production", "produced", "overburden", "lignite", "coal", "output", "tonnage")
TABLE_MARK, REPORT_MARK, TARGET_LINE = "reconstructed from source table", "production performance", r"(coal|lignite|overburden):\s*target\s+\d"
CUES_BY_METRIC = {
    "seam": "coal seam horizons seams identified",
    "seam_thickness": "seam thickness metres",
    "seam_depth": "seam depth occurrence metres",
    "formation_thickness": "formation thickness average metres",
    "seam_parting_thickness": "parting thickness metres",
    "borehole_depth": "borehole depth drilled metres",
    "overburden_thickness": "overburden thickness metres",
    "borehole": "boreholes drilled borehole id",
    "lithology": "lithology sandstone shale coal",
    "formation": "geological formation",
    "geological_structure": "fault geological structure",
    "coal_quality": "coal quality ash moisture",
}
OTHER_CUE = "geological exploration"
SEAM_NAME, BOREHOLE_NAME = r"\bseam\s+(?:i{1,3}v?|iv|v|vi{0,3}|ix|x|\d+|l\d+|[a-z]{1,4}\d*)\b", r"\b(?:bh|cmbj|skj|mprj)[-_]?\w+\b"
LEAST_SCORE, POOL = 0.28, 50


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 for a zero vector or different lengths (RET-1)."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


#: Queries whose scores a task holds at once.
QUERIES_AT_ONCE = 128


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of vectors (-1 for null ones and those with a null), their elements one after another, and where each begins."""
    flat = column.flatten()
    n = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    start, holes = np.cumsum(n) - n, np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False))
    length = np.where(column.is_null().to_numpy(zero_copy_only=False), -1, n)
    length[np.searchsorted(start + n, holes, side="right")] = -1
    return length, flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64), start


def _rounded(scores: np.ndarray) -> np.ndarray:
    """Nine digits, half up, as Spark rounds; each distinct score once."""
    kinds, at = np.unique(scores, return_inverse=True)
    digits = Decimal("1e-9")
    return np.array([float(Decimal(repr(x)).quantize(digits, ROUND_HALF_UP)) if math.isfinite(x) else x for x in kinds.tolist()])[at]


def _nearest(asked: pa.Array, rows: pa.Array, k: int, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its place, and the places and rounded cosines of the k nearest rows that reach ``least``; of equals the first ones. NaN is above all numbers, as in SQL."""
    (q_length, q_flat, q_start), (length, flat, start) = _vectors(asked), _vectors(rows)
    with np.errstate(all="ignore"):
        norm = lambda flat, start, n: np.sqrt(np.array([flat[s : s + m] @ flat[s : s + m] for s, m in zip(start, np.maximum(n, 0), strict=True)], np.float64))
        q_norm, r_norm = norm(q_flat, q_start, q_length), norm(flat, start, length)
        for n in np.unique(q_length):
            among, places = np.flatnonzero(length == n) if n >= 0 else np.zeros(0, np.int64), np.flatnonzero(q_length == n)
            matrix = flat[start[among][:, None] + np.arange(max(n, 0))]
            for some in np.array_split(places, -(-len(places) // QUERIES_AT_ONCE)):
                score = np.zeros((len(some), len(length)))
                if len(among):
                    norms = q_norm[some][:, None] * r_norm[among]
                    score[:, among] = np.where((norms > 0) | np.isnan(norms), q_flat[q_start[some][:, None] + np.arange(n)] @ matrix.T / norms, 0.0)
                order = np.where(np.isnan(score), np.inf, score)
                kth = np.partition(order, len(length) - k, axis=1)[:, len(length) - k] if len(length) > k else np.full(len(some), -np.inf)
                floor = np.maximum(kth, least) - 1e-8  # more than rounding moves a score
                for place, own, by, low in zip(some, score, order, floor, strict=True):
                    near = np.flatnonzero(by >= low)
                    exact = _rounded(own[near])
                    by = np.where(np.isnan(exact), np.inf, exact)
                    best = np.lexsort((near, -by))[:k]
                    best = best[by[best] >= least]
                    yield place, near[best], exact[best]


def exact_top_k(queries: DataFrame, rows: DataFrame, k: int = 10, least: float = 0.0, most_queries: int | None = None, block: int = 4096) -> DataFrame:
    """The k rows nearest to each query by cosine (RET-1, WIN-9, JN-16), for any number of queries: each block of about ``block`` queries meets each block of as many rows in a task, which multiplies
    matrices, and each query keeps k of a block. Callers may state ``most_queries``; over that the set is refused."""
    if most_queries is not None and queries.limit(most_queries + 1).count() > most_queries:
        raise ValueError(f"over {most_queries} queries: use sparse_top_k")
    n_rows, n_queries = (max(1, -(-df.count() // block)) for df in (rows, queries))
    id_type, asked_type = rows.schema["id"].dataType, queries.schema["id"].dataType

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int, asks: bool) -> DataFrame:
        ids = {"query_id": F.col("id") if asks else F.lit(None).cast(asked_type), "id": F.lit(None).cast(id_type) if asks else F.col("id")}
        at = {own: F.pmod(F.xxhash64("id", "vector"), F.lit(n)), other: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))}
        return df.select(F.lit(asks).alias("asks"), F.col("vector"), *(c.alias(name) for name, c in (ids | at).items()))

    if queries.schema["vector"].dataType != rows.schema["vector"].dataType:
        rows, queries = (df.withColumn("vector", F.col("vector").cast("array<double>")) for df in (rows, queries))
    both = dealt(rows, "r", n_rows, "q", n_queries, False).unionByName(dealt(queries, "q", n_queries, "r", n_rows, True))

    def nearest(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        asks = part["asks"]
        asked, given = part.filter(asks), part.filter(pc.invert(asks))
        given = given.take(pc.sort_indices(given["id"], null_placement="at_start"))  # of equal scores the first ids count
        found = list(_nearest(asked["vector"].combine_chunks(), given["vector"].combine_chunks(), k, least)) if asked.num_rows and given.num_rows else []
        places = np.concatenate([np.full(len(near), place) for place, near, _ in found]) if found else np.zeros(0, np.int64)
        near, score = (np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in (1, 2))
        return pa.table({"query_id": asked["query_id"].take(pa.array(places)), "id": given["id"].take(pa.array(near.astype(np.int64))), "score": pa.array(score.astype(np.float64))})

    schema = StructType([StructField("query_id", asked_type), StructField("id", id_type), StructField("score", DoubleType())])
    pairs = both.groupBy("q", "r").applyInArrow(nearest, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


#: Vectors of a block of the sparse index; blocks that a query visits first; tasks that the postings of one term are dealt over; digits of a score.
BLOCK, FIRST, DEAL, DIGITS = 256, 4, 16, 6


def blocked(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """Postings (block, id, idx, weight) of sparse vectors: vectors with the same heaviest term share blocks of about ``size``, so that a block's maxima are tight."""
    heavy = rows.groupBy("id").agg(F.max_by("idx", F.struct(F.abs("weight"), "idx")).alias("heavy"))
    many = heavy.groupBy("heavy").agg(F.count("*").alias("n"))
    block = F.xxhash64("heavy", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / size)))
    return rows.select("id", "idx", "weight").join(heavy.join(many, "heavy").select("id", block.alias("block")), "id")


def block_bounds(asked: DataFrame, postings: DataFrame) -> DataFrame:
    """query_id, block, bound: no vector of the block scores higher. A term adds its weight times the block's largest or smallest weight, or nothing, as a vector may lack it. A term's
    blocks are dealt over DEAL tasks."""
    deal = F.pmod(F.xxhash64("block"), F.lit(DEAL))
    most = postings.groupBy("block", "idx").agg(F.max("weight").alias("top"), F.min("weight").alias("low")).withColumn("deal", deal)
    dealt = asked.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEAL - 1).cast("long"))))
    term = F.greatest(F.lit(0.0), F.col("q") * F.col("top"), F.col("q") * F.col("low"))
    return dealt.join(most, ["idx", "deal"]).groupBy("query_id", "block").agg(F.sum(term).alias("bound"))


def sparse_top_k(queries: DataFrame, rows: DataFrame, k: int = 10, size: int = BLOCK, first: int = FIRST) -> DataFrame:
    """The k rows with the highest products, for sparse unit vectors in long form (id, idx, weight), among those that share a term with the query (RET-2).

    Block-max pruning: a query first visits the ``first`` blocks with the highest bounds; its k-th best score there is a threshold, and only blocks whose bound reaches it are visited then. A
    visit reads the postings of one block and term, at most ``size`` or so, whatever share of all vectors has the term. Results are those of the plain join. Null weights and
    repeated (id, idx) add up to what SQL's sum gives; no queries or rows give no rows."""
    ensure_checkpoints(rows.sparkSession)
    asked = queries.select(F.col("id").alias("query_id"), "idx", F.col("weight").alias("q"))
    postings = blocked(rows, size).checkpoint()
    bounds = block_bounds(asked, postings).checkpoint()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    scored = lambda visits: asked.join(visits, "query_id").join(postings, ["block", "idx"]).groupBy("query_id", "id").agg(F.round(F.sum(F.col("q") * F.col("weight")), DIGITS).alias("score"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))
    visited = bounds.withColumn("turn", order).where(F.col("turn") <= first).select("query_id", "block")
    found = ranked(scored(visited)).drop("rank").checkpoint()
    least = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    rest = bounds.join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") + 10.0**-DIGITS >= F.col("least"))).select("query_id", "block").join(visited, ["query_id", "block"], "left_anti")
    return ranked(found.unionByName(ranked(scored(rest)).drop("rank")))


def query_terms(text: Column) -> Column:
    """The words that a question asks with (RET-3): no stop words; spans of years in both spellings; produced and production count as each other."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9][a-z0-9.\-]{1,})")), lambda w: ~among(w, STOP_WORDS)))
    short = F.transform(F.filter(words, lambda w: w.rlike(r"^20\d{2}-20\d{2}$")), lambda w: F.concat(F.substring(w, 1, 5), F.substring(w, 8, 2)))
    long = F.transform(F.filter(words, lambda w: w.rlike(r"^20\d{2}-\d{2}$")), lambda w: F.concat(F.substring(w, 1, 5), F.lit("20"), F.substring(w, 6, 2)))
    both = F.when(F.arrays_overlap(words, F.array(F.lit("produced"), F.lit("production"))), F.array(F.lit("production"), F.lit("produced"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(words, short, long, both))


def organisations(text: Column) -> Column:
    """Keys of the organisations that a text in lower case speaks of."""
    return F.array_compact(F.array(*(F.when(F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(text, n)), F.lit(key)) for key, names in ORGANISATIONS.items())))


def keyword_boost(query: Column, text: Column, terms: Column | None = None) -> Column:
    """How much a text's words speak for it (RET-4), from -0.55 to 0.75: the share of the question's terms that it holds; whether it holds any name that is
    asked for, or none; tables and reports of production, where that is asked; another organisation than the one asked for. ``terms``: the question's, where they are known already."""
    terms, hay = query_terms(query) if terms is None else terms, F.lower(F.coalesce(text, F.lit("")))
    holds = lambda t: F.contains(hay, t)
    hits = F.size(F.filter(terms, holds))
    names = F.array(*map(F.lit, NAMES))
    named = F.filter(terms, lambda t: ~among(t, METRIC_WORDS) & ~t.startswith("fy") & (F.length(t) >= 3))
    asks_name, has_name = F.size(named) > 0, F.exists(named, holds)
    asks = F.arrays_overlap(terms, F.array(*map(F.lit, PRODUCTION_ASKS)))
    present = ~asks_name | has_name
    table, report = F.contains(hay, F.lit(TABLE_MARK)), F.contains(hay, F.lit(REPORT_MARK))
    bonus = lambda c, x: F.when(c, x).otherwise(0.0)
    score = 0.35 * hits / F.greatest(F.size(terms), F.lit(1)) + 0.12 * F.size(F.filter(names, lambda n: F.array_contains(terms, n) & holds(n)))
    score = score + F.when(asks_name, F.when(has_name, 0.28).otherwise(-0.45)).otherwise(0.0)
    about = (asks | F.array_contains(terms, "performance")) & present
    score = score + bonus(about & report, 0.18) + bonus(about & table, 0.20) + bonus(about & hay.rlike(TARGET_LINE), 0.12) + bonus(~about & asks & ~present & (table | report), -0.25)
    score = score + bonus(asks & (F.contains(hay, F.lit("authorised capital")) | F.contains(hay, F.lit("paid up equity"))), -0.15)
    score = score + bonus(asks & F.contains(hay, F.lit("joint venture")) & ~report & ~F.contains(hay, F.lit("reconstructed")), -0.10)
    theirs, ours = organisations(F.lower(query)), organisations(hay)
    score = score + bonus((F.size(theirs) > 0) & (F.size(ours) > 0) & ~F.arrays_overlap(theirs, ours), -0.22)
    clamped = F.greatest(F.lit(-0.55), F.least(F.lit(0.75), score))
    return F.when((F.size(terms) == 0) | (hay == ""), 0.0).when((hits == 0) & ~F.exists(names, holds), -0.05).otherwise(clamped)


def hybrid(hits: DataFrame, k: int = 10, least: float = LEAST_SCORE) -> DataFrame:
    """Vector hits reranked by words (RET-5): hits have query_id, query, id, content and score. Of each query the pool of the max(POOL, 10 k) best hits of
    no negative score is kept; its scores and boosts add up, within 0 and 1; the best k (50 at most) of ``least`` or more stay."""
    pool = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    near = hits.where(F.col("score") >= 0).withColumn("rank", F.row_number().over(pool)).where(F.col("rank") <= max(POOL, 10 * k)).drop("rank")
    scored = near.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") + keyword_boost(F.col("query"), F.col("content")))), 6))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.where(F.col("score") >= least).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max(1, min(k, 50)))


def augmented(query: Column, metric: Column) -> Column:
    """A geological question with the words that texts on its metric use (RET-9), unless it has them."""
    extra = F.coalesce(lookup(CUES_BY_METRIC, metric), F.lit(OTHER_CUE))
    return F.when(F.contains(F.lower(F.coalesce(query, F.lit(""))), extra), query).otherwise(F.concat_ws(" ", query, extra))


def geological_bonus(text: Column, metric: Column, seam: Column | None = None) -> Column:
    """How much a text speaks of a geological metric (RET-9): the sum of its cues. ``seam``: the seam asked for, null for any."""
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda *words: F.coalesce(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), F.lit(False))
    like, bonus = low.rlike, lambda c, x: F.when(c, x).otherwise(0.0)
    formation, thick, workable = like(r"\bformation\b"), like(r"\bthickness|thick\b"), like(r"\bworkable\s+thickness\b")
    of_seam = bonus(has("seam horizon"), 0.45) + bonus(like(r"\bseams?\b"), 0.2) + bonus(like(SEAM_NAME), 0.35) + bonus(like(r"\bviz\.?\b|\bnamely\b|\bincluding\b"), 0.1)
    asked = F.lower(F.regexp_replace(strip(seam), r"(?i)^seam\s+", "")) if seam is not None else F.lit(None).cast("string")
    quoted = F.regexp_replace(asked, r"([^\w\s])", r"\\$1")
    named = F.regexp_like(low, F.concat(F.lit(r"\bseam\s+"), quoted, F.lit(r"\b|\b"), quoted, F.lit(r"\s+seam\b")))
    wanted = F.when(F.coalesce(asked, F.lit("")) == "", 0.0).when(named, 0.4).when(F.regexp_like(low, F.concat(F.lit(r"\b"), quoted, F.lit(r"\b"))), 0.35).otherwise(-0.35)
    thickness = F.when(formation & ~like(r"\bseams?\b"), -0.5).when(like(r"\b(?:minimum\s+)?workable\s+thickness\b"), -0.6).otherwise(0.25) + wanted
    borehole = bonus(has("borehole"), 0.3) + bonus(like(BOREHOLE_NAME), 0.45) + bonus(like(r"\b(?:roof|floor|dirt\s+band)\b") & ~like(BOREHOLE_NAME), -0.35)
    score = (
        F.when(metric == "seam", of_seam)
        .when(metric == "seam_thickness", of_seam + F.when(has("thickness"), thickness).otherwise(0.0))
        .when(metric == "seam_depth", of_seam + bonus(has("depth"), 0.25))
        .when(metric == "borehole", borehole)
        .when(metric == "lithology", bonus(has("lithology"), 0.35) + bonus(has("sandstone", "shale", "coal", "claystone"), 0.15))
        .when(metric == "formation", bonus(has("formation"), 0.35))
        .when(metric == "formation_thickness", bonus(formation & thick, 0.45) + bonus(like(r"\baverage\s+thickness\b"), 0.2))
        .when(metric == "seam_parting_thickness", bonus(has("parting"), 0.4))
        .when(metric == "borehole_depth", bonus(has("borehole") & like(r"\bdepth|deep\b"), 0.4))
        .when(metric == "geological_structure", bonus(has("fault", "structure"), 0.3))
        .when(metric == "coal_quality", bonus(has("ash", "moisture", "volatile", "fixed carbon", "gcv"), 0.35))
        .otherwise(0.0)
    )
    return F.round(F.coalesce(score, F.lit(0.0)), 6)


#: A row of a reconstructed table.
TABLE_ROW = r"(?i)((?:[A-Z][^|]{0,80}?)\|\s*reporting_period=\w+\s*\|\s*measure=\w+\s*\|\s*FY25=[\d.]+\s*MT\s*\|\s*FY24=[\d.]+\s*MT\.)"


def focused(text: Column, entity: Column, months: Column, measures: Column) -> Column:
    """A reconstructed table's title and the rows of the entity, months and measures asked for (RET-8); the text itself where it is no such table or
    no row is left. ``months`` and ``measures``: arrays, empty for any."""
    tokens = F.filter(F.regexp_extract_all(F.lower(entity), F.lit("([a-z0-9]{2,})")), lambda t: ~among(t, ("the", "and", "of")))
    titled = F.contains(F.substring(text, 1, 160), F.lit(":"))
    title = F.when(titled, F.concat(strip(F.substring_index(text, ":", 1)), F.lit(": "))).otherwise("")
    body = F.when(titled, F.regexp_replace(text, r"(?s)^[^:]*:", "")).otherwise(text)

    def fits(row: Column) -> Column:
        low = F.lower(row)
        padded = F.concat(F.lit(" "), F.regexp_replace(low, "[^a-z0-9]+", " "), F.lit(" "))
        month = (F.size(months) == 0) | F.exists(months, lambda m: F.contains(low, F.lower(m)))
        kind = (F.size(measures) == 0) | F.exists(measures, lambda m: F.contains(F.replace(low, F.lit(" ")), F.concat(F.lit("measure="), m)))
        return F.forall(tokens, lambda t: F.contains(padded, F.concat(F.lit(" "), t, F.lit(" ")))) & month & kind

    kept = F.transform(F.filter(F.regexp_extract_all(body, F.lit(TABLE_ROW)), fits), strip)
    is_table = F.contains(F.lower(text), F.lit("reconstructed from source")) & (F.size(tokens) > 0) & (F.size(kept) > 0)
    return F.when(F.coalesce(is_table, F.lit(False)), F.concat(title, F.array_join(kept, " "))).otherwise(text)


def preferred_evidence(hits: DataFrame, specs: DataFrame, k: int = 5) -> DataFrame:
    """The evidence of each spec (RET-7). Hits: spec_id, id, document_id, page, content, content_type, score, compat, from texts and facts alike; specs: spec_id,
    entity, months, measures (arrays), prefers_numeric. Each hit counts once, where score and compat add up to most. Where a spec asks for a number
    and has structured facts, these alone stay; else reconstructed tables displace other texts of their page, are cut to the rows asked for and move up.
    The k best of each spec."""
    total = F.col("score") + F.col("compat")
    once = one_per(hits, ["spec_id", "id"], [F.desc(F.round(total, 6)), "content_type"]).join(specs, "spec_id")
    own, page = Window.partitionBy("spec_id"), Window.partitionBy("spec_id", "document_id", "page")
    structured = F.col("prefers_numeric") & (F.col("content_type") == "structured_fact")
    table = F.contains(F.lower("content"), F.lit("reconstructed from source"))
    rows = once.withColumns({"is_table": table, "structured": structured}).withColumns({"only": F.max("structured").over(own), "on_page": F.max("is_table").over(page)})
    rows = rows.where(F.col("structured") | (~F.col("only") & (F.col("is_table") | ~F.col("on_page"))))
    text = F.when(F.col("is_table") & ~F.col("only") & F.col("entity").isNotNull(), focused(F.col("content"), F.col("entity"), F.col("months"), F.col("measures"))).otherwise(F.col("content"))
    moved = rows.withColumn("text", text).withColumn("cut", F.col("text") != F.col("content"))
    up = lambda cut, whole: F.when(F.col("only") | ~F.col("is_table"), 0.0).when(F.col("cut"), cut).otherwise(whole)
    ranked = moved.withColumns({"score": F.round(F.col("score") + up(0.08, 0.05), 6), "compat": F.round(F.col("compat") + up(0.15, 0.10), 6)})
    best = Window.partitionBy("spec_id").orderBy(F.desc(F.round(total, 6)), "id")
    return ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("spec_id", "id", "document_id", "page", F.col("text").alias("content"), "content_type", "score", "compat", "rank")


def verified_and_others(verified: DataFrame, others: DataFrame, key: str = "fact_id") -> DataFrame:
    """Verified hits, then those of the others that aren't among them (SET-4), with ``verified`` to tell them apart."""
    rest = others.join(verified.select(key).distinct(), key, "left_anti")
    return verified.withColumn("verified", F.lit(True)).unionByName(rest.withColumn("verified", F.lit(False)), True)


def significant_words(name: Column) -> Column:
    """The words of a name that tell it from others (FN-9)."""
    return F.filter(F.split(N.entity(name), " "), lambda w: (w != "") & ~among(w, ("the", "of", "and", "ltd", "limited", "co", "company", "mine", "mines", "pvt", "corporation")))


def names_entity(text: Column, entity: Column) -> Column:
    """Whether a text holds every significant word of a name, as whole words (FN-9)."""
    words = significant_words(entity)
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), F.lit(" "))
    return F.coalesce((F.size(words) > 0) & F.forall(words, lambda w: F.contains(padded, F.concat(F.lit(" "), w, F.lit(" ")))), F.lit(False))


def names_period(text: Column, period: Column) -> Column:
    """Whether a text holds one of a period's spellings (FLT-11)."""
    low = F.lower(text)
    return F.coalesce(F.exists(N.period_forms(period), lambda p: F.contains(low, p)), F.lit(False))


def compatible(facts: DataFrame, specs: DataFrame) -> DataFrame:
    """Structured facts that answer each query spec (FLT-8, RET-6): specs have spec_id, entity, metric, period, month, measure, null for any.
    Entity and metric must agree where given; score 1.2 and a term for every criterion; reasons tell the rest. Specs are few and meet facts by metric."""
    s = specs.select("spec_id", N.entity(F.col("entity")).alias("s_entity"), N.field(F.col("metric")).alias("s_metric"), N.period(F.col("period")).alias("s_period"), F.lower("month").alias("s_month"), N.measure(F.col("measure")).alias("s_measure"))
    rows = facts.join(s, F.col("storage_metric") == F.col("s_metric"))
    test = lambda want, have: F.col(want).isNull() | F.coalesce(have, F.lit(False))
    entity, period = test("s_entity", N.entity(F.col("entity_name")) == F.col("s_entity")), test("s_period", F.col("period") == F.col("s_period"))
    month, measure = test("s_month", F.lower("reporting_month") == F.col("s_month")), test("s_measure", F.col("measure") == F.col("s_measure"))
    term = lambda want, ok, plus, minus=0.0: F.when(F.col(want).isNull(), 0.0).when(ok, plus).otherwise(minus)
    score = 1.2 + term("s_entity", entity, 0.35) + 0.25 + term("s_period", period, 0.2, -0.15) + term("s_month", month, 0.25) + term("s_measure", measure, 0.15)
    reasons = F.array_compact(F.array(F.when(~period, "period"), F.when(~month, "month"), F.when(~measure, "measure")))
    return rows.where(entity).select("spec_id", "fact_id", "document_id", "entity_name", "storage_metric", F.col("period"), "value", "unit", F.round(score, 6).alias("score"), reasons.alias("reasons"))


def best_evidence(hits: DataFrame, k: int = 5) -> DataFrame:
    """The k best facts of each spec (RET-6, SET-2), each fact once."""
    once = one_per(hits, ["spec_id", "fact_id"], [F.desc("score"), "document_id"])
    best = Window.partitionBy("spec_id").orderBy(F.desc("score"), "fact_id")
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def slots(specs: DataFrame) -> DataFrame:
    """Every combination that a spec's arrays of entities, metrics and periods require (JN-13)."""
    return specs.select("spec_id", F.explode("entities").alias("entity_name"), "metrics", "periods").select("spec_id", "entity_name", F.explode("metrics").alias("metric"), "periods").select("spec_id", "entity_name", "metric", F.explode("periods").alias("period"))


def fill_slots(specs: DataFrame, facts: DataFrame) -> DataFrame:
    """Required slots with the number of facts that fill each and their best value; missing ones have none (JN-13, RET-12)."""
    need = slots(specs).withColumns({"entity": N.entity(F.col("entity_name")), "field": N.field(F.col("metric")), "period": N.period(F.col("period"))})
    have = facts.groupBy("entity", "field", "period").agg(F.count("*").alias("n"), F.max_by("base_value", F.struct("confidence_score", "id")).alias("value"))
    return need.join(have, ["entity", "field", "period"], "left").select("spec_id", "entity", "field", "period", F.coalesce("n", F.lit(0)).alias("n"), "value")


def in_scope(hits: DataFrame, scope: DataFrame | None) -> DataFrame:
    """Hits of the documents in scope (FLT-14): None means all, an empty scope means nothing."""
    return hits if scope is None else hits.join(scope.select("document_id").distinct(), "document_id", "left_semi")


def resolve_documents(phrases: DataFrame, documents: DataFrame, least: float = 0.35, n: int = 3, longest: float = 0.15) -> DataFrame:
    """The documents that a phrase names (JN-14): recall of the phrase's words weighs 0.75, precision of the file's 0.25, and a file that holds the
    phrase's longest word gains ``longest``. Words meet in an index."""
    words = lambda c: F.array_distinct(F.filter(F.split(N.family_key(F.col(c)), " "), lambda w: w != ""))
    most = F.array_max(F.transform("w", F.length))
    p = phrases.select("phrase", words("phrase").alias("w")).withColumn("longest", F.get(F.filter("w", lambda w: F.length(w) == most), 0)).select("phrase", "longest", F.size("w").alias("p_n"), F.explode("w").alias("word"))
    d = documents.select("document_id", words("filename").alias("w")).select("document_id", F.size("w").alias("d_n"), F.explode("w").alias("word"))
    hits = p.join(d, "word").groupBy("phrase", "document_id", "p_n", "d_n").agg(F.count("*").alias("n"), F.max(F.when(F.col("word") == F.col("longest"), longest).otherwise(0.0)).alias("more"))
    scored = hits.select("phrase", "document_id", F.round(0.75 * F.col("n") / F.col("p_n") + 0.25 * F.col("n") / F.col("d_n") + F.col("more"), 6).alias("score")).where(F.col("score") >= least)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("phrase").orderBy(F.desc("score"), "document_id"))).where(F.col("rank") <= n)


def tagged(hits: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Hits with the tag CONFLICT, VERIFIED or EVIDENCE (JN-9, RET-11): conflicts of the hit's page, else of its document."""
    page = conflicts.where("page is not null").groupBy("document_id", "page").agg(F.array_sort(F.collect_set("fingerprint")).alias("on_page"))
    doc = conflicts.groupBy("document_id").agg(F.array_sort(F.collect_set("fingerprint")).alias("in_document"))
    found = hits.join(page, ["document_id", "page"], "left").join(doc, "document_id", "left").withColumn("conflicts", F.coalesce("on_page", "in_document", F.array().cast("array<string>"))).drop("on_page", "in_document")
    return found.withColumn("tag", F.when(F.size("conflicts") > 0, "CONFLICT").when(among(F.col("status"), N.VERIFIED), "VERIFIED").otherwise("EVIDENCE"))


def without_near_copies(hits: DataFrame) -> DataFrame:
    """One hit for each file family, page, first eighty characters and value (WIN-7)."""
    return one_per(hits, [N.family_key(F.col("filename")), "page", F.substring(F.regexp_replace(F.lower("content"), r"\s+", " "), 1, 80), "value"], [F.desc("score"), "id"])


def citations(structured: DataFrame, text: DataFrame, conflict: DataFrame) -> DataFrame:
    """Sources of an answer: structured facts, then text, then conflict evidence, each id and each (file, page, value) once (SET-3)."""
    both = structured.withColumn("source_rank", F.lit(0)).unionByName(text.withColumn("source_rank", F.lit(1)), True).unionByName(conflict.withColumn("source_rank", F.lit(2)), True)
    return one_per(one_per(both, ["id"], ["source_rank", "filename", "page"]), ["filename", "page", "value"], ["source_rank", "id"])


def route(structured: Column, text: Column) -> Column:
    """How a spec can be answered (RET-13)."""
    return F.when((structured > 0) & (text > 0), "hybrid").when(structured > 0, "structured").when(text > 0, "rag").otherwise("none")
