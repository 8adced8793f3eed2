"""Corpus jobs: chunks, hashed embeddings, domain classes, topics, and facts from sentences and tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import normalize as N
from lodestone.functions.text import found, squeeze
from lodestone.operators.facts import once, one_per

SIZE, OVERLAP, DIMENSIONS, MOST_CUES = 500, 80, 384, 8
PROFILE = "structured_fact"


def _packed(sentences: Column, size: int) -> Column:
    """Sentences packed greedily into parts of at most ``size`` characters; longer sentences are cut."""
    pieces = F.flatten(F.transform(sentences, lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(s) / size).cast("int") - 1)), lambda k: F.substring(s, k * size + 1, F.lit(size)))))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("buf"))

    def add(acc: Column, s: Column) -> Column:
        joined = F.when(acc["buf"] == "", s).otherwise(F.concat(acc["buf"], F.lit(" "), s))
        fits = F.length(joined) <= size
        return F.struct(F.when(fits | (acc["buf"] == ""), acc["parts"]).otherwise(F.array_append(acc["parts"], acc["buf"])).alias("parts"), F.when(fits, joined).otherwise(s).alias("buf"))

    return F.aggregate(pieces, start, add, lambda acc: F.when(acc["buf"] == "", acc["parts"]).otherwise(F.array_append(acc["parts"], acc["buf"])))


def chunks(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of each page's text (TXT-1): sections at numbered headings, sentences packed up to ``size``; each chunk but a section's first
    begins with the ``overlap`` last characters of the one before."""
    sections = F.filter(F.transform(F.split("text", r"(?m)(?=^\d{1,2}\.\s+[A-Z])"), squeeze), lambda s: F.length(s) > 0)
    parts = F.transform(sections, lambda s: _packed(F.split(s, r"(?<=[.!?])\s+"), size))
    with_tail = F.flatten(F.transform(parts, lambda p: F.transform(p, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.substring(F.get(p, i - 1), -overlap, overlap), F.lit(" "), x)))))
    out = pages.select("document_id", F.posexplode(with_tail).alias("chunk_index", "content"))
    return out.withColumn("chunk_id", N.stable_id(F.col("document_id"), F.col("chunk_index")))


def stem(token: Column) -> Column:
    return F.when(F.length(token) > 4, F.regexp_replace(token, "(?:ing|ed|es|s)$", "")).otherwise(token)


def embedding_terms(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """The grams of a text as an array of {idx, weight} (TXT-5): stems, pairs of them, and runs of three and four characters of
    each; md5 gives the bucket and the sign."""
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)")), stem)
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws("_", a, b))
    runs = lambda n: F.flatten(F.transform(F.filter(words, lambda w: F.length(w) >= n), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, F.lit(n)))))
    grams = F.concat(words, F.filter(F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda p: p.isNotNull()), runs(3), runs(4))

    def term(g: Column) -> Column:
        digest, rest = F.md5(g), F.lit(0).cast("bigint")
        for k in range(4):  # the 128 bits, 32 at a time, modulo twice the dimensions
            rest = (rest * (2**32 % (2 * dimensions)) + F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")) % (2 * dimensions)
        return F.struct((rest % dimensions).cast("int").alias("idx"), F.when(rest < dimensions, 1.0 + F.log1p(F.length(g))).otherwise(-1.0 - F.log1p(F.length(g))).alias("weight"))

    return F.transform(grams, term)


def embeddings(rows: DataFrame, id_: str = "chunk_id", text: str = "content") -> DataFrame:
    """Sparse unit vectors in long form (TXT-5): id, idx, weight."""
    terms = rows.select(id_, F.explode(embedding_terms(F.col(text))).alias("t")).groupBy(id_, "t.idx").agg(F.sum("t.weight").alias("weight")).where("round(weight, 9) <> 0")
    norm = terms.groupBy(id_).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return terms.join(norm, id_).select(id_, "idx", (F.col("weight") / F.col("norm")).alias("weight"))


def _squeezed(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")


def _cue_score(low: Column, words: dict[str, float]) -> Column:
    """Weights times counts of cues in a squeezed text. Only cues that the text holds at all are counted by pattern."""
    plain = lambda w: re.sub(r"([^\w\s])", r"\\\1", w)
    pattern = lambda w: plain(w) if " " in w else rf"(?<![a-z0-9]){plain(w)}(?![a-z0-9])"
    count = lambda w: F.when(F.contains(low, F.lit(w)), F.least(F.regexp_count(low, F.lit(pattern(w))), F.lit(MOST_CUES))).otherwise(0)
    return F.round(sum((count(w) * F.lit(x) for w, x in words.items()), F.lit(0.0)), 6)


def _by_class(texts: DataFrame, cues: dict[str, dict[str, float]], score: Callable[[Column, Column, dict[str, float]], Column], name: str | None = None) -> DataFrame:
    """document_id and a score for each class, of the squeezed text and the file's name. The lambda keeps scores out of generated code: that of fifty cues outgrows the methods that the JVM compiles (8,000 bytes)."""
    read = F.struct(_squeezed(F.col("text")).alias("low"), F.lower(F.coalesce(F.col(name), F.lit("")) if name is not None else F.lit("")).alias("name"))
    return texts.select("document_id", F.inline(F.transform(F.array(read), lambda t: F.struct(*(score(t["low"], t["name"], words).alias(n) for n, words in cues.items())))))


def cue_counts(texts: DataFrame, cues: dict[str, dict[str, float]]) -> DataFrame:
    """How strongly each document speaks of each class (TXT-6): weights times counts of its cues, each count at most eight. One pass over the text.
    Blanks and line breaks are squeezed first. Cues of one word count where no letter a-z or digit stands beside them, phrases anywhere."""
    return _by_class(texts, cues, lambda low, _, words: _cue_score(low, words))


def classify(texts: DataFrame, cues: dict[str, dict[str, float]], least: float = 2.5, total_least: float = 0.0, name: str | None = None) -> DataFrame:
    """The class with the highest cue score (TXT-6), ``other`` below ``least`` or where all scores add up to less than ``total_least``, with confidence by
    mass and separation. ``name``: a column with the file's name, in which each class's first six cues count 0.35 of their weight. One pass over the rows."""
    hint = lambda called, words: sum((F.when(F.contains(called, F.lit(w)), 0.35 * x).otherwise(0.0) for w, x in list(words.items())[:6]), F.lit(0.0))
    scores = _by_class(texts, cues, lambda low, called, words: _cue_score(low, words) if name is None else F.round(_cue_score(low, words) + hint(called, words), 6), name)
    ranked = F.sort_array(F.array(*(F.struct((-F.col(n)).alias("s"), F.lit(n).alias("name")) for n in cues)))
    top, second = -F.get(ranked, 0)["s"], F.coalesce(-F.get(ranked, 1)["s"], F.lit(0.0))
    total = sum((F.col(n) for n in cues), F.lit(0.0))
    confidence = F.round(F.least(F.lit(0.97), 0.45 + 0.35 * top / F.greatest(total, F.lit(1e-6)) + 0.25 * (top - second) / F.greatest(top, F.lit(1e-6))), 3)
    fine = (top >= least) & (total >= total_least)
    return scores.select("document_id", F.when(fine, F.get(ranked, 0)["name"]).otherwise("other").alias("domain"), top.alias("score"), F.when(fine, confidence).when(top > 0, 0.35).otherwise(0.2).alias("confidence"))


def topics(rows: DataFrame, cues: dict[str, list[str]], least: float = 0.4) -> DataFrame:
    """One row for each chunk and topic whose cues it holds (TXT-7): matched keywords and score."""
    low = F.lower("content")
    hits = F.array(*(F.struct(F.lit(t).alias("topic"), F.array_compact(F.array(*(F.when(low.contains(w), F.lit(w)) for w in words))).alias("keywords")) for t, words in cues.items()))
    out = rows.select("chunk_id", "document_id", F.explode(F.filter(hits, lambda h: F.size(h["keywords"]) > 0)).alias("h")).select("chunk_id", "document_id", "h.*")
    length = F.aggregate("keywords", F.lit(0), lambda a, w: a + F.length(w))
    return out.withColumn("score", F.round(F.least(F.lit(1.0), 0.35 + 0.15 * F.size("keywords") + 0.05 * length / 40), 6)).where(F.col("score") >= least)


def topic_counts(evidence: DataFrame) -> DataFrame:
    """Documents, chunks and mean score of each topic (AGG-19). The mean is taken in whole millionths and rounded half up, so that no order of rows changes it."""
    per = evidence.groupBy("topic").agg(F.count_distinct("document_id").alias("documents"), F.count("*").alias("chunks"), F.sum(F.round(F.col("score") * 1_000_000).cast("long")).alias("s"))
    return per.select("topic", "documents", "chunks", (F.expr("(2 * s + 1000 * chunks) div (2000 * chunks)") / 1000).alias("confidence"))


def fact_sentences(facts: DataFrame) -> DataFrame:
    """A sentence for each fact (TXT-2)."""
    return facts.select("id", "document_id", F.format_string("%s produced %s %s during %s (%s).", "entity_name", "value", F.coalesce("unit", F.lit("units")), "financial_year", "field_name").alias("content"))


def structured_chunks(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Table facts as chunks (TXT-3): chunk_id, document_id, document_name, document_version, chunk_index, page_number, source_type, source_location, content_type, content, token_count, meta (JSON).

    Facts: document_id, entity, metric, reporting_month, measurement_type, fiscal_year, value, unit, page, table_id, table_title, column_path. The content names each part, a null month as Unknown, the
    table by its title or else its id. Ids depend on the document, its version and the fact alone, so that equal facts of a table make one chunk. Chunks are numbered from 0 within a page, so that no task sorts a
    whole document."""
    doc = documents.select("document_id", F.col("filename").alias("document_name"), F.col("version").alias("document_version"))
    told = ["entity", "metric", "reporting_month", "measurement_type", "fiscal_year", "value", "unit", "page", "table_id", "table_title", "column_path"]
    said = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    named = facts.select("document_id", *told).join(doc, "document_id", "left").withColumns({"document_name": F.coalesce("document_name", "document_id"), "document_version": F.coalesce("document_version", F.lit(1))})
    # the one shuffle of chunks, before their texts are made: equal ids have one page of one document
    rows = once(named, _value=N.general(F.col("value")), _at=F.xxhash64(said(F.col("document_id")), said(F.col("page")))).repartition("_at")
    month, title = F.coalesce("reporting_month", F.lit("Unknown")), F.coalesce(F.nullif("table_title", F.lit("")), F.col("table_id"))
    parts = {"entity": F.col("entity"), "metric": F.col("metric"), "reporting_period": month, "measure": F.col("measurement_type"), "fiscal_year": F.col("fiscal_year"), "value": F.col("_value"), "unit": F.col("unit"), "table": title, "page": F.col("page"), "column": F.col("column_path")}
    content = F.concat_ws(" | ", F.lit("STRUCTURED_FACT"), *(F.concat(F.lit(f"{k}="), said(c)) for k, c in parts.items()))
    key = [F.col(c) for c in ("document_id", "document_version", "page", "table_id", "entity", "metric", "reporting_month", "measurement_type", "fiscal_year", "value")]
    meta = F.to_json(F.struct(*told, F.lit(True).alias("structured_fact")))
    place = F.concat_ws(" / ", F.concat(F.lit("page "), said(F.col("page"))), said(F.col("table_id")), said(F.col("column_path")))
    out = rows.select("_at", N.stable_id(*key).alias("chunk_id"), "document_id", "document_name", "document_version", F.col("page").alias("page_number"), F.lit("pdf_table").alias("source_type"), place.alias("source_location"), F.lit(PROFILE).alias("content_type"), content.alias("content"), meta.alias("meta"))
    unique = one_per(out, ["_at", "chunk_id"], ["content", "meta"]).withColumn("token_count", F.size(F.split(squeeze(F.col("content")), " ")))
    return unique.withColumn("chunk_index", F.row_number().over(Window.partitionBy("_at", "document_id", "page_number").orderBy("content", "chunk_id")) - 1).drop("_at")


def parse_sentences(rows: DataFrame) -> DataFrame:
    """Facts read back from such sentences (TXT-4, TXT-10): entity, value, unit, period and field."""
    pattern = r"^(.+?) produced (-?[\d.,]+) (\S+) during (\S+) \(([^)]+)\)"
    at = lambda k: found(F.col("content"), pattern, k)
    out = rows.select("id", "document_id", at(1).alias("entity_name"), N.plain_number(at(2)).alias("value"), at(3).alias("unit"), N.period(at(4)).alias("period"), N.field(at(5)).alias("field"))
    return out.where("value is not null")


def geological_facts(pages: DataFrame) -> DataFrame:
    """Depths, thicknesses and quantities of a page with the nearest seam or borehole that precedes each (TXT-12, TXT-13): all matches
    of one pass with their places, then the last anchor before each measure."""
    anchor = r"(?i)\bseam\s+([ivxlc]{1,6}[ab]?|[a-z]{1,3}\d+[a-z]?|\d{1,3})\b|\b((?:BH|NP|CMP)[-\s]?\d+)\b"
    measure = r"(?i)(depth|thickness|resources?|reserves?)[^.\d]{0,60}?(\d+(?:\.\d+)?)\s*(m|cm|mm|ft|mt|million tonnes|t)\b"
    marked = F.regexp_replace(F.regexp_replace("text", anchor, "\u0001A$0\u0001"), measure, "\u0001M$0\u0001")
    pieces = pages.select("document_id", "page_number", F.posexplode(F.split(marked, "\u0001")).alias("place", "piece")).where(F.col("piece").rlike("^[AM]"))
    kind = F.substring("piece", 1, 1)
    body = F.expr("substring(piece, 2)")
    w = Window.partitionBy("document_id", "page_number").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    is_seam = body.rlike("(?i)^seam")
    rows = pieces.withColumns({"seam_name": F.last(F.when((kind == "A") & is_seam, body), True).over(w), "borehole_id": F.last(F.when((kind == "A") & ~is_seam, body), True).over(w)}).where(kind == "M")
    name = F.lower(found(body, measure))
    metric = F.when(name == "depth", "borehole_depth").when(name == "thickness", "seam_thickness").when(name.startswith("resource"), "resource_quantity").otherwise("reserve_quantity")
    return rows.select("document_id", "page_number", metric.alias("metric_kind"), "seam_name", "borehole_id", found(body, measure, 2).cast("double").alias("value"), found(body, measure, 3).alias("unit"), "place")


def forward_filled(cells: DataFrame) -> DataFrame:
    """Header cells take the last filled cell to their left (WIN-13); cells: document_id, table_no, row_no, col_no, text."""
    w = Window.partitionBy("document_id", "table_no", "row_no").orderBy("col_no").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("filled", F.last(F.when(~F.col("text").isin("", "–", "-"), F.col("text")), True).over(w))


def table_facts(cells: DataFrame, header_rows: int = 2) -> DataFrame:
    """Facts of tables with a measure header and a year header (TXT-17, JN-11): one row for each numeric cell under a fiscal year."""
    head = forward_filled(cells.where(F.col("row_no") < header_rows))
    keys = ["document_id", "table_no", "col_no"]
    columns = head.groupBy(*keys).agg(F.max(F.when(F.col("row_no") == 0, F.col("filled"))).alias("top"), F.max(F.when(F.col("row_no") == 1, F.col("text"))).alias("sub"))
    low = F.lower("top")
    columns = columns.withColumns({"period": N.header_year(F.col("sub")), "measure": F.when(low.contains("target"), "target").when(low.rlike(r"up\s?to"), "upto").otherwise("during"), "month": N.reporting_month(F.col("top"))}).where("period is not null")
    body = cells.where(F.col("row_no") >= header_rows)
    labels = body.where("col_no = 1").select("document_id", "table_no", "row_no", F.col("text").alias("entity_name"))
    out = body.join(columns, keys).join(labels, ["document_id", "table_no", "row_no"]).withColumn("value", N.number(F.col("text"))).where("value is not null")
    return out.where(N.plausible_entity(F.col("entity_name"))).select("document_id", "table_no", "entity_name", "measure", "month", "period", "value")
