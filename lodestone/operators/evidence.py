"""Evidence for query specs: text compatibility, geological retrieval, preferred facts, comparison verdicts and reports' parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import geo as G
from lodestone.functions import normalize as N
from lodestone.functions.text import among
from lodestone.operators.facts import one_per
from lodestone.operators.geology import verified_else_provisional, with_bucket
from lodestone.operators.retrieve import names_entity, names_period

CUES = ("production", "produced", "output", "tonnage", "dispatch")


def factual_role(text: Column, entity: Column) -> Column:
    """Whether a name stands near a number and a word of production, and not only as an owner (FLT-12)."""
    low = F.lower(text)
    pieces = F.split(low, F.regexp_replace(N.entity(entity), r"([^\w\s])", r"\\$1"))
    around = F.zip_with(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))), lambda a, b: F.struct(F.substring(F.coalesce(a, F.lit("")), -100, 100).alias("a"), F.substring(F.coalesce(b, F.lit("")), 1, 180).alias("b")))
    cue = "|".join(CUES)

    def telling(x: Column) -> Column:
        window = F.concat(x["a"], F.lit(" "), x["b"])
        number, word = window.rlike(r"\d+\.\d+"), window.rlike(cue)
        owner = x["a"].rlike(r"(?:govt\.?|government|joint\s+venture|equity|ministry)\s+(?:of\s+)?$")
        return number & (word | window.rlike(r"\bfy\s*2.*\bmt\b")) & (~owner | window.contains("production"))

    return F.coalesce(F.exists(F.filter(around, lambda x: x["b"].isNotNull()), telling), F.lit(False))


def text_compatible(texts: DataFrame, specs: DataFrame) -> DataFrame:
    """Texts that may support each spec (FLT-9), with score and reasons. Specs (spec_id, entity, metric, period, month; null for any) may be
    any number: Spark broadcasts them where they are small, else blocks of texts meet blocks of specs. Texts have document_id, content. Entity and metric are required where given; lignite is not coal, coking coal is not thermal."""
    s = specs.select("spec_id", "entity", N.field(F.col("metric")).alias("metric"), "period", F.lower("month").alias("month"))
    low = F.lower("content")
    rows = texts.crossJoin(s)
    absent = lambda c: F.col(c).isNull()
    entity = absent("entity") | names_entity(F.col("content"), F.col("entity"))
    metric = absent("metric") | F.contains(low, F.replace(F.col("metric"), F.lit("_"), F.lit(" ")))
    period, month = names_period(F.col("content"), F.col("period")), F.coalesce(F.contains(low, F.col("month")), F.lit(False))
    mixed = (F.col("metric") == "coal") & low.rlike(r"\bcoking\s+coal\b")
    score = 1.0 + F.when(absent("entity"), 0.0).otherwise(0.35) + F.when(absent("metric"), 0.0).otherwise(0.25) + F.when(absent("period"), 0.0).when(period, 0.2).otherwise(-0.15) + F.when(absent("month"), 0.0).when(month, 0.25).otherwise(0.0)
    reasons = F.array_compact(F.array(F.when(~absent("entity"), "entity_match"), F.when(~absent("metric"), "metric_match"), F.when(~absent("period"), F.when(period, "period_match").otherwise("period_absent")), F.when(~absent("month") & month, "reporting_month_match")))
    return rows.where(entity & metric & ~F.coalesce(mixed, F.lit(False))).select("spec_id", "document_id", F.round(score, 6).alias("score"), reasons.alias("reasons"))


def has_fields(kind: Column) -> Column:
    """Whether a typed row has the columns that evidence of a metric needs (FLT-13)."""
    filled = lambda c: F.col(c).isNotNull()
    return F.when(kind.isin("seam", "seam_thickness", "seam_depth"), filled("seam") & ((kind == "seam") | filled("metres"))).when(kind == "formation_thickness", filled("metres") & filled("formation") & ~filled("seam")).when(kind.isin("borehole", "borehole_depth"), filled("borehole_key") & ((kind == "borehole") | filled("metres"))).when(kind == "formation", filled("formation")).when(kind.endswith("thickness"), filled("metres")).otherwise(F.lit(True))


def evidence_keys(kind: Column) -> list[Column]:
    """What tells rows of evidence apart (WIN-17): a measured row is its document, kind, seam, borehole, value, page and status; a listing of seams
    names each once (unnamed ones by formation), one of boreholes or formations likewise."""
    uncorrelated = F.coalesce(F.lower("seam_status").isin("uncorrelated", "unnamed"), F.lit(False))
    raw_formation = F.regexp_replace(F.lower(F.coalesce("geological_formation", F.lit(""))), "[^a-z0-9]+", "")
    item = F.when(kind == "seam", F.concat_ws("|", "seam", F.when(uncorrelated, raw_formation))).when(kind == "borehole", F.col("borehole_key")).when(kind == "formation", F.lower("formation"))
    measured = ~F.coalesce(kind, F.lit("")).isin("seam", "borehole", "formation")
    return [F.col("document_id"), item, *(F.when(measured, F.col(c)) for c in ("kind", "seam", "borehole_key", "value_num", "source_page", "status"))]


def geological_evidence(rows: DataFrame, wanted: str, seam: str | None = None, borehole: str | None = None, k: int | None = None) -> DataFrame:
    """Typed rows that answer a geological question (RET-10, WIN-17): compatible kind, needed columns, exact seam and borehole; verified first, then
    by confidence, where rows have one, and page; one for each of evidence_keys()."""
    kind = G.metric_kind(F.lit(wanted))
    out = rows.where("bucket <> 'rejected'").where(G.metrics_compatible(kind, F.col("kind")) & has_fields(kind))
    out = out.where(F.col("seam") == G.seam(F.lit(seam))) if seam else out
    out = out.where(F.col("borehole_key") == G.borehole_key(F.lit(borehole))) if borehole else out
    confidence = [F.desc(F.coalesce("confidence", F.lit(0.0)))] if "confidence" in rows.columns else []
    order = [F.when(F.col("bucket") == "verified", 0).otherwise(1), *confidence, "source_page", "id"]
    once = one_per(out, evidence_keys(kind), order)
    return once.orderBy(*order).limit(k) if k else once


def preferred(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Of agreeing facts that with a numbered table title, then of the smallest page (WIN-10)."""
    titled = F.coalesce(F.col("table_title").rlike(r"(?i)\btable\s+\d"), F.lit(False))
    return one_per(facts, keys, [F.when(titled, 0).otherwise(1), F.asc_nulls_last("page"), "fact_id"])


def best_thickness(rows: DataFrame) -> DataFrame:
    """The best thickness of each seam (WIN-11): ranges before points, verified first, zeros never, then by confidence."""
    real = rows.where("kind = 'seam_thickness' and seam is not null and (coalesce(metres, 0) <> 0 or value_max is not null)")
    return one_per(real, ["seam"], [F.when(F.col("value_max").isNotNull(), 0).otherwise(1), F.when(F.col("bucket") == "verified", 0).otherwise(1), F.desc("confidence"), "id"])


def deduplicated(hits: DataFrame) -> DataFrame:
    """Structured hits once for each (document, metric, period, value, unit, page) (WIN-8)."""
    return one_per(hits, ["document_id", "storage_metric", "period", "value", "unit", "page"], ["fact_id"])


def chosen_entity(names: DataFrame) -> DataFrame:
    """The entity to show first (WIN-18): short and in capitals, else short, else the first by name."""
    n = F.col("entity_name")
    rank = F.when(n.rlike(r"^[A-Z]{2,8}$"), 0).when(n.rlike(r"^[A-Za-z0-9]{2,12}$"), 1).otherwise(2)
    return names.select("entity_name").distinct().orderBy(rank, "entity_name").limit(1)


def compared(slots: DataFrame) -> DataFrame:
    """The verdict on each comparison (ANA-11): slots have spec_id, label, value, unit, conflict. conflict, insufficient, unit_mismatch or ok, with the
    change from the lowest to the highest value."""
    order = F.struct("value", "label")
    out = slots.groupBy("spec_id").agg(
        F.bool_or(F.coalesce("conflict", F.lit(False))).alias("conflict"), F.bool_or(F.col("value").isNull()).alias("missing"), F.count_distinct(F.lower(F.coalesce("unit", F.lit("")))).alias("units"),
        F.max_by("label", order).alias("higher"), F.min_by("label", order).alias("lower"), F.max("value").alias("high"), F.min("value").alias("low"))
    status = F.when(F.col("conflict"), "conflict").when(F.col("missing"), "insufficient").when(F.col("units") > 1, "unit_mismatch").otherwise("ok")
    fine = F.col("status") == "ok"
    return out.withColumn("status", status).select("spec_id", "status", F.when(fine, F.col("higher")).alias("higher"), F.when(fine, F.col("lower")).alias("lower"), F.when(fine, F.round(F.col("high") - F.col("low"), 6)).alias("change"), F.when(fine, F.round(N.percentage_change(F.col("high"), F.col("low"))["value"], 2)).alias("percent"))


def page_of(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A slice of a browsed table with the total number of rows in each row (FLT-4, FLT-5, FLT-6)."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))  # one row


def browse_chunks(chunks: DataFrame, text: str | None = None, content_type: str | None = None) -> DataFrame:
    """Chunks by text and type; structured facts only where asked for (FLT-6)."""
    out = chunks.where(F.col("content_type") == content_type) if content_type else chunks.where("content_type <> 'structured_fact'")
    return out.where(F.contains(F.lower("content"), F.lower(F.lit(text)))) if text else out


def job_stats(facts: DataFrame) -> DataFrame:
    """Each document's extraction results (AGG-21)."""
    return facts.groupBy("document_id").agg(F.count("*").alias("facts"), F.count_if(F.col("status") == "high_confidence").alias("high"), F.count_if(F.col("status") == "review_required").alias("review"), F.round(F.avg("confidence_score"), 3).alias("confidence"))


def fact_detail(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Facts with provenance and a note on their verification (JN-18)."""
    note = F.when(among(F.col("status"), N.VERIFIED), "Verified.").when(F.col("status") == "rejected", "Rejected by a reviewer.").otherwise("Pending human review.")
    return facts.join(documents.select("document_id", "filename", "version"), "document_id", "left").withColumn("note", note)


def report_parts(trend: DataFrame, pairs: DataFrame, bars: DataFrame, facts: DataFrame, conflicts: DataFrame, geological: DataFrame) -> dict[str, DataFrame]:
    """The datasets of a report (AGG-26, SET-6): what is measured, compared, contradicted, found and cited. Rejected rows never appear; provisional ones
    only where nothing is verified."""
    shown = verified_else_provisional(geological)
    sources = facts.select("document_id").union(with_bucket(geological).select("document_id")).distinct()
    review = with_bucket(geological, "all").groupBy("bucket").agg(F.count("*").alias("n"))
    summary = facts.agg(F.count("*").alias("facts"), F.count_distinct("document_id").alias("documents"))
    return {"Summary": summary, "Facts_Metrics": trend, "Actual_Target": pairs, "Comparison": bars, "Validation_Conflicts": conflicts, "Geological_Facts": shown, "Resources": shown.where(among(F.col("kind"), ("resource_quantity", "reserve_quantity"))), "Evidence_Sources": sources, "Audit_Review_Status": review}


def embedded(chunks: DataFrame, provider: Callable[[list[str]], list[list[float]]], dimensions: int) -> DataFrame:
    """Chunks with the vectors of a given provider (UDF-1), batch by batch in tasks; a vector of another length is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = provider([t or "" for t in b.column("content").to_pylist()])
            if len(vectors) != b.num_rows or any(len(v) != dimensions for v in vectors):
                raise ValueError(f"the provider must give a vector of {dimensions} numbers for each text")
            yield pa.RecordBatch.from_arrays([b.column("chunk_id"), pa.array(vectors, pa.list_(pa.float32()))], ["chunk_id", "embedding"])

    return chunks.select("chunk_id", "content").mapInArrow(run, "chunk_id string, embedding array<float>")


def extracted(pages: DataFrame, extractor: Callable[[list[dict]], list[dict]], schema: str, batch: int = 5) -> DataFrame:
    """Drafts of a given extractor (UDF-2), which gets pages in batches and returns rows of the schema."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = frame.to_dict("records")
            drafts = [d for k in range(0, len(rows), batch) for d in extractor(rows[k : k + batch])]
            if drafts:
                yield pd.DataFrame(drafts)

    return pages.mapInPandas(run, schema)


def nearest_anchor(measures: DataFrame, anchors: DataFrame, back: int = 400, ahead: int = 100) -> DataFrame:
    """The anchor of each measure (TXT-13): the last one up to ``back`` characters before it, else the first within ``ahead`` after it. Both have
    document_id, page_number and position; they meet by stretches of text, so that only near ones are compared."""
    w = Window.partitionBy("document_id", "page_number", "position", "measure")
    cell = lambda c: F.floor(c / F.lit(back))
    m = measures.withColumn("cell", F.explode(F.array(cell(F.col("position")) - 1, cell(F.col("position")), cell(F.col("position")) + 1)))
    a = anchors.select("document_id", "page_number", F.col("position").alias("anchor_position"), "anchor").withColumn("cell", cell(F.col("anchor_position")))
    gap = F.col("position") - F.col("anchor_position")
    near = m.join(a, ["document_id", "page_number", "cell"]).where(gap.between(-ahead, back))
    rank = F.struct(F.when(gap >= 0, 0).otherwise(1), F.abs(gap))
    return near.withColumn("best", F.min(rank).over(w)).where(rank == F.col("best")).drop("best", "cell")


def best_ranges(ranges: DataFrame) -> DataFrame:
    """Of competing readings of a range the best by score (TXT-14)."""
    return one_per(ranges, ["document_id", "page_number", "low", "high"], [F.desc("score"), "id"])


def index_rows(text_chunks: DataFrame, table_facts: DataFrame, sentences: DataFrame) -> DataFrame:
    """All that a corpus index holds (TXT-21): text, table facts and verified facts, numbered within each document."""
    union = text_chunks.withColumn("content_type", F.lit("text")).unionByName(table_facts.withColumn("content_type", F.lit("structured_fact")), True).unionByName(sentences.withColumn("content_type", F.lit("verified_fact")), True)
    return union.withColumn("chunk_index", F.row_number().over(Window.partitionBy("document_id").orderBy("content_type", "content")) - 1).withColumn("chunk_id", N.stable_id(F.col("document_id"), F.col("content_type"), F.col("chunk_index")))


def gated(texts: DataFrame, classes: DataFrame, domain: str, least: float = 6.0) -> DataFrame:
    """Documents of a domain, or with that score at least (TXT-16)."""
    return texts.join(classes.where((F.col("domain") == domain) | (F.col("score") >= least)).select("document_id"), "document_id", "left_semi")


def formations_in(texts: DataFrame) -> DataFrame:
    """The distinct plausible formations that each text names (TXT-22)."""
    names = F.regexp_extract_all("text", F.lit(r"\b((?:[A-Z][a-z]+\s+){1,3}Formation)\b"))
    fine = F.array_distinct(F.transform(F.filter(names, G.formation_is_plausible), G.formation))
    return texts.select("document_id", F.explode(fine).alias("formation"))


def topic_summary(evidence: DataFrame, texts: DataFrame, most: int = 40, cited: int = 6) -> DataFrame:
    """An extractive summary of each topic (TXT-8): its best chunks, each text once, the first ones cited."""
    best = Window.partitionBy("topic").orderBy(F.desc("score"), "chunk_id")
    rows = evidence.join(texts.select("chunk_id", F.substring("content", 1, 600).alias("snippet")), "chunk_id")
    rows = rows.withColumn("n", F.row_number().over(best)).where(F.col("n") <= most)
    once = one_per(rows, ["topic", "snippet"], ["n"]).withColumn("k", F.row_number().over(Window.partitionBy("topic").orderBy("n"))).where(F.col("k") <= cited)
    return once.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "snippet"))), lambda x: x["snippet"]), "\n").alias("summary"), F.array_sort(F.collect_set("document_id")).alias("documents"))
