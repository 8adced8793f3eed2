"""Facts from the text of pages: production drafts by pattern, and how far a draft can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import normalize as N
from lodestone.functions.text import among, found, strip
from lodestone.operators.facts import once

# What a page may say of production, and the units and fields that count.
#: A name begins where its run of letters and blanks does, so that a text is read once and not once from each of its places.
PRODUCED = r"(?iU)(?<![\w\s\-/])([\w\s\-/]+?)\s+produced\s+(\d+(?:\.\d+)?)\s*(MT|tonnes|tons|kt)\b(?:[^\n.]{0,80}?during\s+(FY\s?\d{4}|\d{4}-\d{2}|\d{4}/\d{2}))?"
TARGET = r"(?iU)(?:against\s+a\s+)?target\s+of\s+(\d+(?:\.\d+)?)\s*(MT|tonnes|tons|kt)\b"
ACHIEVED = r"(?iU)(?:achievement|achieved)\s*(?:of|=|:)?\s*(\d+(?:\.\d+)?)\s*%"
NOISY = r"(?iU)Pr[o0]ducti[o0]n\s*[:=]\s*(\d+(?:\.\d+)?)\s*M\??"
GRADE = r"(?iU)(?:grade|ore grade)\s*(?:of|=|:)?\s*(\d+(?:\.\d+)?)\s*%"
RESERVES = r"(?iU)reserves?\s*(?:of|=|:)?\s*(\d+(?:\.\d+)?)\s*(MT|tonnes)"
#: Each with letters, of one case only each, that no text can do without in which it is found.
STATEMENTS = {"produced": (PRODUCED, "produced"), "target": (TARGET, "target"), "achieved": (ACHIEVED, "ach"), "noisy": (NOISY, "duct"), "grade": (GRADE, "grade"), "reserves": (RESERVES, "erve")}
SUSPICIOUS = r"(?i)[0O]{2,}|[Il1]{3,}|\?|Pr0duct|M\?|rn|vv"
ALLOWED_UNITS = ("MT", "Mt", "mt", "tonnes", "tons", "kt", "kg", "%", "pct", "ha", "hectares", "sq km", "km2", "m", "million tonnes", "Mm3", "m3")
NUMERIC_FIELDS = ("production", "production_target", "achievement_percentage", "overburden", "lignite", "coal", "dispatch", "grade", "capacity", "reserves")
HIGH_CONFIDENCE = 0.85

DRAFT = "field string, value string, unit string, entity string, year string, evidence string, ambiguous boolean"


def _draft(field: str, value: Column, unit: Column, entity: Column, year: Column, evidence: Column, ambiguous: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), value.alias("value"), unit.alias("unit"), entity.alias("entity"), year.alias("year"), strip(evidence).alias("evidence"), ambiguous.alias("ambiguous"))


def _table_rows(text: Column) -> Column:
    """Drafts of lines such as ``Mine B|3.9|5.0``: production, then target."""
    none = F.lit(None).cast("string")

    def of_line(line: Column) -> Column:
        cells = F.transform(F.split(line, r"\|"), strip)
        is_mine = (F.size(cells) >= 3) & F.get(cells, 0).rlike(r"(?iU)^Mine\s+\w+")
        is_number = lambda k: is_mine & F.get(cells, k).rlike(r"^\d+(\.\d+)?$")
        cell = lambda k, field: F.when(is_number(k), _draft(field, F.get(cells, k), F.lit("MT"), F.get(cells, 0), none, line, F.lit(False)))
        return F.array(cell(1, "production"), cell(2, "production_target"))

    told = text.contains("|") & (text.contains("Mine") | text.contains("Production"))
    return F.when(told, F.flatten(F.transform(F.split(text, r"\r\n|[\n\r]"), of_line))).otherwise(F.array().cast(f"array<struct<{DRAFT.replace(' string', ':string').replace(' boolean', ':boolean')}>>"))


def production_drafts(pages: DataFrame) -> DataFrame:
    """What each page tells of production (TXT-10): the first statement of each form (produced, target of, achievement, noisy production, grade,
    reserves) and every table row of a mine. Pages: document_id, text, and page_number and is_ocr where known. One row for each draft:
    document_id, page_number, is_ocr, text, field, value, unit, entity, year, evidence, ambiguous."""
    page = F.col("page_number") if "page_number" in pages.columns else F.lit(None).cast("int")
    ocr = F.coalesce(F.col("is_ocr"), F.lit(False)) if "is_ocr" in pages.columns else F.lit(False)
    rows = once(pages.select("document_id", page.alias("page_number"), ocr.alias("is_ocr"), F.coalesce("text", F.lit("")).alias("text")), _low=F.lower("text"))
    text, is_ocr, none = F.col("text"), F.col("is_ocr"), F.lit(None).cast("string")
    # each pattern runs over a text once, and only where the text holds a word that it can't do without; its parts are read from what it has matched
    rows = once(rows, **{f"_{p}": F.when(F.contains("_low", F.lit(word)), F.regexp_extract(text, pattern, 0)).otherwise("") for p, (pattern, word) in STATEMENTS.items()})
    part = lambda p, k: found(F.col(f"_{p}"), STATEMENTS[p][0], k)
    is_said = lambda p: F.col(f"_{p}") != ""
    told = is_said("produced")
    mine, year = F.when(told, strip(F.regexp_extract("_produced", PRODUCED, 1))), F.replace(part("produced", 4), F.lit(" "))
    one = lambda field, p, unit, of, fy, ambiguous: F.when(is_said(p), _draft(field, part(p, 1), unit, of, fy, F.col(f"_{p}"), ambiguous))
    said = F.array(
        F.when(told, _draft("production", part("produced", 2), part("produced", 3), mine, year, F.col("_produced"), is_ocr)),
        one("production_target", "target", part("target", 2), mine, year, is_ocr),
        one("achievement_percentage", "achieved", F.lit("%"), mine, year, is_ocr),
        F.when(~told, one("production", "noisy", F.lit("MT"), none, none, F.lit(True))),
        one("grade", "grade", F.lit("%"), none, none, is_ocr),
        one("reserves", "reserves", part("reserves", 2), none, none, is_ocr),
    )
    return rows.withColumn("d", F.explode(F.concat(said, _table_rows(text)))).where("d is not null").select("document_id", "page_number", "is_ocr", "text", "d.*")


def production_facts(pages: DataFrame) -> DataFrame:
    """Typed facts of production_drafts(): document_id, entity_name, period, field, value, unit."""
    d = production_drafts(pages)
    return d.select("document_id", F.col("entity").alias("entity_name"), N.period(F.col("year")).alias("period"), "field", N.plain_number(F.col("value")).alias("value"), "unit")


def confidence(
    value: Column, evidence: Column, unit: Column, entity: Column, year: Column, field: Column, ambiguous: Column, is_ocr: Column, schema_ok: Column, in_text: Column, ocr_mean: Column | None = None, ocr_low: Column | None = None
) -> Column:
    """How far an extracted fact can be trusted (TXT-11), from 0 to 1 in thousandths. ``ocr_mean``: mean confidence of the page's words (null: not
    known); ``ocr_low``: its numbers that were read with little confidence. Null flags count as false, blank texts as missing."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    term = lambda c, plus, minus=0.0: F.when(yes(c), plus).otherwise(minus)
    said = F.coalesce(strip(value.cast("string")), F.lit(""))
    mean = ocr_mean if ocr_mean is not None else F.lit(None).cast("double")
    lows = F.coalesce(ocr_low, F.array().cast("array<string>")) if ocr_low is not None else F.array().cast("array<string>")
    doubted = (said != "") & F.exists(lows, lambda d: F.contains(said, d) | F.contains(d, said))
    score = 0.55 + term(said != "", 0.12) + term(F.length(strip(evidence)) >= 8, 0.12) + term(in_text, 0.10) + term(among(unit, ALLOWED_UNITS), 0.05)
    score = score + term(F.length(entity) > 0, 0.04) + term(F.length(year) > 0, 0.03) + term(schema_ok, 0.06, -0.15) + term(ambiguous, -0.22)
    read = term(evidence.rlike(SUSPICIOUS), -0.12) + term(evidence.contains("?"), -0.08) + term(mean < 75, -0.12) + term(mean < 60, -0.10) + term(doubted, -0.18) - 0.10
    numeric = yes(among(field, NUMERIC_FIELDS) & in_text)
    score = score + F.when(yes(is_ocr), read).otherwise(0.0) + term(numeric, 0.04) + term(numeric & yes(is_ocr) & F.coalesce(mean < 80, F.lit(True)), -0.05)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 3)))


def draft_status(score: Column) -> Column:
    return F.when(score >= HIGH_CONFIDENCE, "high_confidence").otherwise("review_required")


def scored_drafts(drafts: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Drafts with confidence and status. ``words``: recognition quality of pages (document_id, page_number, mean_confidence, low_decimals),
    which drafts of scanned pages are held against."""
    flat = lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))
    rows = drafts.withColumn("_inside", F.contains(flat(F.col("text")), flat(F.col("evidence"))))  # before the join, which needn't carry texts then
    if words is not None:
        rows = rows.join(words.select("document_id", "page_number", "mean_confidence", "low_decimals"), ["document_id", "page_number"], "left")
    mean, low = (F.col("mean_confidence"), F.col("low_decimals")) if words is not None else (None, None)
    schema_ok = among(F.col("field"), NUMERIC_FIELDS) & N.plain_number(F.col("value")).isNotNull()
    score = confidence(F.col("value"), F.col("evidence"), F.col("unit"), F.col("entity"), F.col("year"), F.col("field"), F.col("ambiguous"), F.col("is_ocr"), schema_ok, F.col("_inside"), mean, low)
    return rows.withColumn("confidence", score).withColumn("status", draft_status(F.col("confidence"))).drop("mean_confidence", "low_decimals", "_inside")
