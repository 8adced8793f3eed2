"""Texts whose tables lost their layout: numbers after labels, grids in order, two passes of recognition, and page statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import normalize as N
from lodestone.operators.facts import first_of

# What recognition takes each digit for.
CONFUSIONS = {
    "0": "8OQD",
    "1": "7lI|",
    "2": "Z",
    "3": "58B",
    "4": "A",
    "5": "36S",
    "6": "8G",
    "7": "1",
    "8": "0B3",
    "9": "gq",
}
MEASURES = ("Overburden", "Lignite", "Coal", "Power Gross (NLCIL)", "Power Export (NLCIL)", "Power Gross (NTPL)", "Power Export (NTPL)")
MOST_VALUES = 8

# What a page of production by period must and must not say, in lower case.
YEAR_MARK = r"(?i)\bfy\s*2[0-9]\b"
THERMAL = r"table\s+1\.1:\s*coal\s+production|state-wise\s+coal\s+production"
COKING = r"coking\s+coal\s+production"
STRIPPING = r"\bobr\b|overburden"
COKING_SECTION = r"(?is)table\s+1\.1\s*\(\s*b\s*\).*?(?=table\s+1\.2|\bobr\b|$)"
BY_STATE = r"state[- ]wise"
TITLES = {
    "interleaved": "Production table (reconstructed from source layout)",
    "grid": "State-wise production (reconstructed from source table)",
    "coal grid": "State-wise coal production (reconstructed from source table)",
}
LEAST_ROWS = 3


def confusable(a: Column, b: Column) -> Column:
    """Whether two numbers are equal or differ in one glyph that recognition confuses (TXT-9), in either direction; letters of the other case count too.
    Points are never confused."""
    pairs = sorted({p for digit, glyphs in CONFUSIONS.items() for g in glyphs for p in (digit + g, digit + g.lower() if g.upper() in glyphs else digit + g)})
    known = F.array(*(F.lit(p) for p in pairs))
    glyphs = lambda t: F.split(t, "")
    differ = F.filter(F.zip_with(glyphs(a), glyphs(b), lambda x, y: F.when(x != y, F.struct(x.alias("x"), y.alias("y")))), lambda p: p.isNotNull())
    one = F.get(differ, 0)
    either = F.array_contains(known, F.concat(one["x"], one["y"])) | F.array_contains(known, F.concat(one["y"], one["x"]))
    return (a == b) | ((F.length(a) == F.length(b)) & (F.size(differ) == 1) & either)


def decimals(pages: DataFrame) -> DataFrame:
    """Numbers with two decimals in order of appearance, each with its neighbours (WIN-15)."""
    found = pages.select("document_id", "page_number", F.posexplode(F.regexp_extract_all("text", F.lit(r"((?<!\()\b\d+\.\d{2}\b)"))).alias("place", "number"))
    w = Window.partitionBy("document_id", "page_number").orderBy("place")
    return found.withColumns({"left": F.lag("number").over(w), "right": F.lead("number").over(w)})


def reconciled(base: DataFrame, detail: DataFrame) -> DataFrame:
    """Replacements (document_id, page_number, number, by) that a second pass of recognition gives (TXT-9): a confusable number between the
    same neighbours; at the edge of a page the one neighbour that is there. Pages with under three numbers are left alone."""
    enough = lambda df: df.join(df.groupBy("document_id", "page_number").count().where("count >= 3").drop("count"), ["document_id", "page_number"], "left_semi")
    a = enough(decimals(base))
    b = enough(decimals(detail)).select(F.col("document_id").alias("d_document"), F.col("page_number").alias("d_page"), F.col("number").alias("by"), F.col("left").alias("d_left"), F.col("right").alias("d_right"), F.col("place").alias("d_place"))
    page = (F.col("document_id") == F.col("d_document")) & (F.col("page_number") == F.col("d_page"))
    left, right = F.col("left") == F.col("d_left"), F.col("right") == F.col("d_right")
    by_left = a.where("left is not null").join(b, page & left).where(F.col("right").isNull() | right)
    by_right = a.where("left is null").join(b, page & right)
    hits = by_left.unionByName(by_right).where((F.col("number") != F.col("by")) & confusable(F.col("number"), F.col("by")))
    return hits.groupBy("document_id", "page_number", "number").agg(F.min_by("by", F.struct(-F.col("place"), "d_place")).alias("by"))


def apply_replacements(base: DataFrame, replacements: DataFrame) -> DataFrame:
    """The base pages with their numbers replaced; whole numbers only."""
    maps = replacements.groupBy("document_id", "page_number").agg(F.map_from_entries(F.collect_list(F.struct("number", "by"))).alias("m"))
    tokens = F.regexp_extract_all("text", F.lit(r"((?:(?<!\()\b\d+\.\d{2}\b)|(?s:.))"))
    fixed = F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at("m", t), t)), "")
    return base.join(maps, ["document_id", "page_number"], "left").withColumn("text", F.when(F.col("m").isNull(), F.col("text")).otherwise(fixed)).drop("m")


def lines(pages: DataFrame) -> DataFrame:
    """Non-empty lines with their places and kinds: number, label, growth (a percentage or a sign) or other."""
    out = pages.select("document_id", "page_number", F.posexplode(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")).alias("place", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    kind = F.when(F.col("line").rlike(r"^\d+\.\d{1,3}$"), "number").when(F.col("line").rlike(r"^\d{1,3}$"), "serial").when(F.col("line").rlike(r"(?i)^[-+]\d|%$|^growth|^[▲▼]"), "growth").when(N.plausible_entity(F.col("line")) & F.col("line").rlike("^[A-Za-z]") & ~F.col("line").rlike(r"(?i)\bfy\s*\d|table|production|target|month|during|upto"), "label").otherwise("other")
    return out.withColumn("kind", kind)


def label_runs(pages: DataFrame, least: int = 4) -> DataFrame:
    """Labels followed by a run of numbers (WIN-14): growth lines between them are skipped, runs end at any other line; at most MOST_VALUES values."""
    w = Window.partitionBy("document_id", "page_number").orderBy("place")
    rows = lines(pages).where("kind <> 'growth'")
    rows = rows.withColumn("island", F.sum(F.when(F.col("kind") == "number", 0).otherwise(1)).over(w))
    head = rows.where("kind in ('label', 'serial')").select("document_id", "page_number", "island", F.col("line").alias("label"), F.col("kind").alias("head"), F.col("place").alias("label_place"))
    runs = rows.where("kind = 'number'").groupBy("document_id", "page_number", "island").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"].cast("double")), 1, MOST_VALUES).alias("values"))
    return runs.join(head, ["document_id", "page_number", "island"]).where(F.size("values") >= least).drop("island")


def period_rows(runs: DataFrame, more: list[str] | None = None) -> DataFrame:
    """Runs as rows (label, measure, period, value) (TXT-18): with an achievement among the first four the actuals stand second and fourth. ``more``: columns to keep."""
    v = lambda k: F.get("values", k)
    achievement = F.exists(F.slice("values", 1, 4), lambda x: x.between(70.0, 160.0)) & (F.size("values") >= 6)
    picks = (("during", "later", 1, 0), ("during", "earlier", 3, 1), ("upto", "later", 4, 2), ("upto", "earlier", 5, 3))
    rows = F.array(*(F.struct(F.lit(m).alias("measure"), F.lit(p).alias("year"), F.when(achievement, v(a)).otherwise(v(b)).alias("value")) for m, p, a, b in picks))
    return runs.where("head = 'label'").select("document_id", "page_number", "label", *(more or []), F.explode(rows).alias("r")).select("document_id", "page_number", "label", *(more or []), "r.*")


def zipped_grid(pages: DataFrame) -> DataFrame:
    """Labels and numeric rows that a page lists apart, zipped in order (JN-12, TXT-18): label k with the run of the k-th serial number. Labels stand before a number each, up to the
    first line with a year after them."""
    w = Window.partitionBy("document_id", "page_number").orderBy("label_place")
    runs = label_runs(pages)
    grid = runs.where("head = 'serial'").withColumn("k", F.row_number().over(w)).select("document_id", "page_number", "k", "values")
    own = Window.partitionBy("document_id", "page_number").orderBy("place")
    after = lines(pages).withColumn("next", F.lead("kind").over(own))
    whole = Window.partitionBy("document_id", "page_number")
    pair = (F.col("kind") == "label") & (F.col("next") == "number")
    after = after.withColumn("first_pair", F.min(F.when(pair, F.col("place"))).over(whole))
    year = F.col("line").rlike(YEAR_MARK) & (F.col("place") > F.col("first_pair"))
    after = after.withColumn("listed_to", F.min(F.when(year, F.col("place"))).over(whole)).where(F.col("listed_to").isNull() | (F.col("place") < F.col("listed_to")))
    labels = after.where(pair).withColumn("k", F.row_number().over(own)).select("document_id", "page_number", "k", F.col("line").alias("label"))
    return labels.join(grid, ["document_id", "page_number", "k"])


def production_pages(pages: DataFrame) -> DataFrame:
    """Pages that may hold a table of production by period (TXT-18), with metric, month (Unknown where none is told) and by_state. They tell of production in a fiscal year of the twenties and of coal,
    lignite or overburden; pages of coking coal or stripping alone are left out, and the section on coking coal is cut out of others."""
    low = F.lower("text")
    has = lambda word: F.contains(low, F.lit(word))
    metric = F.when(has("coal"), "coal").when(has("lignite"), "lignite")
    thermal = low.rlike(THERMAL)
    other = (F.col("metric") == "coal") & ~thermal & (low.rlike(COKING) | (low.rlike(STRIPPING) & ~has("coal production")))
    out = pages.withColumn("metric", metric).where(has("production") & low.rlike(YEAR_MARK) & F.col("metric").isNotNull() & ~other)
    # the month's rules stand in a lambda, so that the text is bound once and generated code stays small
    cut = F.when(F.col("metric") == "coal", F.regexp_replace("text", COKING_SECTION, "\n")).otherwise(F.col("text"))
    out = out.withColumn("text", cut)
    return out.withColumns({"month": F.coalesce(F.get(F.transform(F.array("text"), N.reporting_month), 0), F.lit("Unknown")), "by_state": low.rlike(BY_STATE)})


def period_tables(pages: DataFrame) -> DataFrame:
    """Production by label, month, measure (during, upto) and year (later, earlier) of pages whose tables lost their layout (TXT-18, WIN-14, JN-12): numbers after their labels, or, on pages by state
    first, labels and numbers listed apart. Three rows at least make a table; a page has one form. Null and empty texts, and pages without tables, give nothing; rows that share a page's key
    are an error of the caller's."""
    own = production_pages(pages.select("document_id", "page_number", "text"))
    key = ["document_id", "page_number"]
    rows = label_runs(own).where("head = 'label'").select(*key, "label", "values", F.col("label_place").alias("at"), F.lit("interleaved").alias("form"))
    grid = zipped_grid(own).select(*key, "label", "values", F.col("k").alias("at"), F.lit("grid").alias("form"))
    both = rows.unionByName(grid).join(own.select(*key, "metric", "month", "by_state"), key)
    page = Window.partitionBy(*key)
    both = both.withColumn("n", F.count("*").over(Window.partitionBy(*key, "form"))).where(F.col("n") >= LEAST_ROWS)
    first = F.when(F.col("by_state"), F.when(F.col("form") == "grid", 0).otherwise(1)).otherwise(F.when(F.col("form") == "grid", 1).otherwise(0))
    both = both.withColumn("turn", first).withColumn("best", F.min("turn").over(page)).where("turn = best")
    out = period_rows(both.withColumn("head", F.lit("label")), ["metric", "month", "by_state", "form", "at"])
    return out.where("value is not null")


def period_table_texts(tables: DataFrame) -> DataFrame:
    """The evidence text of each page's table (TXT-18): a title, then a sentence for each label and measure, in the page's order. A page's own rows make the text."""
    key = ["document_id", "page_number"]
    plain = lambda v: F.regexp_replace(F.regexp_replace(F.format_string("%.6f", v), r"0+$", ""), r"\.$", "")
    side = lambda y: F.max(F.when(F.col("year") == y, F.col("value")))
    rows = tables.groupBy(*key, "form", "by_state", "at", "label", "metric", "month", "measure").agg(side("later").alias("later"), side("earlier").alias("earlier")).where("later is not null and earlier is not null")
    said = F.format_string("%s %s production | reporting_period=%s | measure=%s | FY25=%s MT | FY24=%s MT.", "label", "metric", "month", "measure", plain(F.col("later")), plain(F.col("earlier")))
    title = F.when(F.col("form") == "interleaved", TITLES["interleaved"]).when(F.col("by_state"), TITLES["coal grid"]).otherwise(TITLES["grid"])
    lines_ = F.transform(F.array_sort(F.collect_list(F.struct("at", "measure", said.alias("said")))), lambda x: x["said"])
    return rows.groupBy(*key, title.alias("title")).agg(lines_.alias("lines")).select(*key, F.concat(F.col("title"), F.lit(": "), F.array_join("lines", " ")).alias("content"))


def actual_target_blocks(pages: DataFrame) -> DataFrame:
    """Seven measures with their actual and target columns (TXT-19): the numbers after the word Actual, then those after Target, or the next seven."""
    numbers = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"(?<!\()\b(\d+\.\d{2})\b")), lambda x: x.cast("double"))
    tail = lambda word: F.regexp_extract("text", rf"(?is)\b{word}\b(.*)$", 1)
    rows = pages.withColumns({"a": numbers(tail("Actual")), "t": numbers(tail("Target"))})
    actual = F.slice("a", 1, 7)
    target = F.when((F.size("t") >= 3) & (F.instr("text", "Target") > F.instr("text", "Actual")), F.slice("t", 1, 7)).otherwise(F.slice("a", 8, 7))
    names = F.array(*(F.lit(m) for m in MEASURES))
    out = rows.select("document_id", "page_number", F.posexplode(F.arrays_zip(names.alias("measure"), actual.alias("actual"), target.alias("target"))).alias("k", "r"))
    return out.select("document_id", "page_number", "r.measure", "r.actual", "r.target").where("actual is not null and target is not null")


def page_confidence(words: DataFrame, low: int = 70, keep_words: int = 40, keep_decimals: int = 20) -> DataFrame:
    """Recognition quality of each page (AGG-22): mean confidence, and its first uncertain words and numbers, each once, null where there are none. Words: document_id, page_number,
    place, word, confidence (below 0: not read). Words are ranked before lists are made."""
    page = ["document_id", "page_number"]
    known = words.where("confidence >= 0")
    poor = known.where((F.col("confidence") < low) & F.col("word").isNotNull()).groupBy(*page, "word").agg(F.min("place").alias("at"))
    out = known.groupBy(*page).agg(F.round(F.avg("confidence"), 3).alias("mean_confidence"))
    for name, rows, n in (("low_words", poor, keep_words), ("low_decimals", poor.where(F.col("word").rlike(r"^\d+\.\d+$")), keep_decimals)):
        out = out.join(first_of(rows, page, ["at", "word"], n, ["word"], name).withColumn(name, F.col(f"{name}.word")), page, "left")
    return out


def scanned(pages: DataFrame, least: float = 40.0) -> DataFrame:
    """Documents whose pages hold too little text to be digital (AGG-23)."""
    return pages.groupBy("document_id").agg(F.avg(F.length(F.trim("text"))).alias("density")).withColumn("is_scanned", F.col("density") < least)
