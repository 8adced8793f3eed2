"""Validation: contradictions between documents, discrepancies within one, and the state of known conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import normalize as N
from lodestone.functions.text import among
from lodestone.operators.facts import normalized, one_per
from lodestone.sources.cut import ensure_checkpoints

TERMINAL = ("confirmed", "dismissed", "resolved")
OPEN = ("review_required", "detected")


def representatives(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Of each (entity, field, period) one reported fact for each file, of its latest version."""
    rows = normalized(facts.where("status <> 'rejected' and numeric_value is not null and not is_calculated"))
    rows = rows.join(documents.select("document_id", F.lower("filename").alias("file"), "version"), "document_id", "left")
    rows = rows.where("field is not null and entity is not null and period is not null").withColumns({"file": F.coalesce("file", "document_id"), "version": F.coalesce("version", F.lit(1))})
    return one_per(rows, ["entity", "field", "period", "file"], [F.desc("version"), F.desc("id")])


def cross_document(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Contradictions and unit reviews between documents (VAL-1, VAL-2, JN-3): one row for each pair of files that
    disagree on an entity's field in a period. Pairs are made within a fact's key, between files, after one fact a file is left."""
    r = representatives(facts, documents).select("id", "document_id", "entity", "field", "period", "numeric_value", "unit_norm", "entity_name")
    side = lambda tag: r.select("entity", "field", "period", *(F.col(c).alias(f"{tag}_{c}") for c in ("id", "document_id", "numeric_value", "unit_norm")))
    pairs = side("a").join(side("b"), ["entity", "field", "period"]).where("a_document_id < b_document_id")
    pairs = pairs.withColumn("c", N.compare(F.col("a_numeric_value"), F.col("a_unit_norm"), F.col("b_numeric_value"), F.col("b_unit_norm"))).where("c.unit_review or c.conflict")
    review = F.col("c.unit_review")
    contra = N.fingerprint(F.lit("contra"), F.col("entity"), F.col("field"), F.col("period"), F.col("a_document_id"), F.col("b_document_id"))
    unit = N.fingerprint(F.lit("unit"), F.col("entity"), F.col("field"), F.col("period"), F.least("a_id", "b_id"), F.greatest("a_id", "b_id"))
    return pairs.select(F.when(review, unit).otherwise(contra).alias("fingerprint"), F.when(review, "unit_review").otherwise("contradiction").alias("conflict_type"), F.when(review, "low").otherwise("high").alias("severity"), "entity", "field", "period", "a_id", "b_id", F.col("c.left_base").alias("a_base"), F.col("c.right_base").alias("b_base"))


def rarest_first(names: DataFrame) -> DataFrame:
    """entity and words (of two letters at least, the rarest first) of distinct names; a word's rarity is the number of names that hold it. One order holds for
    all names, which prefix filtering needs; ties go by the word."""
    words = names.select("entity", F.explode(N.long_words(F.col("entity"))).alias("word"))
    common = words.groupBy("word").agg(F.count("*").alias("n"))
    listed = words.join(common, "word").groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("words"))  # a name's own words
    return listed.select("entity", F.col("words.word").alias("words"))


def ambiguous_entities(facts: DataFrame) -> DataFrame:
    """Names of one field and period in different documents that may mean the same entity (VAL-3, JN-4); each pair of names is reported once.

    Names meet by prefix filtering over their words, the rarest first. If all words of one are among the other's, the rarest of the shorter name is a word of the longer: that one word asks, all words
    answer. Else the names share 0.6 of the longer one's words at least, and then one of the first size - ceil(0.6 * size) + 1 words of both. So a word that all names hold brings together only
    names that have nothing rarer, and candidates grow with the pairs that are reported. Names without such words match nothing.

    Facts are read and grouped once: the names, and then the names with their words, are checkpoints. A pair that meets at several words is kept at the first that both prefixes share, or, where they
    share none, at the word that asks (which only one of the two does then, as words have one order), so that no pairs are sorted to leave out repeated ones."""
    ensure_checkpoints(facts.sparkSession)
    rows = normalized(facts.where("status <> 'rejected' and numeric_value is not null")).where("entity is not null and field is not null")
    names = rows.groupBy("entity", "field", F.coalesce("period", F.lit("")).alias("period")).agg(F.min("document_id").alias("first_document"), F.max("document_id").alias("last_document")).checkpoint()
    sized = names.join(rarest_first(names.select("entity").distinct()), "entity").withColumn("size", F.size("words"))
    sized = sized.withColumn("prefix", F.slice("words", 1, F.col("size") - F.ceil(F.col("size") * 6 / 10).cast("int") + 1)).checkpoint()
    keys, columns = ["field", "period", "word"], ["entity", "first_document", "last_document", "words", "size", "prefix"]
    side = lambda tag, words: sized.select("field", "period", F.explode(words).alias("word"), *(F.col(c).alias(f"{tag}_{c}") for c in columns))
    shared = F.array_intersect("x_prefix", "y_prefix")
    within = side("x", F.slice("words", 1, 1)).join(side("y", F.col("words")), keys).where((F.col("x_size") <= F.col("y_size")) & (F.col("x_entity") != F.col("y_entity")) & (F.size(shared) == 0))
    across = side("x", F.col("prefix")).join(side("y", F.col("prefix")), keys).where((F.col("x_entity") < F.col("y_entity")) & (F.get(shared, F.lit(0)) == F.col("word")))
    found = within.unionByName(across).where("x_first_document <> y_last_document or x_last_document <> y_first_document")
    pairs = found.where(N.name_match(F.col("x_entity"), F.col("y_entity"), F.col("x_words"), F.col("y_words")) == "ambiguous")
    pairs = pairs.select("field", "period", F.least("x_entity", "y_entity").alias("a_entity"), F.greatest("x_entity", "y_entity").alias("b_entity"))
    return pairs.select(N.fingerprint(F.lit("entity"), F.col("field"), F.col("period"), F.col("a_entity"), F.col("b_entity")).alias("fingerprint"), "field", "period", "a_entity", "b_entity")


def achievement_discrepancies(facts: DataFrame, points: float = 2.0) -> DataFrame:
    """Reported achievements that differ from production over target by over ``points`` (VAL-4)."""
    rows = normalized(facts.where("status <> 'rejected' and not is_calculated and numeric_value is not null")).where("entity is not null and period is not null")
    last = lambda f: F.max_by("numeric_value", F.when(F.col("field") == f, F.col("id")))
    wide = rows.where(F.col("field").isin("production", "production_target", "achievement_percentage")).groupBy("document_id", "entity", "period").agg(last("production").alias("production"), last("production_target").alias("target"), last("achievement_percentage").alias("reported"))
    wide = wide.withColumn("calculated", F.round(F.col("production") / F.nullif(F.col("target"), F.lit(0.0)) * 100, 2))
    return wide.where(F.abs(F.col("calculated") - F.col("reported")) > points).withColumn("fingerprint", N.fingerprint(F.lit("disc"), F.col("document_id"), F.col("entity"), F.col("period")))


def calculated_achievements(facts: DataFrame) -> DataFrame:
    """Achievement facts that production and target of one document give (VAL-11), marked as calculated."""
    rows = normalized(facts.where("status <> 'rejected' and not is_calculated"))
    wide = rows.where("field in ('production', 'production_target') and entity is not null and period is not null").groupBy("document_id", "entity", "period").agg(*(F.max_by("base_value", F.when(F.col("field") == f, F.col("id"))).alias(f) for f in ("production", "production_target")))
    return wide.where("production_target <> 0 and production is not null").select("document_id", "entity", "period", F.lit("achievement_percentage").alias("field"), F.round(F.col("production") / F.col("production_target") * 100, 2).alias("numeric_value"), F.lit(True).alias("is_calculated"))


def downgraded_achievements(facts: DataFrame, points: float = 2.0) -> DataFrame:
    """Facts with the status that they have once calculated achievements are known (VAL-11): a reported achievement of high confidence that differs
    from its document's production over target by over ``points`` goes to review, and ``warning`` says so."""
    off = achievement_discrepancies(facts, points).select("document_id", "entity", "period", F.lit(True).alias("off"))
    rows = facts.withColumns({"entity": N.entity(F.col("entity_name")), "period": N.period(F.col("financial_year"))}).join(off, ["document_id", "entity", "period"], "left")
    disagrees = F.coalesce(F.col("off"), F.lit(False)) & (N.field(F.col("field_name")) == "achievement_percentage")
    status = F.when(disagrees & (F.col("status") == "high_confidence"), "review_required").otherwise(F.col("status"))
    return rows.select(*(c for c in facts.columns if c != "status"), status.alias("status"), F.when(disagrees, "achievement_discrepancy").alias("warning"))


def merge_state(stored: DataFrame, found: DataFrame) -> DataFrame:
    """The next snapshot of conflicts (VAL-5, SET-5): ``stored`` and ``found`` have fingerprint, stored also status. New ones are created, open
    ones refreshed, terminal ones kept, and open ones that are found no more dismissed. ``outcome`` tells which."""
    both = stored.select("fingerprint", "status", F.lit(True).alias("known")).join(found.select("fingerprint").distinct().withColumn("seen", F.lit(True)), "fingerprint", "full_outer")
    known, seen, open_ = F.col("known").isNotNull(), F.col("seen").isNotNull(), among(F.col("status"), OPEN)
    outcome = F.when(~known, "created").when(seen & open_, "refreshed").when(~seen & open_, "auto_cleared").when(seen, "unchanged_terminal").otherwise("kept")
    out = both.withColumn("outcome", outcome)
    return out.select("fingerprint", F.when(F.col("outcome").isin("created", "refreshed"), "review_required").when(F.col("outcome") == "auto_cleared", "dismissed").otherwise(F.col("status")).alias("status"), "outcome")


def apply_transitions(conflicts: DataFrame, actions: DataFrame) -> DataFrame:
    """Conflicts after their reviewers' last actions (VAL-6): actions have fingerprint, action (confirm, dismiss, resolve), value, acted_at, action_id."""
    last = one_per(actions, ["fingerprint"], [F.desc("acted_at"), F.desc("action_id")]).select("fingerprint", "action", "value")
    state = F.when(F.col("action") == "confirm", "confirmed").when(F.col("action") == "dismiss", "dismissed").when((F.col("action") == "resolve") & F.col("value").isNotNull(), "resolved")
    return conflicts.join(last, "fingerprint", "left").withColumn("status", F.coalesce(state, "status")).withColumn("selected_value", F.when(F.col("status") == "resolved", F.col("value"))).drop("action", "value")


def conflict_stats(conflicts: DataFrame, facts: DataFrame) -> DataFrame:
    """Numbers of conflicts by status, and facts that no open one touches (AGG-20)."""
    n = facts.agg(F.count("*").alias("facts"))
    out = conflicts.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("review_required", "dismissed", "confirmed", "resolved")))
    return out.join(F.broadcast(n)).withColumn("validated", F.greatest(F.lit(0), F.col("facts") - F.col("review_required")))  # two single rows


def range_conflicts(rows: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Lengths of one (entity key, metric, borehole) whose ranges in metres don't overlap (VAL-7): rows have document_id, entity_key, metric, borehole, low, high.
    Equal ranges of a document are one. Within a document a mismatch of high severity, else a discrepancy of medium."""
    keys = ["entity_key", "metric", "borehole"]
    r = rows.where("low is not null and high is not null").select(*keys, "document_id", "low", "high").distinct()
    side = lambda tag: r.select(*keys, *(F.col(c).alias(f"{tag}_{c}") for c in ("document_id", "low", "high")))
    pairs = side("a").join(side("b"), keys).where(F.struct("a_low", "a_high", "a_document_id") < F.struct("b_low", "b_high", "b_document_id")).where(F.col("a_high") + tolerance < F.col("b_low"))
    same = F.col("a_document_id") == F.col("b_document_id")
    return pairs.withColumn("conflict_type", F.when(same, "mismatch").otherwise("discrepancy")).withColumn("severity", F.when(same, "high").otherwise("medium"))


#: Events of a key that one window sorts; cuts that a larger key gets.
SWEEP, CUTS = 1 << 20, 64


def _swept(events: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Events (keys, at, end: whether a range ends here, document_id, low, high) with the number of ends before them and the last of these.

    A window of running extremes by key. A key with over ``most`` events is cut at CUTS of its places, whose exactness doesn't matter: the totals of a cut's earlier neighbours are added."""
    cuts = F.percentile_approx("at", [i / (CUTS + 1) for i in range(1, CUTS + 1)], 1000)
    large = events.groupBy(*keys).agg(F.count("*").alias("n"), cuts.alias("cuts")).where(F.col("n") > most).drop("n")
    dealt = events.join(large, keys, "left").withColumn("part", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("at"))), F.lit(0))).drop("cuts")
    order = Window.partitionBy(*keys, "part").orderBy("at", "end", F.desc("document_id"), "low", "high").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = F.when(F.col("end"), F.struct("document_id", "low", "high"))
    run = dealt.withColumns({"count_here": F.count_if(F.col("end")).over(order), "last_here": F.last(ended, True).over(order)})
    parts = run.groupBy(*keys, "part").agg(F.max("count_here").alias("count"), F.max_by("last_here", "count_here").alias("last"))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(*keys, "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("count_before"), F.last("last", True).over(earlier).alias("last_before"))
    return run.where(~F.col("end")).join(before, [*keys, "part"]).select(*keys, "document_id", "low", "high", (F.col("count_here") + F.col("count_before")).alias("n"), F.coalesce("last_here", "last_before").alias("nearest"))


def range_disagreements(rows: DataFrame, tolerance: float = 1e-6, most: int = SWEEP) -> DataFrame:
    """Each range that disagrees with others of its (entity key, metric, borehole), once (VAL-7): n (how many ranges it doesn't overlap), n_in_document (those of its own document), the nearest
    of them (document, low, high; of equal gaps the one below, then the smallest document), gap, and severity: high where its own document disagrees, else medium.

    Ranges and their mirror images are swept once each in order of their ends, so that work and rows are linear in the ranges, where pairs are not. Equal ranges of a document are
    one; ranges without both ends take no part; no rows give no rows."""
    keys = ["entity_key", "metric", "borehole"]
    r = rows.where("low is not null and high is not null").select(*keys, "document_id", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high")).distinct()
    r = r.join(r.groupBy(*keys).agg(F.max("low").alias("l"), F.min("high").alias("h")).where(F.col("h") + tolerance < F.col("l")).drop("l", "h"), keys, "left_semi")  # all others agree
    sides = F.explode(F.array(*(F.struct(F.lit(up).alias("up"), start.alias("start"), stop.alias("stop")) for up, start, stop in ((False, F.col("low"), F.col("high") + tolerance), (True, -F.col("high") - tolerance, -F.col("low"))))))
    sided = r.select("*", sides.alias("s")).select(*r.columns, "s.*")
    events = sided.select(*keys, "document_id", "low", "high", "up", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(False).alias("end")), F.struct(F.col("stop").alias("at"), F.lit(True).alias("end")))).alias("e")).select("*", "e.*").drop("e")
    whole = _swept(events, [*keys, "up"], most).withColumn("own", F.lit(False))
    within = _swept(events.withColumn("of", F.col("document_id")), [*keys, "up", "of"], most).drop("of").withColumn("own", F.lit(True))
    found = whole.unionByName(within).where("n > 0")
    gap = F.when(F.col("up"), F.col("nearest.low") - F.col("high")).otherwise(F.col("low") - F.col("nearest.high"))
    out = found.groupBy(*keys, "document_id", "low", "high").agg(F.sum(F.when(~F.col("own"), F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)).alias("n_in_document"), F.min(F.when(~F.col("own"), F.struct(F.round(gap, 9).alias("gap"), "up", F.col("nearest.document_id").alias("document_id"), F.col("nearest.low").alias("low"), F.col("nearest.high").alias("high")))).alias("b"))
    return out.select(*keys, "document_id", "low", "high", "n", "n_in_document", F.col("b.document_id").alias("nearest_document"), F.col("b.low").alias("nearest_low"), F.col("b.high").alias("nearest_high"), "b.gap", F.when(F.col("n_in_document") > 0, "high").otherwise("medium").alias("severity"))


def quality_issues(rows: DataFrame) -> DataFrame:
    """Issues of geological rows (VAL-8), one row each: id, issue. Rows have id, kind, value, seam_name, geological_formation, unit_known."""
    kind, has_seam = F.col("kind"), F.coalesce(F.length("seam_name") > 0, F.lit(False))
    measured = kind.rlike("thickness|depth|quantity")
    tests = {"non_numeric": measured & F.col("value").isNull(), "thickness_without_seam": (kind == "seam_thickness") & ~has_seam, "formation_thickness_with_seam": (kind == "formation_thickness") & has_seam, "workable_mislabelled": (kind == "seam_thickness") & F.coalesce(F.lower("evidence").contains("workable"), F.lit(False)), "unknown_unit": measured & ~F.col("unit_known")}
    return rows.select("id", F.explode(F.array_compact(F.array(*(F.when(t, n) for n, t in tests.items())))).alias("issue"))


def check_drafts(drafts: DataFrame, fields: list[str]) -> DataFrame:
    """Drafts with ``ok`` and ``warnings`` (VAL-10): an allowed field and a number are required; percentages and grades have ranges; unit,
    year and evidence that stand not in the page are warned of."""
    field, value = F.col("field"), F.col("numeric_value")
    bad = F.array_compact(F.array(F.when(~field.isin(*fields), "field_not_allowed"), F.when(value.isNull(), "not_numeric"), F.when((field == "achievement_percentage") & ~value.between(0, 150), "achievement_out_of_range"), F.when((field == "grade") & ~value.between(0, 100), "grade_out_of_range")))
    words = F.slice(F.filter(F.split(F.lower("evidence_text"), r"\s+"), lambda w: F.length(w) > 3), 1, 4)
    page = F.lower("page_text")
    there = page.contains(F.lower("evidence_text")) | F.exists(words, lambda w: F.contains(page, w))
    soft = F.array_compact(F.array(F.when(F.col("unit").isNull(), "unit_missing"), F.when(F.col("financial_year").isNull(), "year_missing"), F.when(~F.coalesce(there, F.lit(False)), "evidence_not_found")))
    return drafts.withColumn("ok", F.size(bad) == 0).withColumn("warnings", F.concat(bad, soft))


def latest_first(conflicts: DataFrame, status: str | None = None, document_id: str | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """Conflicts of a status or a document, newest first (VAL-12)."""
    out = conflicts.where(F.col("status") == status) if status else conflicts
    if document_id is not None and evidence is not None:
        out = out.join(evidence.where(F.col("document_id") == document_id).select("fingerprint"), "fingerprint", "left_semi")
    return out.orderBy(F.desc("created_at"), "fingerprint")
