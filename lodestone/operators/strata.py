"""Geological facts from the text of pages (TXT-12, TXT-13, TXT-15), as native expressions over each page: matches with their places, the nearest seam or
borehole of a measure, drafts of each pass, their scores and the typed rows that they make. A page is a row; nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import geo as G
from lodestone.functions import normalize as N
from lodestone.functions.text import among, blank_as_null, found, squeeze, strip

# How pages name things and measures.
UNITS = r"(m|meter|meters|metre|metres|cm|mm|ft|feet|foot)"
NUMBER = r"([+-]?\d+(?:[.,]\d+)?)"
BOREHOLE = r"(?i)\b(?:bore\s*hole|borehole|drill\s*hole|dh)\s*(?:no\.?|number|#|:)?\s*([A-Z]{0,4}[-_]?\d{1,5}[A-Z]?)\b"
SEAM_NAMED = rf"(?i)\bseam\s+(?:section\s+)?({G.SEAM_BODY})\b"
SEAM_OF_THICKNESS = rf"(?i)\bthickness\s+of\s+(?:the\s+)?(?:seam\s+(?:section\s+)?)?({G.SEAM_BODY})\b"
SEAM_BEFORE = r"(?i)\b((?:[IVXLC]{1,6}(?:[AB])?(?:\s+(?:Top|Bottom|T|B))?|[A-Za-z]{1,3}\d+[A-Za-z]?))\s+seams?\b"
UNNAMED_SEAM = r"(?i)\b(?:an?\s+|one\s+|the\s+)?(?:uncorrelated|unnamed|un-?named|unidentified)\s+(?:coal\s+)?seams?\b(?:\s+of\s+(?:the\s+)?([A-Za-z][A-Za-z\s-]{1,40}?)\s+Formation)?"
RANGE = rf"(?i)\b(?:thickness|seam\s+thickness)\b[\s\S]{{0,160}}?(?:varies?|varying|ranging|range|general\s+thickness)\s+(?:within[\s\S]{{0,55}}?)?(?:(?:var(?:ies|ying)|ranging)\s+)?(?:from|between)\s*{NUMBER}\s*{UNITS}?\s*(?:to|[-–—]|and)\s*{NUMBER}\s*{UNITS}?"
RANGE_DIRECT = rf"(?i)\b(?:general\s+thickness|thickness)\s+{NUMBER}\s*{UNITS}?\s*(?:to|[-–—])\s*{NUMBER}\s*{UNITS}?"
DEPTH = rf"(?i)\b(?:depth|from\s+depth|at\s+depth)\s*(?:of|:)?\s*{NUMBER}\s*{UNITS}?\b"
THICKNESS = rf"(?i)\b(?:minimum\s+thickness|maximum\s+thickness|thickness|seam\s+thickness|thick)\s*(?:of|is|=|:)?\s*{NUMBER}\s*{UNITS}?\b"
WORKABLE = rf"(?i)\bminimum\s+workable\s+thickness\b[\s\S]{{0,100}}?(?:(?:has\s+been\s+)?considered\s+(?:for\s+[^.\n]{{0,60}}?)?)?(?:is|of|=|:)?\s*{NUMBER}\s*{UNITS}?"
FORMATION = r"(?i)\b(?!(?:the|a|an|and|or|of|to|for|in|on|at|by|from|with|this|that|through|into|what|which|where|when|who|how|overlies|underlies|overlie|underlie)\b)((?:(?:Upper|Lower|Middle)\s+)?[A-Za-z][A-Za-z]{2,}(?:\s+[A-Za-z][A-Za-z]{2,})?)\s+Formations?\b"
FORMATION_RANGE = rf"(?i)\b(?:average\s+)?thickness\s+of\s+(?:the\s+)?([A-Za-z][A-Za-z\s-]{{1,40}}?)\s+Formation\b[\s\S]{{0,80}}?(?:is|of|=|:)?\s*{NUMBER}\s*{UNITS}?\s*(?:to|[-–—])\s*{NUMBER}\s*{UNITS}?"
STRUCTURE = r"(?i)\b(fault|fold|anticline|syncline|thrust|unconformity)\b"
BLOCK_WIDE = r"(?i)(?:varies?|varying)\s+within\s+the\s+block|general\s+thickness"
NARRATIVE = r"(?i)(?:varies?|varying)\s+within|general\s+thickness\s+(?:vary|varying)|general\s+thickness\s+[0-9]|thickness\s+of\s+(?:the\s+)?seam"
RESOURCE = r"(?i)(?:(?:gross\s+)?(?:inferred|indicated|measured|total)\s+(?:coal\s+)?resources?\b|contributes\s+\d+\.\d+\s*MT\s+of\s+(?:gross\s+)?(?:inferred\s+)?(?:coal\s+)?resource|(?:gross\s+)?inferred\s+coal\s+resource)[^.\n]{0,160}?(\d+\.\d+)\s*(MT|million\s*tonnes?)?"
RESERVE = r"(?i)(?:(?:inferred|indicated|measured|proved|probable)\s+(?:coal\s+)?reserves?\b)[^.\n]{0,160}?(\d+\.\d+)\s*(MT|million\s*tonnes?)?"
ROCKS = ("coal", "sandstone", "shale", "claystone", "siltstone", "limestone", "mudstone", "carbonaceous shale", "fireclay", "conglomerate")
QUALITIES = {"gcv": "GCV", "gross calorific value": "GCV", "ash": "Ash", "moisture": "Moisture", "volatile matter": "Volatile Matter", "fixed carbon": "Fixed Carbon", "sulphur": "Sulphur", "sulfur": "Sulphur"}
HIGH_CONFIDENCE, UNNAMED_MOST, NO_EVIDENCE = 0.85, 0.65, 0.25

_FIELDS = {
    "metric_kind": "string", "seam_name": "string", "seam_status": "string", "geological_formation": "string", "borehole_id": "string", "depth": "string", "depth_unit": "string", "thickness": "string", "thickness_unit": "string", "thickness_min": "string",
    "thickness_max": "string", "lithology": "string", "geological_structure": "string", "coal_quality_parameter": "string", "coal_quality_value": "string", "coal_quality_unit": "string", "original_value": "string", "original_unit": "string", "evidence_text": "string", "place": "int",
}


def matches(text: Column, pattern: str, groups: int = 1) -> Column:
    """All matches of a pattern in order: an array of {start, end, g1, ...}, places from 0, groups null where empty."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(whole), F.lit(1))), whole, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("own")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["own"]).alias("at"), F.array_append(acc["out"], F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["own"]).alias("end"))).alias("out"))
    places = F.aggregate(F.filter(lengths, lambda x: x["own"].isNotNull()), start, step, lambda acc: acc["out"])
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in range(1, groups + 1)]
    return F.transform(places, lambda p, i: F.struct(p["start"].alias("start"), p["end"].alias("end"), *(F.nullif(F.get(g, i), F.lit("")).alias(f"g{k}") for k, g in enumerate(parts, 1))))


def window(text: Column, a: Column, b: Column) -> Column:
    """The text from place a to place b, within its ends."""
    low = F.greatest(a, F.lit(0))
    return F.substring(text, low + 1, F.greatest(b - low, F.lit(0)))


def evidence(text: Column, a: Column, b: Column, radius: int = 110) -> Column:
    return squeeze(window(text, a - radius, b + radius))


def near_seam(of: Column, before_word: Column, named: Column, at: Column, back: int = 400, ahead: int = 100) -> Column:
    """The seam that a measure at a place belongs to (TXT-13), from the page's matches with canonical names: one named in "thickness of the seam", else a code before the
    word seam, else a named seam; of each sort the last that doesn't follow the place, within ``back`` characters before it and ``ahead`` after."""

    def pick(found_: Column, slack: int, other: int) -> Column:
        inside = F.filter(found_, lambda m: (m["start"] >= at - back) & (m["end"] <= at + ahead))
        before = F.filter(inside, lambda m: m["start"] <= at + slack)
        return F.coalesce(F.try_element_at(before, F.lit(-1)), F.try_element_at(inside, F.lit(other)))["g1"]

    return F.coalesce(pick(of, 5, -1), pick(before_word, 5, -1), pick(named, 0, 1))


def near_borehole(boreholes: Column, at: Column, radius: int = 180) -> Column:
    """The first borehole within ``radius`` characters of a place (TXT-13)."""
    return F.upper(F.get(F.filter(boreholes, lambda m: (m["start"] >= at - radius) & (m["end"] <= at + radius)), 0)["g1"])


def _draft(**columns: Column) -> Column:
    return F.struct(*(columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in _FIELDS.items()))


def _formation(name: Column) -> Column:
    return F.when(G.formation_is_plausible(F.concat(name, F.lit(" Formation"))), G.formation(name))


def _renamed(found_: Column, name) -> Column:
    """Matches whose first group is a name, made canonical; those that aren't names go."""
    rest = lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), name(m["g1"]).alias("g1"))
    return F.filter(F.transform(found_, rest), lambda m: m["g1"].isNotNull())


def _no_commas(value: Column) -> Column:
    return F.replace(value, F.lit(","))


def score(d: Column) -> Column:
    """A draft's confidence (TXT-15): a base, what is filled, what fits together, evidence and page; from 0 to 0.95, 0 for a draft that says nothing."""
    has = lambda c: F.coalesce(F.length(d[c]) > 0, F.lit(False))
    term = lambda c, x: F.when(c, x).otherwise(0.0)
    parts = ("borehole_id", "seam_name", "depth", "thickness", "thickness_min", "lithology", "geological_formation", "geological_structure", "coal_quality_parameter")
    unnamed = among(d["seam_status"], ("uncorrelated", "unnamed"))
    filled = sum((term(has(c), 1.0) for c in parts), F.lit(0.0)) + term(unnamed, 1.0)
    total = 0.4 + sum((term(has(c), 0.07) for c in parts), F.lit(0.0)) + term(unnamed, 0.08) + term(has("seam_name") & (has("thickness") | has("thickness_min")), 0.15)
    total = total + term(has("thickness_min") & has("thickness_max") & has("seam_name"), 0.08) + term(F.coalesce(d["metric_kind"] == "formation_thickness", F.lit(False)) & has("geological_formation"), 0.12)
    total = total + term(F.coalesce(d["metric_kind"] == "minimum_workable_seam_thickness", F.lit(False)), 0.1) + term(F.coalesce(F.length(d["evidence_text"]) >= 12, F.lit(False)), 0.1) + 0.05
    total = total + term(has("depth") & has("thickness") & (d["depth"] == d["thickness"]), -0.15)
    return F.when(filled == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(0.95), F.round(total, 3))))


def _range_score(d: Column) -> Column:
    low = F.lower(d["evidence_text"])
    term = lambda c, x: F.when(F.coalesce(c, F.lit(False)), x).otherwise(0)
    return term(F.contains(low, F.lower(d["seam_name"])), 3) + term(low.rlike(r"thickness\s+of\s+(?:the\s+)?seam"), 4) + term(F.contains(low, F.lit("varies")) | F.contains(low, F.lit("varying")), 2) + term(F.contains(low, F.lit("parting")), -5) + term(d["seam_name"].isNotNull(), 1)


def drafts(pages: DataFrame) -> DataFrame:
    """One row for each geological statement of a page (TXT-12): document_id, page_number and the fields of a draft.

    Passes: seams without a name; the minimum workable thickness; formations' ranges; ranges with the nearest seam and borehole, of which
    competing ones (equal numbers on a page) leave the best; a seam's own thickness; boreholes and seams with the depth, thickness, rock, structure and quality told near
    them, each measure once, for the first that it is near to; resources and reserves; formations by name. Pages: document_id, page_number, text; null
    texts tell nothing."""
    base = pages.select("document_id", "page_number", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    rows = base.withColumns({
        "boreholes": matches(text, BOREHOLE), "named": _renamed(matches(text, SEAM_NAMED), G.seam), "of": _renamed(matches(text, SEAM_OF_THICKNESS), G.seam), "before": _renamed(matches(text, SEAM_BEFORE), G.seam), "unnamed": matches(text, UNNAMED_SEAM),
        "workable": matches(text, WORKABLE, 2), "formation_ranges": matches(text, FORMATION_RANGE, 5), "ranges": F.concat(matches(text, RANGE, 4), matches(text, RANGE_DIRECT, 4)), "formations": _renamed(matches(text, FORMATION), _formation),
    })
    seam_at = lambda at: near_seam(F.col("of"), F.col("before"), F.col("named"), at)
    hole_at = lambda at: near_borehole(F.col("boreholes"), at)
    named_in = lambda a, b: F.get(F.filter(F.col("formations"), lambda f: (f["start"] >= a) & (f["end"] <= b)), 0)["g1"]

    def of_unnamed(m: Column) -> Column:
        ev = evidence(text, m["start"], m["end"], 140)
        status = F.when(window(text, m["start"], m["end"]).rlike(r"(?i)\buncorrelated\b"), "uncorrelated").otherwise("unnamed")
        return _draft(metric_kind=F.lit("seam"), seam_status=status, geological_formation=named_in(m["start"] - 140, m["end"] + 140), evidence_text=ev, place=m["start"])

    def of_workable(m: Column) -> Column:
        value, unit = _no_commas(m["g1"]), F.coalesce(m["g2"], F.lit("m"))
        number = N.plain_number(value)
        fine = number.between(1e-12, 50.0) | ~F.lower(unit).startswith("m") | (F.lower(unit) == "mm")
        return F.when(fine, _draft(metric_kind=F.lit("minimum_workable_seam_thickness"), thickness=value, thickness_unit=unit, evidence_text=squeeze(window(text, m["start"], m["end"] + 40)), place=m["start"]))

    def spanned(m: Column, low: str, high: str, unit: Column, **more: Column) -> Column:
        a, b = _no_commas(m[low]), _no_commas(m[high])
        return _draft(thickness=F.concat(a, F.lit("–"), b), thickness_min=a, thickness_max=b, thickness_unit=F.coalesce(unit, F.lit("m")), place=m["start"], **more)

    def of_formation_range(m: Column) -> Column:
        return F.when(m["name"].isNotNull(), spanned(m, "g2", "g4", F.coalesce(m["g3"], m["g5"]), metric_kind=F.lit("formation_thickness"), geological_formation=m["name"], evidence_text=squeeze(window(text, m["start"], m["end"] + 40))))

    def of_range(m: Column) -> Column:
        around, ev = window(text, m["start"] - 80, m["end"] + 80), squeeze(window(text, m["start"], m["end"] + 100))
        taken = F.exists(F.col("formation_ranges"), lambda f: (F.abs(f["start"] - m["start"]) < 8) & (F.abs(f["end"] - m["end"]) < 8)) | F.exists(F.col("workable"), lambda f: (f["start"] <= m["start"]) & (m["start"] < f["end"]))
        of_formation = around.rlike(r"(?i)\bformation\b") & ~around.rlike(r"(?i)\bseams?\b")
        parting = F.contains(F.lower(window(text, m["start"] - 200, m["end"] + 40)), F.lit("parting")) & ~ev.rlike(NARRATIVE)
        told = ev.rlike(r"(?i)(?:varies?|varying|ranging|from|between|general\s+thickness)")
        seam, kind = m["seam"], F.when(m["seam"].isNotNull(), "seam_thickness")
        hole = F.when(~ev.rlike(BLOCK_WIDE), F.coalesce(hole_at(m["end"]), hole_at(m["start"])))
        return F.when(~taken & ~of_formation & ~parting & told, spanned(m, "g1", "g3", F.coalesce(m["g2"], m["g4"]), metric_kind=kind, seam_name=seam, seam_status=F.when(seam.isNotNull(), "named"), borehole_id=hole, geological_formation=named_in(m["start"], m["end"] + 100), geological_structure=F.lower(found(ev, STRUCTURE)), evidence_text=ev))

    def best_of(ranges: Column) -> Column:
        """Of ranges with equal ends the one of the best score, the first of equals; none of a negative score."""
        same = lambda d, x: (d["thickness_min"] == x["thickness_min"]) & (d["thickness_max"] == x["thickness_max"])
        beats = lambda x, d: (x["score"] > d["score"]) | ((x["score"] == d["score"]) & (x["d"]["place"] < d["d"]["place"]))
        return F.transform(F.filter(ranges, lambda d: (d["score"] >= 0) & ~F.exists(ranges, lambda x: same(d["d"], x["d"]) & beats(x, d))), lambda x: x["d"])

    def of_seam(m: Column) -> Column:
        seam, near = m["g1"], window(text, m["start"], m["end"] + 220)
        value, unit = found(near, THICKNESS), found(near, THICKNESS, 2)
        has_range = F.exists(F.col("kept_ranges"), lambda d: F.coalesce(d["seam_name"] == seam, F.lit(False)))
        point = F.when(value.isNotNull(), F.lit("seam_thickness"))
        return F.when(~has_range, _draft(metric_kind=point, seam_name=seam, seam_status=F.lit("named"), thickness=_no_commas(value), thickness_unit=unit, borehole_id=F.when(value.isNotNull(), hole_at(m["start"])), evidence_text=evidence(text, m["start"], m["end"] + F.when(value.isNotNull(), 60).otherwise(0)), place=m["start"]))

    def of_quantity(m: Column) -> Column:
        ev = evidence(text, m["start"], m["end"], 160)
        value, unit = F.coalesce(found(ev, r"(?i)(\d+\.\d+)\s*(MT)\b"), m["g1"]), F.coalesce(found(ev, r"(?i)(\d+\.\d+)\s*(MT)\b", 2), m["g2"], F.lit("MT"))
        seam = m["seam"]
        return F.when(N.plain_number(value).between(1e-12, 1e6), _draft(metric_kind=m["kind"], seam_name=seam, seam_status=F.when(seam.isNotNull(), "named"), original_value=value, original_unit=unit, evidence_text=ev, place=m["start"]))

    def of_name(m: Column) -> Column:
        return _draft(metric_kind=F.lit("formation"), geological_formation=m["g1"], evidence_text=evidence(text, m["start"], m["end"], 100), place=m["start"])

    each = lambda c, f: F.array_compact(F.transform(F.col(c) if isinstance(c, str) else c, f))
    with_seam = lambda c, first, then: F.transform(c, lambda m: m.withField("seam", F.coalesce(seam_at(m[first]), seam_at(m[then]))))
    quantity = lambda pattern, kind: F.transform(matches(text, pattern, 2), lambda m: m.withField("kind", F.lit(kind)))
    rows = rows.withColumns({
        "ranges": with_seam(F.col("ranges"), "end", "start"), "quantities": with_seam(F.concat(quantity(RESOURCE, "resource"), quantity(RESERVE, "reserve")), "start", "end"),
        "formation_ranges": F.transform("formation_ranges", lambda m: m.withField("name", _formation(squeeze(m["g1"])))),
    })
    rows = rows.withColumn("scored_ranges", F.transform(each("ranges", of_range), lambda d: F.struct(d.alias("d"), _range_score(d).alias("score")))).withColumn("kept_ranges", best_of(F.col("scored_ranges")))
    anchor = lambda c, kind: F.transform(F.col(c), lambda m: F.struct(F.lit(kind).alias("sort"), (F.upper(m["g1"]) if kind == "borehole" else m["g1"]).alias("name"), m["start"].alias("start"), m["end"].alias("end")))
    anchors = F.filter(F.concat(anchor("boreholes", "borehole"), anchor("named", "seam"), anchor("before", "seam")), lambda a: a["name"].isNotNull())

    def rock(w: Column) -> Column:
        """The rock that a label names, else the first that stands in the text."""
        low = F.lower(w)
        places = F.array(*(F.struct(F.regexp_instr(low, F.lit(rf"(?<![a-z]){r}(?![a-z])")).alias("at"), F.lit(r).alias("rock")) for r in ROCKS))
        first = F.array_sort(F.filter(places, lambda x: x["at"] > 0))
        labelled = F.lower(found(w, rf"(?i)\blithology\s*[:=\-]\s*({'|'.join(sorted(ROCKS, key=len, reverse=True))})\b"))
        return F.initcap(F.coalesce(labelled, F.get(first, 0)["rock"]))

    def quality(w: Column) -> Column:
        """The first parameter of QUALITIES that the text gives a value of."""
        told = [(label, rf"(?i)\b{phrase}\s*(?:content|value)?\s*(?:of|:)?\s*{NUMBER}\s*([A-Za-z/%°]+)?") for phrase, label in QUALITIES.items()]
        return F.coalesce(*(F.when(w.rlike(p), F.struct(F.lit(label).alias("label"), found(w, p).alias("value"), found(w, p, 2).alias("unit"))) for label, p in told))

    def measured(a: Column) -> Column:
        """An anchor with the first depth and thickness near it, and where in the page these stand."""
        w, low = window(text, a["start"] - 120, a["end"] + 240), F.greatest(a["start"] - 120, F.lit(0))
        depth, thick = F.get(matches(w, DEPTH, 2), 0), F.get(matches(w, THICKNESS, 2), 0)
        ruled_out = window(w, thick["start"] - 40, thick["end"] + 20).rlike(r"(?i)\bworkable\b|\bminimum\s+thickness\b")
        return F.struct(a["sort"].alias("sort"), a["name"].alias("name"), a["start"].alias("start"), a["end"].alias("end"), w.alias("w"), depth.alias("depth"), (low + depth["start"]).alias("depth_at"), thick.alias("thick"), (low + thick["start"]).alias("thick_at"), F.coalesce(ruled_out, F.lit(False)).alias("ruled_out"), rock(w).alias("rock"), quality(w).alias("quality"), F.lower(found(w, STRUCTURE)).alias("structure"))

    rows = rows.withColumn("anchors", F.transform(anchors, measured))
    taken = F.transform("kept_ranges", lambda d: d["place"])

    def of_anchor(a: Column, i: Column) -> Column:
        before = F.slice(F.col("anchors"), 1, i)
        free = lambda at: F.coalesce(a[at].isNotNull() & ~F.exists(before, lambda b: F.coalesce(b[at] == a[at], F.lit(False))), F.lit(False))
        depth = F.when(free("depth_at"), a["depth"])
        thick = F.when(free("thick_at") & ~F.array_contains(taken, a["thick_at"]), a["thick"])
        told = thick.isNotNull()
        hole = F.when(a["sort"] == "borehole", a["name"]).otherwise(F.when(told, hole_at(a["start"])))
        seam = F.when(a["sort"] == "seam", a["name"]).otherwise(F.when(told, seam_at(a["start"])))
        kind = F.when(told & seam.isNotNull(), "seam_thickness").when(depth.isNotNull() & hole.isNotNull(), "borehole_depth").when(depth.isNotNull(), "seam_depth")
        at, to = F.coalesce(a["depth_at"], a["start"]), F.coalesce(a["depth_at"] + (a["depth"]["end"] - a["depth"]["start"]), a["end"])
        return F.when(~(a["ruled_out"] & free("thick_at")), _draft(
            metric_kind=kind, seam_name=seam, seam_status=F.when(seam.isNotNull(), "named"), borehole_id=hole, depth=_no_commas(depth["g1"]), depth_unit=depth["g2"], thickness=_no_commas(thick["g1"]), thickness_unit=thick["g2"], lithology=a["rock"], geological_formation=named_in(a["start"] - 120, a["end"] + 240),
            geological_structure=a["structure"], coal_quality_parameter=a["quality"]["label"], coal_quality_value=_no_commas(a["quality"]["value"]), coal_quality_unit=a["quality"]["unit"], evidence_text=F.when(depth.isNotNull(), evidence(text, at, to)).otherwise(evidence(text, a["start"], a["end"])), place=a["start"]))

    rows = rows.withColumn("early", F.concat(each("unnamed", of_unnamed), each("workable", of_workable), each("formation_ranges", of_formation_range), F.col("kept_ranges"), each("of", of_seam), F.array_compact(F.transform(F.col("anchors"), of_anchor)), each("quantities", of_quantity)))
    keyed = F.transform("formations", lambda m: F.struct(G.formation_key(m["g1"]).alias("key"), m.alias("m")))
    told = F.transform(F.filter("early", lambda d: F.coalesce(d["metric_kind"] == "formation_thickness", F.lit(False))), lambda d: G.formation_key(d["geological_formation"]))
    rows = rows.withColumns({"keyed": keyed, "told": told})
    first = F.filter("keyed", lambda x, i: ~F.array_contains(F.col("told"), x["key"]) & ~F.exists(F.slice(F.col("keyed"), 1, i), lambda b: b["key"] == x["key"]))
    fresh = F.transform(first, lambda x: of_name(x["m"]))
    return rows.select("document_id", "page_number", F.explode(F.concat("early", fresh)).alias("d")).select("document_id", "page_number", "d.*")


def scored(found_: DataFrame) -> DataFrame:
    """Drafts as typed rows with confidence and status (TXT-15): unnamed seams never are of high confidence, rows with under eight characters of evidence have
    little; lengths in metres, the range's lower end for the number to sort by, and the qualifier of the value."""
    d = F.struct(*_FIELDS)
    unnamed = among(F.col("seam_status"), ("uncorrelated", "unnamed"))
    value = F.when(F.coalesce(F.length(strip(F.col("evidence_text"))) >= 8, F.lit(False)), score(d)).otherwise(NO_EVIDENCE)
    high = value >= HIGH_CONFIDENCE
    metres = lambda c, unit: G.to_metres(N.plain_number(F.col(c)), F.col(unit))
    return found_.withColumns({
        "extraction_confidence": F.when(unnamed & high, F.least(value, F.lit(UNNAMED_MOST))).otherwise(value), "status": F.when(high & ~unnamed, "high_confidence").otherwise("review_required"),
        "thickness_normalized_m": F.coalesce(metres("thickness_min", "thickness_unit"), metres("thickness", "thickness_unit")), "depth_normalized_m": metres("depth", "depth_unit"),
        "qualifier": F.when(F.col("thickness_min").isNotNull(), "range").otherwise(G.qualifier(F.col("evidence_text"))), "metric_kind": G.metric_kind(blank_as_null(F.col("metric_kind"))),
    })
