"""Geological names, kinds, values and places, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.normalize import VERIFIED, plain_number
from lodestone.functions.text import among, blank_as_null, found, lookup, squeeze, strip

# Fixed values.
METRES = {"m": 1.0, "meter": 1.0, "meters": 1.0, "metre": 1.0, "metres": 1.0, "mt": 1.0, "cm": 0.01, "mm": 0.001, "ft": 0.3048, "feet": 0.3048, "foot": 0.3048}
RESOURCE_TONNES = {"kg": 1e-3, "kilogram": 1e-3, "kilograms": 1e-3, "t": 1.0, "te": 1.0, "ton": 1.0, "tons": 1.0, "tonne": 1.0, "tonnes": 1.0, "mt": 1e6, "milliontonne": 1e6, "milliontonnes": 1e6}
SEAM_BODY = r"(?:[ivxlc]{1,6}[ab]?(?:\s+(?:top|bottom|t|b))?|[a-z]{1,3}\d+[a-z]?|\d{1,3}[a-z]?)"
LEADING_WORDS = (
    "a", "an", "the", "and", "or", "of", "to", "for", "in", "on", "at", "by", "from", "with", "into", "this", "that", "these", "those", "its",
    "their", "as", "via", "per", "through", "across", "between", "among", "along", "what", "which", "where", "when", "who", "how", "overlies",
    "underlies", "overlie", "underlie", "overlying", "underlying", "comprises", "comprise", "consists", "consist", "includes", "include", "including",
    "forms", "form", "forming", "occurs", "occur", "occurring", "belongs", "belong", "belonging", "hosts", "host", "hosting", "contains", "contain",
    "containing", "presents", "present", "shows", "show", "showing", "represents", "represent",
)
GRAMMAR_WORDS = (
    "a", "an", "and", "or", "the", "this", "that", "these", "those", "its", "their", "our", "of", "to", "for", "in", "on", "at", "by", "from", "with",
    "into", "onto", "over", "under", "above", "below", "through", "across", "between", "among", "along", "via", "per", "as", "is", "are", "was",
    "were", "be", "been", "being", "has", "have", "had", "do", "does", "did", "what", "which", "where", "when", "who", "whom", "whose", "why", "how",
    "not", "no", "only", "also", "such", "same", "other", "another", "each", "every", "both", "all", "any", "some", "more", "most", "few", "several",
    "various", "said", "etc",
)
DESCRIPTIVE_WORDS = (
    "may", "might", "can", "could", "should", "would", "will", "shall", "respective", "entire", "whole", "upper", "lower", "middle", "main", "local", "regional", "general", "typical",
    "following", "preceding", "concerned", "present", "given", "mentioned", "described", "interpreted", "identified", "established", "reported", "observed", "studied", "mapped",
    "geological", "geology", "stratigraphic", "stratigraphy", "sedimentary", "lithology", "lithologic", "lithological", "guide", "guides", "coaly", "carbonaceous", "separate",
    "associated", "underlying", "overlying", "intervening", "host", "parent", "source", "target", "subject", "corresponding", "equivalent", "probable", "possible", "potential", "major",
    "minor", "thick", "thin", "hard", "soft", "new", "old", "first", "second", "third", "overlies", "underlies", "overlie", "underlie", "comprises", "comprise", "consists", "consist",
    "includes", "include", "including", "forms", "form", "forming", "occurs", "occur", "occurring", "belongs", "belong", "belonging", "hosts", "hosting", "contains", "contain",
    "containing", "formation", "formations", "member", "group", "horizon", "seam", "seams", "borehole", "boreholes", "shale", "sandstone", "siltstone", "claystone", "mudstone",
    "limestone", "ironstone", "coal", "rock", "rocks", "bed", "beds", "unit", "units", "sequence", "sequences", "section", "sections", "part", "parts", "type", "types", "nature",
    "character", "presence", "absence", "occurrence", "occurrences", "boundary", "boundaries", "contact", "contacts", "thickness", "depth", "information", "description", "chapter",
    "table", "figure", "page", "block", "area", "zone", "region", "characteristics", "characteristic", "qualitative", "strata",
)
NOT_FORMATIONS = r"(?i)\b(?:formation\s+characteristics|guide\s+to\s+formation|through\s+the\s+formation|lithology\s+of\s+formation|coaly\s+formation|carbonaceous\s+formations?)\b"
METRIC_ALIASES = {
    "minimum_workable_thickness": "minimum_workable_seam_thickness",
    "workable_seam_thickness": "minimum_workable_seam_thickness",
    "workable_thickness": "minimum_workable_seam_thickness",
    "min_workable_thickness": "minimum_workable_seam_thickness",
    "formations": "formation",
    "geological_formation": "formation",
    "seams": "seam",
    "boreholes": "borehole",
    "borehole_id": "borehole",
    "borehole_depths": "borehole_depth",
    "resource": "resource_quantity",
    "resources": "resource_quantity",
    "seam_resource": "resource_quantity",
    "coal_resource": "resource_quantity",
    "geological_resource": "resource_quantity",
    "reserve": "reserve_quantity",
    "reserves": "reserve_quantity",
}
METRIC_LABELS = {"resource_quantity": "Seam Resource", "reserve_quantity": "Reserve"}
THICKNESS = ("seam_thickness", "formation_thickness", "seam_parting_thickness", "overburden_thickness", "minimum_workable_seam_thickness")
DEPTHS = ("seam_depth", "borehole_depth", "stratigraphic_depth")
INCOMPATIBLE = {
    "seam_thickness": ("formation_thickness", "seam_parting_thickness", "overburden_thickness", "minimum_workable_seam_thickness", "borehole_depth", "stratigraphic_depth", "seam_depth", "resource_quantity", "reserve_quantity"),
    "formation_thickness": ("seam_thickness", "seam_parting_thickness", "overburden_thickness", "minimum_workable_seam_thickness", "borehole_depth", "seam_depth"),
    "seam_parting_thickness": ("seam_thickness", "formation_thickness", "overburden_thickness", "minimum_workable_seam_thickness", "borehole_depth"),
    "minimum_workable_seam_thickness": ("seam_thickness", "formation_thickness", "seam_parting_thickness", "overburden_thickness", "borehole_depth"),
    "seam_depth": ("seam_thickness", "formation_thickness", "borehole_depth"),
    "borehole_depth": ("seam_thickness", "formation_thickness", "seam_depth"),
}
QUANTITIES = ("resource", "reserve", "resource_quantity", "reserve_quantity")
COMPARED = {"formation": "formations", "seam": "seams", "resource_quantity": "resources", "borehole": "boreholes", "borehole_depth": "borehole_depths", "minimum_workable_seam_thickness": "minimum_workable_thickness"}


def letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z]", "")


def to_metres(value: Column, unit: Column) -> Column:
    """A length in metres, null for an unknown unit (FN-18). ``mt`` is read as metres here."""
    return value * lookup(METRES, letters(unit))


def to_tonnes(value: Column, unit: Column) -> Column:
    """A mass in tonnes, null for an unknown unit (FN-19). ``MT`` is a million tonnes here."""
    return value * lookup(RESOURCE_TONNES, letters(unit))


def seam_body(name: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_replace(squeeze(name), r"(?i)^seam\s+", ""), r"(?i)\s+seams?$", ""))


def seam_is_valid(name: Column) -> Column:
    """Whether a name identifies a seam (FN-20): a roman numeral with A or B, Top or Bottom, a letter and digits, or digits.
    Other words never have that form."""
    return _body_is_valid(seam_body(name))


def _body_is_valid(body: Column) -> Column:
    return F.coalesce((F.length(body) <= 24) & body.rlike(rf"(?i)^{SEAM_BODY}$"), F.lit(False))


def seam(name: Column) -> Column:
    """``Seam R4``, ``Seam III Top``; null for what isn't a seam's identifier (FN-20)."""
    return seam_of(seam_body(name))


def seam_of(body: Column) -> Column:
    core = F.upper(F.regexp_extract(body, r"(?i)^([a-z]{1,3}\d+[a-z]?|\d{1,3}[a-z]?|[ivxlc]{1,6}[ab]?)", 1))
    side = F.lower(F.regexp_extract(body, r"(?i)\s(top|bottom|t|b)$", 1))
    return F.when(_body_is_valid(body), F.concat(F.lit("Seam "), core, F.when(side.startswith("t"), " Top").when(side.startswith("b"), " Bottom").otherwise("")))


def seam_label(name: Column, status: Column) -> Column:
    """The seam's name to show; uncorrelated and unnamed seams get no invented identifier."""
    return seam_label_of(seam_body(name), F.lower(strip(status)))


def seam_label_of(body: Column, low: Column) -> Column:
    return F.when(low == "uncorrelated", "Uncorrelated coal seam").when(low == "unnamed", "Unnamed coal seam").otherwise(seam_of(body))


def borehole_key(name: Column) -> Column:
    """A borehole's id for comparison (FN-21)."""
    return blank_as_null(F.regexp_replace(F.lower(name), r"[-_\s]", ""))


def words_of(text: Column) -> Column:
    return F.split(F.regexp_replace(squeeze(text), r"^[ .,;:|-]+|[ .,;:|-]+$", ""), " ")


def _without_leading(text: Column) -> Column:
    return without_leading(words_of(text))


def without_leading(words: Column) -> Column:
    first = F.array_position(F.transform(words, lambda w: ~among(F.regexp_replace(F.lower(w), r"[.,;:]", ""), LEADING_WORDS)), True)
    return F.when(first > 0, F.array_join(F.slice(words, first.cast("int"), F.size(words)), " ")).otherwise("")


def formation(name: Column) -> Column:
    """``Barakar Formation``: leading words dropped, title case, roman numerals in capitals (FN-22)."""
    return formation_of(bare_formation(_without_leading(name)))


def bare_formation(plain: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_replace(plain, r"(?i)\bformations?\b", ""), r"^[ .,;:|-]+|[ .,;:|-]+$", ""))


def formation_of(bare: Column) -> Column:
    titled = F.array_join(F.transform(F.split(bare, " "), lambda w: F.when(w.rlike("(?i)^[ivxlc]+$"), F.upper(w)).otherwise(F.initcap(w))), " ")
    return F.when(F.length(bare) > 0, F.concat(titled, F.lit(" Formation")))


def formation_key(name: Column) -> Column:
    return blank_as_null(F.regexp_replace(F.lower(F.regexp_replace(name, r"(?i)\bformation\b", "")), "[^a-z0-9]+", ""))


def formations_match(a: Column, b: Column) -> Column:
    ka, kb = formation_key(a), formation_key(b)
    return F.coalesce((ka == kb) | ka.contains(kb) | kb.contains(ka), F.lit(False))


def formation_is_plausible(name: Column) -> Column:
    """Whether a text names a formation (FN-22): one to three words, none of grammar, one of them a proper name."""
    low = lower_words(_without_leading(name))
    return plausible_words(name, low, proper_words(low))


def lower_words(plain: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.regexp_replace(plain, r"(?i)\bformations?\s*$", ""), F.lit(r"([A-Za-z]+)")), F.lower)


def proper_words(low: Column) -> Column:
    return F.filter(low, lambda w: ~among(w, DESCRIPTIVE_WORDS))


def plausible_words(name: Column, low: Column, proper: Column) -> Column:
    odd = name.rlike(NOT_FORMATIONS)
    fine = F.size(low).between(1, 3) & ~F.exists(low, lambda w: among(w, GRAMMAR_WORDS)) & (F.size(proper) > 0)
    fine = fine & ((F.size(proper) == F.size(low)) | F.exists(proper, lambda w: F.length(w) >= 4)) & ~((F.size(proper) == 1) & (F.length(proper[0]) <= 2))
    return F.coalesce(fine & ~odd, F.lit(False))


def metric_kind(name: Column) -> Column:
    """A geological metric's canonical name (FN-23)."""
    return metric_kind_of(metric_kind_key(name))


def metric_kind_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(strip(name)), r"[\s-]+", "_")


def metric_kind_of(key: Column) -> Column:
    return F.coalesce(lookup(METRIC_ALIASES, key), blank_as_null(key))


def metric_label(kind: Column) -> Column:
    return F.coalesce(lookup(METRIC_LABELS, kind), F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))))


def compare_category(kind: Column) -> Column:
    return lookup(COMPARED, kind)


def metrics_compatible(wanted: Column, kind: Column) -> Column:
    """Whether evidence of a kind may answer a wanted metric (FN-24): the same kind; never one of INCOMPATIBLE; a seam listing takes seam thickness and
    quantities; quantities take each other and seams; an unknown kind answers all but thicknesses and depths."""
    blocked = F.array_contains(F.split(F.coalesce(lookup({k: ",".join(v) for k, v in INCOMPATIBLE.items()}, wanted), F.lit("")), ","), kind)
    same_family = among(wanted, QUANTITIES) & among(kind, (*QUANTITIES, "seam"))
    listing = (wanted == "seam") & among(kind, ("seam_thickness", *QUANTITIES))
    unknown = F.coalesce(kind, F.lit("")) == ""
    return F.when(wanted.isNull(), True).when(unknown, ~among(wanted, (*THICKNESS, *DEPTHS))).when(wanted == kind, True).when(blocked, False).otherwise((wanted == kind) | same_family | listing)


def infer_kind(text: Column, seam_name: Column, borehole: Column, formation_name: Column, has_thickness: Column, has_depth: Column) -> Column:
    """The metric kind that a row's evidence and columns speak of (FN-25)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    measured = has_thickness | low.rlike(r"thick\w*\D{0,40}\d+(?:\.\d+)?\s*(?:m|cm|mm|ft|metres?|meters?)\b|\d+(?:\.\d+)?\s*(?:m|cm|mm|ft|metres?|meters?)\b\D{0,20}thick")
    named = F.coalesce(F.length(seam_name) > 0, F.lit(False))
    in_formation = (F.coalesce(F.length(formation_name) > 0, F.lit(False)) | low.rlike(r"\b\w+ formation\b")) & ~named
    thick = measured | low.rlike(r"\bthick(?:ness)?\b")
    return (
        F.when(low.contains("parting") & measured & ~named, "seam_parting_thickness")
        .when(low.contains("workable") & low.contains("thickness") & measured, "minimum_workable_seam_thickness")
        .when(low.rlike(r"\boverburden\b") & thick, "overburden_thickness")
        .when(thick & in_formation & measured, "formation_thickness")
        .when(thick & measured & (named | low.rlike(r"\bseam\b")), "seam_thickness")
        .when((has_depth | low.rlike(r"\bdepth\b")) & (F.coalesce(F.length(borehole) > 0, F.lit(False)) | low.rlike(r"\bborehole\b")), "borehole_depth")
        .when((has_depth | low.rlike(r"\bdepth\b")) & (named | low.rlike(r"\bseam\b")), "seam_depth")
        .when(has_depth | low.rlike(r"\bdepth\b"), "stratigraphic_depth")
    )


def qualifier(text: Column) -> Column:
    """range, approximate, greater_than or less_than (FN-26)."""
    low = F.lower(text)
    return (
        F.when(low.rlike(r"\d\s*(?:-|–|to)\s*\d"), "range")
        .when(low.rlike(r"~|\b(?:about|approx\w*|around|nearly)\b"), "approximate")
        .when(low.rlike(r">|\b(?:more|greater) than\b|\babove \d"), "greater_than")
        .when(low.rlike(r"<|\bless than\b|\bbelow \d"), "less_than")
    )


def resource(kind: Column, corrected: Column, corrected_unit: Column, original: Column, original_unit: Column, evidence: Column) -> Column:
    """A row's resource quantity as {value, unit, tonnes} (FN-27): corrected, else original, else from the evidence."""
    is_quantity = among(kind, QUANTITIES)
    pattern = r"(?i)(\d+\.\d+)\s*(MT|million\s*tonnes?|tonnes?|t|kg)\b"
    told = F.when(evidence.rlike(r"(?i)\b(?:resources?|reserves?)\b"), found(evidence, pattern))
    told_unit = F.when(found(evidence, pattern, 2).rlike("(?i)mt|million"), "MT").otherwise(found(evidence, pattern, 2))
    whole = lambda value, unit: F.struct(value.alias("value"), unit.alias("unit"), to_tonnes(plain_number(value), unit).alias("tonnes"))
    return F.coalesce(
        F.when(is_quantity & (F.length(corrected) > 0), whole(corrected, F.coalesce(corrected_unit, original_unit))),
        F.when(is_quantity & (F.length(original) > 0), whole(original, original_unit)),
        F.when(plain_number(told) > 0, whole(told, told_unit)),
    )


def first_value(*pairs: tuple[Column, Column]) -> Column:
    """The first (value, unit) whose value isn't blank, as {value, unit, numeric} (FN-28, FN-29)."""
    return F.coalesce(*(F.when(F.length(strip(v)) > 0, F.struct(v.alias("value"), u.alias("unit"), plain_number(v).alias("numeric"))) for v, u in pairs))


def workable_value(corrected: Column, corrected_unit: Column, thickness: Column, thickness_unit: Column, low: Column, high: Column, original: Column, original_unit: Column, evidence: Column) -> Column:
    """The workable thickness that a row gives, as {value, unit, numeric} (FN-28): corrected, else its thickness, else its range, else the original value, else
    what the evidence says after "workable thickness"."""
    pattern = r"(?i)workable\s+thickness\D{0,60}?(\d+(?:[.,]\d+)?)\s*(m|cm|mm|ft|metres?|meters?)?\b"
    span = F.when((F.length(low) > 0) & (F.length(high) > 0), F.concat(low, F.lit("–"), high))
    return first_value((corrected, F.coalesce(corrected_unit, original_unit)), (thickness, thickness_unit), (span, thickness_unit), (original, original_unit), (found(evidence, pattern), F.coalesce(found(evidence, pattern, 2), F.lit("m"))))


def display_value(row: dict[str, Column]) -> Column:
    """What to show of a geological row, as {value, unit, numeric} (FN-29). ``row`` names its columns: kind, corrected_value, corrected_unit, original_value,
    original_unit, thickness, thickness_min, thickness_max, thickness_unit, depth, depth_min, depth_max, depth_unit, quality_value, quality_unit, seam, formation,
    borehole, evidence; missing ones are null. In order: the correction, a quantity, a range of thickness, a thickness, a workable thickness, a range of
    depth, a depth, the original value, a quality; a listed seam, formation or borehole where the row is of that kind or of none. Numbers are metres and tonnes."""
    c = lambda name: row.get(name, F.lit(None).cast("string"))
    show = lambda value, unit, numeric: F.when(F.length(value) > 0, F.struct(value.alias("value"), unit.cast("string").alias("unit"), numeric.cast("double").alias("numeric")))
    none = F.lit(None)
    metres = lambda value, unit: to_metres(plain_number(value), unit)
    span = lambda a, b: F.when((F.length(a) > 0) & (F.length(b) > 0), F.concat(a, F.lit("–"), b))
    quantity = resource(c("kind"), c("corrected_value"), c("corrected_unit"), c("original_value"), c("original_unit"), c("evidence"))
    workable = workable_value(c("corrected_value"), c("corrected_unit"), c("thickness"), c("thickness_unit"), c("thickness_min"), c("thickness_max"), c("original_value"), c("original_unit"), c("evidence"))
    listed = lambda kind: F.when(c("kind").isNull() | (c("kind") == kind), c(kind))
    return F.coalesce(
        show(c("corrected_value"), F.coalesce(c("corrected_unit"), c("original_unit")), none),
        F.when(among(c("kind"), QUANTITIES), show(quantity["value"], quantity["unit"], F.coalesce(plain_number(quantity["value"]), quantity["tonnes"]))),
        show(span(c("thickness_min"), c("thickness_max")), c("thickness_unit"), metres(c("thickness_min"), c("thickness_unit"))),
        show(c("thickness"), c("thickness_unit"), metres(c("thickness"), c("thickness_unit"))),
        F.when(c("kind") == "minimum_workable_seam_thickness", show(workable["value"], workable["unit"], workable["numeric"])),
        show(span(c("depth_min"), c("depth_max")), c("depth_unit"), metres(c("depth_min"), c("depth_unit"))),
        show(c("depth"), c("depth_unit"), metres(c("depth"), c("depth_unit"))),
        show(c("original_value"), c("original_unit"), none),
        show(c("quality_value"), c("quality_unit"), none),
        show(listed("seam"), none, none), show(listed("formation"), none, none), show(listed("borehole"), none, none),
    )


def latitude_longitude(text: Column) -> Column:
    """{latitude, longitude} from a labelled pair or one with hemispheres; null if out of range or unlabelled (FN-31)."""
    num = r"([+-]?\d{1,3}(?:\.\d+)?)"
    lat = F.coalesce(found(text, rf"(?i)\blat(?:itude)?\b\s*[:=]?\s*{num}"), found(text, rf"(?i){num}\s*°?\s*[NS]\b"))
    lon = F.coalesce(found(text, rf"(?i)\blong?(?:itude)?\b\s*[:=]?\s*{num}"), found(text, rf"(?i){num}\s*°?\s*[EW]\b"))
    south, west = text.rlike(rf"(?i){num}\s*°?\s*S\b"), text.rlike(rf"(?i){num}\s*°?\s*W\b")
    lat, lon = (F.when(neg, -F.abs(v.cast("double"))).otherwise(v.cast("double")) for v, neg in ((lat, south), (lon, west)))
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("latitude"), lon.alias("longitude")))


def is_verified(status: Column) -> Column:
    return among(F.lower(status), VERIFIED)


# A district whose name a country shares, and how it is shown.
DISTRICT = (r"(?i)\b(?:district\s*[:\-]?\s*)?korea\s*[,/]?\s*chhattisgarh\b", r"(?i)\bdistrict\s*[:\-]?\s*korea\b(?!\s*,?\s*republic|\s*,?\s*south)")
DISTRICT_LABEL = "Korea District, Chhattisgarh, India"


def location_label(text: Column) -> Column:
    """The label of the district that a text names (FN-34), null where it names none."""
    return F.when(F.coalesce(text.rlike(DISTRICT[0]) | text.rlike(DISTRICT[1]), F.lit(False)), DISTRICT_LABEL)


def annotated(text: Column) -> Column:
    """A text with its district's label in a line before it (FN-34), unless it begins with the label; other texts, empty and null ones as they are."""
    label = location_label(text)
    return F.when(label.isNotNull() & ~F.startswith(strip(text), label), F.concat(F.lit("["), label, F.lit("]\n"), text)).otherwise(text)
