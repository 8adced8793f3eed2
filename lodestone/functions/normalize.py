"""Normalisation of fields, entities, periods, months, metrics, measures, units and numbers.

Every function takes and returns columns built of native expressions. Null or blank input gives null unless said otherwise."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import among, blank_as_null, found, lookup, squeeze, strip

# Fixed values.
FIELD_ALIASES = {
    "production": "production",
    "annual_production": "production",
    "production_output": "production",
    "output": "production",
    "produced": "production",
    "production_qty": "production",
    "production_target": "production_target",
    "target_production": "production_target",
    "target": "production_target",
    "annual_target": "production_target",
    "achievement_percentage": "achievement_percentage",
    "achievement": "achievement_percentage",
    "achievement_pct": "achievement_percentage",
    "percent_achievement": "achievement_percentage",
    "ore_grade": "grade",
    "lease_area": "area",
}
TONNES = {"t": 1.0, "tonne": 1.0, "tonnes": 1.0, "ton": 1.0, "tons": 1.0, "kt": 1e3, "mt": 1e6, "million_tonnes": 1e6, "kg": 1e-3, "m.t.": 1e6, "m.t": 1e6, "mt.": 1e6, "mtonnes": 1e6}
PERCENT = ("%", "pct", "percent", "percentage")
COMMODITIES = ("coal", "lignite", "coking_coal")
COMMODITY_LABELS = {"coal": "Coal", "lignite": "Lignite", "coking_coal": "Coking Coal"}
MEASURE_LABELS = {"during": "Actual", "actual": "Actual", "upto": "Up to date", "target": "Target", "unknown": "Unknown"}
MEASURES = {"actual": "during", "during": "during", "target": "target", "planned": "target", "revised": "target", "upto": "upto", "up_to": "upto"}
NOT_ENTITIES = ("mt", "te", "na", "n/a", "total", "others", "sub total", "sub-total")
VERIFIED = ("high_confidence", "approved", "corrected")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
ABSOLUTE_TOLERANCE, RELATIVE_TOLERANCE = 0.01, 0.002


def snake(text: Column) -> Column:
    """Trimmed, lower case, runs of white space, hyphens and underscores as one underscore."""
    return F.regexp_replace(F.lower(strip(text)), r"[\s\-_]+", "_")


# Names in two steps, NAME_key() and NAME_of(): the key reads the text once, what is made of a key reads it several times. See facts.once().


def field_key(name: Column) -> Column:
    return snake(blank_as_null(name))


def field_of(key: Column) -> Column:
    return F.coalesce(lookup(FIELD_ALIASES, key), key)


def field(name: Column) -> Column:
    """The field's canonical name (FN-1)."""
    return field_of(field_key(name))


def entity_key(name: Column) -> Column:
    text = F.replace(F.lower(strip(name)), F.lit("&"), F.lit(" and "))
    text = F.regexp_replace(F.regexp_replace(text, r"[_\-/]+", " "), r"(?U)[^\w\s]", "")
    return squeeze(text)


def entity(name: Column) -> Column:
    """An entity's name for comparison (FN-2): lower case, ``&`` as and, separators as blanks, no punctuation."""
    return blank_as_null(entity_key(name))


def period_key(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.translate(F.upper(F.replace(strip(text), F.lit(" "))), "–—", "--"))


def period_of(key: Column) -> Column:
    year = r"^(?:FY)?(\d{4})(?:(-)(?:\d{2})?(\d{2}))?\R?$"
    usual = key.rlike(r"^(?:FY)?\d{4}(?:-\d\d)?\z")  # told first by one pattern, as nearly all are; nothing is to be replaced in them
    return F.when(usual, F.when(key.startswith("FY"), key).otherwise(F.concat(F.lit("FY"), key))).when(key.rlike(year), F.regexp_replace(key, year, "FY$1$2$3")).otherwise(F.lower(key))


def period(text: Column) -> Column:
    """Fiscal years as FYyyyy or FYyyyy-yy; any other text without blanks in lower case (FN-3)."""
    return period_of(period_key(text))


def unit_key(name: Column) -> Column:
    return squeeze(F.replace(F.replace(F.lower(strip(name)), F.lit("million tonnes"), F.lit("million_tonnes")), F.lit("million tons"), F.lit("million_tonnes")))


def unit_of(raw: Column) -> Column:
    key = F.when(raw.contains("million"), F.replace(raw, F.lit(" "), F.lit("_"))).otherwise(F.replace(raw, F.lit(" ")))
    mass = lookup(TONNES, key)
    percent = among(key, PERCENT)
    known = percent | mass.isNotNull()
    canonical = F.when(percent, "percent").when(mass.isNotNull(), "tonnes").otherwise(F.coalesce(blank_as_null(raw), F.lit("unknown")))
    return F.struct(canonical.alias("canonical"), F.coalesce(mass, F.lit(1.0)).alias("mult"), known.alias("compatible"), (~known).alias("review"))


def unit(name: Column) -> Column:
    """A unit as a struct {canonical, mult, compatible, review} (FN-4): masses in tonnes, percentages; others are for review."""
    return unit_of(unit_key(name))


def base_value(value: Column, unit_struct: Column) -> Column:
    return F.when(unit_struct["compatible"], value * unit_struct["mult"]).otherwise(value)


def within_tolerance(a: Column, b: Column) -> Column:
    """Whether two numbers agree absolutely or relatively (FN-5)."""
    diff = F.abs(a - b)
    return (diff <= ABSOLUTE_TOLERANCE) | (diff / F.greatest(F.abs(a), F.abs(b), F.lit(1e-12)) <= RELATIVE_TOLERANCE)


def compare(a: Column, a_unit: Column, b: Column, b_unit: Column) -> Column:
    """Two quantities as a struct {equal, conflict, unit_review, incompatible, left_base, right_base, diff} (FN-6).
    ``a_unit`` and ``b_unit`` are structs of unit()."""
    left, right = base_value(a, a_unit), base_value(b, b_unit)
    missing = left.isNull() | right.isNull()
    review = a_unit["review"] | b_unit["review"]
    differ = ~review & (a_unit["canonical"] != b_unit["canonical"])
    comparable = ~missing & ~review & ~differ
    equal = comparable & F.coalesce(within_tolerance(left, right), F.lit(False))
    return F.struct(equal.alias("equal"), (comparable & ~equal).alias("conflict"), (~comparable).alias("unit_review"), (~missing & differ).alias("incompatible"), left.alias("left_base"), right.alias("right_base"), F.when(~missing, F.abs(left - right)).alias("diff"))


def entity_match(a: Column, b: Column) -> Column:
    """How two names agree: exact, ambiguous, different or missing (FN-7)."""
    a, b = entity(a), entity(b)
    return name_match(a, b, long_words(a), long_words(b))


def long_words(name: Column) -> Column:
    """The distinct words of two letters at least of a name of entity()."""
    return F.array_distinct(F.filter(F.split(name, " "), lambda t: F.length(t) > 1))


def name_match(a: Column, b: Column, a_long: Column, b_long: Column) -> Column:
    """entity_match() for names of entity() whose long_words(), in any order, are known."""
    words = [F.split(x, " ") for x in (a, b)]
    long = [a_long, b_long]
    only = F.array_union(F.array_except(long[0], long[1]), F.array_except(long[1], long[0]))
    shared, most = F.size(F.array_intersect(long[0], long[1])), F.greatest(F.size(long[0]), F.size(long[1]))
    last = [F.element_at(w, -1) for w in words]
    codes = (F.size(words[0]) >= 2) & (F.size(words[1]) >= 2) & (words[0][0] == words[1][0]) & (last[0] != last[1]) & (F.length(last[0]) <= 2) & (F.length(last[1]) <= 2)
    both_differ = (F.size(F.array_except(long[0], long[1])) > 0) & (F.size(F.array_except(long[1], long[0])) > 0)
    return (
        F.when(a.isNull() | b.isNull(), "missing")
        .when(a == b, "exact")
        .when((F.size(long[0]) == 0) | (F.size(long[1]) == 0) | codes, "different")
        .when(shared == F.least(F.size(long[0]), F.size(long[1])), "ambiguous")
        .when((shared >= 1) & (shared >= 0.6 * most) & ~(both_differ & F.forall(only, lambda t: F.length(t) <= 2)), "ambiguous")
        .otherwise("different")
    )


def soft_match(want: Column, have: Column, aliases: dict[str, str] | None = None) -> Column:
    """Whether a stored name answers a wanted one (FN-8): equal, alias of the same name, one's words within the other's, or half of
    the words (two at least) shared. Words compare whole. ``aliases`` maps normalised names to a common one."""
    names = [entity(x) for x in (want, have)]
    if aliases:
        names = [F.coalesce(lookup(aliases, n), n) for n in names]
    words = [F.array_distinct(F.split(n, " ")) for n in names]
    sizes = [F.size(w) for w in words]
    shared = F.size(F.array_intersect(*words))
    partly = (shared >= F.least(F.lit(2), sizes[0])) & (shared >= 0.5 * sizes[0])
    return F.coalesce((names[0] == names[1]) | (shared == F.least(*sizes)) | partly, F.lit(False))


def measure(text: Column) -> Column:
    """during, target, upto, or the text itself in snake case (FN-12)."""
    key = F.translate(F.lower(strip(blank_as_null(text))), " -", "__")
    return F.coalesce(lookup(MEASURES, key), key)


def commodity(text: Column) -> Column:
    """A commodity's key, null for anything else (FN-12)."""
    key = field(F.translate(F.lower(strip(blank_as_null(text))), " -", "__"))
    return F.when(among(key, COMMODITIES), key)


def label(key: Column, labels: dict[str, str]) -> Column:
    return F.coalesce(lookup(labels, key), F.initcap(F.replace(blank_as_null(key), F.lit("_"), F.lit(" "))))


def measurement_key(text: Column | None) -> Column:
    return F.lower(strip(text)) if text is not None else F.lit(None).cast("string")


def classify(raw: Column, kind: Column) -> Column:
    """A canonical metric and a measurement's key as {commodity, metric, measure, storage_metric} (FN-10)."""
    kind = blank_as_null(F.when(kind == "actual", "during").otherwise(kind))
    material = among(raw, COMMODITIES)
    return F.struct(
        F.when(material, raw).alias("commodity"),
        F.when(material | (raw == "production_target"), "production").otherwise(raw).alias("metric"),
        F.when(raw == "production_target", "target").when(material, F.coalesce(kind, F.lit("during"))).otherwise(kind).alias("measure"),
        raw.alias("storage_metric"),
    )


def classify_metric(metric: Column, measurement: Column | None = None) -> Column:
    """A stored metric as {commodity, metric, measure, storage_metric} (FN-10)."""
    return classify(field(metric), measurement_key(measurement))


def storage_metrics(of_commodity: Column, metric: Column, of_measure: Column) -> Column:
    """The stored metrics that answer a selection, in order of preference (FN-11)."""
    c, m, k = commodity(of_commodity), field(metric), measure(of_measure)
    free = m.isNull() | (m == "production")
    some = lambda *x: F.array_distinct(F.array_compact(F.array(*x)))
    return (
        F.when(among(m, COMMODITIES), some(m))
        .when((k == "target") & (free | (m == "production_target")), some(F.lit("production_target"), F.coalesce(c, F.lit("production"))))
        .when(c.isNotNull() & free, some(c, F.lit("production")))
        .otherwise(some(F.coalesce(m, c)))
    )


def plausible_entity(name: Column) -> Column:
    """Whether a row label may be an organisation's name (FN-13)."""
    return plausible(strip(name))


def plausible(text: Column) -> Column:
    fine = F.length(text).between(2, 80) & ~text.rlike(r"^[%(]|^[\d.,\s/-]+$") & ~F.lower(text).isin(*NOT_ENTITIES)
    return F.coalesce(fine, F.lit(False))


def month(text: Column) -> Column:
    """The month that a text names by its first three letters or in full, in title case (FN-14)."""
    at = found(F.lower(text), r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)(?=[a-z]*\b|['’])")
    return F.initcap(lookup({m[:3]: m for m in MONTHS}, at))


def reporting_month(text: Column) -> Column:
    """The month after during, upto or in; else one before a year, as in Mar' 2025 or Dec'24 (FN-14)."""
    name = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
    low = F.lower(text)
    return month(F.coalesce(found(low, rf"\b(?:during|up\s?to|in)\s+(?:the\s+month\s+of\s+)?{name}\b"), found(low, rf"\b{name}\s*['’.,]?\s*(?:20)?\d\d\b")))


def header_year(text: Column) -> Column:
    """The fiscal year of a column header: FY 25, FY2024 or a month and year (FN-15). A month and year stand for that year."""
    digits = F.coalesce(found(F.upper(text), r"\bFY\s*'?(\d{4}|\d{2})\b"), found(F.lower(text), r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s*['’.]?\s*(\d{4}|\d{2})\b"))
    return F.when(digits.isNotNull(), F.concat(F.lit("FY20"), F.substring(digits, -2, 2)))


def year_start(text: Column) -> Column:
    """The first year of a fiscal year, as a number to sort by (FN-15)."""
    return F.coalesce(F.expr("1").cast("int") * found(text, r"(\d{4})").cast("int"), F.lit(2000) + found(text, r"(\d{2})").cast("int"))


def period_forms(text: Column) -> Column:
    """Spellings under which a period may stand in a text, in lower case (FN-16)."""
    year = year_start(period(text))
    s = lambda x: x.cast("string")
    two = lambda x: F.lpad(s(x % 100), 2, "0")
    ends = found(period(text), r"^FY\d{4}-(\d{2})$").isNotNull()
    single = F.array(F.concat(F.lit("fy"), s(year)), F.concat(F.lit("fy "), s(year)), F.concat(F.lit("fy"), two(year)), F.concat(F.lit("fy "), two(year)), F.concat(s(year - 1), F.lit("-"), two(year)), F.concat(s(year), F.lit("-"), two(year + 1)))
    double = F.array(F.concat(F.lit("fy"), s(year), F.lit("-"), two(year + 1)), F.concat(s(year), F.lit("-"), two(year + 1)), F.concat(s(year), F.lit("-"), s(year + 1)), F.concat(F.lit("fy"), two(year + 1)))
    return F.array_distinct(F.when(year.isNull(), F.array(F.lower(strip(text)))).when(ends, double).otherwise(single))


def number(cell: Column) -> Column:
    """A cell's first decimal (one to three places), else its first whole number (FN-17)."""
    text = F.replace(cell, F.lit(","))
    return F.coalesce(found(text, r"(-?\d+\.\d{1,3})(?!\d)"), found(text, r"(-?\d+)")).try_cast("double")


def plain_number(text: Column) -> Column:
    """A text that is a number, with or without thousands separators (FN-17)."""
    return strip(F.replace(text, F.lit(","))).try_cast("double")


def value_and_unit(text: Column) -> Column:
    """142.6 m as {value, unit}; null for other forms (FN-17)."""
    pattern = r"^\s*([+-]?\d+(?:[.,]\d+)?)\s*([A-Za-zµμ°/%]+)?\s*$"
    value = found(text, pattern)
    return F.when(value.isNotNull(), F.struct(F.replace(value, F.lit(",")).alias("value"), found(text, pattern, 2).alias("unit")))


def absolute_change(new: Column, old: Column) -> Column:
    return new - old


def percentage_change(new: Column, old: Column) -> Column:
    """{value, undefined}: percent of the old value, undefined where that is zero (FN-32)."""
    return F.struct(((new - old) / F.nullif(old, F.lit(0.0)) * 100).alias("value"), (old == 0).alias("undefined"))


def same_unit(a: Column, b: Column) -> Column:
    return F.coalesce(F.lower(strip(a)) == F.lower(strip(b)), F.lit(False))


def status_bucket(status: Column) -> Column:
    low = F.lower(status)
    return F.when(among(low, VERIFIED), "verified").when(low == "rejected", "rejected").otherwise("review_required")


def priority(confidence: Column) -> Column:
    """Review priority by confidence (FN-30)."""
    return F.when(confidence < 0.5, 3).when(confidence < 0.7, 2).otherwise(1)


def family_key(filename: Column) -> Column:
    """A file's name without extension, other characters than letters and digits as blanks (FN-33)."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(filename), r"\.[a-z0-9]{1,5}$", ""), r"[^a-z0-9]+", " "))


def slug(name: Column) -> Column:
    """A name for addresses (FN-34); ``topic`` where nothing is left."""
    return F.coalesce(blank_as_null(F.regexp_replace(F.regexp_replace(F.lower(strip(name)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")), F.lit("topic"))


# Words that a title keeps small, but for the first.
SMALL_WORDS = ("of", "the", "and", "in", "on", "for", "to", "a", "an")


def title_words(text: Column) -> Column:
    """Words with capitals, underscores as blanks (FN-34); small words stay small but for the first, abbreviations of up to four capitals stay as they are."""

    def word(w: Column, k: Column) -> Column:
        low = F.lower(w)
        short = (w == F.upper(w)) & (w != low) & (F.length(w) <= 4)
        return F.when((k > 0) & among(low, SMALL_WORDS), low).when(short, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(low, 2, 2**31 - 1)))

    return F.array_join(F.transform(F.filter(F.split(strip(text), r"[\s_]+"), lambda w: w != ""), word), " ")


def general(value: Column) -> Column:
    """A number with six significant digits and no zeros at its end, with an exponent where it is 1e6 or more or below 1e-4 (as C's %g); null, NaN and infinite values as Spark writes them."""
    said = F.format_string("%.5e", F.abs(value))
    digits, power = F.replace(F.substring_index(said, "e", 1), F.lit(".")), F.substring_index(said, "e", -1).try_cast("int")
    short = lambda x: F.regexp_replace(F.regexp_replace(x, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    tail = lambda n: F.substring(digits, n, F.lit(6))
    whole = F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), tail(power + 2))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-power - 1, F.lit(0))), digits)
    wide = F.concat(short(F.concat(F.substring(digits, 1, 1), F.lit("."), tail(F.lit(2)))), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    plain = F.when(power.between(0, 5), short(whole)).when(power.between(-4, -1), short(small)).otherwise(wide)
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), value.cast("string")).when(value == 0, "0").otherwise(F.concat(F.when(value < 0, "-").otherwise(""), plain))


def stable_id(*parts: Column) -> Column:
    """An id that depends on the parts alone (FN-35)."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def fingerprint(*parts: Column) -> Column:
    """The first 40 hex digits of SHA-256 over the parts, joined by ``|`` (FN-36)."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts)), 256), 1, 40)


# Keys of audit details that must not be shown.
SENSITIVE = ("password", "password_hash", "token", "api_key", "secret", "authorization")


def sanitize(details: Column) -> Column:
    """A flat map without its sensitive keys (FN-37)."""
    return F.map_filter(details, lambda k, _: ~among(F.lower(k), SENSITIVE))


def _without_secrets(value: object) -> object:
    return {k: _without_secrets(v) for k, v in value.items() if k.lower() not in SENSITIVE} if isinstance(value, dict) else value


def sanitize_json(details: Column) -> Column:
    """A JSON object without its sensitive keys at any depth of objects (FN-37), its keys in order; null for an empty object and for text that is none.
    Objects nest to any depth, which no native expression follows: Arrow batches of text go to Python."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                value = json.loads(text) if text else None
            except ValueError:
                return None
            return json.dumps(_without_secrets(value), separators=(",", ":")) if isinstance(value, dict) and value else None

        return texts.map(one)

    return clean(details)
