"""Statements of pages: each pattern runs once over a text, and joins carry no texts."""

import re

from pyspark.sql import functions as F

from lodestone.operators import extract as T

PLAIN = r"(?i)([\w\s\-/]+?)\s+produced\s+(\d+(?:\.\d+)?)\s*(MT|tonnes|tons|kt)\b(?:[^\n.]{0,80}?during\s+(FY\s?\d{4}|\d{4}-\d{2}|\d{4}/\d{2}))?"
TEXTS = [
    "In all. Mine  A/1-b\n produced 5.5 MT of coal, during FY 2024. Pit produced 7 kt",
    "x produced much; y PRODUCED 3 tonnes during 2023-24, against a target of 4 tons. Achıevement of 75.5 %. GRADE = 4 %. reſerves: 12 MT",
    " produced 5 MT",
    "a b c " * 50 + "produced 9 MTs, Ä produced 9 kt",
    "Pr0ducti0n: 7.5 M? Ore grade of 3% Reserves of 8 tonnes",
    "no figures were produced",
    None,
]


def test_statements_are_those_of_the_plain_patterns(spark):
    pages = spark.createDataFrame(list(enumerate(TEXTS)), "document_id int, text string")
    got = {(r.document_id, r.field): r for r in T.production_drafts(pages).collect()}
    for n, text in enumerate(TEXTS):
        m = re.search(PLAIN, text or "")
        r = got.get((n, "production"))
        if m:
            assert (r.entity, r.value, r.unit, r.year, r.evidence) == (m[1].strip(" \t\n"), m[2], m[3], m[4] and m[4].replace(" ", ""), m[0].strip(" \t\n"))
        else:
            assert r is None or r.evidence.startswith("Pr0d")
    assert {(n, f, r.value) for (n, f), r in got.items() if f != "production"} == {(1, "production_target", "4"), (1, "achievement_percentage", "75.5"), (1, "grade", "4"), (1, "reserves", "12"), (4, "grade", "3"), (4, "reserves", "8")}


def test_joins_carry_no_texts_and_patterns_run_once(spark):
    pages = spark.createDataFrame([(n, 1, t, True) for n, t in enumerate(TEXTS)], "document_id int, page_number int, text string, is_ocr boolean")
    words = spark.createDataFrame([(0, 1, 70.0, ["5.5"])], "document_id int, page_number int, mean_confidence double, low_decimals array<string>")
    out = T.scored_drafts(T.production_drafts(pages), words)
    text = out.select("document_id", "field", "evidence", "confidence")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"regexp_extract\(text#\d+, [^,]*produced", text)) == 1
    joined = text[text.index("Join ") :].split("Project [", 1)[1].splitlines()[0]
    assert "evidence" in joined and not any(c.startswith("text#") for c in joined.split(", "))
    assert {(r.document_id, r.field): r.confidence for r in out.where("document_id = 0").collect()} == {(0, "production"): 0.44}


def test_a_long_run_of_words_is_read_once(spark):
    from time import perf_counter

    long = spark.range(1).select(F.lit(1).alias("document_id"), F.concat(F.repeat(F.lit("word "), 20_000), F.lit("produced nothing")).alias("text"))
    began = perf_counter()
    assert T.production_drafts(long).count() == 0
    assert perf_counter() - began < 30
