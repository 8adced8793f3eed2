"""Small building blocks of the column functions: literal lookups and whitespace."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(table: Mapping[str, object], key: Column) -> Column:
    """The table's value for a key, null where the key is null or missing."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.when(key.isNotNull(), F.try_element_at(F.create_map(*pairs), key))


def among(key: Column, values: Iterable[str]) -> Column:
    """Whether a key is one of the values; false for null."""
    return F.coalesce(key.isin(*sorted(values)), F.lit(False))


#: What a pattern's \\s stands for.
SPACES = " \t\n\x0b\f\r"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(text, r"\s+", " "))


def blank_as_null(text: Column) -> Column:
    return F.when(F.length(text) > 0, text)


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where there is no match or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
