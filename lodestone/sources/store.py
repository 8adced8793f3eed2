"""Sources and sinks: sheets to pages, pages, chunk upserts, report datasets. Parquet in, Parquet out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.facts import one_per

BUCKETS = 64


def sheets_to_pages(cells: DataFrame, keep: int = 500) -> DataFrame:
    """One page for each sheet (SRC-4): header and rows joined by ``|``; keeps the columns, the row count and the first ``keep`` rows.
    Cells: document_id, sheet_name, row_no (0: header), col_no, text."""
    lines = cells.groupBy("document_id", "sheet_name", "row_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "text"))), lambda c: F.coalesce(c["text"], F.lit(""))), " | ").alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("row_no", "line")))
    pages = lines.groupBy("document_id", "sheet_name").agg(ordered.alias("lines"))
    texts = F.transform("lines", lambda x: x["line"])
    return pages.select("document_id", "sheet_name", F.array_join(texts, "\n").alias("text"), F.split(F.get(texts, 0), r" \| ").alias("columns"), (F.size("lines") - 1).alias("row_count"), F.slice(texts, 2, keep).alias("rows"))


def replaced(stored: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """Stored rows without those of the new rows' documents, and the new rows (SRC-5, SNK-3)."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def page_table(pages: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Pages as they are kept (SRC-5): document_id, page_number, text (empty for null), source_type, sheet_name, source_location (the given one, else the sheet, else the page) and char_count. All stored
    pages of a document that comes again give way to the new ones, however many these are. Columns that ``pages`` lacks are null; other columns are left out."""
    has = lambda c: F.col(c) if c in pages.columns else F.lit(None).cast("string")
    text = F.coalesce("text", F.lit(""))
    place = F.coalesce(has("source_location"), F.concat(F.lit("sheet "), has("sheet_name")), F.concat(F.lit("page "), F.col("page_number").cast("string")))
    new = pages.select("document_id", "page_number", text.alias("text"), has("source_type").alias("source_type"), has("sheet_name").alias("sheet_name"), place.alias("source_location"), F.length(text).alias("char_count"))
    return new if stored is None else replaced(stored, new)


def upserted(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks after an upsert (SNK-1): a document's old chunks go, the last of equal chunk ids stays (by ``version``)."""
    return replaced(stored, one_per(new, ["chunk_id"], [F.desc("version"), F.desc("content")]))


def bucket(column: Column, n: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def write_buckets(df: DataFrame, path: str) -> None:
    """Writes rows by hash bucket of document_id: a fixed number of folders, each of which a later write replaces as a whole."""
    df.withColumn("bucket", bucket(F.col("document_id"))).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def write_report(parts: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """The datasets of a report, one folder each (SNK-2)."""
    for name, df in parts.items():
        df.write.mode("overwrite").format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).save(f"{path}/{name}")
