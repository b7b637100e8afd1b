"""Documents to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.dates import append_date_tokens
from quarry.functions.pages import split_pages, split_sections, split_windows
from quarry.functions.text import bound, normalize, strip


def pages_to_documents(files: DataFrame, text: str = "text", marked: bool = False, force_page: bool = False) -> DataFrame:
    """One row for each page that is not blank; page is the ordinal of the part, set if forced or if there are several marked ones."""
    parts = split_pages(normalize(F.col(text)), marked)
    exploded = files.withColumn("__parts", parts).select("*", F.posexplode_outer("__parts").alias("doc_pos", "__part"))
    page = (F.col("doc_pos") + 1).cast("int")
    number = page if force_page else F.when(F.size("__parts") > 1, page) if marked else F.lit(None).cast("int")
    shaped = exploded.withColumn("page", number).withColumn(text, strip(F.col("__part"))).drop("__parts", "__part")
    return shaped.where(F.col(text) != "")


def is_table_row(sheet: Column, row: Column) -> Column:
    return sheet.isNotNull() & row.isNotNull()


def wants_dates(source_type: Column, sheet: Column, row: Column) -> Column:
    return F.coalesce(F.lower(source_type).isin("xls", "xlsx"), F.lit(False)) | is_table_row(sheet, row)


def chunk(docs: DataFrame, size: int = 800, overlap: int = 100, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs (doc_id, doc_pos, text, source_type, sheet, row, ...) with one row for each chunk and its number in the file.

    A table row is one chunk; other texts are cut into sections and these into windows. All cutting happens inside the row; the only
    shuffle numbers a file's chunks.
    """
    dated = F.when(wants_dates(F.col("source_type"), F.col("sheet"), F.col("row")), append_date_tokens(F.col("text"))).otherwise(F.col("text"))
    whole = is_table_row(F.col("sheet"), F.col("row"))
    pieces = bound(dated, lambda t: F.when(whole, F.array(t)).otherwise(F.flatten(F.transform(split_sections(t), lambda s: split_windows(s, size, overlap)))))
    cut = docs.withColumn("__pieces", pieces).select("*", F.posexplode_outer("__pieces").alias("__pos", "__piece"))  # outer: else the plan computes the pieces again to filter them
    clean = cut.withColumn("text", strip(F.col("__piece"))).where(F.col("text") != "").drop("__pieces", "__piece")
    order = Window.partitionBy(*key).orderBy("doc_pos", "__pos")
    return clean.withColumn("chunk_id", (F.row_number().over(order) - 1).cast("int")).drop("__pos")
