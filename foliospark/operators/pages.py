"""Documents as pages: one row (doc_id, page, text) for each, pages numbered from 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import utf16_length, word_count


def split_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: str = "\n") -> DataFrame:
    """Texts cut into pages at `by`. A null text has no pages."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.posexplode(F.split(F.col(f"`{text_col}`"), by)).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("page"), "text")


def page_rows(docs: DataFrame, pages: Column, id_col: str = "doc_id") -> DataFrame:
    """An array of pages as rows."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.posexplode(pages).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("page"), "text")


def counts(pages: DataFrame) -> DataFrame:
    """(doc_id, page_count, character_count, word_count): UTF-16 units, and runs of characters that are no white space."""
    return pages.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.coalesce(F.sum(utf16_length(F.col("text"))), F.lit(0)).alias("character_count"), F.coalesce(F.sum(word_count(F.col("text"))), F.lit(0)).alias("word_count"))


def aligned(pages: DataFrame, rows: DataFrame, out: str) -> DataFrame:
    """(doc_id, out): for each document an array with the `value` of rows (doc_id, page, value) for each of its pages, null where a page has none."""
    value = rows.select(F.col("doc_id").alias("__id"), F.col("page").alias("__page"), "value")
    own = pages.select("doc_id", "page").distinct()
    joined = own.join(value, (own["doc_id"] == value["__id"]) & (own["page"] == value["__page"]), "left")
    return joined.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "value"))), lambda x: x["value"]).alias(out))
