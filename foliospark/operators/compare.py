"""Choosing the better of two texts, page by page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import quality
from foliospark.functions.text import collapse


def scored(pages: DataFrame) -> DataFrame:
    """pages with their `total`, unless they have it."""
    return pages if "total" in pages.columns else quality.with_total(pages, "text", "total")


def with_alternatives(pages: DataFrame, alternatives: DataFrame, collapsed: bool = False) -> DataFrame:
    """pages (doc_id, page, text), each replaced by the alternative of its number if that is the better text; its runs of white space become one
    space if `collapsed`. Further alternatives are ignored. Texts are scored before the join, or not at all where a column `total` is there."""
    other = scored(alternatives.where("text <> ''")).select("doc_id", "page", F.col("text").alias("other"), F.col("total").alias("other_total"))
    joined = scored(pages).select("doc_id", "page", "text", "total").join(other, ["doc_id", "page"], "left")
    first = quality.first_is_better(F.col("text"), F.col("total"), F.col("other"), F.col("other_total"))
    return joined.select("doc_id", "page", F.when(first, F.col("text")).otherwise(collapse(F.col("other")) if collapsed else F.col("other")).alias("text"))


def with_own_alternatives(rows: DataFrame, collapsed: bool = False) -> DataFrame:
    """rows (text, other, ...) without `other`: texts are replaced by it where it is the better text, as by with_alternatives. Only pairs of texts that are both there are scored."""
    both = F.when((F.col("text") != "") & (F.col("other") != ""), F.struct("text", "other"))
    pair = rows.withColumn("__both", both).withColumns({"__a": F.col("__both.text"), "__b": F.col("__both.other")})
    scored = quality.with_total(quality.with_total(pair, "__a", "__a_total"), "__b", "__b_total")
    first = quality.first_is_better(F.col("text"), F.col("__a_total"), F.col("other"), F.col("__b_total"))
    other = collapse(F.col("other")) if collapsed else F.col("other")
    return scored.withColumn("text", F.when(first, F.col("text")).otherwise(other)).drop("other", "__both", "__a", "__b", "__a_total", "__b_total")


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """The better text of each page number of either side. Where both are empty the page is left out, and later ones move up."""
    one = lambda df, x, y: df.select("doc_id", "page", F.col("text").alias(x), F.lit(None).cast("string").alias(y))
    both = one(a, "a", "b").unionByName(one(b, "b", "a")).groupBy("doc_id", "page").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    some = both.where("coalesce(a, '') <> '' or coalesce(b, '') <> ''")  # a filter on the choice itself would evaluate all of it twice
    chosen = quality.with_better(some, "a", "b", "text").select("doc_id", "page", "text")
    lists = chosen.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("l"))
    return lists.select("doc_id", F.posexplode("l").alias("p", "x")).select("doc_id", (F.col("p") + 1).alias("page"), F.col("x.text").alias("text"))
