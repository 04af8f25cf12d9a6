"""Entities of documents: what is found on which pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions import hosts as hosts_of
from foliospark.functions import patterns
from foliospark.session import written


def hits(pages: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(doc_id, kind, key, page, pos): every hit. All kinds are found in one pass over the text."""
    kinds = kinds or list(patterns.KINDS)

    def named(kind: str):
        return lambda x, i: F.struct(F.lit(kind).alias("kind"), x.alias("key"), i.alias("pos"))

    found = F.concat(*[F.transform(patterns.KINDS[k](F.col("text")), named(k)) for k in kinds])
    return pages.select("doc_id", "page", F.explode(found).alias("h")).select("doc_id", "h.kind", "h.key", "page", "h.pos")


def grouped(found: DataFrame) -> DataFrame:
    """(doc_id, kind, key, pages): distinct pages in ascending order. One shuffle, with partial aggregation before it."""
    return found.groupBy("doc_id", "kind", "key").agg(F.array_sort(F.collect_set("page")).alias("pages"))


def entities(pages: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    return grouped(hits(pages, kinds))


def lists(pages: DataFrame, kind: str) -> DataFrame:
    """(doc_id, entities array<struct<key, pages>>) in the order of first appearance."""
    by_key = hits(pages, [kind]).groupBy("doc_id", "key").agg(F.min(F.struct("page", "pos")).alias("first"), F.array_sort(F.collect_set("page")).alias("pages"))
    return by_key.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", "key", "pages"))).alias("e")).select("doc_id", F.transform("e", lambda x: F.struct(x["key"].alias("key"), x["pages"].alias("pages"))).alias("entities"))


@F.pandas_udf(T.StringType())
def host_rules(hosts_: pd.Series) -> pd.Series:
    return hosts_.map(hosts_of.host_by_rules)


def with_domain(found: DataFrame) -> DataFrame:
    """hits with `domain`: the host of links, and what follows the @ of e-mail addresses with one. Hosts of plain letters stay with built-in
    functions; the few that need IDNA or number rules go through Arrow, the others as nulls."""
    host = F.when(F.col("kind") == "link", patterns.ascii_host(F.col("key")))
    mail = F.when((F.col("kind") == "email") & (F.size(F.split("key", "@")) == 2), F.nullif(F.regexp_replace(F.substring_index("key", "@", -1), "^www\\.", ""), F.lit("")))
    odd = F.when(~F.col("__host").rlike(patterns.PLAIN_HOST), F.col("__host"))
    ruled = found.withColumn("__host", host).withColumn("__odd", odd).withColumn("__ruled", host_rules("__odd"))
    return ruled.withColumn("domain", F.coalesce(F.when(F.col("__odd").isNull(), F.col("__host")).otherwise(F.col("__ruled")), mail)).drop("__host", "__odd", "__ruled")


def hosts(found: DataFrame) -> DataFrame:
    """(doc_id, domain) of links and e-mail addresses, distinct."""
    return with_domain(found).where("domain is not null").select("doc_id", "domain").distinct()


def annotation_hits(links: DataFrame) -> DataFrame:
    """Link annotations (doc_id, page, uri) as hits. Blank addresses are left out."""
    uri = F.trim("uri")
    return links.where(uri != "").select("doc_id", F.lit("link").alias("kind"), uri.alias("key"), F.col("page").cast("int").alias("page"), F.lit(0).alias("pos"))


def everything(pages: DataFrame, annotation_links: DataFrame | None = None, fields: DataFrame | None = None) -> DataFrame:
    """(doc_id, kind, key, pages, first) of all kinds; the addresses of mailto: links are e-mails as well, and domains, of the text alone, a kind without
    pages. Link annotations (doc_id, page, uri) join the links of the text; `fields` (doc_id, page, text) are searched like pages and come before
    them. Entities of one kind are in the order of first appearance by `first`, addresses of links before others, domains in that of their names.

    Each text is searched once; its hits, few as they are, are written to the shared folder, and one grouping makes all kinds.
    """
    texts = hits(pages).withColumn("source", F.lit(1))
    if fields is not None:
        texts = texts.unionByName(hits(fields).withColumn("source", F.lit(0)))
    found = written(with_domain(texts), "hits")  # three kinds of rows come from it; the text is searched once
    links = found.where("kind = 'link'").drop("domain")
    domains = found.where("domain is not null").select("doc_id", F.lit("domain").alias("kind"), F.col("domain").alias("key"), F.lit(None).cast("int").alias("page"), "pos", "source")
    own = found.drop("domain")
    if annotation_links is not None:
        more = annotation_hits(annotation_links).withColumn("source", F.lit(2))
        links, own = links.unionByName(more), own.unionByName(more)
    mails = links.where(F.lower("key").startswith("mailto:")).withColumns({"kind": F.lit("email"), "key": F.substring("key", 8, 1 << 20)})
    rank = lambda df, n: df.withColumn("rank", F.lit(n))
    each = rank(own, 1).unionByName(rank(mails, 0)).unionByName(rank(domains, 0))
    return each.groupBy("doc_id", "kind", "key").agg(F.array_sort(F.collect_set("page")).alias("pages"), F.min(F.struct("rank", "source", "page", "pos")).alias("first"))
