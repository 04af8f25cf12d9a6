"""Signature reports, as printed by a verification tool, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import camel_case, trim


def report_fields(reports: DataFrame, id_col: str = "doc_id", text_col: str = "report") -> DataFrame:
    """(doc_id, signature, key, value, ord): the fields of each signature. A line "Signature #n:" opens one; "- key: value" belongs to it."""
    # the patterns of the lines are those of the tool's output (fixed values)
    lines = reports.select(F.col(f"`{id_col}`").alias("doc_id"), F.posexplode(F.split(f"`{text_col}`", "\n")).alias("ord", "raw")).withColumn("line", trim(F.col("raw")))
    number = F.expr(r"try_cast(nullif(regexp_extract(line, '^Signature #([0-9]+):$', 1), '') as int)")
    own = lines.withColumn("signature", F.last(number, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("ord"))).where("signature is not null")
    key, value = F.regexp_extract("line", r"^-\s*(.+?):\s*(.+)$", 1), F.regexp_extract("line", r"^-\s*(.+?):\s*(.+)$", 2)
    pairs = own.where(key != "").select("doc_id", "signature", camel_case(key).alias("key"), value.alias("value"), "ord")
    signed = own.where(F.col("line").startswith("- Total document signed") & (key == "")).select("doc_id", "signature", F.lit("totalDocumentSigned").alias("key"), F.lit("true").alias("value"), "ord")
    return pairs.unionByName(signed)


def signatures(reports: DataFrame, id_col: str = "doc_id", text_col: str = "report") -> DataFrame:
    """(doc_id, signature, fields map<string,string>, signed_ranges array<array<double>>, signing_time timestamp, total_document_signed)."""
    own = report_fields(reports, id_col, text_col)
    last = own.groupBy("doc_id", "signature", "key").agg(F.max_by("value", "ord").alias("value"))
    fields = last.groupBy("doc_id", "signature").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("fields"))
    ranges = F.transform(F.split(F.col("fields")["signedRanges"], r"\], \["), lambda r: F.transform(F.split(F.regexp_replace(r, r"[\[\]]", ""), " - "), lambda x: x.try_cast("double")))
    return fields.select("doc_id", "signature", "fields", ranges.alias("signed_ranges"), F.try_to_timestamp(F.col("fields")["signingTime"], F.lit("MMM dd yyyy HH:mm:ss")).alias("signing_time"), F.coalesce(F.col("fields")["totalDocumentSigned"] == "true", F.lit(False)).alias("total_document_signed"))
