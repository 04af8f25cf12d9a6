"""The whole extraction: files to pages, entities, counts, metadata, and what is given beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import pdf
from foliospark.operators import archive, compare, entities, pages, redaction, signatures
from foliospark.session import written
from foliospark.sources import files

VERSION = 8
PERSONS = "array<struct<name:string,email:string>>"
MAIL = f"subject string, `from` {PERSONS}, `to` {PERSONS}, cc {PERSONS}, date string, html string, attachments array<struct<filename:string,mimeType:string>>"


def mail_fields(decoded: DataFrame) -> DataFrame:
    """(doc_id, page 1, text) of mails: all fields but the body, which is their page."""
    m = decoded.where("reader = 'mail' and error is null").select("doc_id", F.from_json("metadata", MAIL).alias("m"))
    people = [F.transform(F.col(f"m.{k}"), lambda p: F.concat_ws(" ", p["name"], p["email"])) for k in ("from", "to", "cc")]
    names = F.transform("m.attachments", lambda a: a["filename"])
    text = F.concat_ws("\n", *people, "m.subject", "m.date", "m.html", names)
    return m.select("doc_id", F.lit(1).alias("page"), text.alias("text"))


def annotation_rows(requests: DataFrame) -> DataFrame:
    """(doc_id, page, annot_id, fields...) of the column `annotations`, with the fields of pdf.annotation."""
    raw = requests.select("doc_id", F.posexplode("annotations").alias("annot_id", "a")).select("doc_id", "annot_id", "a.*")
    given = {c: F.col(f"`{c}`") for c in raw.columns}
    return raw.select("doc_id", F.col("page").cast("int").alias("page"), "annot_id", *[v.alias(k) for k, v in pdf.annotation(given).items()])


def page_annotations(rows: DataFrame) -> DataFrame:
    """(doc_id, page, value): the annotations of each page as an array, in the order given."""
    names = [c for c in rows.columns if c not in ("doc_id", "page", "annot_id")]
    return rows.groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("annot_id", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("j")))), lambda x: x["j"]).alias("value"))


def page_redactions(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, page, value): for each page with findings their number and the findings, by operators.redaction."""
    items = requests.select("doc_id", F.posexplode("items").alias("ord", "i")).select("doc_id", F.col("i.page").cast("int").alias("page"), "ord", "i.str", "i.x", "i.y", "i.width", "i.height")
    at = lambda k: F.get("rect", F.lit(k))
    areas = rows.select("doc_id", "page", "annot_id", at(0).alias("x0"), at(1).alias("y0"), at(2).alias("x1"), at(3).alias("y1"), "color", "opacity", F.col("annotationType").alias("annotation_type"))
    found = redaction.sloppy_redactions(items, areas)
    one = F.struct("rect", "text", "text_rect", "annotation_type", "color", "opacity")
    return found.groupBy("doc_id", "page").agg(F.struct(F.count("*").alias("count"), F.array_sort(F.collect_list(one)).alias("findings")).alias("value"))


#: Columns of requests that say more than the file does.
MORE = ("alt_pages", "annotations", "items", "signature_report")


def identified(requests: DataFrame) -> DataFrame:
    """(doc_id, given_id, request_key, extension, content, and what else of `uri` and MORE is there): every request is a row with a doc_id of its own, whatever the
    caller's id is. request_key is a digest of all that the request says: the same in every run, and equal only for requests that have equal results."""
    there = [c for c in ("uri", *MORE) if c in requests.columns]
    said = F.to_json(F.struct(F.col("doc_id"), F.col("extension"), *[F.col(c) for c in there]), {"ignoreNullFields": "false"})
    key = F.sha2(F.concat(said, F.lit("|"), F.coalesce(F.sha2("content", 256), F.lit(""))), 256)
    return requests.select(F.monotonically_increasing_id().alias("doc_id"), F.col("doc_id").alias("given_id"), key.alias("request_key"), "extension", "content", *there)


def page_and_request_rows(decoded: DataFrame, alternatives_for: tuple[str, ...] | None) -> DataFrame:
    """(doc_id, page, text, request): a row for each page, in which the better of its text and its alternative in `alt_pages` is chosen; `request`, the other columns
    of decoded rows, stands at page 1. A request without pages has one row, without a page."""
    kept = F.struct(*[c for c in decoded.columns if c not in ("doc_id", "pages", "alt_pages")])
    given = "alt_pages" in decoded.columns
    wanted = F.lit(given) if alternatives_for is None or not given else F.col("reader").isin(*alternatives_for)
    other = lambda i: F.when(wanted, F.get("alt_pages", i)) if given else F.lit(None).cast("string")
    row = lambda page, text, alt, request: F.struct(page.cast("int").alias("page"), text.cast("string").alias("text"), alt.cast("string").alias("other"), request.alias("request"))
    each = F.transform("pages", lambda p, i: row(i + 1, p, other(i), F.when(i == 0, F.col("request"))))
    none = F.lit(None)
    rows = decoded.withColumn("request", kept).select("doc_id", F.inline(F.when(F.size("pages") > 0, each).otherwise(F.array(row(none, none, none, F.col("request"))))))
    return compare.with_own_alternatives(rows, collapsed=True) if given else rows.drop("other")


def extract(requests: DataFrame, alternatives_for: tuple[str, ...] | None = ("pdf",)) -> DataFrame:
    """One row for each request (doc_id, extension, content), in the caller's ids:
    (doc_id, success, error, version, pages, entities map<kind, array<struct<key, pages>>>, page_count, character_count, word_count, metadata VARIANT, files, files_tree, request_key).

    Requests without id, or with equal ids, are requests of their own: files are decoded and their pages written with a number for each request, and all joins are
    by that number. Equal requests have equal rows. request_key tells requests apart where ids do not. files_tree is the list of an archive's files as nested JSON, null for others.

    Alternatives in a column alt_pages array<string> replace pages where they are the better text, in files of the readers `alternatives_for` (None: all);
    their white space is collapsed. Link annotations of PDF files join the links of their text; their info dictionary is the metadata, with dates in ISO
    form. Mails are searched in all their fields, and counted by their body. Entities stand in the order of first appearance. A request that fails, one with a
    blank `uri` where there is that column among them, has an error and no result.

    What no reader here gives may be given as columns of the requests, and adds columns to the result:
    annotations array<struct<page, rect, ...>> (raw fields of pdf.annotation): page_annotations, for each page a list of JSON or null;
    items array<struct<page, str, x, y, width, height>>, with annotations: sloppy_redactions, for each page its findings or null;
    signature_report string: signatures, a list.
    """
    asked = identified(requests)
    there = [c for c in MORE if c in requests.columns]
    decoded = files.decoded(files.dispatched(asked), ("given_id", "request_key", *there))
    paged = written(page_and_request_rows(decoded, alternatives_for), "pages")  # each file is decoded once, each pair of texts scored once; row numbers are settled
    own = paged.where("coalesce(page, 1) = 1").select("doc_id", "request.*")
    good = own.where("error is null")
    found = paged.where("page is not null").select("doc_id", "page", "text")
    links = good.select("doc_id", F.inline(F.from_json(F.get_json_object("metadata", "$.annotation_links"), "array<struct<page:int,uri:string>>")))
    each = entities.everything(found, links, mail_fields(own)).groupBy("doc_id", "kind").agg(F.array_sort(F.collect_list(F.struct("first", "key", "pages"))).alias("l"))
    in_order = F.when(F.col("kind") == "domain", F.array_sort(F.transform("l", lambda x: F.struct(x["key"].alias("key"), x["pages"].alias("pages"))))).otherwise(F.transform("l", lambda x: F.struct(x["key"].alias("key"), x["pages"].alias("pages"))))
    maps = each.select("doc_id", "kind", in_order.alias("l")).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "l")))).alias("entities"))
    texts = found.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]).alias("final_pages"))
    out = own.join(texts, "doc_id", "left").join(maps, "doc_id", "left").join(pages.counts(found), "doc_id", "left")
    more = []
    if "annotations" in there:
        rows = annotation_rows(good)
        out = out.join(pages.aligned(found, page_annotations(rows), "page_annotations"), "doc_id", "left")
        more.append("page_annotations")
        if "items" in there:
            out = out.join(pages.aligned(found, page_redactions(good, rows), "sloppy_redactions"), "doc_id", "left")
            more.append("sloppy_redactions")
    if "signature_report" in there:
        said = signatures.signatures(good, "doc_id", "signature_report")
        listed = said.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("signature", F.to_json("fields").alias("fields"), "signed_ranges", "signing_time", "total_document_signed"))).alias("signatures"))
        out = out.join(listed, "doc_id", "left")
        more.append("signatures")
    listed = good.select("doc_id", F.explode("files").alias("f")).select("doc_id", "f.path", "f.is_directory", F.struct("f.size", "f.compressed_size", "f.last_modified", "f.md5", "f.error").alias("info"))
    out = out.join(archive.nested(archive.tree(listed)).withColumnRenamed("tree", "files_tree"), "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(F.col("given_id").alias("doc_id"), F.col("error").isNull().alias("success"), "error", F.lit(VERSION).alias("version"), F.coalesce("final_pages", F.array().cast("array<string>")).alias("pages"), "entities", zero("page_count"), zero("character_count"), zero("word_count"), pdf.metadata(F.col("metadata")).alias("metadata"), "files", "files_tree", *more, "request_key")


def write_results(results: DataFrame, out: str) -> None:
    """Results below `out`/results, and (doc_id, error) of requests that failed below `out`/rejects; extracted once."""
    own = written(results, "results")
    own.where("success").write.mode("overwrite").parquet(f"{out}/results")
    own.where("not success").select("doc_id", "error").write.mode("overwrite").parquet(f"{out}/rejects")
