"""The registered queries, and for each the DuckDB SQL of the same result.

Inputs are the given tables or expressions over them, so that work grows with the tables: sentences with codes from customer, accounts
from supplier, dates from orders, rectangles from lineitem, and archives, mails, images and PDF files written from documents in tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import patterns, pdf, quality, text
from foliospark.operators import archive, compare, entities, pages, redaction, signatures
from foliospark.plans import fixtures
from foliospark.session import spread
from foliospark.sources import files
from foliospark.sources.formats import EXTENSIONS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(own) if name in ("documents", "pages") else own


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def joined_pages(c: str = "pages") -> Column:
    return F.array_join(F.transform(F.col(c), lambda p: p.cast("string")), ",").alias("pages")


# --- entities ---

SPLIT = "SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page FROM documents"
EMAIL_SQL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
LINK_SQL = r"\b(?:https?://|mailto:|tel:)[^\s/$.?#].[^\s]*\b"
PHONE_SQL = r"(?:^|[^0-9])\(*(?:(?:\+370|370|8|0)[\s\-.()]*)?(?:6(?:[\s\-.()]*[0-9]){7}|[2-7](?:[\s\-.()]*[0-9]){7}|[2-7][0-9](?:[\s\-.()]*[0-9]){6})"


def grouped_sql(rows: str, key: str) -> str:
    return f"SELECT doc_id, {key}, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages FROM (SELECT DISTINCT doc_id, page, {key} FROM ({rows})) GROUP BY doc_id, {key}"


def matches_sql(source: str, pattern: str, key: str) -> str:
    return f"SELECT doc_id, page, unnest(regexp_extract_all(text, '{pattern}')) AS {key} FROM ({source})"


def phones_sql(source: str) -> str:
    # no look-ahead there: non-digits are doubled, so that a number may consume the one behind it and the next still have one in front
    raw = f"SELECT doc_id, page, unnest(regexp_extract_all(regexp_replace(text, '([^0-9])', '\\1\\1', 'g'), '({DOUBLED})(?:[^0-9]|$)', 1)) AS raw FROM ({source})"
    clean = f"SELECT doc_id, page, regexp_replace(replace(regexp_replace(raw, '[\\s\\-.():]', '', 'g'), '++', '+'), '^([^0-9+])[^0-9+]*', '\\1') AS c FROM ({raw})"
    form = f"SELECT doc_id, page, CASE WHEN c LIKE '+370%' THEN c WHEN c LIKE '370%' THEN '+' || c WHEN c LIKE '8%' OR c LIKE '0%' THEN '+370' || substr(c, 2) WHEN regexp_matches(c, '^[2-7][0-9]{{6,7}}$') THEN '+370' || c END AS phone FROM ({clean})"
    return f"SELECT * FROM ({form}) WHERE phone IS NOT NULL AND NOT regexp_matches(phone, '^\\+370[12]')"


DOUBLED = PHONE_SQL.replace(r"\(*(?:(?:\+370", r"(?:\(\()*(?:(?:\+\+370").replace(r"(?:^|[^0-9])", r"(?:^|[^0-9])")


@query("email_pages", grouped_sql(matches_sql(SPLIT, EMAIL_SQL, "email"), "email"))
def email_pages(spark, sf_dir):
    found = entities.entities(pages.split_pages(table(spark, sf_dir, "documents")), ["email"])
    return found.select("doc_id", F.col("key").alias("email"), joined_pages())


@query("email_domains", f"SELECT DISTINCT doc_id, regexp_replace(regexp_extract(email, '@(.*)$', 1), '^www\\.', '') AS domain FROM ({matches_sql(SPLIT, EMAIL_SQL, 'email')})")
def email_domains(spark, sf_dir):
    return entities.hosts(entities.hits(pages.split_pages(table(spark, sf_dir, "documents")), ["email"]))


URL_PAGES = "SELECT page_id AS doc_id, 1 AS page, 'See ' || url || '/. Or (' || url || ')' AS text FROM pages UNION ALL SELECT page_id, 2, 'mailto:info' || page_id || '@example.org and ' || url FROM pages"


def url_pages(spark, sf_dir):
    two = F.array(F.concat(F.lit("See "), "url", F.lit("/. Or ("), "url", F.lit(")")), F.concat(F.lit("mailto:info"), F.col("page_id").cast("string"), F.lit("@example.org and "), "url"))
    return pages.page_rows(table(spark, sf_dir, "pages"), two, "page_id")


@query("link_pages", grouped_sql(matches_sql(URL_PAGES, LINK_SQL, "uri"), "uri"))
def link_pages(spark, sf_dir):
    return entities.entities(url_pages(spark, sf_dir), ["link"]).select("doc_id", F.col("key").alias("uri"), joined_pages())


HOST_SQL = "nullif(regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract({0}, '^https?:/*([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '^www\\.', ''), '')"


@query("url_domains", f"SELECT DISTINCT page_id AS doc_id, {HOST_SQL.format('url')} AS domain FROM pages WHERE {HOST_SQL.format('url')} IS NOT NULL")
def url_domains(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit("link").alias("kind"), F.col("url").alias("key"))
    return entities.hosts(rows)


@query("href_links", "SELECT page_id, uri, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS uri FROM pages) GROUP BY page_id, uri")
def href_links(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("uri"))
    return found.groupBy("page_id", "uri").agg(F.count("*").alias("n"))


CUSTOMER_PAGES = "SELECT c_custkey AS doc_id, 1 AS page, 'Code ' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || ', tel. +370 6' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS text FROM customer UNION ALL SELECT c_custkey, 2, 'fax: (8 5) 2' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || ';' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || ' x' FROM customer"


def customer_pages(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    two = F.array(F.concat(F.lit("Code "), F.lpad(key, 9, "0"), F.lit(", tel. +370 6"), F.lpad(key, 7, "0")), F.concat(F.lit("fax: (8 5) 2"), F.lpad(key, 6, "0"), F.lit(";"), F.lpad(key, 9, "0"), F.lit(" x")))
    return pages.page_rows(table(spark, sf_dir, "customer"), two, "c_custkey")


@query("company_codes", grouped_sql(matches_sql(CUSTOMER_PAGES, r"\b[0-9]{9}\b", "code"), "code"))
def company_codes(spark, sf_dir):
    return entities.entities(customer_pages(spark, sf_dir), ["company_code"]).select("doc_id", F.col("key").alias("code"), joined_pages())


PHONE_SOURCE = f"{SPLIT} UNION ALL SELECT -doc_id - 1, text, page FROM ({CUSTOMER_PAGES})"


@query("phone_pages", grouped_sql(phones_sql(PHONE_SOURCE), "phone"))
def phone_pages(spark, sf_dir):
    both = pages.split_pages(table(spark, sf_dir, "documents")).unionByName(customer_pages(spark, sf_dir).withColumn("doc_id", -F.col("doc_id") - 1))
    return entities.entities(both, ["phone"]).select("doc_id", F.col("key").alias("phone"), joined_pages())


SUPPLIER_PAGES = "SELECT s_suppkey AS doc_id, 1 AS page, 'Pay to LT' || lpad(CAST(s_suppkey AS VARCHAR), 18, '7') || '.' AS text FROM supplier UNION ALL SELECT s_suppkey, 2, 'not lt12 nor LT' || s_suppkey || ' but LV80BANK' || lpad(CAST(s_suppkey AS VARCHAR), 13, '0') FROM supplier"


@query("iban_pages", grouped_sql(matches_sql(SUPPLIER_PAGES, r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", "iban"), "iban"))
def iban_pages(spark, sf_dir):
    key = F.col("s_suppkey").cast("string")
    two = F.array(F.concat(F.lit("Pay to LT"), F.lpad(key, 18, "7"), F.lit(".")), F.concat(F.lit("not lt12 nor LT"), key, F.lit(" but LV80BANK"), F.lpad(key, 13, "0")))
    return entities.entities(pages.page_rows(table(spark, sf_dir, "supplier"), two, "s_suppkey"), ["iban"]).select("doc_id", F.col("key").alias("iban"), joined_pages())


WORDS_SQL = r"[^\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
COUNTS_SQL = f"CAST(count(*) AS BIGINT) AS page_count, CAST(sum(length(text) + len(regexp_extract_all(text, '[\\x{{10000}}-\\x{{10FFFF}}]'))) AS BIGINT) AS character_count, CAST(sum(len(regexp_extract_all(text, '{WORDS_SQL}'))) AS BIGINT) AS word_count"


@query("doc_counts", f"SELECT doc_id, {COUNTS_SQL} FROM ({SPLIT}) GROUP BY doc_id")
def doc_counts(spark, sf_dir):
    return pages.counts(pages.split_pages(table(spark, sf_dir, "documents")))


@query("conversation_counts", f"SELECT conv_id AS doc_id, {COUNTS_SQL} FROM conversations GROUP BY conv_id")
def conversation_counts(spark, sf_dir):
    return pages.counts(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text"))


ALL_SOURCE = f"{SPLIT} UNION ALL SELECT -doc_id - 1, text, page FROM ({URL_PAGES})"
ALL_HITS = f"""SELECT doc_id, page, 'company_code' AS kind, unnest(regexp_extract_all(text, '\\b[0-9]{{9}}\\b')) AS key FROM src
UNION ALL SELECT doc_id, page, 'iban', unnest(regexp_extract_all(text, '\\b[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}\\b')) FROM src
UNION ALL SELECT doc_id, page, 'email', unnest(regexp_extract_all(text, '{EMAIL_SQL}')) FROM src
UNION ALL SELECT doc_id, page, 'link', unnest(regexp_extract_all(text, '{LINK_SQL}')) FROM src
UNION ALL SELECT doc_id, page, 'phone', phone FROM ({phones_sql('SELECT * FROM src')})"""


@query(
    "entities_all",
    f"""WITH src AS ({ALL_SOURCE}), hits AS ({ALL_HITS}), more AS (SELECT * FROM hits UNION ALL SELECT doc_id, page, 'email', substr(key, 8) FROM hits WHERE kind = 'link' AND lower(key) LIKE 'mailto:%'),
dom AS (SELECT DISTINCT doc_id, CASE WHEN kind = 'link' THEN {HOST_SQL.format('key')} ELSE regexp_replace(regexp_extract(key, '@(.*)$', 1), '^www\\.', '') END AS key FROM hits WHERE kind IN ('link', 'email'))
SELECT doc_id, kind, key, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages FROM (SELECT DISTINCT doc_id, kind, key, page FROM more) GROUP BY doc_id, kind, key
UNION ALL SELECT doc_id, 'domain', key, '' FROM dom WHERE key IS NOT NULL""",
)
def entities_all(spark, sf_dir):
    both = pages.split_pages(table(spark, sf_dir, "documents")).unionByName(url_pages(spark, sf_dir).withColumn("doc_id", -F.col("doc_id") - 1))
    return entities.everything(both).select("doc_id", "kind", "key", joined_pages())


# --- quality ---

#: Some criteria are zero on plain documents: a second text of each has Lithuanian letters and digits within words.
SECOND_SQL = "regexp_replace(translate(text, 'aeiu', 'ąęįų'), '([a-z])or', '\\1o7r', 'g')"


def second(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, "aeiu", "ąęįų"), "([a-z])or", "$1o7r")


def measure_sql(source: str) -> str:
    w = "trim(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}{1}]+', ' ', 'g'), ' ')"
    return f"""SELECT doc_id, which, text, string_split({w.format('text', '')}, ' ') AS w, string_split({w.format('text', '–—-')}, ' ') AS d,
 CAST(length(text) AS DOUBLE) AS size, CAST(len(regexp_extract_all(text, '\\p{{L}}')) AS DOUBLE) AS letters, CAST(len(regexp_extract_all(text, '[{quality.LITHUANIAN}]')) AS DOUBLE) AS lt FROM ({source})"""


def falling_sql(r: str, good: float, bad: float, span: str | None = None) -> str:
    return f"CASE WHEN {r} <= {good} THEN 1.0 WHEN {r} >= {bad} THEN 0.0 ELSE ({bad}::DOUBLE - {r}) / {span or f'({bad}::DOUBLE - {good}::DOUBLE)'} END"


def count_sql(pattern: str) -> str:
    return f"CAST(len(regexp_extract_all(text, '{pattern}')) AS DOUBLE)"


N = "CAST(len(w) AS DOUBLE)"
MEAN = f"(CAST(list_sum(list_transform(w, lambda x: length(x))) AS DOUBLE) / {N})"
DIA = "(lt / nullif(letters, 0))"
CAPS = f"(CAST(len(list_filter(w, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) AS DOUBLE) / {N})"
MARKS = f"({count_sql('[.!?]')} / {N})"
SHORT = f"(CAST(len(list_filter(w, lambda x: length(x) <= 3)) AS DOUBLE) / {N})"
LONG = f"(CAST(len(list_filter(w, lambda x: length(x) > 20)) AS DOUBLE) / {N})"
SINGLE = f"(CAST(len(list_filter(w, lambda x: length(x) = 1)) AS DOUBLE) / {N})"
JUNK = f"({count_sql(quality.JUNK)} / nullif(size, 0))"
INNER = f"(CAST(len(list_filter(w, lambda x: length(x) > 2 AND regexp_matches(substr(x, 2, length(x) - 2), '[{quality.CAPITALS}]'))) AS DOUBLE) / nullif(len(list_filter(w, lambda x: length(x) > 2)), 0) * 100)"
DIGITS = "(CAST(len(list_filter(d, lambda x: length(x) > 2 AND NOT regexp_matches(x, '[–—-]') AND len(regexp_extract_all(x, '[0-9]')) < 3 AND regexp_matches(substr(x, 2, length(x) - 2), '[0-9]'))) AS DOUBLE) / nullif(len(list_filter(d, lambda x: length(x) > 2)), 0) * 100)"
SCORES_SQL = {
    "word_length": f"greatest(0.0, CASE WHEN {MEAN} < 5 THEN 1 - (5 - {MEAN}) / 2 WHEN {MEAN} > 11 THEN 1 - ({MEAN} - 11) / 2 ELSE 1.0 END)",
    "diacritics": f"CASE WHEN {DIA} IS NULL OR {DIA} < 0.01 OR {DIA} > 0.3 THEN 0.0 WHEN {DIA} < 0.05 THEN ({DIA} - 0.01) / 0.04 WHEN {DIA} <= 0.2 THEN 1.0 ELSE (0.3 - {DIA}) / 0.1 END",
    "junk_symbols": f"CASE WHEN {JUNK} IS NULL THEN 0.0 ELSE {falling_sql(JUNK, 0.02, 0.1)} END",
    "capitalised": f"CASE WHEN {CAPS} = 0 THEN 0.5 WHEN {CAPS} < 0.01 THEN 0.5 + {CAPS} / 0.01 * 0.5 WHEN {CAPS} <= 0.1 THEN 1.0 WHEN {CAPS} <= 0.2 THEN (0.2 - {CAPS}) / 0.1 ELSE 0.0 END",
    "sentence_marks": f"CASE WHEN {MARKS} < 0.03 THEN {MARKS} / 0.03 WHEN {MARKS} > 0.13 THEN (1 - {MARKS}) / 0.87 ELSE 1.0 END",
    "long_words": falling_sql(LONG, 0.02, 0.1),
    "short_words": falling_sql(SHORT, 0.1, 0.3, "0.25"),
    "plain_letters": f"coalesce(({count_sql('[a-zA-Z0-9]')} + lt) / nullif(size, 0), 0.0)",
    "single_letters": falling_sql(SINGLE, 0.03, 0.05),
    "inner_capitals": f"coalesce(CASE WHEN {INNER} IS NULL THEN NULL ELSE {falling_sql(INNER, 1.0, 3.0)} END, 1.0)",
    "inner_digits": f"coalesce(CASE WHEN {DIGITS} IS NULL THEN NULL ELSE {falling_sql(DIGITS, 1.0, 15.0)} END, 1.0)",
    "not_empty": "CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN -100.0 ELSE 1.0 END",
}
BOTH_SQL = f"SELECT doc_id, 1 AS which, text FROM documents UNION ALL SELECT doc_id, 2, {SECOND_SQL} FROM documents"
TOTAL_SQL = " + ".join(f"({s}) * {quality.WEIGHTS[k]}" for k, s in SCORES_SQL.items())


def both_texts(spark, sf_dir) -> DataFrame:
    own = table(spark, sf_dir, "documents")
    return own.select("doc_id", F.posexplode(F.array(F.col("text"), second(F.col("text")))).alias("k", "text")).select("doc_id", (F.col("k") + 1).alias("which"), "text")


def criterion(name: str):
    def run(spark, sf_dir):
        measured = quality.with_measures(both_texts(spark, sf_dir), "text", "m")
        return measured.select("doc_id", "which", F.round(quality.scores("m", F.col("text"))[name], 6).alias("score"))

    return run


for _name, _sql in SCORES_SQL.items():
    query(f"quality_{_name}", f"SELECT doc_id, which, round(CAST({_sql} AS DOUBLE), 6) AS score FROM ({measure_sql(BOTH_SQL)})")(criterion(_name))


@query("quality_total", f"SELECT doc_id, which, round(CAST({TOTAL_SQL} AS DOUBLE), 6) AS total FROM ({measure_sql(BOTH_SQL)})")
def quality_total(spark, sf_dir):
    return quality.with_total(both_texts(spark, sf_dir), "text", "t").select("doc_id", "which", F.round("t", 6).alias("total"))


@query(
    "quality_best_of",
    f"""WITH s AS (SELECT doc_id, text, round(CAST({TOTAL_SQL} AS DOUBLE), 9) AS t FROM ({measure_sql('SELECT doc_id, 1 AS which, text FROM documents')}))
SELECT a.doc_id, sha256(CASE WHEN b.text IS NULL OR b.text = '' THEN a.text WHEN a.t >= b.t THEN a.text ELSE b.text END) AS text_sha256 FROM s a LEFT JOIN s b ON b.doc_id = a.doc_id + 1""",
)
def quality_best_of(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    scored = compare.scored(own).repartition("doc_id")  # one exchange that both sides reuse: each text is scored once
    chosen = compare.with_alternatives(scored, scored.withColumn("doc_id", F.col("doc_id") - 1))
    return chosen.select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@query(
    "merge_pages",
    f"""WITH a AS (SELECT doc_id, page, text FROM ({SPLIT})), b AS (SELECT doc_id, page + 1 AS page, reverse(text) AS text FROM ({SPLIT}) WHERE page % 2 = 0),
sa AS (SELECT doc_id, which AS page, text, {TOTAL_SQL} AS t FROM ({measure_sql('SELECT doc_id, page AS which, text FROM a')})), sb AS (SELECT doc_id, which AS page, text, {TOTAL_SQL} AS t FROM ({measure_sql('SELECT doc_id, page AS which, text FROM b')})),
j AS (SELECT coalesce(sa.doc_id, sb.doc_id) AS doc_id, coalesce(sa.page, sb.page) AS page, CASE WHEN sb.text IS NULL OR sb.text = '' THEN sa.text WHEN sa.text IS NULL OR sa.text = '' THEN sb.text WHEN round(sa.t, 9) >= round(sb.t, 9) THEN sa.text ELSE sb.text END AS text FROM sa FULL JOIN sb ON sa.doc_id = sb.doc_id AND sa.page = sb.page)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS page, sha256(text) AS text_sha256 FROM j WHERE text IS NOT NULL AND text <> ''""",
)
def merge_pages(spark, sf_dir):
    a = pages.split_pages(table(spark, sf_dir, "documents"))
    b = a.where("page % 2 = 0").select("doc_id", (F.col("page") + 1).alias("page"), F.reverse("text").alias("text"))
    return compare.merged(a, b).select("doc_id", F.col("page").cast("long").alias("page"), F.sha2("text", 256).alias("text_sha256"))


@query("quality_vs_labels", f"SELECT quality, count(*) AS n, round(avg(t), 4) AS mean_total FROM (SELECT doc_id, CAST({TOTAL_SQL} AS DOUBLE) AS t FROM ({measure_sql('SELECT doc_id, 1 AS which, text FROM documents')})) JOIN labels USING (doc_id) GROUP BY quality")
def quality_vs_labels(spark, sf_dir):
    scored = quality.with_total(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "t")
    return scored.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.round(F.avg("t"), 4).alias("mean_total"))


# --- PDF values and geometry ---

ITEMS_SQL = "SELECT l_orderkey AS doc_id, CAST(l_linenumber % 2 AS BIGINT) AS page, l_orderkey * 10 + l_linenumber AS ord, 'w' || l_partkey AS str, l_quantity * 10 AS x, CAST(l_suppkey % 300 AS DOUBLE) AS y, 20.0 AS width, 10.0 AS height FROM lineitem"
AREAS_SQL = "SELECT l_orderkey AS doc_id, CAST(l_linenumber % 2 AS BIGINT) AS page, l_orderkey * 10 + l_linenumber AS annot_id, l_quantity * 10 AS x0, CAST(l_partkey % 300 AS DOUBLE) AS y0, l_quantity * 10 + 30 AS x1, CAST(l_partkey % 300 + 100 AS DOUBLE) AS y1, CASE l_linenumber % 3 WHEN 0 THEN '#000000' WHEN 1 THEN '#FF0000' ELSE '#00ff00' END AS color, CASE WHEN l_discount = 0 THEN 0.0 ELSE 1.0 END AS opacity, 'SQUARE' AS annotation_type FROM lineitem"


@query(
    "redaction_overlap",
    f"""WITH i AS ({ITEMS_SQL}), a AS ({AREAS_SQL})
SELECT i.doc_id, i.page, x0, y0, string_agg(str, ' ' ORDER BY ord, annot_id, str, x) AS text, arg_min(x, (ord, annot_id, str, x)) AS first_x, arg_min(lower(color), (ord, annot_id, str, x)) AS color, count(*) AS n_items
FROM i JOIN a ON i.doc_id = a.doc_id AND i.page = a.page AND x0 - (x + width) <= 2 AND y0 - (y + height) <= 2 AND x1 - x >= 2 AND y1 - y >= 2
WHERE lower(color) IN ('#000000', '#ff0000') AND opacity <> 0 GROUP BY i.doc_id, i.page, x0, y0, x1, y1""",
)
def redaction_overlap(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    key = [F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).cast("long").alias("page")]
    place = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    y = lambda c: (F.col(c) % 300).cast("double")
    items = line.select(*key, place.alias("ord"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("str"), (F.col("l_quantity") * 10).alias("x"), y("l_suppkey").alias("y"), F.lit(20.0).alias("width"), F.lit(10.0).alias("height"))
    areas = line.select(*key, place.alias("annot_id"), (F.col("l_quantity") * 10).alias("x0"), y("l_partkey").alias("y0"), (F.col("l_quantity") * 10 + 30).alias("x1"), (y("l_partkey") + 100).alias("y1"), F.when(F.col("l_linenumber") % 3 == 0, "#000000").when(F.col("l_linenumber") % 3 == 1, "#FF0000").otherwise("#00ff00").alias("color"), F.when(F.col("l_discount") == 0, 0.0).otherwise(1.0).alias("opacity"), F.lit("SQUARE").alias("annotation_type"))
    found = redaction.sloppy_redactions(items, areas)
    return found.select("doc_id", "page", F.col("rect")[0].alias("x0"), F.col("rect")[1].alias("y0"), "text", F.col("text_rect")[0].alias("first_x"), F.lower("color").alias("color"), "n_items")


@query("annotation_flags", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"((l_partkey % 1024) & {1 << k}) <> 0 AS \"{n}\"" for k, n in enumerate(pdf.FLAGS)) + " FROM lineitem WHERE l_partkey % 1024 <> 0")
def annotation_flags(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", pdf.flags(F.col("l_partkey") % 1024).alias("f"))
    return line.where("f is not null").select("l_orderkey", "l_linenumber", "f.*")


DATES_SQL = "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, 'D:%Y%m%d%H%M%S') || 'Z' WHEN 1 THEN strftime(o_orderdate, 'D:%Y%m') WHEN 2 THEN strftime(o_orderdate, 'D:%Y%m%d%H%M%S') || '+02''30''' WHEN 3 THEN strftime(o_orderdate, 'D:%Y%m%d%H%M%S') || '-05' ELSE strftime(o_orderdate, '%Y%m%d') END AS raw FROM orders"


@query(
    "pdf_dates",
    f"""WITH r AS ({DATES_SQL}), p AS (SELECT o_orderkey, raw, regexp_extract(raw, '^D:([0-9]{{4}})([0-9]{{2}})?([0-9]{{2}})?([0-9]{{2}})?([0-9]{{2}})?([0-9]{{2}})?([Z+-])?([0-9]{{2}})?''?([0-9]{{2}})?', ['y','m','d','h','i','s','z','zh','zm']) AS g FROM r)
SELECT o_orderkey, CASE WHEN raw LIKE 'D:%' THEN g.y || '-' || coalesce(nullif(g.m, ''), '01') || '-' || coalesce(nullif(g.d, ''), '01') || 'T' || coalesce(nullif(g.h, ''), '00') || ':' || coalesce(nullif(g.i, ''), '00') || ':' || coalesce(nullif(g.s, ''), '00') ||
 CASE WHEN g.z IN ('+', '-') THEN g.z || coalesce(nullif(g.zh, ''), '00') || ':' || coalesce(nullif(g.zm, ''), '00') ELSE 'Z' END END AS iso FROM p""",
)
def pdf_dates(spark, sf_dir):
    k, at = F.col("o_orderkey") % 5, lambda f: F.date_format("o_orderdate", f)
    raw = F.when(k == 0, F.concat(at("'D:'yyyyMMddHHmmss"), F.lit("Z"))).when(k == 1, at("'D:'yyyyMM")).when(k == 2, F.concat(at("'D:'yyyyMMddHHmmss"), F.lit("+02'30'"))).when(k == 3, F.concat(at("'D:'yyyyMMddHHmmss"), F.lit("-05"))).otherwise(at("yyyyMMdd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", pdf.iso_date(raw).alias("iso"))


def byte_sql(v: str) -> str:
    return f"printf('%02x', CAST(floor(({v}) * 255 + 0.5) AS INTEGER))"


@query("color_hex", f"WITH p AS (SELECT p_partkey, (p_partkey % 101) / 100.0::DOUBLE AS a, (p_size % 51) / 50.0::DOUBLE AS b, (p_partkey % 11) / 10.0::DOUBLE AS c FROM part) SELECT p_partkey, '#' || {byte_sql('a')} || {byte_sql('a')} || {byte_sql('a')} AS gray, '#' || {byte_sql('a')} || {byte_sql('b')} || {byte_sql('c')} AS rgb, '#' || {byte_sql('(1 - a) * (1 - c)')} || {byte_sql('(1 - b) * (1 - c)')} || {byte_sql('(1 - c) * (1 - c)')} AS cmyk FROM p")
def color_hex(spark, sf_dir):
    a, b, c = (F.col("p_partkey") % 101) / F.lit(100.0), (F.col("p_size") % 51) / F.lit(50.0), (F.col("p_partkey") % 11) / F.lit(10.0)
    return table(spark, sf_dir, "part").select("p_partkey", pdf.hex_color(F.array(a)).alias("gray"), pdf.hex_color(F.array(a, b, c)).alias("rgb"), pdf.hex_color(F.array(a, b, c, c)).alias("cmyk"))


@query("annotation_types", "SELECT l_orderkey, l_linenumber, coalesce([" + ", ".join(f"'{t}'" for t in pdf.TYPES) + "][CAST(l_quantity AS INTEGER)], 'Unknown') AS type_name, CAST(l_linenumber AS VARCHAR) || 'px' AS border_width, coalesce(['solid', 'dashed', 'solid', 'inset', 'none'][l_linenumber + 1], 'solid') AS border_style FROM lineitem")
def annotation_types(spark, sf_dir):
    border = pdf.border(F.col("l_linenumber"), F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", pdf.type_name(F.col("l_quantity").cast("int")).alias("type_name"), border["borderWidth"].alias("border_width"), border["borderStyle"].alias("border_style"))


@query(
    "annotation_normalised",
    "SELECT l_orderkey, l_linenumber, l_returnflag AS type_name, CASE WHEN l_linenumber = 1 THEN 0 ELSE 90 * l_linenumber END AS rotation, CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN "
    + "'#' || " + " || ".join([byte_sql("l_discount * 10")] * 3) + " ELSE '#' || " + " || ".join(byte_sql(x) for x in ("l_discount * 10", "l_tax * 10", "0.5")) + " END AS color, "
    "coalesce(CASE WHEN l_linenumber <> 2 THEN l_linestatus END, '') AS contents, strftime(l_shipdate, '%Y-%m-%dT00:00:00Z') AS created, CASE WHEN l_partkey % 1024 <> 0 THEN (l_partkey % 1024) & 4 <> 0 END AS printed, "
    "coalesce([" + ", ".join(f"'{t}'" for t in pdf.TYPES) + "][CAST(l_quantity AS INTEGER)], 'Unknown') AS annotation_type, l_linenumber || 'px ' || coalesce(['solid', 'dashed', 'solid', 'inset', 'none'][l_linenumber + 1], 'solid') AS border FROM lineitem",
)
def annotation_normalised(spark, sf_dir):
    """Raw fields of annotations, a row of lineitem each, in their normal form."""
    n, flag, tenth = F.col("l_linenumber"), F.col("l_partkey") % 1024, lambda c: F.col(c).cast("double") * 10
    raw = {
        "subtype": F.col("l_returnflag"), "rotation": F.when(n != 1, n * 90), "contentsText": F.when(n != 2, F.col("l_linestatus")), "creationDate": F.date_format("l_shipdate", "'D:'yyyyMMdd"), "annotationFlags": flag,
        "color": F.when(n % 3 == 1, F.array(tenth("l_discount"))).when(n % 3 == 2, F.array(tenth("l_discount"), tenth("l_tax"), F.lit(0.5))), "annotationType": F.col("l_quantity").cast("int"), "borderWidth": n, "borderStyle": n,
    }
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.struct(*[v.alias(k) for k, v in pdf.annotation(raw).items()]).alias("a"))
    border = F.concat_ws(" ", "a.borderStyle.borderWidth", "a.borderStyle.borderStyle")
    return own.select("l_orderkey", "l_linenumber", F.col("a.typeName").alias("type_name"), "a.rotation", "a.color", "a.contents", "a.created", F.col("a.flags.Print").alias("printed"), F.col("a.annotationType").alias("annotation_type"), border.alias("border"))


@query(
    "page_values",
    """WITH p AS (SELECT o_orderkey AS doc_id, unnest(range(1, CAST(o_orderkey % 4 AS INTEGER) + 2)) AS page FROM orders), v AS (SELECT l_orderkey AS doc_id, l_linenumber % 3 + 1 AS page, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS v FROM lineitem GROUP BY ALL)
SELECT doc_id, string_agg(coalesce(v, '-'), '|' ORDER BY page) AS page_values FROM p LEFT JOIN v USING (doc_id, page) GROUP BY doc_id""",
)
def page_values(spark, sf_dir):
    """What rows have for pages of documents as an array with a place for each page, null where there is nothing."""
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.sequence(F.lit(1), (F.col("o_orderkey") % 4).cast("int") + 1)).alias("page"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 3 + 1).alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_partkey")), lambda x: x.cast("string")), ",").alias("value"))
    return pages.aligned(own, rows, "v").select("doc_id", F.array_join(F.transform("v", lambda x: F.coalesce(x, F.lit("-"))), "|").alias("page_values"))


# --- dispatch, paths, digests ---

ASKED = [*sorted(EXTENSIONS), "", "constructor"]


@query(
    "ext_dispatch",
    "WITH e(k, r) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in EXTENSIONS.items()) + "), q AS (SELECT doc_id, upper([" + ", ".join(f"'{x}'" for x in ASKED) + f"][CAST(doc_id % {len(ASKED)} AS INTEGER) + 1]) AS x FROM documents) "
    "SELECT doc_id, lower(coalesce(nullif(x, ''), 'pdf')) AS extension, r AS reader, CASE WHEN r IS NULL THEN 'unsupported extension: ' || lower(x) END AS error FROM q LEFT JOIN e ON e.k = lower(coalesce(nullif(x, ''), 'pdf'))",
)
def ext_dispatch(spark, sf_dir):
    asked = F.upper(F.get(F.array(*[F.lit(x) for x in ASKED]), (F.col("doc_id") % len(ASKED)).cast("int")))
    return files.dispatched(table(spark, sf_dir, "documents").select("doc_id", asked.alias("extension")))


@query(
    "path_tree",
    """WITH e AS (SELECT page_id % 10 AS doc_id, regexp_replace(url, '^https?://|[?#].*$', '', 'g') AS path FROM pages), p AS (SELECT doc_id, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM e),
k AS (SELECT doc_id, parts, len(parts) AS n, unnest(range(1, len(parts) + 1)) AS depth FROM p),
r AS (SELECT doc_id, array_to_string(parts[1:depth], '/') AS path, array_to_string(parts[1:depth - 1], '/') AS parent_path, parts[depth] AS name, CAST(depth AS INTEGER) AS depth, depth < n AS dir FROM k)
SELECT doc_id, path, parent_path, name, depth, bool_or(dir) AS is_directory, count(*) AS n_files, CASE WHEN NOT bool_or(dir) THEN lower(regexp_extract(name, '[^/]\\.([^./]*)$', 1)) END AS extension FROM r GROUP BY doc_id, path, parent_path, name, depth""",
)
def path_tree(spark, sf_dir):
    return archive.tree(url_entries(spark, sf_dir))


def url_entries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("doc_id"), F.regexp_replace("url", "^https?://|[?#].*$", "").alias("path"), F.lit(False).alias("is_directory"))


@query("path_walk", f"SELECT doc_id, path, depth, row_number() OVER (PARTITION BY doc_id ORDER BY string_split(path, '/')) AS rank FROM ({ORACLE_SQL['path_tree']})")
def path_walk(spark, sf_dir):
    """The tree's rows in the order of a walk."""
    return archive.flattened(archive.tree(url_entries(spark, sf_dir))).select("doc_id", "path", "depth", F.col("rank").cast("long").alias("rank"))


#: Levels that the SQL folds; the paths of the tables are less deep.
DEEP = 12
NODE_SQL = """'{"name":' || to_json(name) || ',"path":' || to_json(path) || ',"is_directory":' || is_directory || CASE WHEN extension IS NULL THEN '' ELSE ',"extension":' || to_json(extension) END || ',"n_files":' || n_files"""
FOLD_SQL = f"WITH t AS ({ORACLE_SQL['path_tree']}), n{DEEP + 1} AS (SELECT doc_id, path AS parent_path, name, '' AS node FROM t WHERE false), " + ", ".join(
    f"""n{d} AS (SELECT doc_id, parent_path, name, {NODE_SQL} || CASE WHEN is_directory THEN ',"children":[' || coalesce((SELECT string_agg(c.node, ',' ORDER BY c.name) FROM n{d + 1} c WHERE c.doc_id = t.doc_id AND c.parent_path = t.path), '') || ']}}' ELSE '}}' END AS node FROM t WHERE depth = {d})"""
    for d in range(DEEP, 0, -1)
)


@query("path_tree_nested", FOLD_SQL + " SELECT doc_id, '[' || string_agg(node, ',' ORDER BY name) || ']' AS tree FROM n1 GROUP BY doc_id")
def path_tree_nested(spark, sf_dir):
    """The tree of each group of pages as nested JSON."""
    return archive.nested(archive.tree(url_entries(spark, sf_dir)))


@query("content_md5", "SELECT doc_id, md5(text) AS md5 FROM documents")
def content_md5(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("md5"))


@query("normalised_text", "SELECT doc_id, sha256(trim(regexp_replace(text, '[\\s]+', ' ', 'g'), ' ')) AS collapsed, sha256(replace(replace(text, chr(10), chr(13) || chr(10)), chr(13) || chr(10), chr(10))) AS unix FROM documents")
def normalised_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.collapse(F.col("text")), 256).alias("collapsed"), F.sha2(text.unix_lines(F.replace("text", F.lit("\n"), F.lit("\r\n"))), 256).alias("unix"))


@query("object_merge", "SELECT c_custkey, 'name' AS key, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'segment', lower(c_mktsegment) FROM customer UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS VARCHAR) FROM customer")
def object_merge(spark, sf_dir):
    a = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    b = F.create_map(F.lit("segment"), F.lower("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(text.right_wins(a, b)))


@query(
    "name_forms",
    """SELECT p_partkey, array_to_string(list_transform(list_filter(string_split(regexp_replace(p_type || '-x ' || p_brand, '[^a-zA-Z0-9 ]', '', 'g'), ' '), lambda w: w <> ''), lambda w, i: CASE WHEN i = 1 THEN lower(w) ELSE upper(substr(w, 1, 1)) || substr(w, 2) END), '') AS camel,
 p_brand AS local, lower(regexp_extract(p_name, '[^/]\\.([^./]*)$', 1)) || 'txt' AS extension, 'f' || p_partkey || '.TXT' AS base FROM part""",
)
def name_forms(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    path = F.concat(F.lit("a/b/f"), key, F.lit(".TXT"))
    return table(spark, sf_dir, "part").select("p_partkey", text.camel_case(F.concat("p_type", F.lit("-x "), "p_brand")).alias("camel"), text.local_name(F.concat(F.lit("v:t:"), "p_brand")).alias("local"), text.extension(path).alias("extension"), text.base_name(F.concat(path, F.lit("/"))).alias("base"))


NAMES_SQL = "SELECT doc_id, which, text, CAST(len(regexp_extract_all(text, '[ąčęėįšųūžĄČĘĖĮŠŲŪŽ]')) AS BIGINT) AS lt, CAST(len(regexp_extract_all(text, '[A-Za-z0-9_ .()-]')) AS BIGINT) AS plain, CAST(len(regexp_extract_all(text, '[\\x00-\\x1F\\x7F\\x{FFFD}]')) AS BIGINT) AS bad FROM (" + BOTH_SQL + ")"


@query("name_scores", f"SELECT doc_id, which, CAST(3 * lt + plain - 5 * bad - (length(text) - lt - plain - bad) AS BIGINT) AS score FROM ({NAMES_SQL})")
def name_scores(spark, sf_dir):
    return both_texts(spark, sf_dir).select("doc_id", "which", text.name_score(F.col("text")).cast("long").alias("score"))


# --- files written from the tables, then read ---


@query("zip_listing", "SELECT doc_id, 'src/d' || doc_id || '.TXT' AS path, 'd' || doc_id || '.TXT' AS name, octet_length(encode(text)) AS size, 'txt' AS extension, md5(text) AS md5 FROM documents UNION ALL SELECT doc_id, 'src/a.b.' || lang, 'a.b.' || lang, octet_length(encode(source)), lang, md5(source) FROM documents")
def zip_listing(spark, sf_dir):
    made = fixtures.built(table(spark, sf_dir, "documents"), "zip")
    return files.decoded(files.dispatched(made)).select("doc_id", F.inline("files")).select("doc_id", "path", "name", "size", "extension", "md5")


@query("eml_extract", "SELECT doc_id, sha256(rtrim(text, ' ' || chr(10)) || chr(10)) AS text_sha256, 'No. ' || doc_id AS subject, lang || '@' || source || '.example.org' AS sender FROM documents")
def eml_extract(spark, sf_dir):
    made = fixtures.built(table(spark, sf_dir, "documents"), "eml")
    read = files.decoded(files.dispatched(made))
    return read.select("doc_id", F.sha2(F.concat(F.regexp_replace(F.col("pages")[0], "[ \n]+$", ""), F.lit("\n")), 256).alias("text_sha256"), F.get_json_object("metadata", "$.subject").alias("subject"), F.get_json_object("metadata", "$.from[0].email").alias("sender"))


@query("office_props", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \\n]+')) AS BIGINT) AS words, lang AS author, source AS title, 'docs' AS producer, sha256(regexp_replace(text, '\\n+', chr(10), 'g')) AS text_sha256 FROM documents")
def office_props(spark, sf_dir):
    read = files.decoded(files.dispatched(fixtures.built(table(spark, sf_dir, "documents"), "docx")))
    get = lambda k: F.get_json_object("metadata", f"$.{k}")
    return read.select("doc_id", get("wordCount").cast("long").alias("words"), get("Author").alias("author"), get("Title").alias("title"), get("Producer").alias("producer"), F.sha2(F.col("pages")[0], 256).alias("text_sha256"))


@query("exif_tags", "SELECT doc_id, CAST(doc_id % 5000 + 1 AS BIGINT) AS width, CAST(n_chars % 4000 + 1 AS BIGINT) AS height, source AS creator, lang AS model, '2024-02-0' || (doc_id % 9 + 1) || ' 10:20:30' AS created FROM documents")
def exif_tags(spark, sf_dir):
    read = files.decoded(files.dispatched(fixtures.built(table(spark, sf_dir, "documents"), "tiff")))
    get = lambda k: F.get_json_object("metadata", f"$.{k}")
    return read.select("doc_id", get("width").cast("long").alias("width"), get("height").cast("long").alias("height"), get("creator").alias("creator"), get("model").alias("model"), get("createdAt").alias("created"))


@query("pdf_text", "SELECT doc_id, page, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) AS text_sha256 FROM (" + SPLIT + ")")
def pdf_text(spark, sf_dir):
    read = files.decoded(files.dispatched(fixtures.built(table(spark, sf_dir, "documents"), "pdf")))
    return pages.page_rows(read, F.col("pages")).select("doc_id", F.col("page").cast("long").alias("page"), F.sha2("text", 256).alias("text_sha256"))


@query("filename_decode", "SELECT doc_id, translate(lang || '_' || source || '_aciuz.txt', 'ciuz', 'čįūž') AS name FROM documents")
def filename_decode(spark, sf_dir):
    return fixtures.decoded_names(table(spark, sf_dir, "documents"))


@query("pdfsig_report", "SELECT o_orderkey AS doc_id, s AS signature, 'Signer ' || o_custkey || '-' || s AS signer, CAST(s = 2 AS BOOLEAN) AS total_document_signed, CAST(o_custkey AS DOUBLE) AS first_byte, date_trunc('second', o_orderdate) AS signing_time FROM orders, (VALUES (1), (2)) v(s)")
def pdfsig_report(spark, sf_dir):
    n, who = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    one = lambda k: F.concat(F.lit(f"Signature #{k}:\n  - Signer Certificate Common Name: Signer "), who, F.lit(f"-{k}\n  - Signing Time: "), F.date_format("o_orderdate", "MMM dd yyyy HH:mm:ss"), F.lit("\n  - Signed Ranges: [0 - "), who, F.lit("], ["), who, F.lit(" - 900000]\n"))
    reports = table(spark, sf_dir, "orders").select(n.alias("doc_id"), F.concat(F.lit("File 'x.pdf'\n"), one(1), one(2), F.lit("  - Total document signed\n")).alias("report"))
    found = signatures.signatures(reports)
    return found.select("doc_id", "signature", F.col("fields")["signerCertificateCommonName"].alias("signer"), "total_document_signed", F.col("signed_ranges")[1][0].alias("first_byte"), F.col("signing_time").cast("timestamp_ntz").alias("signing_time"))


@query("quality_scores", "SELECT doc_id, which, " + ", ".join(f"round(CAST({v} AS DOUBLE), 6) AS {k}" for k, v in SCORES_SQL.items()) + f", round(CAST({TOTAL_SQL} AS DOUBLE), 6) AS total FROM ({measure_sql(BOTH_SQL)})")
def quality_scores(spark, sf_dir):
    """Every criterion and the total side by side."""
    measured = quality.with_measures(both_texts(spark, sf_dir), "text", "m")
    by = quality.scores("m", F.col("text"))
    scored = measured.select("doc_id", "which", *[v.alias(k) for k, v in by.items()])
    whole = sum((F.col(k) * w for k, w in quality.WEIGHTS.items()), F.lit(0.0))
    return scored.select("doc_id", "which", *[F.round(k, 6).alias(k) for k in by], F.round(whole, 6).alias("total"))


@query(
    "info_dates",
    "SELECT o_orderkey, 'Title' AS key, 'D:' || o_orderpriority AS value FROM orders UNION ALL SELECT o_orderkey, 'CreationDate', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') FROM orders UNION ALL SELECT o_orderkey, 'update', CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-01T00:00:00Z') ELSE 'on ' || o_orderkey END FROM orders",
)
def info_dates(spark, sf_dir):
    """Info dictionaries: dates by the name of their key, whatever is no date as it is."""
    at = lambda f: F.date_format("o_orderdate", f)
    last = F.when(F.col("o_orderkey") % 2 == 0, at("'D:'yyyyMM")).otherwise(F.concat(F.lit("on "), F.col("o_orderkey").cast("string")))
    info = F.create_map(F.lit("Title"), F.concat(F.lit("D:"), "o_orderpriority"), F.lit("CreationDate"), at("'D:'yyyyMMddHHmmss"), F.lit("update"), last)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(pdf.dated(info)))


@query(
    "metadata_variant",
    """SELECT o_orderkey, '{"CreationDate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '","Date":[1,"D:2024"],"Title":"' || o_orderpriority || '","nested":{"list":["' || o_orderstatus || '",{" deep ":"x\\\\\\"y"},null],"n":' || o_custkey || '},"update":"on \\\\ ' || o_orderkey || '"}' AS metadata FROM orders""",
)
def metadata_variant(spark, sf_dir):
    """Info dictionaries with NUL characters and white space at all depths, as VARIANT."""
    nul, text = F.lit("\x00"), lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c])
    deep = F.struct(text("x", nul, '\\"y \t').alias(" deep "))
    nested = F.to_json(F.struct(F.array(F.to_json(F.array(text("\n ", F.col("o_orderstatus"), nul))), F.to_json(deep)).alias("l")))
    listed = text("[", F.substr(F.get_json_object(nested, "$.l[0]"), F.lit(2), F.length(F.get_json_object(nested, "$.l[0]")) - 2), ",", F.get_json_object(nested, "$.l[1]"), ",null]")
    own = F.to_json(F.struct(F.date_format("o_orderdate", "'D:'yyyyMMddHHmmss").alias("CreationDate"), text(nul, " ", F.col("o_orderpriority"), " \ufeff").alias("Title"), text("on \\ ", F.col("o_orderkey").cast("string"), "\u00a0").alias("update")))
    whole = text('{"info":', F.expr("left(own, length(own) - 1)"), ',"Date":[1," D:2024 "],"nested":{"n":', F.col("o_custkey").cast("string"), ',"list":', listed, '}},"other":" "}')
    return table(spark, sf_dir, "orders").withColumn("own", own).select("o_orderkey", F.to_json(pdf.metadata(whole)).alias("metadata"))


@query(
    "annotation_links",
    f"""WITH h AS (SELECT doc_id, page, uri FROM ({matches_sql(URL_PAGES, LINK_SQL, 'uri')}) UNION ALL SELECT page_id, 3, url FROM pages UNION ALL SELECT page_id, 1, 'mailto:a' || page_id % 7 || '@x.org' FROM pages)
SELECT doc_id, kind, key, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages FROM (SELECT DISTINCT doc_id, page, 'link' AS kind, uri AS key FROM h UNION SELECT doc_id, page, 'email', substr(uri, 8) FROM h WHERE lower(uri) LIKE 'mailto:%' UNION SELECT doc_id, page, 'email', e FROM ({matches_sql(URL_PAGES, EMAIL_SQL, 'e')})) GROUP BY doc_id, kind, key""",
)
def annotation_links(spark, sf_dir):
    """Link annotations merged with the links of the text, and addresses of mailto: links of either with its e-mails."""
    own = table(spark, sf_dir, "pages")
    given = own.select(F.col("page_id").alias("doc_id"), F.lit(3).alias("page"), F.concat(F.lit(" "), "url").alias("uri")).unionByName(own.select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page"), F.concat(F.lit("mailto:a"), (F.col("page_id") % 7).cast("string"), F.lit("@x.org")).alias("uri")))
    found = entities.everything(url_pages(spark, sf_dir), given).where(F.col("kind").isin("link", "email"))
    return found.select("doc_id", "kind", "key", joined_pages())


#: Chosen pages: the better of each page and of the first alternative, the whole text backwards.
CHOSEN_SQL = f"""p AS (SELECT doc_id, page, trim(regexp_replace(text, '[\\s]+', ' ', 'g'), ' ') AS text FROM ({SPLIT})), sp AS (SELECT doc_id, which AS page, text, round(CAST({TOTAL_SQL} AS DOUBLE), 9) AS t FROM ({measure_sql('SELECT doc_id, page AS which, text FROM p')})),
sa AS (SELECT doc_id, text, round(CAST({TOTAL_SQL} AS DOUBLE), 9) AS t FROM ({measure_sql("SELECT doc_id, 1 AS which, reverse(text) AS text FROM documents WHERE text <> ''")})),
src AS (SELECT sp.doc_id, page, CASE WHEN sa.text IS NULL OR (sp.text <> '' AND sp.t >= sa.t) THEN sp.text ELSE trim(regexp_replace(sa.text, '[\\s]+', ' ', 'g'), ' ') END AS text FROM sp LEFT JOIN sa ON sp.doc_id = sa.doc_id AND page = 1)"""


#: Pages `src` (doc_id, page, text) of each request to its entities as one string, counts and digest.
RESULT_SQL = f"""hits AS ({ALL_HITS}), more AS (SELECT * FROM hits UNION ALL SELECT doc_id, page, 'email', substr(key, 8) FROM hits WHERE kind = 'link' AND lower(key) LIKE 'mailto:%'),
dom AS (SELECT DISTINCT doc_id, CASE WHEN kind = 'link' THEN {HOST_SQL.format('key')} ELSE regexp_replace(regexp_extract(key, '@(.*)$', 1), '^www\\.', '') END AS key FROM hits WHERE kind IN ('link', 'email')),
e AS (SELECT doc_id, kind || ' ' || key || ' ' || string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS x FROM (SELECT DISTINCT doc_id, kind, key, page FROM more) GROUP BY doc_id, kind, key UNION ALL SELECT doc_id, 'domain ' || key || ' ' FROM dom WHERE key IS NOT NULL),
l AS (SELECT doc_id, string_agg(x, '; ' ORDER BY x) AS entities FROM e GROUP BY doc_id), c AS (SELECT doc_id, {COUNTS_SQL}, sha256(string_agg(text, chr(10) ORDER BY page)) AS pages_sha256 FROM src GROUP BY doc_id)"""


def entity_string() -> Column:
    each = F.flatten(F.transform(F.map_entries("entities"), lambda m: F.transform(m["value"], lambda e: F.concat_ws(" ", m["key"], e["key"], F.array_join(F.transform(e["pages"], lambda p: p.cast("string")), ",")))))
    return F.coalesce(F.array_join(F.array_sort(each), "; "), F.lit("")).alias("entities")


@query("sql_entities", ORACLE_SQL["entities_all"])
def sql_entities(spark, sf_dir):
    """The entities of entities_all, in plain SQL over the registered functions."""
    from foliospark.operators import sql

    sql.register(spark)
    both = pages.split_pages(table(spark, sf_dir, "documents")).unionByName(url_pages(spark, sf_dir).withColumn("doc_id", -F.col("doc_id") - 1))
    return spark.sql(
        """WITH hits AS (SELECT p.doc_id, p.page, e.kind, e.key, entity_domain(e.kind, e.key) AS domain FROM {pages} p, LATERAL extract_entities(p.text) e),
        each AS (SELECT inline(array(named_struct('doc_id', doc_id, 'kind', kind, 'key', key, 'page', page),
         CASE WHEN kind = 'link' AND lower(key) LIKE 'mailto:%' THEN named_struct('doc_id', doc_id, 'kind', 'email', 'key', substring(key, 8), 'page', page) END,
         CASE WHEN domain IS NOT NULL THEN named_struct('doc_id', doc_id, 'kind', 'domain', 'key', domain, 'page', CAST(NULL AS INT)) END)) FROM hits)
        SELECT doc_id, kind, key, array_join(transform(array_sort(collect_set(page)), p -> CAST(p AS STRING)), ',') AS pages FROM each WHERE kind IS NOT NULL GROUP BY doc_id, kind, key""",
        pages=both,
    )


@query("sql_quality", ORACLE_SQL["quality_scores"])
def sql_quality(spark, sf_dir):
    """Every criterion and the total, in plain SQL over the registered functions."""
    from foliospark.operators import sql

    sql.register(spark)
    scored = spark.sql("SELECT doc_id, which, q.*, total FROM (SELECT doc_id, which, quality_scores(text) AS q, quality_total(text) AS total FROM {texts})", texts=both_texts(spark, sf_dir))
    return scored.select("doc_id", "which", *[F.round(c, 6).alias(c) for c in (*quality.CRITERIA, "total")])


@query(
    "full_extract",
    f"""WITH {CHOSEN_SQL}, {RESULT_SQL}
SELECT doc_id, true AS success, 8 AS version, page_count, character_count, word_count, pages_sha256, coalesce(entities, '') AS entities FROM c LEFT JOIN l USING (doc_id)""",
)
def full_extract(spark, sf_dir):
    """Every document as a PDF file, extracted with an alternative text for its first page, end to end."""
    from foliospark.plans.extract import extract

    own = table(spark, sf_dir, "documents").withColumn("alt_pages", F.array(F.reverse("text")))
    out = extract(fixtures.built(own, "pdf", ("alt_pages",)))
    return out.select("doc_id", "success", "version", "page_count", "character_count", "word_count", F.sha2(F.array_join("pages", "\n"), 256).alias("pages_sha256"), entity_string())


@query(
    "extract_requests",
    f"""WITH sp AS (SELECT doc_id, text, round(CAST({TOTAL_SQL} AS DOUBLE), 9) AS t FROM ({measure_sql('SELECT doc_id, 1 AS which, text FROM documents')})),
sa AS (SELECT doc_id, text, round(CAST({TOTAL_SQL} AS DOUBLE), 9) AS t FROM ({measure_sql("SELECT doc_id, 1 AS which, reverse(text) AS text FROM documents WHERE text <> ''")})),
src AS (SELECT sp.doc_id, 1 AS page, CASE WHEN sa.text IS NULL OR (sp.text <> '' AND sp.t >= sa.t) THEN sp.text ELSE trim(regexp_replace(sa.text, '[\\s]+', ' ', 'g'), ' ') END AS text FROM sp LEFT JOIN sa ON sp.doc_id = sa.doc_id WHERE sp.doc_id % 11 <> 0 AND sp.doc_id % 13 <> 0),
{RESULT_SQL}
SELECT CASE WHEN doc_id % 5 <> 0 THEN doc_id % 50 ELSE -1 END AS doc_id, CASE WHEN doc_id % 11 = 0 THEN 'missing uri' WHEN doc_id % 13 = 0 THEN 'unsupported extension: nope' END AS error, coalesce(page_count, 0) AS page_count, coalesce(character_count, 0) AS character_count,
 coalesce(word_count, 0) AS word_count, coalesce(pages_sha256, sha256('')) AS pages_sha256, coalesce(entities, '') AS entities FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)""",
)
def extract_requests(spark, sf_dir):
    """Every document as a text file, a fifth of the requests without id and the others with few ids, alternatives for texts, some without uri or with an unknown extension. Missing ids are shown as -1."""
    from foliospark.plans.extract import extract

    n = F.col("doc_id")
    uri = F.when(n % 11 == 0, " ").otherwise(F.concat(F.lit("d"), n.cast("string")))
    asked = table(spark, sf_dir, "documents").select(F.when(n % 5 != 0, n % 50).alias("doc_id"), uri.alias("uri"), F.when(n % 13 == 0, "NOPE").otherwise("TXT").alias("extension"), F.encode("text", "UTF-8").alias("content"), F.array(F.reverse("text")).alias("alt_pages"))
    out = extract(asked, alternatives_for=None)
    return out.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "error", "page_count", "character_count", "word_count", F.sha2(F.array_join("pages", "\n"), 256).alias("pages_sha256"), entity_string())
