"""The queries op1 to op13 over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import collocations, decontam, grades, hard_negatives, licenses, mixing, packing, quality_rules, records, simhash, substring, toxicity, warc
from foliospark.llm.common import table, work_dir


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("class_distance", 9).alias("class_distance"), F.round("word_distance", 9).alias("word_distance"))


def _distance_sql(own: str, ref: str) -> str:
    """Jensen-Shannon distance of two lists of counts."""
    p, q = f"(CAST({own}[i] AS DOUBLE) / list_sum({own}))", f"(CAST({ref}[i] AS DOUBLE) / list_sum({ref}))"
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END"
    return f"sqrt(greatest(0, list_sum(list_transform(range(1, len({ref}) + 1), lambda i: ({part(p)} + {part(q)}) / 2))))"


OP1_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce('of ' || lang, 'none') AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS lw,
 [len(regexp_extract_all(t, '[a-z]')), len(regexp_extract_all(t, '[A-Z]')), len(regexp_extract_all(t, '[0-9]')), len(regexp_extract_all(t, '[\x20\x09-\x0D]')), len(regexp_extract_all(t, '[.,;:!?]')), len(regexp_extract_all(t, '[''"()\[\]{{}}-]')), len(regexp_extract_all(t, '[^\x00-\x7F]'))] AS c7 FROM d),
c AS (SELECT *, CAST(len(ws) AS BIGINT) AS n_words, [c7[1], c7[2], c7[3], c7[4], c7[5], c7[6], length(t) - list_sum(c7), c7[7]] AS cc FROM w),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS p FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM c)),
rep AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, p) AS m FROM win) WHERE m > 1) GROUP BY doc_id),
rc AS (SELECT lang, [{', '.join(f'sum(cc[{k}])' for k in range(1, 9))}] AS rc FROM c WHERE n_words >= 50 GROUP BY lang),
wc AS (SELECT lang, x, count(*) AS n FROM (SELECT lang, unnest(lw) AS x FROM c WHERE n_words >= 50) GROUP BY lang, x),
top AS (SELECT lang, list(x ORDER BY n DESC, x) AS xs, list(n ORDER BY n DESC, x) AS ns FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, x) AS r FROM wc) WHERE r <= 40 GROUP BY lang),
total AS (SELECT lang, sum(n) AS n FROM wc GROUP BY lang),
ref AS (SELECT lang, xs, list_append(ns, CAST(total.n - list_sum(ns) AS BIGINT)) AS rw, rc FROM top JOIN rc USING (lang) JOIN total USING (lang)),
own AS (SELECT doc_id, n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, cc, rc, rw, length(t) AS n_chars,
 list_transform(xs, lambda x: len(list_filter(lw, lambda y: y = x))) AS found FROM c LEFT JOIN ref USING (lang)),
m AS (SELECT own.*, list_append(found, CAST(n_words - coalesce(list_sum(found), 0) AS BIGINT)) AS ow, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, n_words >= 50 AND word_chars >= 200 AND rc IS NOT NULL AS judged FROM own LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
j AS (SELECT *, CASE WHEN judged THEN {_distance_sql('cc', 'rc')} END AS jc, CASE WHEN judged THEN {_distance_sql('ow', 'rw')} END AS jw, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (NOT judged OR (jc <= sqrt(0.28 * 0.28 + 7 / (8 * n_chars * ln(2))) AND jw <= sqrt(0.2 * 0.2 + (len(rw) - 1) / (8 * n_words * ln(2))))) AS kept, round(jc, 9) AS class_distance, round(jw, 9) AS word_distance FROM j
"""


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_dir(spark, "records")
    records.write_records(table(spark, sf_dir, "documents"), out, tokenizer_path())
    return records.read_records(spark, out).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted", F.size("found").alias("n_found"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives and index are written, every page's URL is found through the index, and the records are read by their ranges."""
    out = work_dir(spark, "warc")
    captures = warc.write_archives(table(spark, sf_dir, "pages"), out)
    warc.write_index(captures, out)
    found = warc.full_payload(warc.read_captures(warc.lookup(captures.select("key"), out), out))
    return found.select(F.col("name").cast("long").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.col("refers").cast("long").alias("refers_to"))


OP5_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN n >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN n >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), F.expr(decontam.CONTAMINATED).alias("contaminated"))


OP6_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bl AS (SELECT item_id, w, least(13, len(w)) AS m FROM bw WHERE len(w) > 0),
pat AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS p FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM bl)),
sizes AS (SELECT DISTINCT m FROM pat),
win AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS p FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, sizes WHERE len(w) >= m)),
occ AS (SELECT doc_id, win.m, i, item_id FROM win JOIN pat USING (m, p)),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM occ) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op7_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.duplicate_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM dw)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY p ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM dup),
removed AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
kept AS (SELECT a.doc_id, string_agg(x, ' ' ORDER BY k) AS s FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM dw) a ANTI JOIN gone g ON a.doc_id = g.doc_id AND a.k = g.k GROUP BY a.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM dw LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op8_ordinal_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return grades.grade(docs, grades.fit(docs, grades.graded(table(spark, sf_dir, "labels"))))


def op9_license_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op10_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH counts AS (SELECT source, count(*) AS n, sqrt(CAST(count(*) AS DOUBLE)) AS w FROM documents GROUP BY source),
rates AS (SELECT source, (SELECT CAST(sum(n) AS DOUBLE) FROM counts) * w / (SELECT sum(w) FROM counts) / n AS rate FROM counts),
steps AS (SELECT source, greatest(1, CAST(ceil(rate / 32) AS BIGINT)) AS draws, rate / greatest(1, CAST(ceil(rate / 32) AS BIGINT)) AS step FROM rates),
cdfs AS (SELECT source, draws, list_transform(range(0, 129), lambda k: CASE WHEN k = 0 THEN exp(-step) ELSE exp(-step) + list_sum(list_transform(range(1, k + 1), lambda j: exp(-step + j * ln(step) - lgamma(j + 1.0)))) END) AS cdf FROM steps),
us AS (SELECT d.*, cdf, list_transform(range(1, draws + 1), lambda k: CAST(CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(k AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0) AS us
 FROM documents d JOIN cdfs c ON d.source IS NOT DISTINCT FROM c.source),
counted AS (SELECT doc_id, text, lang, source, n_chars, CAST(list_sum(list_transform(us, lambda u: len(list_filter(cdf, lambda c: c <= u)))) AS BIGINT) AS n_copies FROM us),
copies AS (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM counted)
SELECT doc_id, text, lang, source, n_chars, copy, n_copies, CAST('0x' || substr(md5('17/order:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(copy AS VARCHAR)), 1, 15) AS BIGINT) AS shuffle_key FROM copies
"""

def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS t FROM d),
w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
pos AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS k FROM pos),
f AS (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM g) GROUP BY lang, k, phrase HAVING count(*) >= 100),
part AS (SELECT DISTINCT lang, f, array_to_string(ws[i : i + j - 1], ' ') AS phrase FROM (SELECT lang, f, k, ws, j, unnest(range(1, k - j + 2)) AS i FROM (SELECT lang, f, k, string_split(phrase, ' ') AS ws, unnest(range(2, k)) AS j FROM f WHERE k > 2))),
c AS (SELECT f.lang, f.phrase, f.k, f.f AS a FROM f ANTI JOIN part ON f.lang = part.lang AND f.phrase = part.phrase AND f.f <= part.f WHERE f.k > 1),
cut AS (SELECT lang, phrase, a, j, array_to_string(string_split(phrase, ' ')[1 : j], ' ') AS x, array_to_string(string_split(phrase, ' ')[j + 1 : k], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (SELECT cut.lang, cut.phrase, a, j, l.f AS l, r.f AS r, n, CAST(1000 * CAST(a AS HUGEINT) * n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = x JOIN f r ON r.lang = cut.lang AND r.phrase = y JOIN n ON n.lang = cut.lang),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best)
SELECT * FROM ranked WHERE rank <= 2000
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH e AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS INTEGER) AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER () AS k
 FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.k AS anchor, a.vec_id AS anchor_id, r.vec_id AS id, r.k <> a.k AS other, r.label = a.label AS same, CAST(list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
 FROM e a, e r WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS slot FROM s WHERE other AND same QUALIFY slot <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor, slot ORDER BY s.score DESC, s.id) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
 FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_divergence_rules, op2_token_records, op3_toxicity, op4_simhash, op5_capture_index, op6_decontamination, op7_relative_lz, op8_ordinal_grades, op9_license_classifier, op10_poisson_mixing, op11_packing, op12_collocations, op13_hard_negatives)
}
ORACLE_SQL: dict[str, str] = {"op1_divergence_rules": OP1_SQL, "op5_capture_index": OP5_SQL, "op6_decontamination": OP6_SQL, "op7_relative_lz": OP7_SQL, "op10_poisson_mixing": OP10_SQL, "op12_collocations": OP12_SQL, "op13_hard_negatives": OP13_SQL}
