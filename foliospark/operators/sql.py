"""The entities and criteria as SQL functions of a session, for queries in plain SQL.

    register(spark)
    spark.sql("SELECT d.id, e.* FROM docs d, LATERAL extract_entities(d.text) e")
    spark.sql("SELECT id, quality_total(text), quality_scores(text).long_words FROM docs")

extract_entities(text) is a table (kind, key, pos) of every hit, in the order of its kind; Spark turns its call into a generator over the rows, without a join.
entity_domain(kind, key) and url_domain(uri) give hosts; quality_scores(text) a struct with every criterion, quality_total(text) their weighted sum. All are
expressions of built-in functions, made from the same patterns as the columns, but for the few hosts that url_domain passes through Arrow, and the counts of
a text (text_counts), which are found there in one pass.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from foliospark.functions import counting, patterns, quality
from foliospark.functions.text import WS
from foliospark.operators.entities import host_rules


def raw(pattern: str) -> str:
    return f"r'{pattern}'"


def let(name: str, value: str, body: str) -> str:
    """body, in which name stands for value, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def found(text: str, pattern: str, may: str) -> str:
    return f"CASE WHEN {may} THEN regexp_extract_all({text}, {raw(pattern)}, 0) ELSE CAST(array() AS ARRAY<STRING>) END"


def phones(text: str) -> str:
    kept = f"transform({found(text, patterns.PHONE, f'{text} RLIKE {raw(f"(?:[0-9]{patterns.GAP}){{8}}")}')}, x -> regexp_replace(x, {raw(f'[{WS}' + r'\-.():]')}, ''))"
    whole = "CASE WHEN startswith(x, '+370') THEN x WHEN startswith(x, '370') THEN concat('+', x) WHEN x RLIKE '^[80]' THEN concat('+370', substring(x, 2)) WHEN x RLIKE '^[2-7][0-9]{6,7}$' THEN concat('+370', x) END"
    return f"filter(transform({kept}, x -> {whole}), x -> x IS NOT NULL AND NOT x RLIKE {raw(r'^\+370[12]')})"


def entity_arrays(text: str) -> dict[str, str]:
    return {
        "company_code": found(text, patterns.COMPANY, f"{text} RLIKE '[0-9]{{9}}'"),
        "iban": found(text, patterns.IBAN, f"{text} RLIKE '[0-9]{{2}}[A-Z0-9]{{11}}'"),
        "phone": phones(text),
        "link": found(text, patterns.LINK, f"contains({text}, '://') OR contains({text}, 'mailto:') OR contains({text}, 'tel:')"),
        "email": found(text, patterns.EMAIL, f"contains({text}, '@')"),
    }


def hits(text: str) -> str:
    return "concat(" + ", ".join(f"transform({v}, (x, i) -> named_struct('kind', '{k}', 'key', x, 'pos', i))" for k, v in entity_arrays(text).items()) + ")"


def scores(text: str, criteria: dict[str, quality.Criterion] = quality.CRITERIA) -> str:
    """A struct of all scores of a text: counts and measures are made once each, words only where criteria of the caller's look at them."""
    at = {"text": text, "counted": "k", "flat": "f", "words": "w", "dashed": "d"}
    fields = lambda of: "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in of.items()) + ")"
    counts = quality.all_counts(criteria)
    own = at | {k: f"c.{k}" for k in counts}
    made = let("m", fields({k: c.measure.format_map(own) for k, c in criteria.items()}), fields({k: f"CASE WHEN {text} IS NOT NULL THEN {c.score.format(m=f'm.{k}')} END" for k, c in criteria.items()}))
    out = let("c", fields({k: v.format_map(at) for k, v in counts.items()}), made)
    asked = " ".join(v for k, v in counts.items() if k not in quality.COUNTS)
    for name, template in (("dashed", quality.DASHED), ("words", quality.WORDS), ("flat", quality.FLAT)):
        if f"{{{name}}}" in asked:
            out, asked = let(at[name], template.format_map(at), out), asked + template
    return let("k", f"text_counts({text})", out)


HOST = rf"nullif(regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(uri, r'^https?:/*([^/?#\\]*)', 1), r'^.*@', ''), r':[0-9]*$', '')), r'^www\.', ''), '')"
PLAIN = raw(patterns.PLAIN_HOST)
MAIL_DOMAIN = r"CASE WHEN size(split(key, '@')) = 2 THEN nullif(regexp_replace(substring_index(key, '@', -1), r'^www\.', ''), '') END"


def statements(criteria: dict[str, quality.Criterion] = quality.CRITERIA) -> list[str]:
    doubles = ", ".join(f"{k}: DOUBLE" for k in criteria)
    total = "0.0D" + "".join(f" + s.{k} * {float(c.weight)!r}D" for k, c in criteria.items())
    make = "CREATE OR REPLACE TEMPORARY FUNCTION"
    return [
        f"{make} extract_entities(page_text STRING) RETURNS TABLE(kind STRING, key STRING, pos INT) RETURN SELECT * FROM inline({hits('page_text')})",
        f"{make} url_host(uri STRING) RETURNS STRING RETURN {HOST}",
        f"{make} url_domain(uri STRING) RETURNS STRING RETURN coalesce(CASE WHEN url_host(uri) RLIKE {PLAIN} THEN url_host(uri) END, host_by_rules(CASE WHEN NOT url_host(uri) RLIKE {PLAIN} THEN url_host(uri) END))",
        f"{make} entity_domain(kind STRING, key STRING) RETURNS STRING RETURN coalesce(url_domain(CASE WHEN kind = 'link' THEN key END), CASE WHEN kind = 'email' THEN {MAIL_DOMAIN} END)",
        f"{make} quality_scores(quality_text STRING) RETURNS STRUCT<{doubles}> RETURN {scores('quality_text', criteria)}",
        f"{make} quality_total(quality_text STRING) RETURNS DOUBLE RETURN {let('s', scores('quality_text', criteria), total)}",
    ]


def register(spark: SparkSession, criteria: dict[str, quality.Criterion] = quality.CRITERIA) -> None:
    """Make the functions known to a session, with criteria of the caller's if there are. Names of one's own stay as they are."""
    spark.udf.register("host_by_rules", host_rules)
    spark.udf.register("text_counts", counting.text_counts)
    for s in statements(criteria):
        spark.sql(s)
