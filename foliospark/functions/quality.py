"""Twelve weighted criteria of text quality, for Lithuanian and English text from documents.

Words are the runs left when all that is no letter or digit becomes a space; an empty text has one word, the empty one. Every measure is
made of counts; those of all criteria are found in one pass over a text, and a score is plain arithmetic inside generated code.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import counting
from foliospark.functions.counting import CAPITALS, JUNK, LITHUANIAN  # noqa: F401
from foliospark.functions.text import ASTRAL


def literal(pattern: str) -> str:
    """A pattern as a SQL literal inside a template: nothing in it is an escape of SQL's or a place of the template's."""
    return "r'" + pattern.replace("{", "{{").replace("}", "}}") + "'"


#: Text in which letters and digits beyond the Basic Multilingual Plane are two characters of it, as their UTF-16 units are two.
FLAT = f"CASE WHEN {{text}} RLIKE {literal(ASTRAL)} THEN regexp_replace(regexp_replace({{text}}, {literal(r'[\x{10000}-\x{10FFFF}&&\p{L}]')}, 'øø'), {literal(r'[\x{10000}-\x{10FFFF}&&\p{N}]')}, '٠٠') ELSE {{text}} END"
#: Words joined by spaces, with one in front as well, so that a search for words begins at a space; and those that dashes do not part.
WORDS = f"concat(' ', trim(regexp_replace({{flat}}, {literal(r'[^\p{L}\p{N}]+')}, ' ')))"
DASHED = f"CASE WHEN {{flat}} RLIKE {literal('[–—-]')} THEN concat(' ', trim(regexp_replace({{flat}}, {literal(r'[^\p{L}\p{N}–—-]+')}, ' '))) ELSE {{words}} END"

#: What measures are made of, each found once, as SQL over the struct of a text's counts (see counting).
COUNTS = {k: f"{{counted}}.{k}" for k in counting.NAMES} | {"count": "coalesce({counted}.count, 1.0D)", "filled": "coalesce({counted}.filled, 0.0D)"}


@dataclass(frozen=True)
class Criterion:
    """A criterion of text quality in three SQL templates: `measure` over {counts}, the ratio, mean or percentage that it judges; `score` over {m}, its measure; and
    `counts` of its own, if those of COUNTS are not enough, over {text}, {words} and {dashed}, each a pass of its own. Its share of the total is score * weight."""

    measure: str
    score: str
    weight: float = 1.0
    counts: dict[str, str] = field(default_factory=dict)


def ratio(x: str, y: str) -> str:
    return f"CASE WHEN {y} > 0 THEN ({x}) / ({y}) END"


def falling(good: float, bad: float, span: float | None = None) -> str:
    """1 up to good, 0 from bad, and between them what is left to bad, in parts of span."""
    return f"CASE WHEN {{m}} <= {good!r}D THEN 1.0D WHEN {{m}} >= {bad!r}D THEN 0.0D ELSE ({bad!r}D - {{m}}) / {bad - good if span is None else span!r}D END"


#: The twelve criteria (fixed values: thresholds and weights).
CRITERIA: dict[str, Criterion] = {
    "word_length": Criterion("{chars} / {count}", "greatest(0.0D, CASE WHEN {m} < 5 THEN 1.0D - (5.0D - {m}) / 2.0D WHEN {m} > 11 THEN 1.0D - ({m} - 11.0D) / 2.0D ELSE 1.0D END)", 1.0),
    "diacritics": Criterion(ratio("{lithuanian}", "{chars} - {numbers}"), f"CASE WHEN {{m}} IS NULL OR {{m}} < 0.01D OR {{m}} > 0.3D THEN 0.0D WHEN {{m}} < 0.05D THEN ({{m}} - 0.01D) / {0.05 - 0.01!r}D WHEN {{m}} <= 0.2D THEN 1.0D ELSE (0.3D - {{m}}) / {0.3 - 0.2!r}D END", 2.0),
    "junk_symbols": Criterion(ratio("{junk}", "{size}"), f"coalesce({falling(0.02, 0.1)}, 0.0D)", 5.0),
    "capitalised": Criterion("{upper} / {count}", f"CASE WHEN {{m}} = 0 THEN 0.5D WHEN {{m}} < 0.01D THEN 0.5D + {{m}} / 0.01D * 0.5D WHEN {{m}} <= 0.1D THEN 1.0D WHEN {{m}} <= 0.2D THEN (0.2D - {{m}}) / {0.2 - 0.1!r}D ELSE 0.0D END", 2.0),
    "sentence_marks": Criterion("{marks} / {count}", f"CASE WHEN {{m}} < {0.08 - 0.05!r}D THEN {{m}} / {0.08 - 0.05!r}D WHEN {{m}} > {0.08 + 0.05!r}D THEN (1.0D - {{m}}) / {1.0 - (0.08 + 0.05)!r}D ELSE 1.0D END", 2.0),
    "long_words": Criterion("{over20} / {count}", falling(0.02, 0.1), 1.0),
    "short_words": Criterion("({count} - {over3}) / {count}", falling(0.1, 0.3, 0.3 - 0.05), 2.0),
    "plain_letters": Criterion(ratio("{chars} - {foreign} + {lithuanian}", "{size}"), "coalesce({m}, 0.0D)", 1.0),
    "single_letters": Criterion("(CASE WHEN {chars} = 0 THEN 0.0D ELSE {count} END - {over1}) / {count}", falling(0.03, 0.05), 3.0),
    "inner_capitals": Criterion(f"({ratio('{inner}', '{over2}')}) * 100.0D", f"coalesce({falling(1.0, 3.0)}, 1.0D)", 1.5),
    "inner_digits": Criterion(f"({ratio('{digits}', '{dashed2}')}) * 100.0D", f"coalesce({falling(1.0, 15.0)}, 1.0D)", 5.0),
    "not_empty": Criterion("{filled}", "CASE WHEN {m} = 0 THEN -100.0D ELSE 1.0D END", 1.0),
}
WEIGHTS = {k: c.weight for k, c in CRITERIA.items()}


def all_counts(criteria: dict[str, Criterion]) -> dict[str, str]:
    own = dict(COUNTS)
    for name, c in criteria.items():
        for k, v in c.counts.items():
            if own.setdefault(k, v) != v:
                raise ValueError(f"criterion {name}: there is another count {k}")
    return own


def with_measures(df: DataFrame, text_col: str, prefix: str, criteria: dict[str, Criterion] = CRITERIA) -> DataFrame:
    """df with a column prefix_<criterion> for each measure of a text column.

    The counts that all share come from one pass over each text. Words, own counts of criteria, then measures are columns of their own: what is used more
    than once further up is kept apart by Catalyst, so that each pattern is evaluated once, and what nobody asks for is pruned.
    """
    own, found = df.columns, all_counts(criteria)
    at = {k: f"`{prefix}__{k}`" for k in ("counted", "flat", "words", "dashed", *found)} | {"text": f"`{text_col}`"}
    df = df.withColumn(f"{prefix}__counted", counting.text_counts(F.col(f"`{text_col}`")))
    for name, template in (("flat", FLAT), ("words", WORDS), ("dashed", DASHED)):
        df = df.withColumn(f"{prefix}__{name}", F.expr(template.format_map(at)))
    df = df.withColumns({f"{prefix}__{k}": F.expr(v.format_map(at)) for k, v in found.items()})
    return df.select(*[F.col(f"`{c}`") for c in own], *[F.expr(c.measure.format_map(at)).alias(f"{prefix}_{k}") for k, c in criteria.items()])


def scores(prefix: str, text: Column, criteria: dict[str, Criterion] = CRITERIA) -> dict[str, Column]:
    """The score of each criterion, before its weight, from columns prefix_<criterion>. A null text has null scores."""
    return {k: F.when(text.isNotNull(), F.expr(c.score.format(m=f"`{prefix}_{k}`"))) for k, c in criteria.items()}


def with_total(df: DataFrame, text_col: str, out: str, criteria: dict[str, Criterion] = CRITERIA, weights: DataFrame | None = None) -> DataFrame:
    """df with the weighted sum of all scores of a text column. Weights are those of the criteria, or those of a table (criterion string, weight double) read as
    a subquery of one row: criteria that it lacks weigh nothing, and of several rows for one the sum counts."""
    by = scores(f"{out}__m", F.col(text_col), criteria)
    measured, whole = with_measures(df, text_col, f"{out}__m", criteria), F.lit(0.0)
    if weights is not None:
        own = weights.where(F.col("criterion").isin(list(criteria))).groupBy("criterion").agg(F.sum("weight").alias("weight"))
        measured = measured.withColumn(f"{out}__w", own.agg(F.map_from_entries(F.collect_list(F.struct("criterion", "weight")))).scalar())
    for k, c in criteria.items():
        whole = whole + by[k] * (F.lit(c.weight) if weights is None else F.coalesce(F.col(f"{out}__w")[k], F.lit(0.0)))
    return measured.withColumn(out, whole).drop(f"{out}__w", *[f"{out}__m_{k}" for k in criteria])


def first_is_better(a: Column, a_total: Column, b: Column, b_total: Column) -> Column:
    """Whether the first of two texts stands: it has the higher total or they are equal, or the second is null or empty and the first is not."""
    no = lambda c: c.isNull() | (c == "")
    return F.when(no(b), True).when(no(a), False).otherwise(F.round(a_total, 9) >= F.round(b_total, 9))


def with_better(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """df with the text of the higher total of two columns, the first if they are equal; where one is null or empty, the other."""
    both = with_total(with_total(df, a, f"{out}__a"), b, f"{out}__b")
    first = first_is_better(F.col(a), F.col(f"{out}__a"), F.col(b), F.col(f"{out}__b"))
    return both.withColumn(out, F.when(first, F.col(a)).otherwise(F.col(b))).drop(f"{out}__a", f"{out}__b")
