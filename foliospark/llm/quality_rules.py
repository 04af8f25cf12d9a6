"""Quality rules: base counts, and divergence of character classes and common words from the language's own.

For each language of the corpus, rows without one being a language of their own, a first pass counts character classes and words over all
documents that are long enough. A document's
histograms of classes and of the language's most common words (all other words being one class) are then compared with those by
Jensen-Shannon distance, the root of the divergence in bits. A short text strays from any reference by chance: a histogram of k
classes over n draws has an expected divergence of about (k - 1) / (8 n ln 2), which the limit adds to
the divergence that is tolerated.
Texts under a minimum length are not judged by divergence at all.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import BLANK, mapped, sliced, window_hashes, word_hashes, written


@dataclass(frozen=True)
class Rules:
    """Documented limits. Base: fewer than min_words words, or more than max_repeat percent of words in repeated windows."""

    min_words: int = 20
    max_repeat: int = 30
    window: int = 8
    #: Guards: texts with fewer words or characters in words are not judged by divergence.
    judged_words: int = 50
    judged_chars: int = 200
    common_words: int = 40
    #: Distances tolerated in texts of any length.
    class_tolerance: float = 0.28
    word_tolerance: float = 0.2
    #: Languages whose references are sent to tasks at once, about 100 bytes for each common word; more are judged in several passes.
    languages: int = 1000


RULES = Rules()
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
#: Character classes of bytes: lower, upper, digit, blank, stops, quotes and brackets, other ASCII, letters beyond ASCII (their first byte).
CLASSES = 8


def _class_of() -> np.ndarray:
    of = np.full(256, 6, np.int64)
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\x0b\x0c\r", b".,;:!?", b"'\"()[]{}-")):
        of[list(chars)] = k
    of[0xC0:] = 7
    of[0x80:0xC0] = CLASSES  # the rest of a character that is counted by its first byte
    return of


CLASS_OF = _class_of()


def byte_counts(raw: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(raw, np.uint8), minlength=256)


def class_counts(by_byte: np.ndarray) -> np.ndarray:
    return np.bincount(CLASS_OF, weights=by_byte, minlength=CLASSES + 1)[:CLASSES]


def repeated_words(raw: bytes, window: int) -> int:
    """Words that lie in a window found twice or more."""
    h = window_hashes(word_hashes(raw), window)
    if len(h) < 2:
        return 0
    _, back, n = np.unique(h, return_inverse=True, return_counts=True)
    if len(n) == len(h):
        return 0
    edge = np.zeros(len(h) + window, np.int64)
    at = np.flatnonzero(n[back] > 1)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def duplicate_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def distance(a: np.ndarray, b: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, 0 to 1."""
    p, q = a / a.sum(), b / b.sum()
    m = (p + q) / 2
    part = lambda x: float(np.sum(x[x > 0] * np.log2(x[x > 0] / m[x > 0])))
    return math.sqrt(max(0.0, (part(p) + part(q)) / 2))


def limit(tolerance: float, classes: int, n: float) -> float:
    return math.sqrt(tolerance**2 + (classes - 1) / (8 * n * math.log(2)))


Reference = dict[str | None, tuple[list[float], dict[str, int]]]


def word_counts(docs: DataFrame, rules: Rules = RULES, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, word, n, c0, c1, ...) over all documents with enough words, written to the shared folder; the classes stand at the null word.
    One pass; words are counted per batch before the shuffle."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string("lang string, word string, n bigint, classes array<double>")
    kinds = to_arrow_schema(schema)

    def run(batches):
        words: dict[str | None, Counter] = {}
        classes: dict[str | None, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            rows = [(lang, w.decode("utf-8", "surrogatepass"), n, None) for lang, c in words.items() for w, n in c.items()]
            rows += [(lang, None, None, x.tolist()) for lang, x in classes.items()]
            words.clear(), classes.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)] if rows else [pa.array([], f.type) for f in kinds], names=kinds.names)

        for b in sliced(batches):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                tokens = raw.lower().split()
                if len(tokens) < rules.judged_words:
                    continue
                words.setdefault(lang, Counter()).update(tokens)
                classes[lang] = classes.get(lang, 0) + class_counts(byte_counts(raw))
            if sum(map(len, words.values())) > 200_000:
                yield out()
        yield out()

    source = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    counted = source.mapInArrow(run, schema)
    # sums of classes meet the words in one table, under the null word
    return written(counted.groupBy("lang", "word").agg(F.sum("n").alias("n"), *[F.sum(F.col("classes")[k]).alias(f"c{k}") for k in range(CLASSES)]), "word-counts")


def references(counts: DataFrame, rules: Rules = RULES) -> Reference:
    """For each language of word_counts: class counts, and its common words with their counts; under the key "" of these the count of all words.
    What reaches the driver is common_words + 2 rows for each language."""
    # the most common of each slice of a language's words, then the most common of those: no language's words meet in one task
    words = counts.where("word is not null").select("lang", "word", "n", F.pmod(F.xxhash64("word"), F.lit(64)).alias("slice"))
    top = lambda df, *by: df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "word"))).where(F.col("r") <= rules.common_words).drop("r")
    out: Reference = {}
    for r in counts.where("word is null").collect():
        out[r["lang"]] = ([r[f"c{k}"] for k in range(CLASSES)], {})
    for r in top(top(words, "lang", "slice"), "lang").collect():
        out[r["lang"]][1][r["word"]] = r["n"]
    for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect():
        out[r["lang"]][1][""] = r["n"]
    return out


class Judge:
    def __init__(self, known: Reference, rules: Rules = RULES):
        self.rules, self.known = rules, {}
        for lang, (classes, words) in known.items():
            common = [w for w in words if w]
            rest = max(0, words.get("", 0) - sum(words[w] for w in common))
            self.known[lang] = (np.array(classes, float), {w.encode("utf-8", "surrogatepass"): i for i, w in enumerate(common)}, np.array([*(words[w] for w in common), rest], float))

    def measure(self, text: str | None, lang: str | None) -> dict:
        r = self.rules
        raw = (text or "").encode("utf-8", "surrogatepass")
        by_byte = byte_counts(raw)
        words = raw.split()
        chars = int(by_byte.sum() - by_byte[0x80:0xC0].sum() - by_byte[BLANK].sum())
        repeated = repeated_words(raw, r.window)
        out = {"n_words": len(words), "word_chars": chars, "n_symbols": int(by_byte[SYMBOLS].sum()), "n_dup_lines": duplicate_lines(raw), "n_repeat_words": repeated, "class_distance": None, "word_distance": None}
        out["base_failed"] = len(words) < r.min_words or 100 * repeated > r.max_repeat * len(words)
        good = True
        if len(words) >= r.judged_words and chars >= r.judged_chars:
            ref_classes, index, ref_words = self.known[lang]  # a text of so many words is part of it
            counts, found = class_counts(by_byte), Counter(raw.lower().split())
            own = np.zeros(len(ref_words))
            for w, i in index.items():
                own[i] = found.get(w, 0)
            own[-1] = len(words) - own.sum()
            a, b = distance(counts, ref_classes), distance(own, ref_words)
            good = a <= limit(r.class_tolerance, CLASSES, counts.sum()) and b <= limit(r.word_tolerance, len(ref_words), len(words))
            out["class_distance"], out["word_distance"] = a, b
        out["kept"] = good and not out["base_failed"]
        return out


ADDED = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, class_distance double, word_distance double, base_failed boolean, kept boolean"


def judge(docs: DataFrame, rules: Rules = RULES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, base counts, distances (null where not judged), base_failed and kept for every row.

    Null texts have no words and fail the base rules, as empty ones do. Rows with a null language are compared with each other. Repeated rows
    each get a row. An empty table gives an empty result.
    """
    counts = word_counts(docs, rules, text_col, lang_col)
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    known = counts.where("word is null").select("lang")
    passes = max(1, -(-known.count() // rules.languages))
    place = lambda: F.pmod(F.xxhash64("lang"), F.lit(passes))
    while passes > 1 and known.groupBy(place().alias("p")).count().agg(F.max("count")).first()[0] > rules.languages:
        passes += 1

    def judged(part: DataFrame, sent) -> DataFrame:
        def start():
            own = Judge(sent.value, rules)

            def run(b: dict) -> dict:
                rows = [own.measure(t, lang) for t, lang in zip(b["text"], b["lang"])]
                return {k: [r[k] for r in rows] for k in rows[0]} if rows else {x.split()[0]: [] for x in ADDED.split(", ")}

            return run

        return mapped(part, start, ["text", "lang"], ["doc_id"], ADDED)

    if passes == 1:
        return judged(source, docs.sparkSession.sparkContext.broadcast(references(counts, rules)))
    # each row is judged in the pass that has its language
    parts = [judged(source.where(place() == k), docs.sparkSession.sparkContext.broadcast(references(counts.where(place() == k), rules))) for k in range(passes)]
    return reduce(DataFrame.unionByName, parts)
