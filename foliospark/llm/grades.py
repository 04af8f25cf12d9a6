"""Ordinal quality: a cumulative-link logistic regression on hashed text.

One weight vector is shared by all grades: P(grade <= k) = s(t_k - w.x) with ordered thresholds t_0 < t_1 < ..., so a text's place
on one scale gives the probability of each grade, the expected grade and the probability of at least a given grade.

Ratings: the labels table has two marks, so a row's grade is 0 for low quality, 1 for good quality but toxic, 2 for good quality and not toxic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import keyed_texts, mapped, word_hashes, written
from foliospark.llm.quality_rules import CLASSES, byte_counts, class_counts, duplicate_lines, repeated_words

DIM = 1 << 16
#: Shape features stand at the head of the vector; hashed words follow.
SHAPES = CLASSES + 6
GRADES = 3
#: Labelled rows that the model is fitted on, at most: those with the least hash of doc_id.
FIT_ROWS = 6000
#: Entries of their vectors, at most: 64 MB on the driver.
FIT_ENTRIES = 8_000_000
#: A text is selected if the probability of at least this grade is SELECT_AT or more.
SELECT_GRADE, SELECT_AT = 1, 0.5


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's vector. Words are lower-cased (A-Z), hashed, and weighted by a damped count; the part has norm 1."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    hashes = word_hashes(raw.lower())
    n = len(hashes)
    shape = np.zeros(SHAPES)
    if raw:
        counts = class_counts(byte_counts(raw))
        shape[:CLASSES] = counts / counts.sum()
    if n:
        lines = raw.count(b"\n") + 1
        shape[CLASSES:] = (1.0, min(1.0, np.log1p(n) / 10), len(np.unique(hashes)) / n, repeated_words(raw, 8) / n, duplicate_lines(raw) / lines, min(1.0, len(raw) / n / 20))
    which, times = np.unique((hashes >> np.uint64(20)).astype(np.int64) % (DIM - SHAPES), return_counts=True)
    values = np.log1p(times)
    if n:
        values = values / np.sqrt((values**2).sum())
    used = np.flatnonzero(shape)
    return np.concatenate((used, which + SHAPES)).astype(np.int32), np.concatenate((2 * shape[used], values)).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, index: np.ndarray, values: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ..."""
        place = float(self.weights[index] @ values)
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds - place, -60, 60)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def solved(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int = GRADES, steps: int = 250, rate: float = 0.05, penalty: float = 2e-5) -> Model:
    """Penalised maximum likelihood by Adam on all rows at once; classes count alike. Thresholds are a first one and positive gaps, so they stay ordered."""
    cut = n_grades - 1
    w, first, gaps = np.zeros(DIM), -1.0, np.zeros(cut - 1)
    if not len(rows):
        return Model(w, np.arange(cut) - cut)
    lengths = np.array([len(i) for i, _ in rows])
    index, value = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]).astype(np.float64)
    row = np.repeat(np.arange(len(rows)), lengths)
    share = np.bincount(grades, minlength=n_grades).astype(float)
    weight = np.sqrt(len(rows) / np.maximum(share, 1))[grades]
    weight /= weight.sum()
    state = [[np.zeros(DIM), np.zeros(DIM)], [np.zeros(cut), np.zeros(cut)]]
    for step in range(1, steps + 1):
        steps_up = np.exp(gaps)
        t = first + np.concatenate(([0.0], np.cumsum(steps_up)))
        place = np.bincount(row, weights=value * w[index], minlength=len(rows))
        bounds = np.concatenate(([-1e9], t, [1e9]))
        up, low = sigmoid(bounds[grades + 1] - place), sigmoid(bounds[grades] - place)
        p = np.maximum(up - low, 1e-9)
        d_up, d_low = up * (1 - up) / p * weight, low * (1 - low) / p * weight
        g_place = d_up - d_low  # of the negative log likelihood
        g_t = np.array([-(d_up[grades == k].sum() - d_low[grades == k + 1].sum()) for k in range(cut)])
        g_w = np.bincount(index, weights=value * g_place[row], minlength=DIM) + penalty * w
        g_theta = np.concatenate(([g_t.sum()], [g_t[k + 1 :].sum() * steps_up[k] for k in range(cut - 1)]))
        for (m, v), g, apply in zip(state, (g_w, g_theta), ("w", "t")):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            if apply == "w":
                w -= move
            else:
                first -= move[0]
                gaps -= move[1:]
    return Model(w, first + np.concatenate(([0.0], np.cumsum(np.exp(gaps)))))


def graded(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, grade) of rows with both marks; of rows that share an id, the least grade."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 2)
    return labels.select(F.col(f"`{id_col}`").alias("doc_id"), grade.alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def sample(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, fit_entries: int = FIT_ENTRIES) -> DataFrame:
    """(doc_id, grade, index, value): vectors of at most fit_rows rated ids whose crc32 mod 3 is not 1, those with the least hash, one text for each id (of several,
    that with the least hash). They end where they would have more than fit_entries entries together."""
    rows = ratings.where(F.expr("crc32(cast(doc_id as string)) % 3 <> 1")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).select(F.col("doc_id").alias("__id"), "grade")
    texts = keyed_texts(docs, id_col, text_col)
    met = texts.join(F.broadcast(rows), texts["doc_id"] == rows["__id"])  # fit_rows rows of 16 bytes at most
    one = met.groupBy("doc_id", "grade").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "grade", "t.text")

    def start():
        def run(b: dict) -> dict:
            made = [features(t) for t in b["text"]]
            return {"index": [i.tobytes() for i, _ in made], "value": [v.tobytes() for _, v in made]}

        return run

    vectors = written(mapped(one, start, ["text"], ["doc_id", "grade"], "index binary, value binary"), "vectors")
    sizes = vectors.select("doc_id", F.sum(F.octet_length("index") / 4).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")).alias("entries"))  # fit_rows rows
    return vectors.join(F.broadcast(sizes.where(F.col("entries") <= fit_entries).select("doc_id")), "doc_id")


def fit(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, fit_entries: int = FIT_ENTRIES) -> Model:
    """The model of the sampled rows (doc_id, grade); ids whose crc32 mod 3 is 1 are held out. Vectors are made on the executors; those of the sample, fit_rows with
    fit_entries entries of 8 bytes at most, are solved on the driver. Without ratings all weights are zero."""
    found = sorted(sample(docs, ratings, id_col, text_col, fit_rows, fit_entries).collect(), key=lambda r: r["doc_id"])
    return solved([(np.frombuffer(r["index"], np.int32), np.frombuffer(r["value"], np.float32)) for r in found], np.array([r["grade"] for r in found], np.int64))


def grade(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_grade, p_grade_1, p_grade_2, selected) for every row: p_grade_k is the probability of grade k or more.
    Null and empty texts have the empty vector and a defined grade. Repeated rows each get a row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIM weights

    def start():
        own = sent.value

        def run(b: dict) -> dict:
            tails = [own.at_least(*features(t)) for t in b["text"]]
            return {"expected_grade": [float(t.sum()) for t in tails], "p_grade_1": [float(t[0]) for t in tails], "p_grade_2": [float(t[1]) for t in tails]}

        return run

    out = mapped(keyed_texts(docs, id_col, text_col), start, ["text"], ["doc_id"], "expected_grade double, p_grade_1 double, p_grade_2 double")
    return out.withColumn("selected", F.col(f"p_grade_{SELECT_GRADE}") >= SELECT_AT)
