"""Hard negatives by exact integer scores: matrix products in residue number systems.

A vector's components become integers, floor(256 x). Scores of anchors with all rows are products of matrices; float32 adds integers exactly below 2^24 only,
so the product is taken modulo several small primes, in residues between -p/2 and p/2, and the signed score put together again by Chinese
remaindering with digits of the same kind. The primes are as many as the largest possible score asks for.

Anchors are dealt to blocks of about ANCHORS, rows to SLABS; a task streams the rows of its slab, in the order of their ids, past its block and keeps the best of
each anchor only. What the slabs kept is ranked by window functions. A first search finds the positives, a second the negatives in the range that each sets.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import sliced, written

SCALE = 256
ANCHOR_EVERY, FLIP_EVERY, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is at least LEAST and at most MOST hundredths of the positive's.
LEAST, MOST = 30, 90
#: Anchors in a block, about; rows that meet them at once; parts that the rows are dealt to.
ANCHORS, TILE, SLABS = 4096, 512, 16
#: Components multiplied before residues are taken again.
DEPTH = 256


# --- scores in residues ---


def primes_for(bound: int, depth: int) -> list[int]:
    """Odd primes, largest first, whose product passes 2 * bound, and whose residues' products, depth of them, add up to less than 2^24."""
    top, out, product = 2 * isqrt(((1 << 24) - 1) // max(depth, 1)) + 1, [], 1
    for p in range(min(top, 1 << 11), 2, -1):
        if product > 2 * bound:
            break
        if all(p % q for q in range(2, isqrt(p) + 1)) and p % 2:
            out.append(p)
            product *= p
    if product <= 2 * bound:
        raise ValueError("scores are too large for these residues")
    return out


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p, from -(p-1)/2 to (p-1)/2, in x's own kind of number."""
    half = (p - 1) // 2
    r = x - p * np.rint(x * x.dtype.type(1 / p))
    r[r > half] -= p
    r[r < -half] += p
    return r


def residues(x: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """float32 residues of integers given as float64: fmod is exact at any size."""
    return [balanced(np.fmod(x, p), p).astype(np.float32) for p in primes]


def products(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact inner products (int64) of the rows of a with those of b, both given by their residues."""
    digits: list[np.ndarray] = []
    for x, y, p in zip(a, b, primes):
        t = np.zeros((len(x), len(y)), np.float32)
        for k in range(0, x.shape[1], DEPTH):
            t = balanced(t + balanced(x[:, k : k + DEPTH] @ y[:, k : k + DEPTH].T, p), p)
        for d, q in zip(digits, primes):  # (t - digit) / q modulo p
            inverse = pow(q, -1, p)
            t = balanced((t - d) * np.float32(inverse - p if inverse > p // 2 else inverse), p)
        digits.append(t)
    out = np.zeros(digits[0].shape, np.int64)
    for d, p in zip(reversed(digits), reversed(primes)):
        out = out * p + d.astype(np.int64)
    return out


# --- the best of a stream ---


class Best:
    """The k best (score, id) for each of n lists. Rows are offered in the order of their ids, so that of equal scores those held stay."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, np.iinfo(np.int64).min)
        self.who, self.score, self.row = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def offer(self, who: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        if not len(who):
            return
        who, score, row = np.concatenate((self.who, who)), np.concatenate((self.score, score)), np.concatenate((self.row, row))
        order = np.lexsort((-score, who))  # stable: what is held comes first
        who, score, row = who[order], score[order], row[order]
        first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
        rank = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
        keep = rank < self.k
        self.who, self.score, self.row, rank = who[keep], score[keep], row[keep], rank[keep]
        full = rank == self.k - 1
        self.least[self.who[full]] = self.score[full]


class Search:
    """One block of anchors, past which rows are streamed."""

    def __init__(self, primes: list[int], dim: int):
        self.primes, self.dim, self.given, self.side, self.ids, self.seen = primes, dim, [], None, [], 0

    def _matrix(self, b) -> list[np.ndarray]:
        v = b.column("vector")
        n, values = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        out = np.zeros((len(v), self.dim))
        out[np.arange(self.dim)[None, :] < n[:, None]] = values
        return residues(np.floor(SCALE * out), self.primes)

    def anchors(self, b) -> None:
        self.given.append(b)

    def rows(self, b) -> None:
        if self.side is None:
            if not self.given:
                return
            self.side = [np.concatenate(x) for x in zip(*[self._matrix(g) for g in self.given])]
            self.key, self.label = (np.concatenate([g.column(c).to_numpy() for g in self.given]) for c in ("key", "label"))
            self.start()
        found = products(self.side, self._matrix(b), self.primes)
        same = self.label[:, None] == b.column("label").to_numpy()[None, :]
        self.meet(found, same, b)
        self.ids.append(b.column("vec_id"))
        self.seen += b.num_rows

    def put(self, best: Best, mask: np.ndarray, found: np.ndarray) -> None:
        who, at = np.nonzero(mask)
        best.offer(who, found[who, at], at + self.seen)

    def anchor_columns(self, names: list[str]) -> dict:
        import pyarrow as pa

        return {c: pa.concat_arrays([g.column(c) for g in self.given]) for c in names}


class Positives(Search):
    NAMES = ["key", "anchor_id", "other_id", "score"]

    def start(self) -> None:
        self.best = Best(len(self.key), POSITIVES)

    def meet(self, found, same, b) -> None:
        other = self.key[:, None] != b.column("key").to_numpy()[None, :]
        self.put(self.best, same & other & (found > self.best.least[:, None]), found)

    def done(self):
        import pyarrow as pa

        if self.side is None:
            return
        a, ids, who = self.anchor_columns(["key", "vec_id"]), pa.concat_arrays(self.ids), pa.array(self.best.who)
        yield pa.RecordBatch.from_arrays([a["key"].take(who), a["vec_id"].take(who), ids.take(pa.array(self.best.row)), pa.array(self.best.score)], names=self.NAMES)


class Negatives(Search):
    NAMES = ["key", "slot", "anchor_id", "positive_id", "positive_score", "other_id", "score"]

    def start(self) -> None:
        self.positives = [p for g in self.given for p in g.column("positives").to_pylist()]
        self.slots = max(map(len, self.positives))
        self.best, self.range = [], []
        for j in range(self.slots):
            scores = [p[j]["score"] if j < len(p) else None for p in self.positives]
            least = [1 if s is None else -(-LEAST * s // 100) for s in scores]  # 1 and 0: an empty range
            most = [0 if s is None else MOST * s // 100 for s in scores]
            self.best.append(Best(len(scores), NEGATIVES))
            self.range.append((np.array(least, np.int64)[:, None], np.array(most, np.int64)[:, None]))

    def meet(self, found, same, b) -> None:
        for best, (least, most) in zip(self.best, self.range):
            self.put(best, (found <= most) & (found >= least) & (found > best.least[:, None]) & ~same, found)

    def done(self):
        import pyarrow as pa

        if self.side is None:
            return
        a, ids = self.anchor_columns(["key", "vec_id"]), pa.concat_arrays(self.ids)
        for j, best in enumerate(self.best):
            who, own = pa.array(best.who), [self.positives[k][j] for k in best.who.tolist()]
            yield pa.RecordBatch.from_arrays(
                [a["key"].take(who), pa.array([j] * len(own), pa.int32()), a["vec_id"].take(who), pa.array([p["other_id"] for p in own], pa.int64()), pa.array([p["score"] for p in own], pa.int64()), ids.take(pa.array(best.row)), pa.array(best.score)],
                names=self.NAMES,
            )


# --- Spark jobs ---


def searched(anchors: DataFrame, rows: DataFrame, kind: type[Search], schema: str, primes: list[int], dim: int, blocks: int) -> DataFrame:
    """What each (block, slab) keeps: anchors go to all slabs of their block, rows to their slab of all blocks."""
    lacking = [c for c in anchors.columns if c not in rows.columns]
    a = anchors.withColumns({"block": F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"), "slab": F.explode(F.sequence(F.lit(0), F.lit(SLABS - 1))), "turn": F.lit(0)})
    r = rows.withColumns({c: F.lit(None).cast(anchors.schema[c].dataType) for c in lacking})
    r = r.withColumns({"slab": F.pmod(F.xxhash64("key"), F.lit(SLABS)).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "turn": F.lit(1)})
    dealt = a.unionByName(r).repartitionById(blocks * SLABS, F.col("block") * SLABS + F.col("slab")).sortWithinPartitions("block", "slab", "turn", F.col("vec_id").asc_nulls_last())

    def run(batches):
        search, at = None, None
        for b in sliced(batches, TILE):
            marks = np.stack([b.column(c).to_numpy() for c in ("block", "slab", "turn")])
            edges = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for i, j in zip(edges, edges[1:]):
                block, slab, turn = marks[:, i].tolist()
                if (block, slab) != at:
                    if search:
                        yield from search.done()
                    search, at = kind(primes, dim), (block, slab)
                (search.rows if turn else search.anchors)(b.slice(i, j - i))
        if search:
            yield from search.done()

    return dealt.mapInArrow(run, schema)


def mine(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and positive its first NEGATIVES rows of another label
    whose score is in the range that the positive's sets.

    Rows with a null label or vector, or a null or non-finite component, take no part. Rows with null id are no anchors; among equal scores they come last.
    Repeated rows are rows of their own: an anchor's copy may be its positive. Vectors of different length are filled up with zeros. Other columns are not looked at, and
    names may clash. An empty table, or one without anchors, gives no rows. A table in which a score could pass 2^56 is an error (components of about 10^5).
    """
    label = F.when(F.col("vec_id") % FLIP_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    own = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("int").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = written(own.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & finite).select(F.monotonically_increasing_id().alias("key"), "vec_id", label.alias("label"), "vector"), "vectors")
    anchor = F.col("vec_id") % ANCHOR_EVERY == 0
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + (F.abs(x) * SCALE + 1) * (F.abs(x) * SCALE + 1))
    said = rows.agg(F.max(square).alias("square"), F.max(F.size("vector")).alias("dim"), F.count(F.when(anchor, 1)).alias("anchors")).first()  # three numbers
    spark = embeddings.sparkSession
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not said["anchors"]:
        return spark.createDataFrame([], schema)
    if said["square"] > 2.0**56:
        raise ValueError("vectors are too long: scores could pass 2^56")
    dim, blocks = max(said["dim"], 1), -(-said["anchors"] // ANCHORS)
    primes = primes_for(int(said["square"] * (1 + 1e-9)) + 1, min(dim, DEPTH))
    anchors = rows.where(anchor)
    best = lambda keys: Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("other_id").asc_nulls_last())
    first = searched(anchors, rows, Positives, "key bigint, anchor_id bigint, other_id bigint, score bigint", primes, dim, blocks)
    chosen = first.withColumn("rank", F.row_number().over(best(["key"]))).where(F.col("rank") <= POSITIVES)
    lists = chosen.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other_id", "score"))), lambda x: F.struct(x["other_id"].alias("other_id"), x["score"].alias("score"))).alias("positives"))
    second = searched(anchors.join(lists, "key"), rows, Negatives, "key bigint, slot int, anchor_id bigint, positive_id bigint, positive_score bigint, other_id bigint, score bigint", primes, dim, blocks)
    ranked = second.withColumn("rank", F.row_number().over(best(["key", "slot"]))).where(F.col("rank") <= NEGATIVES)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
