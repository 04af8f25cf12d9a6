"""SimHash fingerprints, and covering locality-sensitive hashing to link those within a Hamming radius.

Covering hashing: give every bit i of the fingerprint a vector m(i) of radius + 1 bits. For each of the
2^(radius+1) - 1 non-zero vectors v, the mask of v keeps the bits with <m(i), v> odd. At most `radius`
differing bits span at most `radius` dimensions, so some v is orthogonal to all of their m(i): under
that mask the two fingerprints are equal. No pair within the radius is lost, whatever the data.

Work is on distinct fingerprints, so a group of exact copies counts once. A fingerprint whose masked
value is its own in all tables has no neighbour and goes no further. In the tables where it has company,
links are found without pairs: for radius 2, two fingerprints of one bucket are within 2 bits if and only if
some value is within 1 bit of both, so each sends itself to the values that it reaches by flipping at most one
masked-out bit, and all that arrive at one value are linked to the least of them. A bucket of n
fingerprints therefore makes n x (masked-out bits + 1) rows, never n^2.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import discard, keyed_texts, mapped, work_dir, written

SHINGLE, BITS, RADIUS, SEED = 3, 64, 2, 42
#: For each byte value the bits that it sets, lowest first.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of lower-cased (A-Z) words' shingles; 0 without words. Fewer words than a shingle make one shingle."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest, flat = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle:
        return digest(flat, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate(([0], np.cumsum(lengths)))
    ends = (starts[shingle:] - 1).tolist()
    n = len(ends)
    hashes = np.fromiter([digest(flat[a:b], SEED) for a, b in zip(starts.tolist(), ends)], np.uint64, n)
    as_bytes = hashes.view(np.uint8).reshape(n, 8)
    out = 0
    for k in range(8):
        ones = np.bincount(as_bytes[:, k], minlength=256) @ BYTE_BITS
        out |= sum(1 << (8 * k + i) for i in np.flatnonzero(2 * ones > n).tolist())
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash long, fp long) for every row; a null text has no words."""

    def start():
        return lambda b: {"fp": np.array([fingerprint(t) for t in b["text"]], dtype=np.uint64).view(np.int64)}

    texts = keyed_texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return mapped(texts, start, ["text"], ["doc_id", "text_hash"], "fp bigint")


def masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """The kept bits of each table. m(i) runs through the non-zero vectors in turn, so that masks are of like size."""
    m = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (m[i] & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b), b < a, among distinct fingerprints (column fp), whose components are those of "within 2 bits"."""
    tables = masks()
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for k, m in enumerate(tables)])).alias("x")).select("fp", "x.t", "x.key")
    shared = keyed.groupBy("t", "key").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least <> most").select("t", "key")
    met = keyed.join(shared, ["t", "key"])
    flips = F.element_at(F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in tables]), F.col("t") + 1)
    near = met.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at")).distinct()
    least = near.groupBy("at").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).where("b <> most").select("at", "b")
    return near.join(least, "at").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every node of an edge, the least node of its component.

    Alternating stars: each node hands its larger neighbours, then its smaller ones, to the least that it knows,
    so that depth falls quickly. Each round is written to the shared folder, and the one before it deleted. Hubs are grouped
    by partial aggregation and joined back, where adaptive execution can split them; no group is ever collected.
    """
    spark = edges.sparkSession

    def kept(df: DataFrame) -> tuple[str, DataFrame]:
        path = work_dir(spark, "edges")
        df.write.parquet(path)
        return path, spark.read.schema(df.schema).parquet(path)

    path, now = kept(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        root = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        old, (path, now) = path, kept(small)
        discard(old)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long, component_id) per row: component_id is the least doc_id reachable by links of at most 2 bits.

    Null, blank and empty texts have fingerprint 0 and link like any other. Repeated rows each get a row.
    An empty table gives an empty result. Null ids take part, and lose to any other as component_id.
    """
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    return prints.join(named(prints, F.col("doc_id")), "fp").select("doc_id", "fp", F.col("name").alias("component_id"))


def named(prints: DataFrame, value: Column) -> DataFrame:
    """(fp, name): for each distinct fingerprint the least `value` among all rows of its component."""
    first = written(prints.groupBy("fp").agg(F.min(value).alias("first")), "distinct")
    groups = components(links(first.select("fp")))
    members = groups.join(first, groups["node"] == first["fp"]).select("node", "root", "first")
    least = members.groupBy("root").agg(F.min("first").alias("component"))
    multi = members.join(least, "root").select(F.col("node").alias("fp"), "component")
    return written(first.join(multi, "fp", "left").select("fp", F.coalesce("component", "first").alias("name")), "names")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, columns unchanged: that with the least id, null being the largest, and of one id that with the
    least hash of its text. A row only goes for one of its own component: rows that share an id, or have none, but are not near
    each other, all stay. Of rows with equal id and text that with the least JSON form of all its columns stays.
    """
    mine = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints").withColumn("mine", mine)
    key = [F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")]
    lost = prints.join(named(prints, F.col("mine")), "fp").where(~F.col("mine").eqNullSafe(F.col("name"))).select(*key).distinct()
    again = prints.groupBy(*key).count().where("count > 1").select("__id", "__hash")
    own_id, own_hash = docs[f"`{id_col}`"], F.xxhash64(docs[f"`{text_col}`"])
    same = lambda other: own_id.eqNullSafe(other["__id"]) & (own_hash == other["__hash"])
    kept = docs.join(lost, same(lost), "left_anti")
    if again.isEmpty():
        return kept
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = kept.join(again, same(again), "left_semi").groupBy(own_id, own_hash).agg(F.min_by(row, F.to_json(row)).alias("__row"))
    return kept.join(again, same(again), "left_anti").unionByName(one.select("__row.*"))
