"""Mixing sources to target weights by Poisson replication, with built-in functions only.

A source with n documents and target weight w of an output of `total` documents has mean repetition rate
total * w / n. Each document's count is drawn by inverting the Poisson distribution at a uniform number that is a hash of seed and
id: the same on any cluster, on any rerun. The document is exploded into that many copies, and the copies are dealt over the
output by a second hash, sorted: a global shuffle without a random generator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A rate above this is drawn as a sum of independent draws of equal rates below it, so that exp(-rate) stays well above zero.
STEP = 32
#: Terms of the distribution function that are listed for one draw: beyond these its tail is below 2^-53 for any rate up to STEP.
TERMS = 128
#: Sources whose table of rates is broadcast, at most: 10 MB.
FEW = 10_000


def rates(docs: DataFrame, source_col: str, weights: dict[str | None, float] | None, total: float | None, power: float) -> DataFrame:
    """(src, n, rate, draws, cdf) for each source. Without weights, a source's weight is its number of documents to `power`.
    The table is marked for broadcast if it was counted to have at most FEW rows, a kilobyte each."""
    spark = docs.sparkSession
    counts = docs.groupBy(F.col(f"`{source_col}`").cast("string").alias("src")).agg(F.count("*").alias("n"))
    if weights is None:
        counts = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(power)))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "src string, w double")
        counts = counts.join(given.withColumnRenamed("src", "__s"), F.col("src").eqNullSafe(F.col("__s")), "left").select("src", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    sums = counts.agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.count("*").alias("sources")).first()  # three numbers
    w_sum, goal = sums["w"] or 1.0, float(total if total is not None else sums["n"] or 0)
    rate = F.when(F.col("w") > 0, F.lit(goal) * F.col("w") / F.lit(w_sum) / F.col("n")).otherwise(F.lit(0.0))
    out = counts.select("src", "n", rate.alias("rate")).withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP)).cast("int"))
    step = out.withColumn("step", F.col("rate") / F.col("draws"))
    cdf = F.expr(f"transform(aggregate(sequence(1, {TERMS}), array(named_struct('p', exp(-step), 'c', exp(-step))), (acc, k) -> concat(acc, array(named_struct('p', element_at(acc, -1).p * step / k, 'c', element_at(acc, -1).c + element_at(acc, -1).p * step / k)))), x -> x.c)")
    made = step.withColumn("cdf", cdf).drop("step")
    return F.broadcast(made) if sums["sources"] <= FEW else made


def replicate(docs: DataFrame, weights: dict[str | None, float] | None = None, total: float | None = None, power: float = 0.5, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The columns of docs, with copy (from 1), n_copies and shuffle_key, in the order of shuffle_key.

    The mean number of copies of source s is total * w_s / n_s; total is the number of rows of docs where not given. Given
    weights need not add up to 1; sources that they lack get none, as do those of weight zero or less. Null sources are a source of their own. Null ids and repeated
    rows draw by their id like any other: rows of one id get the same count. Texts are not looked at. An empty table stays
    empty. Columns of docs that are named like the three new ones give way to them; all others come back as they are, whatever their names.

    The table of rates, one row for each source, is broadcast if it has at most FEW rows, so that texts move once; beyond it the join on source is an
    ordinary one, whose hot keys adaptive execution splits.
    """
    made = rates(docs, source_col, weights, total, power)
    kept = [c for c in docs.columns if c.lower() not in ("copy", "n_copies", "shuffle_key")]
    column = lambda c: F.col(f"`{c}`")
    # the caller's columns go by their place, so that no name of theirs can meet ours
    own = docs.select(*[column(c).alias(f"given{k}") for k, c in enumerate(kept)], column(source_col).cast("string").alias("src"), F.coalesce(column(id_col).cast("string"), F.lit("")).alias("id"), column(id_col).alias("order"))
    joined = own.join(made.select(F.col("src").alias("of"), "draws", "cdf"), F.col("src").eqNullSafe(F.col("of")))
    drawn = joined.withColumn("us", F.expr(f"transform(sequence(1, draws), k -> cast(cast(conv(substring(md5(concat_ws(':', '{int(seed)}', id, cast(k as string))), 1, 13), 16, 10) as bigint) as double) / {float(1 << 52)!r}D)"))
    counted = drawn.withColumn("n_copies", F.expr("aggregate(us, 0L, (acc, u) -> acc + size(filter(cdf, c -> c <= u)))"))
    copies = counted.where("n_copies > 0").withColumn("copy", F.explode(F.expr("sequence(1L, n_copies)")))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{int(seed)}/order"), "id", F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long")
    out = copies.withColumn("shuffle_key", key).repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key", "order", "copy")
    return out.select(*[F.col(f"given{k}").alias(c) for k, c in enumerate(kept)], "copy", "n_copies", "shuffle_key")
