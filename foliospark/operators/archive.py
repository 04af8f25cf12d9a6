"""Archive entries as a tree of folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import extension
from foliospark.session import written

#: Levels that are folded in one plan; between such runs the folders folded so far are written.
LEVELS = 6


def tree(entries: DataFrame) -> DataFrame:
    """(doc_id, path, parent_path, name, depth, is_directory, extension, n_files): a row for each entry (doc_id, path, is_directory) and for each
    folder above one, whether it has an entry of its own or not. The depth is 1 at the top; the parent of the top is ''. A struct `info` of an entry is
    kept, null for folders without an entry; of entries with one path, the greatest."""
    info = [c for c in ("info",) if c in entries.columns]
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    own = entries.select("doc_id", parts.alias("parts"), F.col("is_directory").alias("own_dir"), *info).where(F.size("parts") > 0)
    each = own.select("doc_id", "own_dir", *info, F.size("parts").alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice("parts", F.lit(1), k), "/").alias("path"), F.array_join(F.slice("parts", F.lit(1), k - 1), "/").alias("parent_path"), F.element_at("parts", k).alias("name")))).alias("x"))
    rows = each.select("doc_id", "x.*", ((F.col("x.depth") < F.col("n")) | F.col("own_dir")).alias("dir"), (~F.col("own_dir") & (F.col("x.depth") <= F.col("n"))).cast("long").alias("file"), *[F.when(F.col("x.depth") == F.col("n"), F.col(c)).alias(c) for c in info])
    out = rows.groupBy("doc_id", "path", "parent_path", "name", "depth").agg(F.max("dir").alias("is_directory"), F.sum("file").alias("n_files"), *[F.max(c).alias(c) for c in info])
    return out.withColumn("extension", F.when(~F.col("is_directory"), extension(F.col("name"))))


def flattened(rows: DataFrame) -> DataFrame:
    """tree rows with their rank in a walk of the tree by path."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.split("path", "/"))))


def nested(rows: DataFrame, deepest: int | None = None) -> DataFrame:
    """(doc_id, tree): tree rows as JSON, a list of the nodes at the top, each {"name", "path", "is_directory", "extension", "n_files", fields of info} and, if it
    is a folder, "children", sorted by name.

    Folded from the deepest level up, with one grouping for each level: a folder's group holds its own row and its children, which are JSON already, so no more than
    one folder's direct children ever meet. The number of levels is the greatest depth, one number read from the rows unless given. Archives without entries have no row.
    """
    deepest = rows.agg(F.max("depth")).first()[0] if deepest is None else deepest
    more = [F.col(f"info.{f.name}").alias(f.name) for f in rows.schema["info"].dataType.fields] if "info" in rows.columns else []
    own = rows.select("doc_id", "path", "parent_path", "depth", "name", "is_directory", F.to_json(F.struct("name", "path", "is_directory", "extension", "n_files", *more)).alias("node"))
    child = F.struct("name", "node")
    below = None
    for d in range(deepest or 0, 0, -1):
        level = own.where(F.col("depth") == d).drop("depth").withColumn("child", F.lit(None).cast("struct<name:string,node:string>"))
        if below is not None:
            up = below.select("doc_id", F.col("parent_path").alias("path"), child.alias("child"))
            level = level.unionByName(up, allowMissingColumns=True)
        folded = level.groupBy("doc_id", "path").agg(*[F.max(c).alias(c) for c in ("parent_path", "name", "is_directory", "node")], F.transform(F.array_sort(F.collect_list("child")), lambda x: x["node"]).alias("children"))
        whole = F.concat(F.expr("left(node, length(node) - 1)"), F.lit(',"children":['), F.array_join("children", ","), F.lit("]}"))
        below = folded.select("doc_id", "path", "parent_path", "name", F.when(F.col("is_directory"), whole).otherwise(F.col("node")).alias("node"))
        if d > 1 and (deepest - d + 1) % LEVELS == 0:
            below = written(below, "tree")
    if below is None:
        return rows.select("doc_id", F.lit("").alias("tree")).limit(0)
    return below.groupBy("doc_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda x: x["node"]), ","), F.lit("]")).alias("tree"))
