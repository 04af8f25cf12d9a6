"""New files extracted as they arrive, and changed ones when the folder is scanned again.

What one run extracts is one commit: results, rejects and the list of files seen are written below folders named for it, and then a row that says that it counts.
Readers look at commits that have that row, so results and rejects appear together or not at all; a run that was stopped before is run
again under its name and replaces what it left. A file that comes again with the content that a commit has seen is passed over; one with other content
is extracted anew, and its newest result stands.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliospark.functions.text import extension
from foliospark.plans.extract import extract
from foliospark.session import written

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
COMMIT = "commit string, number bigint"


def as_requests(listed: DataFrame) -> DataFrame:
    return listed.select(F.col("path").alias("doc_id"), F.col("path").alias("uri"), extension(F.col("path")).alias("extension"), "content", F.col("modificationTime").alias("modified"), "length")


def arriving(spark: SparkSession, path: str, glob: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """Files of a folder as a stream of requests; each path comes once, as long as the stream's checkpoint is kept."""
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return as_requests(reader.load(path))


def put(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def commits(spark: SparkSession, out: str) -> DataFrame | None:
    """(commit, number) of what counts; None before the first."""
    try:
        return spark.read.schema(COMMIT).parquet(f"{out}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def committed(spark: SparkSession, out: str, kind: str) -> DataFrame | None:
    """The rows of a kind (results, rejects, seen) of all commits that count, with `number`; None before the first."""
    done = commits(spark, out)
    return done and spark.read.option("basePath", f"{out}/{kind}").option("mergeSchema", "true").parquet(f"{out}/{kind}").withColumn("commit", F.col("commit").cast("string")).join(F.broadcast(done), "commit")  # a row for each commit


def newest(rows: DataFrame) -> DataFrame:
    """Of each doc_id the rows of its last commit."""
    last = rows.groupBy("doc_id").agg(F.max("number").alias("number"))
    return rows.join(last, ["doc_id", "number"], "left_semi")


def results(spark: SparkSession, out: str) -> DataFrame | None:
    """The newest result of each file that succeeded when it was last extracted."""
    good, seen = committed(spark, out, "results"), committed(spark, out, "seen")
    return good and good.join(newest(seen).select("doc_id", "number"), ["doc_id", "number"], "left_semi")


def rejects(spark: SparkSession, out: str) -> DataFrame | None:
    """(doc_id, error) of files that failed when they were last extracted."""
    bad, seen = committed(spark, out, "rejects"), committed(spark, out, "seen")
    return bad and bad.join(newest(seen).select("doc_id", "number"), ["doc_id", "number"], "left_semi")


def commit(requests: DataFrame, out: str, name: str) -> int:
    """Extract requests (doc_id, uri, extension, content, modified, length) as one commit. Gives its number; that of the first run if it was committed before, and 0 if
    nothing new was there."""
    spark = requests.sparkSession
    before = commits(spark, out)
    done = {r["commit"]: r["number"] for r in before.collect()} if before else {}  # a row for each commit
    if name in done:
        return done[name]
    asked = requests.withColumn("digest", F.sha2("content", 256))
    seen = committed(spark, out, "seen")
    if seen is not None:
        asked = asked.join(newest(seen).select("doc_id", "digest"), ["doc_id", "digest"], "left_anti")
    asked = written(asked, "asked")
    if asked.isEmpty():
        return 0
    found = written(extract(asked), "results")
    put(found.where("success"), f"{out}/results/commit={name}")
    put(found.where("not success").select("doc_id", "error"), f"{out}/rejects/commit={name}")
    put(asked.select("doc_id", "digest", "modified", "length"), f"{out}/seen/commit={name}")
    number = max(done.values(), default=0) + 1
    spark.createDataFrame([(name, number)], COMMIT).coalesce(1).write.mode("append").parquet(f"{out}/commits")
    return number


def extract_stream(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of `arriving` is a commit, named for its number."""

    def sink(batch: DataFrame, number: int) -> None:
        commit(batch, out, f"stream-{number:09d}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def extract_changes(spark: SparkSession, path: str, out: str, glob: str | None = None) -> int:
    """One commit of the files below a path that no commit has seen with their time and size: new ones, and those that were written over, which a stream does
    not give again. Contents are read of these only."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    listed, seen = reader.load(path), committed(spark, out, "seen")
    if seen is not None:
        known = newest(seen).select(F.col("doc_id").alias("path"), F.col("modified").alias("modificationTime"), "length")
        new = listed.select("path", "modificationTime", "length").join(known, ["path", "modificationTime", "length"], "left_anti")
        listed = listed.join(new.select("path"), "path", "left_semi")
    before = commits(spark, out)
    return commit(as_requests(listed), out, f"scan-{before.count() + 1 if before else 1:09d}")
