"""Files as rows, and their decoding in tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.text import extension
from foliospark.sources.formats import EXTENSIONS, read

FILE = "struct<name:string,path:string,size:bigint,compressed_size:bigint,extension:string,last_modified:string,is_directory:boolean,method:int,md5:string,error:string>"
#: Files that a worker turns into Python objects at once; Arrow batches themselves are bounded in bytes by Spark.
BATCH = 16


def wanted_extension(c: Column) -> Column:
    """Lower-case, pdf where none is given."""
    return F.lower(F.coalesce(F.nullif(c, F.lit("")), F.lit("pdf")))


def read_files(spark: SparkSession, path: str, glob: str | None = None, most_bytes: int | None = None) -> DataFrame:
    """(doc_id, uri, extension, content) of all files below a path, or of those up to a size if one is named. Glob, size and time are pushed to the file listing."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    if most_bytes is not None:
        files = files.where(F.col("length") <= most_bytes)
    return files.select(F.col("path").alias("doc_id"), F.col("path").alias("uri"), extension(F.col("path")).alias("extension"), "content")


def dispatched(requests: DataFrame) -> DataFrame:
    """requests with `reader` and `error`: a column `uri` that is null or blank, then an extension that is not in the table of 36, is an error of that row,
    not of the job."""
    table = requests.sparkSession.createDataFrame(sorted(EXTENSIONS.items()), "known string, reader string")
    own = requests.withColumn("extension", wanted_extension(F.col("extension")))
    joined = own.join(F.broadcast(table), F.col("extension") == F.col("known"), "left").drop("known")  # 36 rows
    error = F.when(F.col("reader").isNull(), F.concat(F.lit("unsupported extension: "), "extension"))
    if "uri" in requests.columns:
        error = F.when(F.coalesce(F.trim("uri"), F.lit("")) == "", F.lit("missing uri")).otherwise(error)
    return joined.withColumn("error", error)


def decoded(requests: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, reader, pages, metadata JSON, files, error) of dispatched rows with `content`, and the columns `keep` as they are; each file is read once."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([requests.schema["doc_id"], requests.schema["reader"], *T._parse_datatype_string(f"pages array<string>, metadata string, files array<{FILE}>, error string").fields, *[requests.schema[c] for c in keep]])
    kinds = to_arrow_schema(schema)

    def run(batches):
        for b in (whole.slice(k, BATCH) for whole in batches for k in range(0, whole.num_rows, BATCH)):
            rows = [([], "{}", [], e) if e else ([], "{}", [], "no content") if c is None else read(r, c) for r, c, e in zip(*[b.column(k).to_pylist() for k in ("reader", "content", "error")])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("reader")] + [pa.array([r[i] for r in rows], kinds.field(i + 2).type) for i in range(4)] + [b.column(c) for c in keep], names=kinds.names)

    return requests.select("doc_id", "reader", "content", "error", *keep).mapInArrow(run, schema)
