"""WARC archives with revisit records, and a two-level capture index.

Archives are files of gzip members, one for each WARC/1.1 record, so that a record can be read by its range. Of pages with equal
payloads of at least MIN_REVISIT bytes the one with the least id is a response; the others are revisits without payload that name it.

The index lists all captures by reversed-host key (com,example,www)/path), in ascending order over all of its files. Each file is a
run of compressed blocks of LINES captures, and has a directory beside it with the first key, offset and length of each block. A
table of files with their first and last keys is the top. To find a key: bisect the table, then the file's directory, read and
decompress the blocks that may hold it, bisect their lines, and read the records' ranges. A table of files has one row for each task
that wrote; directories are read by the tasks that need them, so no list of blocks is ever in one place.

Attempts write files of their own names; only those that a committed Parquet row names count.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import mapped, written

MIN_REVISIT, LINES = 100, 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
#: Name of a record whose page has no id.
NAMELESS = "<urn:page-without-id>"
#: Bytes of records that one task reads, about.
READ_BYTES = 32 << 20


def capture_key(url: str | None) -> str:
    """Reversed-host key: scheme, user, port, fragment and a leading www. go; host lower-cased and reversed, then the rest.
    Without a host, the text as it is; null gives an empty key."""
    if not url:
        return ""
    m = re.match(r"(?i)(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)([^#]*)", url.strip())
    if not m:
        return url.strip()
    host = re.sub(r":\d*$", "", m[1].rpartition("@")[2]).lower()
    host = re.sub(r"^www\d*\.", "", host)
    return ",".join(reversed(host.split("."))) + ")" + (m[2] if m[2].startswith("/") else "/" + m[2])


def record(kind: str, name: str | None, url: str | None, digest: str, payload: bytes, refers: str | None, date: str = DATE) -> bytes:
    body = HTTP + f"Content-Length: {len(payload)}\r\n\r\n".encode() + (b"" if kind == "revisit" else payload)
    head = [("WARC-Type", kind), ("WARC-Record-ID", NAMELESS if name is None else f"<urn:page:{name}>"), ("WARC-Date", date), ("WARC-Target-URI", re.sub(r"[\r\n]+", " ", url or "")), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(body)))]
    if kind == "revisit":
        head[4:4] = [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers}>")]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + body + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """Headers and payload of one record; raises ValueError if lengths or digest don't hold. A revisit has no payload but its length."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n" or len(body) != int(fields["Content-Length"]):
        raise ValueError("record length damaged")
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload damaged")
    name = lambda k: fields[k].removeprefix("<urn:page:").removesuffix(">") if fields.get(k, NAMELESS) != NAMELESS else None
    return {"type": fields["WARC-Type"], "name": name("WARC-Record-ID"), "refers": name("WARC-Refers-To"), "url": fields["WARC-Target-URI"], "digest": digest, "length": length, "payload": payload if fields["WARC-Type"] == "response" else None}


class Files:
    """Files of one output folder, written in a stream or read by ranges; a few stay open."""

    def __init__(self, out: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(out)
        self.open: dict = {}

    def create(self, name: str):
        self.fs.create_dir(self.root, recursive=True)
        return self.fs.open_output_stream(f"{self.root}/{name}", compression=None)

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        if name not in self.open:
            if len(self.open) >= 8:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.fs.open_input_file(f"{self.root}/{name}")
        f = self.open[name]
        return f.read_at(f.size() if length is None else length, offset)

    def close(self) -> None:
        for f in self.open.values():
            f.close()
        self.open.clear()


class ArchiveWriter:
    """One task's archive. The id is the page's, as text; the row tells where the record is."""

    def __init__(self, out: str, date: str):
        self.out, self.date, self.sink, self.offset = out, date, None, 0
        self.name = f"pages-{uuid.uuid4().hex}.warc.gz"

    def __call__(self, b: dict) -> dict:
        if self.sink is None:
            self.sink = Files(self.out).create(self.name)
        got: dict[str, list] = {"key": [], "file": [], "offset": [], "length": []}
        for name, url, html, digest, refers in zip(b["name"], b["url"], b["html"], b["digest"], b["refers"]):
            payload = (html or "").encode("utf-8", "surrogatepass")
            raw = gzip.compress(record("response" if refers is None else "revisit", name, url, digest, payload, refers, self.date), 3, mtime=0)
            self.sink.write(raw)
            for k, v in zip(got, (capture_key(url), self.name, self.offset, len(raw))):
                got[k].append(v)
            self.offset += len(raw)
        return got

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()


def write_archives(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """Write archives below the URI `out`; returns the captures (name, key, file, offset, length) in `out`/captures.

    Null html is an empty payload, null url an empty one. A page without id has a record without name; with the payload of a page that has
    an id it is a revisit of that one, and a response if no page with that payload has an id. Rows that repeat the id and payload of a
    response are responses too. Other columns are not looked at. Without pages there are no archives and no captures.
    """
    spark = pages.sparkSession
    own = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    own = own.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256))
    # ids by payload: digests only, aggregated before they are dealt out; texts of groups never meet
    prints = written(own.where(F.octet_length("html") >= MIN_REVISIT).select("id", "digest"), "digests")
    first = prints.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("of"), "first")
    revisits = prints.join(first, F.col("digest") == F.col("of")).where("first is not null and (id is null or id <> first)").select(F.col("id").alias("of_id"), F.col("digest").alias("of_digest"), F.col("first")).distinct()
    dealt = own.join(revisits, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("digest") == F.col("of_digest")), "left")
    rows = dealt.select(F.col("id").cast("string").alias("name"), "url", "html", "digest", F.when(F.col("of_digest").isNotNull(), F.col("first").cast("string")).alias("refers"))
    mapped(rows, lambda: ArchiveWriter(out, date), ["name", "url", "html", "digest", "refers"], ["name"], "key string, file string, offset bigint, length bigint").write.parquet(f"{out}/captures")
    return spark.read.parquet(f"{out}/captures")


def write_index(captures: DataFrame, out: str, lines: int = LINES) -> DataFrame:
    """The two-level index of captures (key, file, offset, length), written below `out`; returns the table of files
    (first, last, blocks, directory). Captures of one key are spread over files by their place, so that one hot URL is no one task's."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string("first string, last string, blocks string, directory string, n bigint")
    kinds = to_arrow_schema(schema)

    def run(batches):
        files, name, sink, offset, block, first, last, total = Files(out), f"index-{uuid.uuid4().hex}", None, 0, [], None, None, 0
        directory = []

        def flush() -> None:
            nonlocal offset, sink
            if block:
                sink = sink or files.create(f"{name}.cdx.gz")
                raw = gzip.compress("\n".join(json.dumps(x, ensure_ascii=True) for x in block).encode(), 6, mtime=0)
                sink.write(raw)
                directory.append([block[0][0], offset, len(raw)])
                offset += len(raw)
                block.clear()

        for b in batches:
            for x in zip(*[b.column(c).to_pylist() for c in ("key", "file", "offset", "length")]):
                first, last, total = x[0] if first is None else first, x[0], total + 1
                block.append(x)
                if len(block) >= lines:
                    flush()
        flush()
        if sink:
            sink.close()
            with files.create(f"{name}.dir") as f:
                f.write("\n".join(json.dumps(x, ensure_ascii=True) for x in directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((first, last, f"{name}.cdx.gz", f"{name}.dir", total), kinds)], names=kinds.names)

    by = ("key", "file", "offset")
    captures.select("key", "file", "offset", "length").repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, schema).write.parquet(f"{out}/index")
    return captures.sparkSession.read.parquet(f"{out}/index")


def lookup(keys: DataFrame, out: str) -> DataFrame:
    """(key, file, offset, length) of every capture of the distinct keys given (column key). Keys that are not there give nothing.

    First the blocks that may hold each key are found, in the order of keys; then each block is read once, by one task, for all keys
    that may be in it. A key with very many captures spans many blocks and so many tasks.
    """
    spark = keys.sparkSession
    files = sorted((r["first"], r["last"], r["blocks"], r["directory"]) for r in spark.read.parquet(f"{out}/index").collect())  # one row for each task that wrote
    top = spark.sparkContext.broadcast(files)

    def find():
        source, cache = Files(out), {}
        lasts = [f[1] for f in top.value]

        def run(b: dict) -> dict:
            refs = []
            for key in b["key"]:
                mine = []
                for first, _, blocks, directory in top.value[bisect.bisect_left(lasts, key) :]:
                    if first > key:
                        break
                    if directory not in cache:
                        if len(cache) >= 8:
                            cache.pop(next(iter(cache)))
                        rows = [json.loads(x) for x in source.read(directory).decode().split("\n")]
                        cache[directory] = ([x[0] for x in rows], rows)
                    firsts, rows = cache[directory]
                    low = max(0, bisect.bisect_left(firsts, key) - 1)
                    mine += [{"blocks": blocks, "at": x[1], "size": x[2]} for x in rows[low : bisect.bisect_right(firsts, key)]]
                refs.append(mine)
            return {"refs": refs}

        return run

    found = mapped(keys.select("key").distinct().where("key is not null").repartitionByRange("key").sortWithinPartitions("key"), find, ["key"], ["key"], "refs array<struct<blocks:string,at:bigint,size:bigint>>")
    wanted = found.select("key", F.explode("refs").alias("r")).select("key", "r.*").repartition("blocks", "at").sortWithinPartitions("blocks", "at", "key")

    def fetch():
        source, now = Files(out), {"block": None, "keys": [], "rows": []}

        def run(b: dict) -> dict:
            hits = []
            for key, blocks, at, size in zip(b["key"], b["blocks"], b["at"], b["size"]):
                if now["block"] != (blocks, at):
                    rows = [json.loads(x) for x in zlib.decompress(source.read(blocks, at, size), 31).decode().split("\n")]
                    now.update(block=(blocks, at), keys=[x[0] for x in rows], rows=rows)
                low, high = bisect.bisect_left(now["keys"], key), bisect.bisect_right(now["keys"], key)
                hits.append([{"file": x[1], "offset": x[2], "length": x[3]} for x in now["rows"][low:high]])
            return {"hits": hits}

        return run

    hits = mapped(wanted, fetch, ["key", "blocks", "at", "size"], ["key"], "hits array<struct<file:string,offset:bigint,length:bigint>>")
    return hits.select("key", F.explode("hits").alias("h")).select("key", "h.*")


def read_captures(captures: DataFrame, out: str) -> DataFrame:
    """(key, name, record_type, refers, url, digest, length, payload) of the captures given, read by ranges in the order of files.
    The tasks are as many as the records' bytes need: rows of the index alone are small, so that adaptive execution would leave all to a few."""
    wanted = written(captures.select("key", "file", "offset", "length"), "wanted")
    size = wanted.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    tasks = max(1, min(size["n"], max(wanted.sparkSession.sparkContext.defaultParallelism, -(-size["bytes"] // READ_BYTES))))

    def start():
        source = Files(out)

        def run(b: dict) -> dict:
            rows = [parsed(zlib.decompress(source.read(f, o, n), 31)) for f, o, n in zip(b["file"], b["offset"], b["length"])]
            return {"name": [r["name"] for r in rows], "record_type": [r["type"] for r in rows], "refers": [r["refers"] for r in rows], "url": [r["url"] for r in rows], "digest": [r["digest"] for r in rows], "payload_bytes": [r["length"] for r in rows], "payload": [r["payload"] for r in rows]}

        return run

    dealt = wanted.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return mapped(dealt, start, ["file", "offset", "length"], ["key"], "name string, record_type string, refers string, url string, digest string, payload_bytes bigint, payload binary")


def full_payload(read: DataFrame) -> DataFrame:
    """(name, record_type, refers, payload_bytes, digest) with those of revisits taken from the response that they name, which must be there
    with the digest that the revisit states."""
    own = written(read.select("name", "record_type", "refers", "payload_bytes", "digest"), "records")
    responses = own.where("record_type = 'response'").select(F.col("name").alias("of"), F.col("payload_bytes").alias("n"), F.col("digest").alias("d")).distinct()
    revisits = own.where("record_type = 'revisit'")
    joined = revisits.join(responses, (F.col("refers") == F.col("of")) & (F.col("digest") == F.col("d")), "left")
    checked = F.when(F.col("of").isNull(), F.raise_error(F.concat(F.lit("no response for revisit "), "name"))).otherwise(F.col("n"))
    return own.where("record_type = 'response'").unionByName(joined.select("name", "record_type", "refers", checked.cast("long").alias("payload_bytes"), F.col("d").alias("digest")))
