"""Token ids as length-delimited binary records with masked checksums, and a separate index of offsets.

A shard file is a run of records in TFRecord's framing:

    uint64 length | uint32 masked CRC-32C of the length's bytes | payload | uint32 masked CRC-32C of the payload

all little-endian; the mask rotates a checksum right by 15 bits and adds 0xa282ead8, so that checksums of data that
hold checksums stay sound. The payload is the sequence's ids as unsigned 16-bit integers if the vocabulary fits, else
32-bit. The index is a Parquet table with, for each record, file, offset, length, id and token counts. A shuffled read
joins or sorts that index and fetches ranges; the shards are never rewritten.

Recovery: each task attempt writes a file of its own, and the index rows, which Spark's committer makes visible only for the
attempt that counted, name it. What a lost executor left behind is a file that no index row names.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import keyed_texts, mapped
from foliospark.llm.tokens import Store, encoder

POLY, MASK = 0x82F63B78, 0xA282EAD8
CHUNK = 64
END_ID = 2


# --- CRC-32C over many byte strings at once ---


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(POLY), t >> np.uint32(1)).astype(np.uint32)
    return t


TABLE = _byte_table()


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = tables[0][crc & np.uint32(255)]
    for k in (1, 2, 3):
        out = out ^ tables[k][(crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _shifts(levels: int = 40) -> list[np.ndarray]:
    """Tables that advance a checksum register over CHUNK, 2 CHUNK, 4 CHUNK ... zero bytes; the map is linear."""
    ones = (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32)
    for _ in range(CHUNK):
        ones = TABLE[ones & np.uint32(255)] ^ (ones >> np.uint32(8))
    out = []
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    for _ in range(levels):
        tables = np.zeros((4, 256), np.uint32)
        for k in range(4):
            for i in range(8):
                tables[k] ^= np.where(bits[:, i], ones[8 * k + i], 0).astype(np.uint32)
        out.append(tables)
        ones = _apply(tables, ones)
    return out


SHIFTS = _shifts()


def _short(part: bytes) -> int:
    if len(part) >= 4:
        return 0
    c = 0xFFFFFFFF
    for b in part:
        c = int(TABLE[(c ^ b) & 255]) ^ (c >> 8)
    return c ^ 0xFFFFFFFF


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each byte string. Zeros in front don't change a register that starts at zero, so every string is filled up
    in front to whole chunks; chunks run side by side, then pairs of neighbours are joined. The register's start at all ones is the
    same as turning over the first 4 bytes; shorter strings go byte by byte."""
    if not parts:
        return np.empty(0, np.uint32)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    if lengths.min() < 4:
        out = np.fromiter(map(_short, parts), np.uint32, len(parts))
        long = np.flatnonzero(lengths >= 4)
        out[long] = crc32c([parts[i] for i in long.tolist()])
        return out
    counts = -(-lengths // CHUNK)
    ends = np.cumsum(counts) * CHUNK
    buf = np.zeros(int(ends[-1]), np.uint8)
    for part, end, n in zip(parts, ends.tolist(), lengths.tolist()):
        buf[end - n : end] = np.frombuffer(part, np.uint8)
    starts = ends - lengths
    for k in range(4):
        buf[starts + k] ^= 0xFF
    columns = np.ascontiguousarray(buf.reshape(-1, CHUNK).T)
    crc = np.zeros(columns.shape[1], np.uint32)
    for column in columns:
        crc = TABLE[(crc ^ column) & np.uint32(255)] ^ (crc >> np.uint32(8))
    level = 0
    while len(crc) > len(parts):
        first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        crc = np.insert(crc, first[counts % 2 == 1], 0)
        crc = _apply(SHIFTS[level], crc[0::2]) ^ crc[1::2]
        counts, level = (counts + 1) // 2, level + 1
        if len(crc) == len(parts):
            break
    return crc ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


def framed(payloads: list[bytes]) -> list[bytes]:
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    a, b = masked(crc32c(heads)).astype("<u4"), masked(crc32c(payloads)).astype("<u4")
    return [h + x.tobytes() + p + y.tobytes() for h, x, p, y in zip(heads, a, payloads, b)]


def unframed(records: list[bytes], where: str = "") -> list[bytes]:
    """The payloads. A length or checksum that doesn't hold raises ValueError."""
    heads, payloads = [r[:8] for r in records], [r[12:-4] for r in records]
    if any(struct.unpack("<Q", h)[0] != len(p) for h, p in zip(heads, payloads)):
        raise ValueError(f"record length damaged {where}")
    said = np.frombuffer(b"".join(r[8:12] + r[-4:] for r in records), "<u4").reshape(-1, 2)
    if len(records) and ((masked(crc32c(heads)) != said[:, 0]).any() or (masked(crc32c(payloads)) != said[:, 1]).any()):
        raise ValueError(f"record checksum damaged {where}")
    return payloads


# --- tokens ---


#: How a tokenizer file must split texts for Encoder to put them together from parts (fixed value): letters, single digits, or other
#: characters, and white space dropped.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Latin-1 in lower case, with spaces for ASCII white space.
LOWER = bytes(32 if 9 <= c <= 13 else ord(chr(c).lower()) for c in range(256))


def divisible(tokenizer: dict) -> bool:
    """Whether a tokenizer file's ids of a text are those of its parts in turn, by what the file says.

    The normalizers must be NFC, lower case (of single characters) and white space to one space: none joins or changes characters across ASCII
    white space, and a letter of Latin-1 has the ids of its lower case. Texts must be split by SPLIT: no match spans white space, and none looks
    behind. Special tokens must be plain strings without white space, and nothing may be added to the ids.
    """
    plain = [{"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}]
    split = [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
    added = tokenizer.get("added_tokens") or []
    return (
        all(n in plain for n in (tokenizer.get("normalizer") or {}).get("normalizers", [None]))
        and {"type": "Lowercase"} in tokenizer["normalizer"]["normalizers"]
        and (tokenizer.get("pre_tokenizer") or {}).get("pretokenizers") == split
        and tokenizer.get("post_processor") is None
        and all(t["content"].startswith("<|") and not re.search(r"\s", t["content"]) and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in added)
    )


class Encoder(Store):
    """Cuts texts at ASCII white space, for tokenizer files that say that nothing reaches across it."""

    folded = True

    divisible = staticmethod(divisible)

    @staticmethod
    def cut(text: str) -> list[str]:
        """Chunks between spaces; in lower case where that is known to change no id: Latin-1 without special tokens."""
        try:
            raw = text.encode("latin-1")
            if b"<|" not in raw:
                return raw.translate(LOWER).decode("latin-1").split(" ")
        except UnicodeEncodeError:
            pass
        return text.translate(BLANKS).split(" ")

    @staticmethod
    def beside(chunk: str) -> str:
        return chunk + " "

    def fixed(self) -> dict[str, bytes]:
        return {"": b""}

    def __call__(self, texts: list[str | None], end: int) -> list[bytes]:
        tail = self.packed([end])
        return [x + tail for x in self.parts([t or "" for t in texts])]


BLANKS = str.maketrans("\t\n\v\f\r", "     ")


# --- Spark jobs ---


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one task's shard; called with a batch, it gives that batch's index columns. The file is opened with the first batch."""

    def __init__(self, out: str, tokenizer: str, end_id: int, chunked: bool):
        self.out, self.encode, self.end_id = out, encoder(Encoder, tokenizer, chunked), end_id
        self.shard = TaskContext.get().partitionId()
        self.name, self.sink = f"shard-{self.shard:06d}-{uuid.uuid4().hex}.rec", None
        self.seq = self.offset = self.start = 0

    def __call__(self, b: dict) -> dict:
        if self.sink is None:
            files, root = _open(self.out)
            files.create_dir(root, recursive=True)
            self.sink = files.open_output_stream(f"{root}/{self.name}")
        payloads = self.encode(b["text"], self.end_id)
        records = framed(payloads)
        for r in records:
            self.sink.write(r)
        n, size = len(records), self.encode.kind.itemsize
        lengths = np.fromiter(map(len, records), np.int64, n)
        tokens = np.fromiter(map(len, payloads), np.int64, n) // size
        got = {"shard": np.full(n, self.shard, np.int32), "seq": self.seq + np.arange(n), "file": [self.name] * n, "offset": self.offset + np.cumsum(lengths) - lengths, "length": lengths, "width": np.full(n, size, np.int32), "n_tokens": tokens, "local_start": self.start + np.cumsum(tokens) - tokens}
        self.seq, self.offset, self.start = self.seq + n, self.offset + int(lengths.sum()), self.start + int(tokens.sum())
        return got

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()


INDEX = "shard int, seq bigint, file string, offset bigint, length bigint, width int, n_tokens bigint, local_start bigint"


def write_records(docs: DataFrame, out: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, chunked: bool = True) -> None:
    """Encode every text and write shards and index below the URI `out`, in ascending order of id.

    Null texts count as empty; every record ends with end_id. Null ids come first. Rows of one id follow each other by a
    hash of the text, then the text; a huge group of one id is spread over shards by that hash. An empty table gives no shards
    and an empty index. Other columns are not looked at. `chunked` is for tokenizers whose split drops white space (Encoder).
    """
    by = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    dealt = keyed_texts(docs, id_col, text_col).repartitionByRange(*by).sortWithinPartitions(*by, "text")
    mapped(dealt, lambda: ShardWriter(out, tokenizer, end_id, chunked), ["text"], ["doc_id"], INDEX).write.mode("overwrite").parquet(f"{out}/index")


def read_index(spark: SparkSession, out: str) -> DataFrame:
    """The index with `start`, the number of ids in all records before. Totals are one row for each shard: a task's worth of
    documents, so their running sum and the broadcast are small whatever the input (a few MB at 100,000 shards)."""
    index = spark.read.parquet(f"{out}/index")
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    base = totals.select(F.col("shard"), F.expr("sum(n) OVER (ORDER BY shard) - n").alias("base"))
    return index.join(F.broadcast(base), "shard").withColumn("start", F.col("base") + F.col("local_start")).drop("base")


def read_records(spark: SparkSession, out: str, index: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary of little-endian uint32, ids_crc32) for the index rows given, in their order within
    each task; every length and checksum is verified. Neighbouring records are fetched in one range read, so a sorted index
    reads shards in sequence and a shuffled or filtered one only what it names."""
    index = read_index(spark, out) if index is None else index

    def start():
        files, root = _open(out)

        def run(b: dict) -> dict:
            records, k, n, last, source = [], 0, len(b["file"]), None, None
            names, offsets, lengths = b["file"], b["offset"], b["length"]
            while k < n:
                j, end = k + 1, offsets[k] + lengths[k]
                while j < n and names[j] == names[k] and offsets[j] == end and end - offsets[k] < 1 << 24:
                    end += lengths[j]
                    j += 1
                if names[k] != last:
                    if source:
                        source.close()
                    last, source = names[k], files.open_input_file(f"{root}/{names[k]}")
                source.seek(offsets[k])
                raw = source.read(end - offsets[k])
                records += [raw[o - offsets[k] : o - offsets[k] + m] for o, m in zip(offsets[k:j], lengths[k:j])]
                k = j
            if source:
                source.close()
            ids = [np.frombuffer(p, "<u2" if w == 2 else "<u4").astype("<u4").tobytes() for p, w in zip(unframed(records, f"in {out}"), b["width"])]
            return {"n_tokens": [len(x) // 4 for x in ids], "ids": ids, "ids_crc32": [zlib.crc32(x) for x in ids]}

        return run

    return mapped(index.select("doc_id", "start", "file", "offset", "length", "width"), start, ["file", "offset", "length", "width"], ["doc_id", "start"], "n_tokens bigint, ids binary, ids_crc32 bigint")


def shuffled_index(index: DataFrame, seed: int) -> DataFrame:
    """The index in a random order for one epoch, the same for the same seed."""
    key = F.xxhash64(F.lit(seed), "file", "offset")
    return index.repartitionByRange(key).sortWithinPartitions(key)
