"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the windows of the benchmark items: 13 consecutive words, or the whole item if it is shorter. Patterns of
one length m are searched together. The search looks at the block of the last two words under the current end. A shift table, addressed by
the block's hash, says how far the end can move before any pattern could end there: m - 1 words for a block that is in none, and the
least of all where blocks share a slot. At a slot of shift 0 its bucket holds the patterns that end so, sorted by the hash of their
first block; those with the hash of the text's are compared with it word by word.

The words of the benchmark are kept once, as a list of shared byte strings; a pattern is the place of its first word there. All else is
arrays of numbers, so that the tables of a block of benchmark text take a few times its bytes (README has the figures).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import kept_where, keyed_texts, mapped, sliced, worker_keeps, written

WINDOW = 13
#: Bytes of benchmark words that one broadcast holds; a larger benchmark is searched block by block.
BLOCK_BYTES = 8 << 20
#: Words of one piece of a long item.
PIECE = 4096
#: Every byte that is in no word becomes a space: below "0", ":" to "`", "{" to DEL, after A-Z are lowered.
WORDS = bytes(x + 32 if 65 <= x <= 90 else 32 if x < 0x30 or 0x3A <= x <= 0x60 or 0x7B <= x <= 0x7F else x for x in range(256))
CONTAMINATED = "n_hit > 0 and 20 * n_hit >= n_words"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()


class Patterns:
    """Search tables for the windows of m words of texts (item number, words), each of m words or more."""

    def __init__(self, m: int, texts: list[tuple[int, list[bytes]]]):
        self.m, self.block = m, min(2, m)
        self.flat = [w for _, words in texts for w in words]
        lengths = np.array([len(words) for _, words in texts], np.int64)
        firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        size = 1 << max(10, (2 * len(self.flat)).bit_length())
        self.mask = size - 1
        # the hash of the block that begins at each word; blocks across two texts are never asked for
        blocks = np.fromiter(map(hash, self.flat) if self.block == 1 else map(hash, zip(self.flat, [*self.flat[1:], b""])), np.int64, len(self.flat))
        slots = blocks & self.mask
        inside = np.arange(len(self.flat)) - np.repeat(firsts, lengths)
        left = np.repeat(lengths, lengths) - inside
        whole = left >= self.block
        shift = np.full(size, m - self.block + 1, np.uint8)
        np.minimum.at(shift, slots[whole], np.maximum(0, m - self.block - inside[whole]).astype(np.uint8))
        places = np.flatnonzero(left >= m)
        ends, prefix = slots[places + m - self.block], (blocks[places] & 0xFFFFFFFF).astype(np.uint32)
        order = np.lexsort((prefix, ends))
        starts = np.zeros(size + 1, np.uint32)
        np.cumsum(np.bincount(ends, minlength=size), out=starts[1:])
        self.shift, self.starts, self.prefix = bytes(shift), memoryview(starts), memoryview(prefix[order])
        self.places = memoryview(places[order].astype(np.uint32))
        self.owners = memoryview(np.repeat(np.array([i for i, _ in texts], np.uint32), lengths)[places][order])

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[int]]]:
        """(first word, item numbers) of each occurrence."""
        m, n, mask, shift, starts, prefix = self.m, len(words), self.mask, self.shift, self.starts, self.prefix
        pair, end = self.block == 2, m - 1
        while end < n:
            slot = hash((words[end - 1], words[end]) if pair else words[end]) & mask
            step = shift[slot]
            if step:
                end += step
                continue
            low, high, start = starts[slot], starts[slot + 1], end - m + 1
            if low < high:
                mine = hash((words[start], words[start + 1]) if pair else words[start]) & 0xFFFFFFFF
                k, items = bisect_left(prefix, mine, low, high), set()
                here = words[start : end + 1]
                while k < high and prefix[k] == mine:
                    at = self.places[k]
                    if self.flat[at : at + m] == here:
                        items.add(self.owners[k])
                    k += 1
                if items:
                    yield start, items
            end += 1


class Search:
    """The tables of one block of items (name or None, words joined by spaces)."""

    def __init__(self, rows: list[tuple[str | None, bytes]], window: int = WINDOW):
        same: dict[bytes, bytes] = {}
        numbers: dict[str | None, int] = {}
        by: dict[int, list[tuple[int, list[bytes]]]] = defaultdict(list)
        for name, words in rows:
            own = [same.setdefault(w, w) for w in words.split(b" ")]
            by[min(window, len(own))].append((numbers.setdefault(name, len(numbers)), own))
        self.names, self.tables = list(numbers), [Patterns(m, texts) for m, texts in sorted(by.items())]

    def __call__(self, words: list[bytes]) -> tuple[int, list[tuple[int, int]], list[str | None]]:
        """Number of words, merged spans of hit words, names of items, None last."""
        spans, found = [], set()
        for p in self.tables:
            for start, items in p.search(words):
                spans.append((start, start + p.m))
                found |= items
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return len(words), merged, sorted((self.names[i] for i in found), key=lambda x: (x is None, x or ""))


def search_of(key: str, rows, window: int) -> Search:
    """The Search of a broadcast block; a worker keeps that of the last block."""
    return worker_keeps((Search, key), lambda: Search(rows.value, window))


def pieces(benchmark: DataFrame, item_id: str, item_text: str, window: int) -> DataFrame:
    """(item, words binary), distinct: the words of each item, joined by spaces; long items in pieces that overlap by window - 1 words, so
    that each window lies in one of them. Items without words give nothing."""
    import pyarrow as pa

    rows = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{item_text}`").alias("text"))
    step = max(PIECE, 2 * window) - window + 1

    def run(batches):
        for b in sliced(batches):
            at, out = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                words = words_of(text)
                for k in range(0, max(1, len(words) - window + 1) if words else 0, step):
                    at.append(i), out.append(b" ".join(words[k : k + step + window - 1]))
            if at:
                yield pa.RecordBatch.from_arrays([b.column("item").take(pa.array(at)), pa.array(out, pa.binary())], names=["item", "words"])

    return rows.mapInArrow(run, "item string, words binary").distinct()


def blocks_of(benchmark: DataFrame, item_id: str, item_text: str, window: int, block_bytes: int) -> list:
    """For each block of the benchmark a function that collects and broadcasts it, when its turn comes: it gives the function that tasks call to get their Search,
    and the broadcast, to be destroyed after. Sizes are counted before anything is sent: a block has at most block_bytes, or is one piece, and the
    driver holds one block at a time."""
    spark = benchmark.sparkSession
    own = written(pieces(benchmark, item_id, item_text, window), "benchmark").withColumn("bytes", F.length("words") + 40)
    whole = own.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("all"), F.coalesce(F.max("bytes"), F.lit(0)).alias("most")).first()
    n = max(1, -(-whole["all"] // block_bytes))
    place = lambda: F.pmod(F.xxhash64("item", "words"), F.lit(n))
    while n > 1 and own.groupBy(place().alias("b")).agg(F.sum("bytes").alias("s")).agg(F.max("s")).first()[0] > max(block_bytes, whole["most"]):
        n *= 2

    def sent(k: int):
        rows = sorted(((r["item"], bytes(r["words"])) for r in own.where(place() == k).select("item", "words").collect()), key=lambda r: (r[0] is None, r[0] or "", r[1]))
        held = spark.sparkContext.broadcast(rows)
        return partial(search_of, hashlib.sha256(repr((window, rows)).encode()).hexdigest(), held, window), held

    return [partial(sent, k) for k in range(n)]


def _spans(docs: DataFrame, searches: list, id_col: str, text_col: str) -> DataFrame:
    """What find_spans gives, and row_hash."""
    texts = keyed_texts(docs, id_col, text_col).withColumn("row_hash", F.xxhash64("text"))

    def scan(search) -> DataFrame:
        def start():
            own = search()

            def run(b: dict) -> dict:
                out = [own(words_of(t)) for t in b["text"]]
                return {"n_words": [x[0] for x in out], "n_hit": [sum(y - x for x, y in o[1]) for o in out], "spans": [[{"a": x, "b": y} for x, y in o[1]] for o in out], "items": [o[2] for o in out]}

            return run

        return mapped(texts, start, ["text"], ["doc_id", "row_hash"], "n_words bigint, n_hit bigint, spans array<struct<a:bigint,b:bigint>>, items array<string>")

    if len(searches) == 1:
        return scan(searches[0]()[0])
    found = None
    for sent in searches:
        search, held = sent()
        one = written(scan(search), "spans")
        held.destroy()
        found = one if found is None else found.unionByName(one)
    last = "element_at(acc, -1)"
    merged = f"aggregate(all_spans, cast(array() as array<struct<a:bigint,b:bigint>>), (acc, x) -> if(size(acc) > 0 and x.a <= {last}.b, concat(slice(acc, 1, size(acc) - 1), array(named_struct('a', {last}.a, 'b', greatest({last}.b, x.b)))), concat(acc, array(x))))"
    rows = found.groupBy("doc_id", "row_hash", "n_words").agg((F.count("*") / len(searches)).cast("int").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("all_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return rows.withColumn("spans", F.expr(merged)).withColumn("copy", F.explode(F.expr("sequence(1, n)"))).select("doc_id", "row_hash", "n_words", F.expr("aggregate(spans, 0L, (acc, x) -> acc + x.b - x.a)").alias("n_hit"), "spans", "items")


def find_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, spans array<struct<a, b>>, items array<string>) for each row: spans of hit words [a, b), merged and sorted.

    The benchmark is a stated query set against all documents. What fits in block_bytes is broadcast after its size was read; a larger one is
    cut into blocks, each searched by a pass over the documents, and the passes' spans are merged for each row. Items without an id are
    searched like others and stand as one null, last in `items`; items without words match nothing; items of one id count as one.
    Null documents have no words. Repeated rows each get a row. Without documents the result is empty; without items nothing is hit.
    """
    return _spans(docs, blocks_of(benchmark, item_id, item_text, window, block_bytes), id_col, text_col).drop("row_hash")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the contaminated ones (hit words are a twentieth of all or more); columns unchanged. Each row goes by its own text: others
    with its id, or none, stay. With one block of benchmark text rows are dropped as they are read; with more, by (id, hash of text)."""
    searches = blocks_of(benchmark, item_id, item_text, window, block_bytes)
    if len(searches) == 1:
        search, _ = searches[0]()

        def start():
            own = search()

            def clean(text: str | None) -> bool:
                n, spans, _ = own(words_of(text))
                hit = sum(b - a for a, b in spans)
                return not (hit and 20 * hit >= n)

            return clean

        return kept_where(docs, start, text_col)
    bad = _spans(docs, searches, id_col, text_col).where(CONTAMINATED).select(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__hash")).distinct()
    return docs.join(bad, docs[f"`{id_col}`"].eqNullSafe(bad["__id"]) & (F.xxhash64(docs[f"`{text_col}`"]) == bad["__hash"]), "left_anti")
