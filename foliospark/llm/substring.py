"""Duplicate substrings by relative Lempel-Ziv factors.

The reference is the corpus itself, earlier text before later, dealt into blocks of text over the cluster. A block holds, in the order
of the corpus, every stretch of text around one anchor, and each stretch is parsed against what the block holds of earlier text: a
factor (start, length, ref_doc, ref_start) says that length words from start are those at ref_start of ref_doc, and is greedily
extended while the reference goes on in step. Where it stops, phrases that straddle the boundary are looked up like any others, so
a duplicate that is put together from several places is found as well. Factors of at least `size` words become duplicate spans: it is the
factors' words, and nothing else, that are removed.

Hashes only decide which block a phrase of `size` words goes to: that of its anchor, the least hash of the runs of ANCHOR words in it. Equal
phrases have equal anchors, and neighbouring phrases mostly share theirs. Only anchors that are found twice or more can hold a
duplicate; others, most of the text, are dropped after a count. In a block phrases are looked up by their words, so two texts whose
hashes agree by chance meet in one block and are told apart there.
Under anchors with more than HOT occurrences, each phrase is filed under its own hash, so that no anchor's group grows without
bound; tasks resolve what they can before the shuffle, so that of a phrase that a third of all documents share, each passes on one.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import keyed_texts, mapped, sliced, window_hashes, word_hashes, written

SIZE, ANCHOR, HOT = 20, 5, 10_000
#: Stretches that a task remembers, and bytes of them, to resolve their like before the shuffle.
COMBINED, COMBINED_BYTES = 100_000, 32 << 20


def phrases(text: str | None, size: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (the first `bits` bits) of all phrases, their anchors, and all anchor candidates."""
    runs, drop = word_hashes((text or "").encode("utf-8", "surrogatepass")), np.uint64(64 - bits)
    whole, short = window_hashes(runs, size) >> drop, window_hashes(runs, min(ANCHOR, size)) >> drop
    if not len(whole):
        return whole, whole, short
    least = short[: len(whole)].copy()
    for k in range(1, size - min(ANCHOR, size) + 1):
        np.minimum(least, short[k : k + len(whole)], out=least)
    return whole, least, short


def _anchors(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """(key, anchor, n): the anchors of each document, and how often the run of words that is the anchor stands there."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([docs.schema["key"], T.StructField("anchor", T.LongType()), T.StructField("n", T.LongType())])
    names = to_arrow_schema(schema).names

    def run(batches):
        for b in sliced(batches):
            at, anchors, counts = [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                _, least, short = phrases(text, size, bits)
                if not len(least):
                    continue
                own = np.unique(least)
                there = np.sort(short)
                n = np.searchsorted(there, own, "right") - np.searchsorted(there, own, "left")
                at.append(np.full(len(own), i)), anchors.append(own), counts.append(n)
            if at:
                rows = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays([b.column("key").take(rows), pa.array(np.concatenate(anchors).view(np.int64)), pa.array(np.concatenate(counts).astype(np.int64))], names=names)

    return docs.select("key", "text").mapInArrow(run, schema)


def _order(key) -> tuple:
    """Spark's order of keys: nulls first."""
    return tuple((v is not None, v) for v in key.values()) if isinstance(key, dict) else (key is not None, key)


RUN = "deal bigint, anchor bigint, start bigint, words binary, n bigint, ref_start bigint"
FACTOR = "start bigint, n bigint, ref_start bigint"


def _runs(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """For documents with the list `repeated` of their anchors found twice or more, and among these `hots`: each stretch of phrases under
    one such anchor, as (key, deal, anchor, start, words joined by spaces). Under a hot anchor each phrase is filed under itself.

    This is also the combiner before the shuffle: a stretch of the same words as one met in this task, earlier in the corpus, is a factor
    at once (n, ref_start, ref_key, no words). So of a huge group of copies each task passes on one.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    key = docs.schema["key"]
    schema = T.StructType([key, *T._parse_datatype_string(RUN).fields, T.StructField("ref_key", key.dataType)])
    kinds = to_arrow_schema(schema)

    def run(batches):
        met: dict[bytes, tuple] = {}
        held = 0
        for b in sliced(batches):
            out: list[list] = [[] for _ in kinds]
            at = out[0]
            for i, (key, text, repeated, hots) in enumerate(zip(*[b.column(c).to_pylist() for c in ("key", "text", "repeated", "hots")])):
                whole, least, _ = phrases(text, size, bits)
                wanted = np.isin(least, np.array(repeated, np.int64).view(np.uint64))
                if not wanted.any():
                    continue
                if len(met) > COMBINED or held > COMBINED_BYTES:
                    met.clear()
                    held = 0
                words = text.encode("utf-8", "surrogatepass").split()
                flat, begin = b" ".join(words), [0, *accumulate(len(w) + 1 for w in words)]
                order, signed = _order(key), least.view(np.int64)
                cut = np.concatenate(([0], np.flatnonzero(np.diff(least)) + 1, [len(least)]))
                stretches = [(x, y, int(signed[x])) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()) if wanted[x]]
                if hots:
                    single, own = set(hots), whole.view(np.int64).tolist()
                    stretches = [z for x, y, a in stretches for z in ([(k, k + 1, own[k]) for k in range(x, y)] if a in single else [(x, y, a)])]
                for x, y, a in stretches:
                    own_words = flat[begin[x] : begin[y + size - 1] - 1]
                    mine, first = (order, x), met.get(own_words)
                    at.append(i)
                    out[2].append(a), out[3].append(x), out[5].append(y - x)
                    if first is not None and (first[0], first[1]) < mine:
                        out[1].append((a + 0x9E3779B1 * (x + i)) % (1 << 62)), out[4].append(None), out[6].append(first[1]), out[7].append(first[2])
                    else:
                        met[own_words] = (order, x, key)
                        held += len(own_words)
                        out[1].append(a), out[4].append(own_words), out[6].append(None), out[7].append(None)
            if at:
                yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(at))] + [pa.array(c, f.type) for c, f in zip(out[1:], list(kinds)[1:])], names=kinds.names)

    return docs.select("key", "text", "repeated", "hots").mapInArrow(run, schema)


def _parsed(runs: DataFrame, size: int) -> DataFrame:
    """(key, start, n, ref_start, ref_key): factors of n phrases each. Expects the stretches with words of an anchor in one task, by key and
    start. Each is parsed from the left: a factor goes on as long as the words of the next phrase stand where the reference goes on."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    key = runs.schema["key"]
    schema = T.StructType([key, *T._parse_datatype_string(FACTOR).fields, T.StructField("ref_key", key.dataType)])
    kinds = to_arrow_schema(schema)

    def run(batches):
        anchor, seen = None, {}
        for b in sliced(batches):
            out: list[list] = [[] for _ in kinds]

            def put(*row) -> None:
                for c, x in zip(out, row):
                    c.append(x)

            for key, a, start, raw, n, ref_start, ref_key in zip(*[b.column(c).to_pylist() for c in ("key", "anchor", "start", "words", "n", "ref_start", "ref_key")]):
                if raw is None:
                    put(key, start, n, ref_start, ref_key)
                    continue
                if a != anchor:
                    anchor, seen = a, {}
                begun = length = ref = None
                begin = [0, *accumulate(len(w) + 1 for w in raw.split(b" "))]
                for k, (x, y) in enumerate(zip(begin, begin[size:]), start):
                    first = seen.setdefault(raw[x : y - 1], (key, k))
                    if first == (key, k):
                        first = None
                    if ref is not None and first is not None and first[0] == ref[0] and first[1] == ref[1] + length:
                        length += 1
                        continue
                    if ref is not None:
                        put(key, begun, length, ref[1], ref[0])
                    begun, length, ref = k, 1, first
                if ref is not None:
                    put(key, begun, length, ref[1], ref[0])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, kinds)], names=kinds.names)

    return runs.mapInArrow(run, schema)


def factors(texts: DataFrame, size: int = SIZE, hot: int = HOT, bits: int = 64) -> DataFrame:
    """(key, start, n, ref_start, ref_key) for texts of (key, text), keys distinct: n phrases from start, of size words each, stand
    earlier, from ref_start of ref_key: under a smaller key, or before start under the same. Every such phrase is in one factor.
    `bits` is the length of the hashes that deal phrases out; the result does not depend on it."""
    own = written(_anchors(texts, size, bits), "anchors")
    counts = own.groupBy("anchor").agg(F.sum("n").alias("total")).where("total > 1").select(F.col("anchor").alias("of"), (F.col("total") > hot).alias("hot"))
    lists = own.join(counts, F.col("anchor") == F.col("of")).select(F.col("key").alias("of_key"), F.struct("anchor", "hot").alias("x"))
    lists = lists.groupBy("of_key").agg(F.collect_list("x").alias("xs"))
    listed = texts.join(lists, F.col("key").eqNullSafe(F.col("of_key"))).select("key", "text", F.expr("xs.anchor").alias("repeated"), F.expr("transform(filter(xs, x -> x.hot), x -> x.anchor)").alias("hots"))
    return _parsed(_runs(listed, size, bits).repartition("deal").sortWithinPartitions("anchor", "key", "start"), size)


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, hot: int = HOT, bits: int = 64) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, spans array<struct<a, b>>) for each row: words [a, b) are in phrases that stand earlier in
    the corpus: in a row of smaller id, or before in the same text. kept_text is the other words, joined by single spaces.

    Null texts have no words. Where ids are null or repeated, rows go by (id, hash of text), null first, and rows with equal texts and ids
    are one document: each gets its result, and none is earlier than the other. An empty table gives an empty result.
    """
    texts = keyed_texts(docs, id_col, text_col)
    unique = texts.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()
    texts = texts.select((F.col("doc_id") if unique else F.struct("doc_id", F.xxhash64("text").alias("text_hash"))).alias("key"), "text")
    distinct = texts if unique else texts.dropDuplicates(["key"])
    found = factors(distinct, size, hot, bits)
    spans = found.groupBy(F.col("key").alias("of_key")).agg(F.collect_list(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n") + (size - 1)).alias("b"))).alias("raw"))
    joined = texts.join(spans, F.col("key").eqNullSafe(F.col("of_key")), "left").select("key", "text", "raw")

    def start():
        def run(b: dict) -> dict:
            out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_text": [], "spans": []}
            for text, raw in zip(b["text"], b["raw"]):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                spans: list[list[int]] = []
                for x, y in sorted((r["a"], r["b"]) for r in raw or ()):
                    if spans and x <= spans[-1][1]:
                        spans[-1][1] = max(y, spans[-1][1])
                    else:
                        spans.append([x, y])
                kept, at = [], 0
                for x, y in spans:
                    kept += words[at:x]
                    at = y
                kept += words[at:]
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["kept_text"].append(b" ".join(kept).decode("utf-8", "surrogatepass"))
                out["spans"].append([{"a": x, "b": y} for x, y in spans])
            return out

        return run

    out = mapped(joined, start, ["text", "raw"], ["key"], "n_words bigint, n_removed bigint, kept_text string, spans array<struct<a:bigint,b:bigint>>")
    return out.select((F.col("key") if unique else F.col("key.doc_id")).alias("doc_id"), "n_words", "n_removed", "kept_text", "spans")
