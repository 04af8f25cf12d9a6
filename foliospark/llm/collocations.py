"""Phrases that stand together, from a weighted de Bruijn graph of words.

The longest grams (five words) are edges between the grams of four words that they overlap in. Each place of a text gives one gram: five words, or what is left
before the piece ends. Edges are aggregated once; the count of a shorter gram is then the flow through it: the weights of all longer grams that begin with it, and
how often a piece ends with it. Paths of nodes through which all flow is one edge in and one edge out are compacted into one passage with one weight: its windows
are the phrases of five words, and a phrase of four with the weight of such a passage is only a part of it.

A phrase that is frequent has only frequent words and frequent pairs of neighbours. A first pass counts hashes of both and leaves a bitmap of fixed size; in the
second, pieces end where a pair cannot be frequent. A hash that is met by chance lets a rare pair through, never stops a frequent one, so the counts of frequent
phrases are exact whatever the size of the bitmap: on a corpus that fills it, it only saves less.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import BASE, mixed, sliced, span_hashes, written

LONGEST, LEAST, TOP = 5, 100, 2000
#: Bits of the bitmap of frequent words and pairs, a power of two of 32,768 at least: 8 MB.
BITS = 1 << 26
#: Bytes of text that are turned into arrays at once; longer texts are divided where pieces end.
PORTION = 1 << 20
NO_LANG = "und"

ENDS = re.compile("[.,;:!?\n-\r]")
LINES = bytes(10 if chr(c) in ".,;:!?\n\v\f\r" else 32 if c == 9 else c for c in range(256))


# --- words of many texts as arrays ---


class Words:
    """The words of texts: `start` and `size` in `norm`, where they stand with one space between; `piece` number; `salt` of the language; hash `h`."""

    def __init__(self, texts: list[str], langs: list[str]):
        parts = [t.encode() for t in texts]
        data = np.frombuffer(b"\n".join(parts).lower().translate(LINES), np.uint8)
        blank = (data == 32) | (data == 10)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        self.piece = np.cumsum(data == 10)[starts] if len(starts) else starts
        begins = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
        self.lang = np.searchsorted(begins, starts, "right") - 1  # the number of the text
        self.langs = langs
        self.h = span_hashes(data, starts, ends) if len(starts) else np.empty(0, np.uint64)
        self.size = ends - starts
        self.start = np.cumsum(self.size + 1) - self.size - 1
        self.norm = np.full(int((self.size + 1).sum()), 32, np.uint8)
        self.norm[np.flatnonzero(~blank) + np.repeat(self.start - starts, self.size)] = data[~blank]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of (language, word), and of (language, word, next word) with 0 where the piece ends."""
        salts = mixed(np.array([zlib.crc32(x.encode()) for x in self.langs], np.uint64) + np.uint64(1))
        own = self.h + salts[self.lang] if len(self.h) else self.h
        pairs = np.zeros(len(own), np.uint64)
        if len(own):
            pairs[:-1] = np.where(self.piece[:-1] == self.piece[1:], mixed(own[:-1] * np.uint64(BASE) + self.h[1:]) | np.uint64(1 << 63), 0)
        return mixed(own), pairs

    def grams(self, bitmap: np.ndarray):
        """(text number, words, gram) of each place with a frequent word, as Arrow arrays."""
        import pyarrow as pa

        words, pairs = self.keys()
        met = lambda k: (bitmap[(k & np.uint64(8 * len(bitmap) - 1)) >> np.uint64(3)] >> (k & np.uint64(7)).astype(np.uint8)) & 1 != 0
        good = met(words)
        linked = np.zeros(len(words), bool)
        linked[:-1] = good[:-1] & good[1:] & (pairs[:-1] != 0) & met(pairs[:-1])
        stops, at = np.flatnonzero(~linked), np.flatnonzero(good)
        n = np.minimum(stops[np.searchsorted(stops, at)] + 1 - at, LONGEST)
        first, last = self.start[at], (self.start + self.size)[at + n - 1]
        offsets = np.concatenate(([0], np.cumsum(last - first)))
        data = self.norm[np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], last - first)]
        grams = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
        return self.lang[at], n, grams


def portions(batches):
    """(texts, languages) of about PORTION bytes each."""
    texts, langs, size = [], [], 0
    for b in sliced(batches, 100):
        for t, lang in zip(*[b.column(c).to_pylist() for c in ("text", "lang")]):
            while t:
                cut = len(t)
                if cut > PORTION:
                    end = ENDS.search(t, PORTION // 2)
                    cut = end.end() if end else cut
                texts.append(t[:cut])
                langs.append(lang)
                size, t = size + cut, t[cut:]
                if size >= PORTION // 2:
                    yield texts, langs
                    texts, langs, size = [], [], 0
    if texts:
        yield texts, langs


# --- Spark jobs ---


def prepared(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(f"`{text_col}`").alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NO_LANG)).alias("lang")).where("text <> ''")


def frequent(texts: DataFrame, least: int, bits: int = BITS) -> tuple[np.ndarray, DataFrame]:
    """The bitmap of words and pairs that may be frequent, and (lang, n): the words of each language."""
    import pyarrow as pa

    def run(batches):
        for some, langs in portions(batches):
            w = Words(some, langs)
            words, pairs = w.keys()
            keys, n = np.unique(np.concatenate((words, pairs[pairs != 0])), return_counts=True)
            of = np.bincount(w.lang, minlength=len(langs))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.nulls(len(langs), pa.int64()), pa.array(of, pa.int64())], names=["lang", "key", "n"])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "key", "n"])

    seen = texts.mapInArrow(run, "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    kept = written(seen.where((F.col("n") >= least) | F.col("key").isNull()), "frequent")
    bit = F.pmod("key", F.lit(bits))
    made = kept.where("key is not null").select(F.shiftright(bit, 15).alias("k"), F.pmod(bit, F.lit(1 << 15)).alias("bit")).groupBy("k").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bitmap = np.zeros(bits // 8, np.uint8)
    for r in made.collect():  # bits / 8 bytes at most
        bitmap[r["k"] << 12 : (r["k"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    return bitmap, kept.where("key is null").select("lang", "n")


def edges(texts: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(lang, words, gram, f): edges of LONGEST words, and with fewer words what pieces end with, each with its weight."""
    import pyarrow as pa

    sent = texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for some, langs in portions(batches):
            lang, n, grams = Words(some, langs).grams(sent.value)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(lang)), pa.array(n, pa.int32()), grams], names=["lang", "words", "gram"])

    return texts.mapInArrow(run, "lang string, words int, gram string").groupBy("lang", "words", "gram").agg(F.count("*").alias("f"))


def head(gram: Column | str, words: int) -> Column:
    return F.substring_index(gram, " ", words)


def rest(gram: Column | str) -> Column:
    """Without the first word."""
    return F.expr(f"substring({gram}, instr({gram}, ' ') + 1)")


def flows(graph: DataFrame) -> dict[int, DataFrame]:
    """For each number of words (lang, gram, f): a gram's count is what flows out of it into longer ones, and the pieces that end with it."""
    own = lambda k: graph.where(F.col("words") == k).select("lang", "gram", "f")
    out = {LONGEST: own(LONGEST)}
    for k in range(LONGEST - 1, 0, -1):
        flow = out[k + 1].select("lang", head("gram", k).alias("gram"), "f").unionByName(own(k))
        out[k] = written(flow.groupBy("lang", "gram").agg(F.sum("f").alias("f")), f"flow{k}")
    return out


def paths(heavy: DataFrame, nodes: DataFrame) -> DataFrame:
    """(lang, passage, f): edges (lang, gram, f) compacted along the nodes (lang, gram, f) through which one edge in and one edge out carry all flow.

    Each edge looks up the edge before it, then the one two before, four, eight: rounds are the logarithm of the longest passage. Edges
    of rings without a beginning stay passages of their own. A passage is no longer than a text.
    """
    n = nodes.select("lang", F.col("gram").alias("node"), "f")
    into = heavy.select("lang", rest("gram").alias("node"), "f", F.col("gram").alias("before")).join(n, ["lang", "node", "f"])
    outof = heavy.select("lang", head("gram", LONGEST - 1).alias("node"), "f", "gram").join(n, ["lang", "node", "f"])
    links = into.join(outof, ["lang", "node", "f"]).select("lang", "gram", "before")
    state = heavy.join(links, ["lang", "gram"], "left").select("lang", "gram", "f", F.coalesce("before", "gram").alias("back"), F.when(F.col("before").isNull(), 0).otherwise(1).alias("steps"), F.col("before").isNull().alias("done"))
    state, last = written(state, "paths"), None
    while (open_ := state.where("not done").count()) and open_ != last:
        other = state.select("lang", F.col("gram").alias("back"), F.col("back").alias("back2"), F.col("steps").alias("steps2"), F.col("done").alias("done2"))
        moved = state.where("not done").join(other, ["lang", "back"]).select("lang", "gram", "f", F.col("back2").alias("back"), (F.col("steps") + F.col("steps2")).alias("steps"), F.col("done2").alias("done"))
        state, last = written(state.where("done").unionByName(moved), "paths"), open_
    chosen = state.select("lang", "gram", "f", F.when(F.col("done"), F.col("back")).otherwise(F.col("gram")).alias("first"), F.when(F.col("done"), F.col("steps")).otherwise(0).alias("steps"))
    lists = chosen.groupBy("lang", "first").agg(F.max("f").alias("f"), F.array_sort(F.collect_list(F.struct("steps", F.substring_index("gram", " ", -1).alias("word")))).alias("l"))
    return lists.select("lang", F.concat_ws(" ", "first", F.transform(F.slice("l", 2, F.size("l")), lambda x: x["word"])).alias("passage"), "f")


def windows(passages: DataFrame, size: int) -> DataFrame:
    """(lang, gram, f): each run of `size` words of each passage."""
    words = F.split("passage", " ")
    each = F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, F.lit(size)), " "))
    return passages.select("lang", F.explode(each).alias("gram"), "f")


def phrase_graph(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", bits: int = BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(grams, passages, totals): (lang, words, gram, f) of all grams with at least `least` occurrences; (lang, passage, f) of all
    compacted passages of five words and more; (lang, n), the number of words of each language."""
    texts = prepared(docs, text_col, lang_col)
    bitmap, totals = frequent(texts, least, bits)
    graph = written(edges(texts, bitmap), "edges")
    by = flows(graph)
    heavy = written(by[LONGEST].where(F.col("f") >= least), "heavy")
    passages = written(paths(heavy, by[LONGEST - 1].where(F.col("f") >= least)), "passages")
    shorter = [by[k].where(F.col("f") >= least).select("lang", F.lit(k).alias("words"), "gram", "f") for k in range(1, LONGEST)]
    grams = windows(passages, LONGEST).select("lang", F.lit(LONGEST).alias("words"), "gram", "f")
    for s in shorter:
        grams = grams.unionByName(s)
    return written(grams, "grams"), passages, totals


def whole_phrases(grams: DataFrame, passages: DataFrame) -> DataFrame:
    """The grams of two words and more that lie in no longer one with the same count. If any longer one has it, one of one word more has it."""
    held = windows(passages, LONGEST - 1)
    longer = grams.where(F.col("words").between(3, LONGEST - 1))
    held = held.unionByName(longer.select("lang", F.expr("substring_index(gram, ' ', words - 1)").alias("gram"), "f")).unionByName(longer.select("lang", rest("gram").alias("gram"), "f"))
    return grams.where("words > 1").join(held, ["lang", "gram", "f"], "left_anti")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang", bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to 5 words.

    a is a phrase's count, n its language's words, l and r the counts of its parts where the cut scores least; score is 1000 a n / (l r), rounded down,
    in exact arithmetic of 38 digits. Phrases that lie in a longer one of the same count are left out. Null texts have no words, null languages are
    `und`. Ids are not looked at: repeated rows count as often as they are there. Languages without frequent phrases have no row. Other columns are not looked at.
    """
    grams, passages, totals = phrase_graph(docs, least, text_col, lang_col, bits)
    part = lambda name, to: grams.select("lang", F.col("gram").alias(name), F.col("f").alias(to))
    cuts = whole_phrases(grams, passages).select("lang", F.col("gram").alias("phrase"), F.col("f").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("other", F.expr("substring(phrase, length(first) + 2)"))
    met = cuts.join(part("first", "l"), ["lang", "first"]).join(part("other", "r"), ["lang", "other"]).join(totals, "lang")
    whole = lambda c: f"cast({c} as decimal(17, 0))"
    scored = met.withColumn("score", F.expr(f"(cast(1000 as decimal(4, 0)) * {whole('a')} * {whole('n')}) div ({whole('l')} * {whole('r')})"))
    least_cut = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"), F.first("a").alias("a"), F.first("n").alias("n"))
    ranked = least_cut.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")))
    return ranked.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
