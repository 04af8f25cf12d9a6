"""Toxicity with noisy-channel deobfuscation.

Fitting makes one pass over the corpus, which counts every word of every text for a character language model, and one over the distinct texts
of labelled training rows, which counts the texts of either label that hold a word. Words that speak for label 1 form a lexicon with a
probability each.

Scoring looks for disguised words: tokens with digits or symbols among letters, letters of two scripts in one word, letters dealt out with
separators of any kind and number, words parted in pieces, letters with marks, and repeated letters; characters that are not seen are taken out first. Each is a lattice: an observed character may stand for itself, for a letter that it resembles, or for
nothing (separators, repeats), at a cost. A Viterbi search under the character trigram model gives the likeliest original. The restored text,
that is the words found as they stand and the restored ones in place of disguises, is scored by the noisy-or of its words' probabilities.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import begun, kept_where, keyed_texts, mapped, sliced, written

#: Labelled rows that the lexicon is fitted on, at most: those with the least hash of doc_id. Bounds the broadcast of labels.
FIT_ROWS = 20_000
#: A word in p distinct texts of label 1 and n of label 0 has probability (p + PRIOR * STRENGTH) / (p + n + STRENGTH), so that few texts
#: prove little whatever their labels. It enters the lexicon at LEAST. A text is toxic at TOXIC.
PRIOR, STRENGTH, LEAST, TOXIC = 0.1, 6.0, 0.4, 0.7
#: Each text of label 1 is shared out among its lexicon words in proportion to the cube of their counts; a word that gets less than
#: this part of its texts is explained by the others, as the common words of near copies are, and leaves the lexicon. LEAST and SHARE were chosen
#: by folds of training rows.
SHARE = 0.04
#: Score of a text in which nothing is found.
CLEAN = 0.02
#: What a restored word's probability is multiplied by.
RESTORED = 0.97
#: Letters that an observed character may stand for (fixed values of the channel).
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¢": "c", "*": "aeiou",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ο": "o", "α": "a", "ι": "i",
}
#: The look-alikes that are letters themselves, and words with one of them beside a letter of ASCII.
OTHER_SCRIPT = re.compile("[" + "".join(c for c in LOOKS_LIKE if c.isalpha()) + "]")
TWO_SCRIPTS = re.compile(rf"(?=[^\W\d_]*[a-z])(?=[^\W\d_]*{OTHER_SCRIPT.pattern})[^\W\d_]+")
SEPARATORS = " .-_*~'·"
#: Characters that are not seen (fixed values): soft hyphen, joiners, zero-width space, word joiner, byte-order mark, variation selectors. They vanish; the wide
#: forms of ASCII become ASCII.
UNSEEN = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0xFE00, 0xFE10)]) | {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
ANY_UNSEEN = re.compile("[" + "".join(map(chr, UNSEEN)) + "]")
#: Log probabilities of the channel.
SAME, SUBSTITUTED, DROPPED, REPEATED = math.log(0.9), math.log(0.3), math.log(0.5), math.log(0.4)
#: Letters whose trigrams are counted. Other letters stand for themselves, each as likely as the floor of the model.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
WORD = re.compile(r"[^\W\d_]+")
#: Letters dealt out one by one, with any number of separators of any kind, line ends among them; or a token of letters with other characters inside or repeats.
SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|€£¢])(?:(?:[^\w@$!|€£¢]|_)+(?:[^\W_]|[@$!|€£¢])){2,}(?![^\W_])")
BETWEEN = re.compile(r"((?:[^\w@$!|€£¢]|_)+)")
TOKEN = re.compile(r"[\w@$!|+(€£¢*.~·'-]+")
MIXED = re.compile(r"[^\W\d_][^\w\s]*[\d@$!|+(€£¢*.~·_'-]|[\d@$!|+(€£¢*][^\w\s]*[^\W\d_]")
RUN = re.compile(r"([^\W\d_])\1")
#: Characters cut off the edges of a token: those that are only separators, and with them look-alikes.
EDGE, BARE = "._~·'-", "|+(*.~·_'-!"
MANY = re.compile(r"(.)\1{3,}", re.S)
CHAINS = [re.compile(x) for x in (r"\.+", r"-+", r"_+", r"[.\-_~·]+")]
#: Restored tokens that a worker remembers.
KEPT = 50_000


@lru_cache(100_000)
def bare(word: str) -> str:
    """Without marks on its letters."""
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


class CharModel:
    """Trigrams of letters within words, with "^" before and after; interpolated with bigrams and a uniform floor."""

    def __init__(self, counts: dict[str, int]):
        self.three = counts
        self.two: Counter = Counter()
        self.context3: Counter = Counter()
        self.context2: Counter = Counter()
        for g, n in counts.items():
            self.two[g[1:]] += n
            self.context3[g[:2]] += n
            self.context2[g[1]] += n
        self.floor = 0.02 / (len(LETTERS) + 1)
        self.known: dict[str, float] = {}

    def log(self, g: str) -> float:
        if (x := self.known.get(g)) is None:
            a, b = self.context3.get(g[:2], 0), self.context2.get(g[1], 0)
            p = 0.78 * (self.three.get(g, 0) / a if a else 0) + 0.2 * (self.two.get(g[1:], 0) / b if b else 0) + self.floor
            x = self.known[g] = math.log(p)
        return x

    @staticmethod
    @lru_cache(100_000)
    def arcs(ch: str, before: str) -> list[tuple[str, float]]:
        """What a character may stand for (a letter or nothing) after the character before, with log probabilities."""
        out = [(ch, SAME)] if ch.isalpha() else []
        out += [(c, SUBSTITUTED - math.log(len(LOOKS_LIKE[ch]))) for c in LOOKS_LIKE.get(ch, "")]
        if (base := bare(ch)) != ch:
            out.append((base, SUBSTITUTED))
        if ch == before:
            out.append(("", REPEATED))
        elif ch in SEPARATORS or not out:
            out.append(("", DROPPED))
        return out

    def restore(self, seen: str, cut: bool = False) -> str:
        """The likeliest word behind the characters seen: the best path through the lattice, states being the last two letters. With `cut`,
        a space may also end a word and begin the next; the words are then separated by a space."""
        states = {"^^": (0.0, "")}
        before = ""
        for ch in seen:
            arcs = self.arcs(ch, before)
            best: dict[str, tuple[float, str]] = {}
            for state, (cost, path) in states.items():
                for c, p in arcs:
                    to = state[1] + c if c else state
                    x = cost + p + (self.log(state + c) if c else 0.0)
                    if to not in best or x > best[to][0]:
                        best[to] = (x, path + c)
                if cut and ch == " " and state != "^^":
                    x = cost + DROPPED + self.log(state + "^")
                    if "^^" not in best or x > best["^^"][0]:
                        best["^^"] = (x, path + " ")
            states, before = best, ch
        return max((cost + self.log(s + "^"), path) for s, (cost, path) in states.items())[1]


class Scorer:
    def __init__(self, trigrams: dict[str, int], lexicon: dict[str, float]):
        self.model, self.lexicon, self.restored = CharModel(trigrams), lexicon, {}
        self.tree: dict = {}
        for w in lexicon:
            node = self.tree
            for c in w:
                node = node.setdefault(c, {})
            node[""] = {}
        self.prefixes = {w[:k] for w in lexicon for k in range(1, len(w))}
        #: How a token of letters alone begins if a word of the lexicon may be behind it.
        self.begins = {w[:2] for w in lexicon} | {w[0] * 2 for w in lexicon}

    def disguised(self, low: str) -> Iterator[str]:
        """Tokens that may hide a word; of letters dealt out, also the parts between gaps wider than the least, and all without a first or last letter
        that may be a word of its own."""
        for m in SPACED.finditer(low):
            parts = BETWEEN.split(m.group())  # letters, and what stands between them
            least = min(map(len, parts[1::2]))
            runs, own = [parts[0::2]], [[parts[0]]]
            for gap, c in zip(parts[1::2], parts[2::2]):
                if len(gap) > least:
                    own.append([])
                own[-1].append(c)
            for units in runs + (own if len(own) > 1 else []):
                for i in range(2):
                    for j in range(2):
                        if len(units) - i - j > 2:
                            yield " ".join(units[i : len(units) - j])
        for t in set(TOKEN.findall(low)):
            core = t.strip(EDGE)
            if not core.isalpha():
                yield from self.forms(MANY.sub(r"\1\1\1", t))
            elif core[:2] in self.begins and RUN.search(core):
                yield MANY.sub(r"\1\1\1", core)
        if OTHER_SCRIPT.search(low):
            yield from set(TWO_SCRIPTS.findall(low))

    def marked(self, words: set[str]) -> Iterator[str]:
        """Words that are in the lexicon but for marks on their letters."""
        return (w for w in words if not w.isascii() and w not in self.lexicon and bare(w) in self.lexicon)

    def parted(self, words: list[str]) -> set[str]:
        """Neighbouring words, with a space between, that are pieces of one of the lexicon."""
        out, prefixes, lexicon = set(), self.prefixes, self.lexicon
        for i in [i for i, w in enumerate(words) if w in prefixes]:
            own = words[i]
            for j in range(i + 1, len(words)):
                own += words[j]
                if own in lexicon:
                    out.add(" ".join(words[i : j + 1]))
                if own not in prefixes:
                    break
        return out

    @staticmethod
    def forms(token: str) -> set[str]:
        """A token and the links of a chain, with look-alikes at either edge kept and cut off."""
        if not (MIXED.search(token) or RUN.search(token)):
            return set()
        out = set()
        for t in {token, *(x for c in CHAINS if c.search(token) for x in c.split(token))}:
            core = t.strip(EDGE)
            for f in {core, core.lstrip(BARE), core.rstrip(BARE), core.strip(BARE)}:
                if len(f) > 2 and (MIXED.search(f) or RUN.search(f)):
                    out.add(f)
        return out

    def words_of(self, t: str) -> list[str]:
        """Words of the lexicon behind a token; a run of letters dealt out is also cut into words."""
        spaced = " " in t
        if not self.reachable(t, spaced):
            return []
        found = [self.restore(t)]
        if spaced:
            found += self.restore(t, True).split(" ")
        return [w for w in found if w in self.lexicon]

    def reachable(self, t: str, cut: bool) -> bool:
        """Whether any path through the token's lattice spells a word of the lexicon; where none does, the best one cannot."""
        nodes, before = [self.tree], ""
        for ch in t:
            if cut and ch == " ":
                if any("" in n for n in nodes):
                    return True
                nodes.append(self.tree)
            elif not nodes and not cut:
                return False
            arcs = self.model.arcs(ch, before)
            now = {id(n[c] if c else n): n[c] if c else n for n in nodes for c, _ in arcs if not c or c in n}
            nodes, before = list(now.values()), ch
        return any("" in n for n in nodes)

    def restore(self, t: str, cut: bool = False) -> str:
        if (x := self.restored.get((t, cut))) is None:
            if len(self.restored) > KEPT:
                self.restored.clear()
            x = self.restored[t, cut] = self.model.restore(t, cut)
        return x

    def found(self, text: str | None) -> dict[str, float]:
        """Words of the lexicon, plain or restored, with their probabilities."""
        low = (text or "").lower()
        if not low.isascii() and ANY_UNSEEN.search(low):
            low = low.translate(UNSEEN).lower()
        lexicon, words = self.lexicon, WORD.findall(low)
        each = set(words)
        hits = {w: lexicon[w] for w in lexicon.keys() & each}
        found = [w for t in self.disguised(low) for w in self.words_of(t)]
        found += [w for t in self.marked(each) for w in self.words_of(t)]
        found += [w for t in self.parted(words) for w in self.restore(t, True).split(" ") if w in lexicon]
        return {w: RESTORED * lexicon[w] for w in found} | hits

    def score(self, text: str | None) -> float:
        return combined(self.found(text))


def combined(hits: dict[str, float]) -> float:
    """Noisy-or: the text is toxic if any of its words is."""
    return 1.0 - (1.0 - CLEAN) * math.prod(1.0 - p for p in hits.values())


def training_rows(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, label) of labelled rows outside the held-out third, one for each id (its largest label), at most fit_rows."""
    rows = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("doc_id is not null and label is not null")
    rows = rows.where(F.expr("crc32(cast(doc_id as string)) % 3 <> 1")).groupBy("doc_id").agg(F.max("label").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)


def columns(word: list[str], **numbers: list):
    """An Arrow batch of words and numbers."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), *[pa.array(x, pa.float64() if k == "credit" else pa.int64()) for k, x in numbers.items()]], names=["word", *numbers])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Scorer:
    """Character model of the whole corpus, and lexicon from at most fit_rows labelled rows outside the held-out third.

    What reaches the driver is bounded: trigrams over LETTERS (60^3 at most), and words with enough texts of label 1 among fit_rows.
    Equal texts count once, with the larger label. Without labels or texts the lexicon is empty.
    """
    texts = keyed_texts(docs, id_col, text_col)

    def count(batches):
        n: Counter = begun(Counter)
        for b in sliced(batches):
            for text in b.column("text").to_pylist():
                n.update(WORD.findall((text or "").lower()))
                if len(n) > 200_000:
                    yield columns(word=list(n), n=list(n.values()))
                    n.clear()
        yield columns(word=list(n), n=list(n.values()))

    words = written(texts.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    grams = words.where(F.col("word").rlike(f"^[{LETTERS}]+$")).withColumn("w", F.concat(F.lit("^^"), "word", F.lit("^")))
    grams = grams.select(F.explode(F.expr("transform(sequence(1, length(w) - 2), i -> substring(w, i, 3))")).alias("g"), "n").groupBy("g").agg(F.sum("n").alias("n"))

    train = training_rows(labels, fit_rows=fit_rows).withColumnRenamed("doc_id", "__id")
    joined = texts.join(F.broadcast(train), texts["doc_id"] == train["__id"]).select("text", "label")  # fit_rows rows of 16 bytes at most
    sample = written(joined.groupBy("text").agg(F.max("label").alias("label")), "labelled")

    def by_label(batches):
        by: tuple[Counter, Counter] = (Counter(), Counter())
        for b in sliced(batches):
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
                by[label > 0].update(set(WORD.findall((text or "").lower())))
        every = list(by[0].keys() | by[1].keys())
        yield columns(word=every, neg=[by[0][w] for w in every], pos=[by[1][w] for w in every])

    p = f"(pos + {PRIOR * STRENGTH}) / (pos + neg + {STRENGTH})"
    counted = sample.mapInArrow(by_label, "word string, neg bigint, pos bigint").groupBy("word").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    found = counted.where(f"pos > 0 and {p} >= {LEAST}").select("word", "pos", F.expr(p).cast("double").alias("p")).collect()
    pos = {r["word"]: r["pos"] for r in found}
    due = credits(sample.where("label = 1").select("text"), pos)
    return Scorer({r["g"]: r["n"] for r in grams.collect()}, {r["word"]: r["p"] for r in found if due.get(r["word"], 0.0) >= SHARE * r["pos"]})


def credits(toxic: DataFrame, pos: dict[str, int]) -> dict[str, float]:
    """For each word of pos, the sum of its shares of the documents that hold it."""
    sent = toxic.sparkSession.sparkContext.broadcast(pos)

    def run(batches):
        known, due = sent.value, Counter()
        for b in sliced(batches):
            for text in b.column("text").to_pylist():
                own = known.keys() & set(WORD.findall((text or "").lower()))
                whole = sum(known[w] ** 3 for w in own)
                for w in own:
                    due[w] += known[w] ** 3 / whole
        yield columns(word=list(due), credit=list(due.values()))

    rows = toxic.mapInArrow(run, "word string, credit double").groupBy("word").agg(F.sum("credit").alias("credit"))
    return {r["word"]: r["credit"] for r in rows.collect()} if pos else {}


def score(docs: DataFrame, model: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, found array<string>) for every row. Null and empty texts get the score of a text in which nothing is
    found; null ids are not held out."""
    sent = docs.sparkSession.sparkContext.broadcast((model.model.three, model.lexicon))

    def start():
        scorer = Scorer(*sent.value)

        def run(b: dict) -> dict:
            hits = [scorer.found(t) for t in b["text"]]
            return {"score": [combined(h) for h in hits], "found": [sorted(h) for h in hits]}

        return run

    out = mapped(keyed_texts(docs, id_col, text_col), start, ["text"], ["doc_id"], "score double, found array<string>")
    held = F.expr("coalesce(crc32(cast(doc_id as string)), 0) % 3 = 1")
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "found")


def remove_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """docs without those that score TOXIC or more; columns and further columns unchanged."""
    model = fit(docs, labels, id_col, text_col, fit_rows)
    sent = docs.sparkSession.sparkContext.broadcast((model.model.three, model.lexicon))

    def start():
        scorer = Scorer(*sent.value)
        return lambda text: scorer.score(text) < TOXIC

    return kept_where(docs, start, text_col)
