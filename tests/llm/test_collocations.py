"""Phrases against plain Python: counts, passages, cuts, on odd texts and with a bitmap that is too small."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import collocations


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in (re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\n-\r]", low)) if w]


def counted(rows):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for i in range(len(w)) for k in range(1, 6) if i + k <= len(w))
    return f, n


def slow(rows, least, top):
    f, n = counted(rows)
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    gone = set()
    for (lang, p), a in cand.items():
        for k in range(2, len(p)):
            gone |= {(lang, p[i : i + k]) for i in range(len(p) - k + 1) if 100 * a >= 100 * f[lang, p[i : i + k]]}
    out = {}
    for (lang, p), a in cand.items():
        if (lang, p) not in gone:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, r + 1, p.decode(), -a, l, q, n[lang], -s) for lang, v in out.items() for r, (s, a, p, l, q) in enumerate(sorted(v)[:top]))


def corpus(seed):
    rng = random.Random(seed)
    words = ["a", "B", "b", "Ä", "ä", "é", "x\x1cy", "zu", " nbsp", "🙂", "it's", "\x00"]
    passage = " ".join(rng.choice(words + ["q", "w", "e", "r"]) for _ in range(40))
    rows = []
    for i in range(160):
        t = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(rng.choice([0, 1, 4, 30])))
        if i % 4 == 0:
            t += passage if i % 8 else passage[:50] + "; " + passage[20:]
        rows.append((t, rng.choice(["en", "en", "en", "de", None, "und", ""])))
    ring = ("na " * 30, "ho hey " * 20, "one two three " * 15)
    return rows + [(r, "en") for r in ring] + [(None, "en"), ("", None), (" \t\n", "fr"), ("only once here", "it"), ("x " * 3000, "long")] * 2


@pytest.mark.parametrize(("seed", "least", "top", "bits"), [(1, 3, 2000, 1 << 26), (2, 2, 7, 1 << 15), (3, 20, 2000, 1 << 15)])
def test_collocations(spark, seed, least, top, bits):
    rows = corpus(seed)
    docs = spark.createDataFrame([(t, lang, "x", 1, 2) for t, lang in rows], "text string, lang string, gram string, f int, n int").withColumn("words", F.lit("w")).repartition(4)
    got = collocations.collocations(docs, least, top, bits=bits).collect()
    assert sorted(map(tuple, got)) == slow(rows, least, top)


def test_counts_are_flows_and_passages_are_compacted(spark):
    rows = corpus(4)
    f, n = counted(rows)
    grams, passages, totals = collocations.phrase_graph(spark.createDataFrame(rows, "text string, lang string").repartition(3), 3)
    got = [((r["lang"], tuple(r["gram"].split(" "))), r["f"]) for r in grams.collect()]
    assert len(got) == len(dict(got)) and dict(got) == {p: a for p, a in f.items() if a >= 3}
    assert {r["lang"]: r["n"] for r in totals.collect() if r["n"]} == dict(n)
    begins, ends = Counter(), Counter()
    for (lang, p), a in f.items():
        if len(p) == 5:
            begins[lang, p[:4]] = max(begins[lang, p[:4]], a)
            ends[lang, p[1:]] = max(ends[lang, p[1:]], a)
    unary = lambda v: begins[v] == ends[v] == f[v]
    seen = []
    for r in passages.collect():
        w = tuple(r["passage"].split(" "))
        seen += [(r["lang"], w[i : i + 5]) for i in range(len(w) - 4)]
        assert all(f[r["lang"], w[i : i + 5]] == r["f"] for i in range(len(w) - 4)) and all(unary((r["lang"], w[i : i + 4])) for i in range(1, len(w) - 4))
        inner = unary((r["lang"], w[:4])) or unary((r["lang"], w[-4:]))
        assert not inner or len(w) == 5  # only edges of rings are left uncompacted
    assert sorted(seen) == sorted(p for p, a in f.items() if len(p[1]) == 5 and a >= 3)
    assert max(len(r["passage"].split(" ")) for r in passages.collect()) > 15


def test_long_texts_are_divided_where_pieces_end(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(collocations, "PORTION", 50)
    texts = ["word, " * 100, "nothing to divide at " * 20, "", "short", None]
    b = pa.RecordBatch.from_pydict({"text": texts, "lang": ["a", "b", "c", "d", "e"]})
    got = [(t, x) for some, langs in collocations.portions([b]) for t, x in zip(some, langs)]
    assert all("".join(t for t, x in got if x == lang) == (text or "") for text, lang in zip(texts, "abcde"))
    assert max(len(t) for t, x in got if x == "a") < 60 and sum(len(pieces(t)) for t, _ in got) == sum(len(pieces(t)) for t in texts)
    w = collocations.Words(["Aé  b,C", "d"], ["x", "y"])
    assert [bytes(w.norm[a : a + n]).decode() for a, n in zip(w.start, w.size)] == ["aé", "b", "c", "d"] and w.lang.tolist() == [0, 0, 0, 1] and len(np.unique(w.piece)) == 3


def test_of_nothing(spark):
    for rows in ([], [(None, None)], [("one two three", "en")]):
        assert collocations.collocations(spark.createDataFrame(rows, "text string, lang string")).collect() == []
