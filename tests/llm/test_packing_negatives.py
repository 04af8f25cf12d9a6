"""Packing and hard negatives against plain Python, on odd rows."""

import json
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import hard_negatives, packing, queries

P = pytest.importorskip("public_tokenizers")
BYTES = P.path("byte_bpe_50k.json")


def test_plan_fills_every_sequence():
    rng = random.Random(5)
    for most in (1, 7, 64, 100, 2048):
        for _ in range(30):
            h = {rng.randint(1, most): rng.choice([1, 2, 50, 10**6]) for _ in range(rng.randint(0, 40))}
            rows, n = packing.plan(h, most)
            total = sum(k * c for k, c in h.items())
            assert n == total // most + (total % most).bit_count() and len(rows) <= 40 * most
            at, fill = defaultdict(int), defaultdict(list)
            for length, rank, many, pieces in rows:
                assert at[length] == rank and many > 0
                at[length] += many
                assert [p[0] for p in pieces] == [sum(p[1] for p in pieces[:k]) for k in range(len(pieces))] and sum(p[1] for p in pieces) == length
                for _, ids, d, offset in pieces:
                    fill[offset, ids].append((d + rank, d + rank + many))
            assert dict(at) == h
            if total < 200_000:
                ends = defaultdict(list)
                for (offset, ids), spans in fill.items():
                    for a, b in spans:
                        for s in range(a, b):
                            ends[s].append((offset, offset + ids))
                sizes = [check_gapless(sorted(e)) for _, e in sorted(ends.items())]
                assert len(sizes) == n and sizes[: total // most] == [most] * (total // most) and all(x.bit_count() == 1 for x in sizes[total // most :])


def check_gapless(spans):
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    return spans[-1][1]


def test_longest_go_first_into_the_shortest_pack():
    rows, n = packing.plan({6: 2, 3: 1, 1: 1}, 8)
    assert n == 2 and rows == [(1, 0, 1, ((0, 1, 1, 6),)), (3, 0, 1, ((0, 2, 0, 6), (2, 1, 1, 7))), (6, 0, 2, ((0, 6, 0, 0),))]


def test_chunks_have_the_ids_of_whole_texts():
    rng = random.Random(1)
    some = list("abcXYZé ß  \n\t\r\x1c\x85\xa0 ᠎​.,!?';:<|>’'s 12٣ 漢字🙂é́ªº") + ["<|endoftext|>", "'ll ", "'re", " the", "  "]
    plain = [x for x in some if x not in "\t\r\x1c\x85\xa0 ᠎​" and x != "  "] + ["\n", " it,", " a.b"]
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(0, 40))) for a in (some, plain, plain) for _ in range(4000)]
    own, whole = packing.Encoder(BYTES), packing.Encoder(BYTES, chunked=False)
    assert own.chunked and sum(own.cut(t) is not None for t in texts) > 1000
    assert own.parts(texts) == whole.parts(texts)
    assert not packing.Encoder(P.path("word_bpe_49k.json")).chunked


class Counted(dict):
    """Counts what is looked up."""

    asked = 0

    def __getitem__(self, key):
        self.asked += 1
        return super().__getitem__(key)

    def get(self, key, default=None):
        self.asked += 1
        return super().get(key, default)


def test_a_chunk_is_looked_up_once_however_often_it_occurs():
    texts = ["the end of it, " * 500 + "then\nthe end", "no  chunks", ""] * 3
    own, whole = packing.Encoder(BYTES), packing.Encoder(BYTES, chunked=False)
    own.kept = Counted()
    for _ in range(2):  # with an empty store and a full one
        own.kept.asked = 0
        assert own.parts(texts) == whole.parts(texts)
        assert own.kept.asked <= 20  # 6,000 chunks occur


def test_stores_that_overflow_and_batches_without_chunks(monkeypatch):
    rng = random.Random(2)
    own, whole = packing.Encoder(BYTES), packing.Encoder(BYTES, chunked=False)
    monkeypatch.setattr(packing, "KEPT", 300)
    for _ in range(20):
        texts = [rng.choice([" ", "\n", " <|endoftext|> ", ", ", ""]).join(str(rng.randint(0, 10**6)) + rng.choice(["", " ", "\n", "é", "'s", "…"]) for _ in range(9)) for _ in range(40)]
        assert own.parts(texts) == whole.parts(texts)
    assert len(own.kept) < 2000
    assert own.parts([]) == [] and own.parts(["", "  "]) == whole.parts(["", "  "]) and own.parts(["a ", "a\n", "a"]) == whole.parts(["a ", "a\n", "a"])


def test_files_without_a_token_for_white_space_get_whole_texts(tmp_path):
    for lost in "ĠĊ":
        d = json.load(open(BYTES))
        d["model"]["merges"] = [m for m in d["model"]["merges"] if lost not in "".join(m)]
        d["model"]["vocab"] = {t: i for t, i in d["model"]["vocab"].items() if lost not in t}
        (tmp_path / "lost.json").write_text(json.dumps(d))
        own, whole = packing.Encoder(str(tmp_path / "lost.json")), packing.Encoder(str(tmp_path / "lost.json"), chunked=False)
        assert not own.chunked and own.parts(["a b\nc", "d"]) == whole.parts(["a b\nc", "d"])


ODD = [(1, None), (2, ""), (3, "word " * 9000), (None, "no id"), (None, None), (4, "same"), (4, "same"), (4, "other"), (5, "\x00 ￿ 🙂\n\n"), (6, "a")] + [(i, "the end of it, " * (i % 37)) for i in range(7, 120)]


def test_packing_on_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in ODD], "doc_id long, text string, part string, rank int").withColumn("length", F.lit("clash")).repartition(5)
    whole = packing.Encoder(BYTES, chunked=False)
    for most in (2048, 64):
        got = packing.pack(docs, BYTES, most).collect()
        by_sequence, seen = defaultdict(list), defaultdict(list)
        for r in got:
            ids = np.frombuffer(r["ids"], "<u4")
            assert len(ids) == r["length"] > 0
            by_sequence[r["sequence_id"]].append((r["offset"], r["offset"] + r["length"]))
            seen[r["doc_id"]].append((r["start"], tuple(ids), r["doc_tokens"]))
        total = sum(r["length"] for r in got)
        sizes = [check_gapless(sorted(v)) for _, v in sorted(by_sequence.items())]
        assert sorted(by_sequence) == list(range(len(sizes))) and sorted(x for x in sizes if x != most) == [1 << k for k in range(most.bit_length() - 1) if total % most >> k & 1]
        want = defaultdict(list)
        for i, t in ODD:
            ids = [*np.frombuffer(whole.parts([t or ""])[0], "<u2").tolist(), packing.END_ID]
            want[i].append(ids)
        for i, lists in want.items():
            assert sorted(x for _, ids, _ in seen[i] for x in ids) == sorted(x for ids in lists for x in ids)
            if len(lists) == 1:
                assert [x for _, ids, _ in sorted(seen[i]) for x in ids] == lists[0] and all(s[2] == len(lists[0]) for s in seen[i])


def test_packing_of_nothing_and_query(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), BYTES).collect() == []
    rows = queries.op11_packing(spark, "/root/testdata/sf0.001").collect()
    whole, want = packing.Encoder(BYTES, chunked=False), {}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        want[r["doc_id"]] = np.append(np.frombuffer(whole.parts([r["text"] or ""])[0], "<u2"), 1).astype("<u4")
    at = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        ids = want[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        at[r["doc_id"]] += r["length"]
    assert dict(at) == {k: len(v) for k, v in want.items()}


# --- hard negatives ---


def test_products_are_exact():
    rng = np.random.default_rng(3)
    for dim, top in ((1, 3), (64, 300), (300, 10**5), (700, 2**22)):
        a, b = rng.integers(-top, top + 1, (9, dim)).astype(float), rng.integers(-top, top + 1, (31, dim)).astype(float)
        a[0] = b[0] = top
        a[1] = -top
        primes = hard_negatives.primes_for(dim * top * top + 1, min(dim, hard_negatives.DEPTH))
        assert all((p - 1) // 2 * ((p - 1) // 2) * min(dim, hard_negatives.DEPTH) < 1 << 24 for p in primes) and math.prod(primes) > 2 * dim * top * top
        got = hard_negatives.products(hard_negatives.residues(a, primes), hard_negatives.residues(b, primes), primes)
        assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]


def test_the_best_of_a_stream():
    rng = np.random.default_rng(4)
    scores, best = rng.integers(0, 6, (5, 400)), hard_negatives.Best(5, 7)
    for k in range(0, 400, 50):
        part = scores[:, k : k + 50]
        who, at = np.nonzero(part > best.least[:, None])
        best.offer(who, part[who, at], at + k)
    for i in range(5):
        assert best.row[best.who == i].tolist() == sorted(range(400), key=lambda j: (-scores[i, j], j))[:7]


def slow_mine(rows):
    own = []
    for k, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own.append((k, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out, late = [], lambda i: math.inf if i is None else i
    for k, i, label, v in own:
        if i is None or i % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), j, lab) for m, j, lab, w in own if m != k]
        pos = sorted((-s, late(j), j) for s, j, lab in scored if lab == label)[:5]
        for s, _, j in pos:
            p = -s
            neg = sorted(((-n, late(m), m) for n, m, lab in scored if lab != label and 30 * p <= 100 * n <= 90 * p), key=lambda x: x[:2])[:10]
            out += [(i, j, r + 1, m, p, -n) for r, (n, _, m) in enumerate(neg)]
    return out


def vectors(seed=9):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0.05, 0.2) for _ in range(8)], rng.randint(0, 2)) for i in range(400)]
    rows += [(i, [0.1] * 8, 1) for i in range(400, 480)]  # one vector often
    rows += [(100, [0.1] * 8, 1), (100, [0.1] * 8, 1), (3, rows[3][1], rows[3][2]), (None, [0.1] * 8, 2), (None, [0.3] * 8, 1)]
    rows += [(500, None, 1), (501, [0.1] * 8, None), (502, [float("nan")] * 8, 1), (503, [float("inf")] + [0.0] * 7, 1), (504, [None] + [0.1] * 7, 1), (600, [], 1), (700, [0.2, 0.1], 2), (None, None, None)]
    return rows


def key(r):
    return tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize("anchors", [4096, 2])
def test_hard_negatives_on_odd_rows(spark, monkeypatch, anchors):
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, key string, slab int").withColumn("vector", F.lit(1)).repartition(3)
    narrow = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    assert sorted(map(tuple, hard_negatives.mine(df).collect()), key=key) == sorted(slow_mine(narrow), key=key)


def test_hard_negatives_of_nothing(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, [0.1], 1)], [(100, [0.1], 1)], [(0, [], 1), (1, [], 1), (2, [], 3)]):
        assert [tuple(r) for r in hard_negatives.mine(spark.createDataFrame(rows, schema)).collect()] == slow_mine(rows)
    with pytest.raises(ValueError, match="too long"):
        hard_negatives.mine(spark.createDataFrame([(100, [1e9], 1)], schema))
