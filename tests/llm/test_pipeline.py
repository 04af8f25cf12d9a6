"""The pipeline against a plain Python version on the smallest tables, and its stages on odd rows."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliospark.llm import records, toxicity
from foliospark.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
pytest.importorskip("public_tokenizers")


def test_pipeline_equals_plain_python(spark):
    from test_small import closed, slow_fingerprint

    table = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    docs = table("documents").orderBy("doc_id").collect()
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.score(table("documents"), toxicity.fit(table("documents"), table("labels"))).collect()}
    docs = [d for d in docs if not scores[d["doc_id"]]]
    prints = [slow_fingerprint(d["text"]) for d in docs]
    docs = [d for d, c in zip(docs, closed([d["doc_id"] for d in docs], prints)) if d["doc_id"] == c]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    grams = set()
    for r in table("benchmark").collect():
        w = words(r["text"])
        m = min(13, len(w))
        grams |= {tuple(w[k : k + m]) for k in range(len(w) - m + 1)}
    clean = []
    for d in docs:
        w, hit = words(d["text"]), set()
        for m in {len(g) for g in grams}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in grams:
                    hit.update(range(k, k + m))
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append(d)
    n = {s: sum(d["source"] == s for d in clean) for s in {d["source"] for d in clean}}
    whole = sum(math.sqrt(x) for x in n.values())
    encoder, want, start = records.Encoder(tokenizer_path(), chunked=False), [], 0
    for d in clean:
        rate = len(clean) * math.sqrt(n[d["source"]]) / whole / n[d["source"]]
        draws = max(1, math.ceil(rate / 32))
        copies = 0
        for k in range(1, draws + 1):
            u = int(hashlib.md5(f"17:{d['doc_id']}:{k}".encode()).hexdigest()[:13], 16) / (1 << 52)
            p = c = math.exp(-rate / draws)
            i = 0
            while c <= u:
                i += 1
                p *= rate / draws / i
                c += p
            copies += i
        ids = np.frombuffer(encoder([d["text"]], 2)[0], "<u2").astype("<u4")
        for _ in range(copies):
            want.append((d["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted(want) and len(got) > 100


def test_stages_on_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    odd = docs.unionByName(docs.limit(3)).unionByName(docs.select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes]).limit(2))
    odd = odd.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(10**6).cast("long"), "text": F.lit("")})).unionByName(docs.limit(1).withColumns({"doc_id": F.lit(10**6 + 1).cast("long"), "text": F.lit("lang " * 100_000), "source": F.lit(None).cast("string")}))
    for rows in (odd, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF)
            if name != "records":
                assert rows.columns == corpus_pipeline.COLUMNS
        rows.collect()


def test_five_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "records"]
