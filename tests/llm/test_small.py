"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing names; each operator against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import common, decontam, grades, licenses, mixing, quality_rules, queries, records, simhash, substring, toxicity, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ASCII_WS = " \t\n\x0b\x0c\r"


def split(text):
    return [w for w in re.split(f"[{ASCII_WS}]+", text or "") if w]


def corpus(seed=3, n=60):
    """Words of a few letters, copies, shared passages, odd characters, nulls and empties."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 4))) for _ in range(80)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    out = []
    for i in range(n):
        t = " ".join(rng.choice(words) + rng.choice(["", "", ".", ","]) for _ in range(rng.choice([0, 1, 2, 10, 60, 200])))
        if i % 5 == 0:
            t = t[: len(t) // 2] + " " + passage + "\n" + t[len(t) // 2 :]
        if i % 7 == 0 and i:
            t = out[i // 2][1]
        if i % 9 == 0 and t:
            t = "Und " * rng.randint(1, 70) + t
        out.append((i, t, rng.choice(["en", "de"]), f"s{i % 3}", len(t or "")))
    out[11] = (11, None, None, None, None)
    out[12] = (12, "", "en", "s1", 0)
    out[13] = (13, " \n\t ", "en", "s1", 4)
    out[14] = (14, "ѕ x y \x1cz É̃ <|endoftext|> it's 12a", "fr", "s2", 20)
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Null and repeated ids, repeated rows, and columns named like the operators' own."""
    some = [(i if i != 5 else None, t, *r, "x", 1.5) for i, t, *r in rows] + [(3, *rows[3][1:], "y", 2.5), (3, "other text", "en", "s0", 10, "z", 1.0), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(some, DOC + ", copy string, score double").withColumn("fp", F.lit("no")).withColumn("key", F.lit(1)).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def test_window_hashes_tell_windows_apart():
    words = np.arange(50, dtype=np.uint64) % np.uint64(7)
    for size in (1, 2, 3, 5, 8, 13, 20):
        h = common.window_hashes(common.mixed(words), size)
        want = [tuple(words[k : k + size].tolist()) for k in range(51 - size)]
        assert len(h) == len(want) and len(set(h.tolist())) == len(set(want))
        assert {(a, b) for a, b in zip(h.tolist(), want)} == {(a, dict(zip(h.tolist(), want))[a]) for a in h.tolist()}


def test_word_hashes_do_not_depend_on_place():
    a, b = common.word_hashes("  aé b\taé\n".encode()), common.word_hashes("b aé".encode())
    assert len(a) == 3 and a[0] == a[2] == b[1] and a[1] == b[0] and not len(common.word_hashes(b" \n"))


# --- op1 ---


def test_base_counts(docs, rows):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    for i, t, *_ in rows:
        w = split(t)
        c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if x.strip(ASCII_WS)]
        want = (len(w), sum(map(len, w)), sum((t or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and not (r["base_failed"] and r["kept"])


def test_divergence_is_that_of_scipy_formula():
    p, q = np.array([3.0, 1.0, 0.0]), np.array([1.0, 1.0, 2.0])
    a, b = p / 4, q / 4
    m = (a + b) / 2
    kl = lambda x: sum(v * np.log2(v / w) for v, w in zip(x, m) if v > 0)
    assert abs(quality_rules.distance(p, q) ** 2 - (kl(a) + kl(b)) / 2) < 1e-12 and quality_rules.distance(p, 2 * p) == 0


def test_references_are_counted_over_all(docs, rows):
    rules = quality_rules.Rules(judged_words=5, common_words=7)
    got = quality_rules.references(quality_rules.word_counts(docs, rules), rules)
    for lang in ("en", "de"):
        c = Counter(w for _, t, l, *_ in rows if l == lang and len(split(t)) >= 5 for w in split(re.sub("[A-Z]", lambda m: m[0].lower(), t)))
        assert {k: v for k, v in got[lang][1].items() if k} == dict(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:7]) and got[lang][1][""] == sum(c.values())


def test_shouting_is_rejected_and_prose_kept(spark):
    rng = random.Random(1)
    prose = [" ".join(rng.choice("the of and to in a is that for it was on are as with his they at be this".split()) for _ in range(120)) for _ in range(30)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(prose)] + [(99, " ".join(f"X{k}ZQ!!" for k in range(120)), "en"), (98, prose[0], None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(df).collect()}
    assert not got[99] and got[98] and all(got[i] for i in range(30))


def test_rules_equal_their_sql(spark, tmp_path):
    """Null and rare languages, null, empty and blank texts, repeated words."""
    rng = random.Random(11)
    sets = {"en": "the of and to in a is that for it".split(), "de": "der die und in den von zu das mit sich".split(), None: "un que de la el y a los se del".split()}
    text = lambda w: " ".join(rng.choice(w) + rng.choice(["", "", str(rng.randint(0, 999))]) for _ in range(rng.choice([10, 49, 50, 90, 150])))
    rows = [(i, text(sets[lang]) if i % 7 else "X#Q! " * rng.randint(30, 80), lang) for i in range(90) for lang in [rng.choice(["en", "de", None])]]
    rows += [(100, None, "en"), (101, "", None), (102, " \n ", "fr"), (103, "seul " * 60, "fr"), (104, " ".join(f"w{k}" for k in range(80)), "it")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    df.toPandas().to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    keys = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]
    want = sorted(con.execute(f"SELECT {', '.join(keys)} FROM ({queries.OP1_SQL})").fetchall())
    near = lambda x: round(x, 6) if isinstance(x, float) else x
    for rules in (quality_rules.RULES, quality_rules.Rules(languages=1)):
        got = sorted(tuple(r[k] for k in keys) for r in quality_rules.judge(df, rules).collect())
        assert [tuple(map(near, r)) for r in got] == [tuple(map(near, r)) for r in want]
    assert quality_rules.judge(df.limit(0)).count() == 0


# --- op2 ---


def test_crc32c_known_values():
    assert [hex(x) for x in records.crc32c([b"123456789", b"\0" * 32, b"abcd" * 1000]).tolist()[:2]] == ["0xe3069283", "0x8a9136aa"]
    rng, slow = np.random.default_rng(0), []
    parts = [rng.bytes(int(n)) for n in (0, 1, 2, 3, 4, 5, 63, 64, 65, 128, 129, 1000, 4097)]
    for p in parts:
        c = 0xFFFFFFFF
        for b in p:
            c = int(records.TABLE[(c ^ b) & 255]) ^ (c >> 8)
        slow.append(c ^ 0xFFFFFFFF)
    assert records.crc32c(parts).tolist() == slow


@pytest.fixture(scope="module")
def tokenizer_file():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_records_round_trip(spark, odd, tokenizer_file):
    from tokenizers import Tokenizer

    t, out = Tokenizer.from_file(tokenizer_file), common.work_dir(spark, "t")
    records.write_records(odd, out, tokenizer_file)
    got = records.read_records(spark, out).orderBy("start").collect()
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)
    assert [key(r) for r in got] == sorted(key(r) for r in odd.collect())
    want = Counter((r["doc_id"], tuple(t.encode(r["text"] or "", add_special_tokens=False).ids + [2])) for r in odd.collect())
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want
    assert [r["start"] for r in got] == np.concatenate(([0], np.cumsum([r["n_tokens"] for r in got])[:-1])).tolist()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in got)
    again = records.read_records(spark, out, records.shuffled_index(records.read_index(spark, out), 5))
    assert Counter(r["ids_crc32"] for r in again.collect()) == Counter(r["ids_crc32"] for r in got)


def test_damage_is_found(spark, docs, tokenizer_file):
    from pyarrow import fs

    out = common.work_dir(spark, "t")
    records.write_records(docs.coalesce(1), out, tokenizer_file)
    name = records.read_index(spark, out).select("file").first()[0]
    files, root = fs.FileSystem.from_uri(out)
    raw = bytearray(files.open_input_file(f"{root}/{name}").read())
    raw[20] ^= 1
    with files.open_output_stream(f"{root}/{name}") as f:
        f.write(bytes(raw))
    with pytest.raises(Exception, match="damaged"):
        records.read_records(spark, out).collect()


def test_encoder_equals_library_on_odd_texts(tokenizer_file):
    rng = random.Random(4)
    letters = "aAzZéÉßöÖñçÿŸ漢Σσςİıµªº12.,!?;:*%$#&|'\"-<>()́  ​\x1c\x85 \t\n\r"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(400)] + ["it's <|endoftext|> <|startoftext|>x", "ÅÅ", None]
    e = records.Encoder(tokenizer_file)
    whole = records.Encoder(tokenizer_file, chunked=False)
    assert e.chunked and e(texts, 2) == whole(texts, 2) and e(texts, 2) == whole(texts, 2)


def test_encoder_equals_library_on_all_documents(spark, tokenizer_file):
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert records.Encoder(tokenizer_file)(texts, 2) == records.Encoder(tokenizer_file, chunked=False)(texts, 2)


def test_only_files_that_say_so_are_divided(tokenizer_file):
    import json

    own = json.loads(open(tokenizer_file).read())
    assert records.divisible(own)
    for path, value in ((("normalizer", "normalizers", 0, "type"), "NFKC"), (("pre_tokenizer", "pretokenizers", 0, "behavior"), "Isolated"), (("added_tokens", 0, "lstrip"), True), (("added_tokens", 0, "content"), "a b"), (("post_processor",), {"type": "ByteLevel"})):
        other = json.loads(json.dumps(own))
        at = other
        for k in path[:-1]:
            at = at[k]
        at[path[-1]] = value
        assert not records.divisible(other), path
    other = records.Encoder(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    assert not other.chunked and other(["a  b"], 0) == [other.packed(other.tokenizer.encode("a  b", add_special_tokens=False).ids + [0])]


# --- op3 ---


def test_restores_disguised_words():
    s = toxicity.Scorer(Counter(g for w in ["idiot"] * 50 + ["moron"] * 50 + ["the", "water", "green"] * 200 for g in (f"^^{w}^"[k : k + 3] for k in range(len(w) + 1))), {"idiot": 0.9, "moron": 0.9})
    for t in ("you 1d10t", "an i d i o t!", "m0r0n", "i.d.i.o.t", "idiooooot", "M*RON", "mo-ron"):
        assert s.found(t), t
    for t in ("the water 1234", "", None, "green!!", "a b", "the-water"):
        assert not s.found(t) and s.score(t) < 0.1, t


def test_every_disguise_is_tried():
    n = {"idiot": 50, "moron": 50, "stupid": 50, "clown": 50, "such": 200, "the": 200, "water": 200, "green": 200, "all": 200}
    grams = Counter()
    for w, k in n.items():
        for i in range(len(w) + 1):
            grams[f"^^{w}^"[i : i + 3]] += k
    s = toxicity.Scorer(grams, {w: 0.9 for w in ("idiot", "moron", "stupid", "clown")})
    for t, w in [("idioot", "idiot"), ("stuupid", "stupid"), ("!diot", "idiot"), ("idio+", "idiot"), ("(lown", "clown"), ("such a s t u p i d", "stupid"), ("such a  s t u p i d", "stupid"), ("idi" + "o" * 90 + "t", "idiot"), ("green." * 20 + "1d10t", "idiot"), ("water-" * 20 + "m0ron", "moron")]:
        assert w in s.found(t), t
    assert set(s.found("i d i o t m o r o n")) == set(s.found("i d i o t  m o r o n")) == {"idiot", "moron"}
    for t in ("all green water", "green!", "the-water." * 30, "1 2 3 4 5 6", "x1" * 5000, "g r e e n  w a t e r"):
        assert not s.found(t), t


def test_separators_pieces_marks_and_unseen_characters():
    n = {"idiot": 50, "moron": 50, "the": 200, "water": 200, "green": 200, "all": 200, "is": 300, "land": 90, "idle": 40, "rota": 30, "you": 200}
    grams = Counter()
    for w, k in n.items():
        for i in range(len(w) + 1):
            grams[f"^^{w}^"[i : i + 3]] += k
    s = toxicity.Scorer(grams, {"idiot": 0.9, "moron": 0.9})
    seen = ["i   d   i   o   t", "i\nd\ni\no\nt", "i,d,i,o,t", "i/d/i/o/t", "i\td\ti\to\tt", "i \u2013 d \u2013 i \u2013 o \u2013 t", "i  d  i  o  t    m  o  r  o  n", "you i | d | i | o | t"]
    seen += ["id iot", "idi ot", "i diot", "an id i ot", "mor\non", "i.diot", "\u00efdiot", "\u00edd\u00ed\u00f3t", "\u00ed d \u00ed \u00f3 t", "\uff49\uff44\uff49\uff4f\uff54", "\uff29\uff24\uff29\uff2f\uff34", "id\u00adiot", "i\u200bd\u200bi\u200bo\u200bt", "idi\ufeffot", "1d\u200d10t"]
    for t in seen:
        assert s.found(t), t
    assert set(s.found("i  d  i  o  t    m  o  r  o  n")) == {"idiot", "moron"}
    for t in ("the is land", "i d\ni", "a, b, c, d, e", "w\u00e4ter gr\u00eben", "id water iot", "idi, water ot", "i " * 5000, "mo the ron", "\u200b" * 50, "1. a\n2. b\n3. c"):
        assert not s.found(t), t


def test_lexicon_and_trigrams_equal_plain_counts(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        t = " ".join(rng.choice(vocabulary[: 40 + 20 * toxic]) for _ in range(8)) + ("!" if i % 3 else " \u00e9t\u00e9 \u0434\u0430")
        rows.append((i, rows[i // 2][1] if i % 11 == 10 else t))
        labels += [(i, int(toxic))] * (1 + (i % 50 == 0)) if i % 5 else []
    labels += [(3, 1), (None, 1), (7, None)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int"))
    grams, by, texts = Counter(), {}, dict(rows)
    for _, t in rows:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            if all(c in toxicity.LETTERS for c in w):
                grams.update(f"^^{w}^"[k : k + 3] for k in range(len(w) + 1))
    for i, x in labels:
        if i is not None and x is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            by[texts[i]] = max(by.get(texts[i], 0), x)
    words = {t: set(re.findall(r"[^\W\d_]+", t.lower())) for t in by}
    pos, neg = (Counter(w for t, x in by.items() if x == y for w in words[t]) for y in (1, 0))
    p = {w: (n + toxicity.PRIOR * toxicity.STRENGTH) / (n + neg[w] + toxicity.STRENGTH) for w, n in pos.items()}
    kept = {w: n for w, n in pos.items() if p[w] >= toxicity.LEAST}
    due = Counter()
    for t, x in by.items():
        own = words[t] & kept.keys() if x else set()
        for w in own:
            due[w] += kept[w] ** 3 / sum(kept[v] ** 3 for v in own)
    assert model.model.three == dict(grams) and model.lexicon == {w: pytest.approx(p[w]) for w, n in kept.items() if due[w] >= toxicity.SHARE * n} and len(model.lexicon) > 3


def test_other_scripts():
    s = toxicity.Scorer(Counter(f"^^idiot^"[k : k + 3] for k in range(6)), {"idiot": 0.9, "дурак": 0.9})
    for t in ("idіot", "іdiоt", "д у р а к", "д.у.р.а.к", "дураааак", "дурак"):
        assert s.found(t), t
    assert not s.found("идти домой") and not s.found("idle дом")


def test_viterbi_equals_all_paths():
    """The best of all paths of short lattices, each path scored by itself."""
    rng = random.Random(12)
    model = toxicity.CharModel(Counter({f"^^{w}^"[k : k + 3]: rng.randint(1, 9) for w in ("idiot", "is", "it", "lot", "tool", "soil") for k in range(len(w) + 1)}))
    for _ in range(150):
        seen = "".join(rng.choice("idot10!.s s*") for _ in range(rng.randint(1, 6)))
        for cut in (False, True):
            best: dict[str, float] = {}
            paths = [("^^", 0.0, "")]
            for before, ch in zip("\0" + seen, seen):
                paths = [(state[1] + c if c else state, cost + p + (model.log(state + c) if c else 0), path + c) for state, cost, path in paths for c, p in model.arcs(ch, before)] + [("^^", cost + toxicity.DROPPED + model.log(state + "^"), path + " ") for state, cost, path in paths if cut and ch == " " and state != "^^"]
            for state, cost, path in paths:
                best[path] = max(best.get(path, -1e9), cost + model.log(state + "^"))
            assert best[model.restore(seen, cut)] >= max(best.values()) - 1e-9, seen


def test_toxicity_learns_from_its_part_only(spark):
    rng = random.Random(2)
    plain = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = [(i, " ".join(rng.choice(plain) for _ in range(20)) + (" vermin" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (1000, ""), (1001, "v3rm1n here")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, l) for i, _, l in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(df, toxicity.fit(df, labels)).collect()}
    assert all(got[i]["predicted"] == l for i, _, l in rows) and got[1001]["predicted"] == 1 and got[1000]["score"] < 0.1 and got[None]["predicted"] == 0
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows)
    assert toxicity.remove_toxic(df, labels).count() == 400 - 100 + 2
    assert toxicity.score(df, toxicity.fit(df, labels.limit(0))).where("predicted = 1").count() == 0


# --- op4 ---


def slow_fingerprint(text):
    import xxhash

    w = split(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_masks_cover_every_pair():
    tables = simhash.masks()
    assert len(tables) == 7
    for i in range(64):
        for j in range(i, 64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in tables)


def closed(ids, prints):
    parent = dict.fromkeys(range(len(ids)))
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in parent:
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i in parent:
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in parent]


def test_near_duplicates_equal_brute_force(docs, rows):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    prints = [slow_fingerprint(t) for _, t, *_ in rows]
    assert [got[r[0]]["fp"] & (1 << 64) - 1 for r in rows] == prints
    assert [got[r[0]]["component_id"] for r in rows] == closed([r[0] for r in rows], prints)


def test_links_of_dense_fingerprints(spark):
    rng = random.Random(5)
    prints = {0, 1, 2, 3}
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(10):
            for _ in range(rng.randint(1, 2)):
                base ^= 1 << rng.randrange(64)
            prints.add(base)
    prints = sorted(prints)
    edges = simhash.links(spark.createDataFrame([(simhash.signed(x),) for x in prints], "fp long"))
    root = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    mine = [root.get(simhash.signed(x), simhash.signed(x)) for x in prints]
    assert mine == closed([simhash.signed(x) for x in prints], prints)


def test_keep_first_loses_only_near_rows(spark, odd, empty):
    one, two, three = "a b c d e f g h i", "totally other words that nobody else has written here", "and a third text of its own with nothing in common"
    rows = [(1, one, "x"), (3, one, "x"), (3, two, "x"), (None, three, "x"), (None, one, "x"), (None, "no id and alone in the world of texts", "x"), (3, two, "w"), (3, two, "w"), (None, three, "x")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, row string"))
    want = [(1, one, "x"), (3, two, "w"), (None, three, "x"), (None, "no id and alone in the world of texts", "x")]
    assert Counter(map(tuple, kept.collect())) == Counter(want)
    groups: dict[int, list] = {}
    every = odd.collect()
    for r, c in zip(every, closed(list(range(len(every))), [slow_fingerprint(r["text"]) for r in every])):
        groups.setdefault(c, []).append(r)
    mine = simhash.keep_first(odd)
    left = [(r["doc_id"], r["text"]) for r in mine.collect()]
    assert mine.columns == odd.columns and len(left) == len(groups) and simhash.keep_first(empty).count() == 0
    for g in groups.values():
        ids = [r["doc_id"] for r in g if r["doc_id"] is not None]
        assert sum((r["doc_id"], r["text"]) in left for r in g) >= 1 and (not ids or any(i == min(ids) and t in {r["text"] for r in g} for i, t in left))


# --- op5 ---


def test_archives_and_index(spark, tmp_path):
    page = lambda k: f"<p>{'same' if k % 4 == 0 else k} {'x' * 120}</p>"
    rows = [(k, f"http://www.Ex{k % 5}.com:80/p/{k % 11}?q#f", page(k), "z") for k in range(200)] + [(300, None, None, "z"), (301, "no url", "short", "z"), (302, "http://a.b/é\nx", "short", "z"), (5, "http://ex5.com/again", page(5), "z")]
    rows += [(None, "http://n.com/1", page(0), "z"), (None, "http://n.com/2", page(777), "z"), (None, "http://n.com/3", page(777), "z"), (None, None, None, "z")]
    pages, out = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(4), common.work_dir(spark, "w")
    captures = warc.write_archives(pages, out)
    warc.write_index(captures, out, lines=7)
    found = warc.read_captures(warc.lookup(captures.select("key"), out), out).cache()
    assert found.count() == len(rows)
    text = lambda k: None if k is None else str(k)
    got = Counter((r["name"], r["record_type"], r["refers"], r["payload_bytes"], r["digest"]) for r in warc.full_payload(found).collect())
    want = Counter()
    for k, _, h, _ in rows:
        raw = (h or "").encode()
        least = min((i for i, _, x, _ in rows if (x or "") == (h or "") and i is not None), default=None)
        revisit = len(raw) >= 100 and least is not None and least != k
        want[text(k), "revisit" if revisit else "response", text(least) if revisit else None, len(raw), hashlib.sha256(raw).hexdigest()] += 1
    assert got == want
    pages.select("page_id", "url", "html").toPandas().astype({"page_id": "Int64"}).to_parquet(tmp_path / "pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    keys = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    mine = Counter(tuple(r[k] for k in keys) for r in queries.op5_capture_index(spark, str(tmp_path)).collect())
    assert mine == Counter(con.execute(f"SELECT {', '.join(keys)} FROM ({queries.OP5_SQL})").fetchall())
    key = warc.capture_key("https://ex3.com/p/3?q")
    assert key == "com,ex3)/p/3?q"
    mine = warc.read_captures(warc.lookup(spark.createDataFrame([(key,), ("com,none)/",), (None,)], "key string"), out), out)
    assert sorted(int(r["name"]) for r in mine.collect()) == [k for k in range(200) if k % 5 == 3 and k % 11 == 3]


def test_no_pages(spark):
    out = common.work_dir(spark, "w")
    captures = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), out)
    warc.write_index(captures, out)
    assert warc.lookup(captures.select("key"), out).count() == 0


# --- op6 ---


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(6)
    words = ["ab", "c", "dé", "7x", "zz", "q"]
    text = lambda n: rng.choice([" ", "-", ". "]).join(rng.choice(words) for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate((20, 14, 13, 12, 5, 2, 1, 0, 30))] + [(9, None), (None, "zz q"), (10, "zz q zz"), (3, "c c c")]
    docs = [(k, text(rng.choice([0, 1, 12, 60, 150])) + " " + (items[k % 9][1] or "").upper()) for k in range(60)] + [(70, None), (71, ""), (72, "x"), (70, None)]
    own = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    patterns = {}
    for i, t in items:
        w = own(t)
        m = min(13, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            patterns.setdefault(tuple(w[k : k + m]), set()).add(None if i is None else str(i))
    want = []
    for i, t in docs:
        w, hit, names = own(t), set(), set()
        for k in range(len(w)):
            for p, who in patterns.items():
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    names |= who
        want.append((i, len(w), len(hit), sorted(names, key=lambda x: (x is None, x or ""))))
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 20, 500):
        got = decontam.find_spans(d, b, block_bytes=limit).collect()
        assert sorted(map(repr, ((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got))) == sorted(map(repr, want))
        assert all(sum(s["b"] - s["a"] for s in r["spans"]) == r["n_hit"] for r in got)
    assert decontam.find_spans(d, b.limit(0)).where("n_hit > 0").count() == 0 and decontam.find_spans(d.limit(0), b).count() == 0
    clean = Counter(i for i, n, h, _ in want if not (h and 20 * h >= n))
    for limit in (1 << 20, 500):
        assert Counter(r["doc_id"] for r in decontam.remove_contaminated(d, b, block_bytes=limit).collect()) == clean


def test_clean_rows_stay_beside_contaminated_ones_of_their_id(spark):
    bad, good = "one two three four five six seven eight nine ten eleven twelve thirteen", "nothing of that kind"
    d = spark.createDataFrame([(None, bad), (None, good), (1, bad + " x"), (1, good), (2, None)], "doc_id long, text string")
    b = spark.createDataFrame([(None, bad), (4, "a much longer item that nobody has copied into any document at all so far, it seems")], "item_id long, text string")
    for limit in (1 << 20, 60):
        assert sorted(map(repr, (tuple(r) for r in decontam.remove_contaminated(d, b, block_bytes=limit).collect()))) == sorted(map(repr, [(None, good), (1, good), (2, None)]))


def test_long_items_are_cut_without_losing_windows():
    rng = random.Random(13)
    words = [b"w%d" % rng.randint(0, 40) for _ in range(3000)]
    whole, cut = decontam.Search([("a", b" ".join(words))]), decontam.Search([("a", b" ".join(words[k : k + 100])) for k in range(0, 2988, 88)])
    for k in (0, 80, 87, 88, 1000, 2987):
        text = [b"x"] * 5 + words[k : k + 13] + [b"y"]
        assert whole(text) == cut(text) == (19, [(5, 18)], ["a"])
    assert whole([b"w1"] * 12) == (12, [], []) and decontam.Search([])([b"a"]) == (1, [], [])


# --- op7 ---


def slow_removed(rows, size):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        w, gone = split(t), set()
        for k in range(len(w) - size + 1):
            p = tuple(w[k : k + size])
            if p in seen:
                gone.update(range(k, k + size))
            seen.add(p)
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("size, hot", [(20, 10_000), (20, 2), (6, 3), (3, 10_000)])
def test_duplicate_spans_equal_brute_force(docs, rows, size, hot):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring.duplicate_spans(docs, size=size, hot=hot).collect()}
    assert got == slow_removed(rows, size)


@pytest.mark.parametrize("bits, hot", [(1, 10_000), (3, 10_000), (3, 5), (6, 10_000)])
def test_equal_hashes_remove_nothing(docs, rows, bits, hot):
    """With hashes of a few bits, phrases that differ collide all the time; words decide."""
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring.duplicate_spans(docs, size=6, hot=hot, bits=bits).collect()}
    assert got == slow_removed(rows, 6)


def test_factors_point_at_equal_words(docs, rows):
    texts = {r[0]: split(r[1]) for r in rows}
    for r in substring.factors(common.keyed_texts(docs).withColumnRenamed("doc_id", "key"), size=6).collect():
        n = r["n"] + 5
        assert texts[r["key"]][r["start"] : r["start"] + n] == texts[r["ref_key"]][r["ref_start"] : r["ref_start"] + n] and (r["ref_key"], r["ref_start"]) < (r["key"], r["start"])


def test_spans_of_odd_ids(odd, empty):
    got = substring.duplicate_spans(odd).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in odd.collect()) and substring.duplicate_spans(empty).count() == 0


# --- op8 ---


def test_ordinal_thresholds_are_ordered_and_predict(spark):
    rng = random.Random(8)
    sets = [["bad", "junk", "spam"], ["fair", "plain", "usual"], ["fine", "clear", "true"]]
    rows = [(i, " ".join(rng.choice(sets[i % 3]) for _ in range(30)), i % 3) for i in range(300)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (900, "")], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, grade int")
    model = grades.fit(df, ratings)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in grades.grade(df, model).collect()}
    held = [(i, g) for i, _, g in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(round(got[i]["expected_grade"]) == g for i, g in held) >= 0.9 * len(held)
    assert all(r["p_grade_1"] >= r["p_grade_2"] for r in got.values()) and got[900]["expected_grade"] == got[None]["expected_grade"]
    assert grades.grade(df, grades.fit(df, ratings.limit(0))).count() == 302


def test_grades_equal_plain_python(spark):
    """Features and probabilities of the operator against a version with lists, and the gradient against differences of the likelihood."""
    texts = ["", None, "one two two, three", "A b c\nA b c\n" * 6, "é ß 1 (x)"]
    rng = np.random.default_rng(3)
    model = grades.Model(rng.normal(size=grades.DIM) / 5, np.array([-0.7, 0.4]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in grades.grade(df, model).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        own = dict(zip(*(x.tolist() for x in grades.features(texts[r["doc_id"]]))))
        place = sum(float(model.weights[i]) * v for i, v in own.items())
        want = [1 / (1 + math.exp(t - place)) for t in model.thresholds]
        assert np.allclose([r["p_grade_1"], r["p_grade_2"], r["expected_grade"]], [*want, sum(want)], atol=1e-6) and r["selected"] == (want[0] >= 0.5)
        n = Counter(raw.lower().split())
        counted = sorted(v for i, v in own.items() if i >= grades.SHAPES)
        norm = math.sqrt(sum(math.log1p(x) ** 2 for x in n.values())) or 1
        assert np.allclose(counted, sorted(math.log1p(x) / norm for x in n.values()), atol=1e-6)


def test_solution_is_near_the_best_by_search():
    """Two features and three grades: no other weights and thresholds of a fine grid are likelier."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 1))
    y = np.digitize(x[:, 0] + rng.logistic(size=300) * 0.5, [-0.5, 0.8])
    model = grades.solved([(np.array([5], np.int32), v.astype(np.float32)) for v in x], y, steps=1500, penalty=0.0)
    share = np.sqrt(len(y) / np.bincount(y))[y]

    def loss(w, a, b):
        up = lambda t: 1 / (1 + np.exp(w * x[:, 0] - t))
        p = np.select([y == 0, y == 1], [up(a), up(b) - up(a)], 1 - up(b))
        return -(share * np.log(np.maximum(p, 1e-12))).sum() / share.sum()

    w, (a, b) = float(model.weights[5]), model.thresholds
    mine = loss(w, a, b)
    for dw in (-0.3, 0, 0.3):
        for da in (-0.2, 0, 0.2):
            for db in (-0.2, 0, 0.2):
                assert mine <= loss(w + dw, a + da, b + db) + 1e-4


# --- op9 ---


def test_licences(spark):
    rng = random.Random(9)
    plain = lambda: " ".join(rng.choice("ther and shing onea the of to ernd that wher inble".split()) for _ in range(12))
    rows = [(k, f"{plain()}\n{plain()}") for k in range(80)]
    rows += [(100, plain() + "\nReleased under the MIT License."), (101, "Licensed under the Apache License, Version 2.0."), (102, f"{plain()} {plain()} {plain()} {plain()} {plain()} {plain()} this work is licensed under the GNU General Public License, version 3. {plain()}"), (103, None), (104, ""), (105, "The license plate was new."), (100, "All rights reserved.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("family", F.lit("clash"))
    got = {r["doc_id"]: r for r in licenses.license_scan(df).collect()}
    assert got[100]["families"] == "mit,proprietary" and got[101]["family"] == "apache-2.0" and got[102]["family"] == "gpl-3.0"
    assert all(got[k]["family"] == "unknown" for k in (*range(80), 103, 104, 105)) and len(got) == 86
    assert licenses.license_scan(df.limit(0)).count() == 0


#: Openings of licence texts, wrapped as they are published.
WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are\nmet:\n\n1. Redistributions of source code must retain the above copyright notice",
    "mpl-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */",
    "gpl-3.0": "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.",
    "gpl-2.0": "This program is free software; you can redistribute it and/or\r\nmodify it under the terms of the GNU General Public License\r\nas published by the Free Software Foundation; either version 2\r\nof the License, or (at your option) any later version.",
}


def test_wrapped_licences(spark):
    rng = random.Random(10)
    plain = lambda: "\n".join(" ".join(rng.choice("ther and shing onea the of to ernd that wher inble".split()) for _ in range(11)) for _ in range(6))
    rows = [(f"p{k}", plain()) for k in range(60)] + [(f, f"{plain()}\n{t}\n{plain()}") for f, t in WRAPPED.items()] + [("alone " + f, t) for f, t in WRAPPED.items()]
    rows += [("half", WRAPPED["mit"].split("\n")[0] + "\n" + plain()), ("one line", plain() + "\nReleased under the MIT License.\n" + plain())]
    got = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for f in WRAPPED:
        assert [(got[k]["family"], got[k]["families"], got[k]["n_confirmed"]) for k in (f, "alone " + f)] == [(f, f, 1)] * 2
    assert all(got[k]["family"] == "unknown" for k in ("half", *(f"p{k}" for k in range(60)))) and got["one line"]["n_confirmed"] == 1 and got["one line"]["n_paragraphs"] == 13


#: Statements and look-alikes that are in no training list (held out).
HELD_OUT = [
    ("gpl-3.0", "ledger is free software you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This program is free software; you may redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License or, at your option, any later version. More"),
    ("agpl-3.0", "This server program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("mit", "Some tool, released under the MIT License, see there"),
    ("apache-2.0", "Copyright 2020 X. Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. Thanks"),
    ("cc-by-sa", "Photos by N. N., this work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License, 2021"),
    ("bsd", "Redistribution and use in source or binary forms, with or without modification, are permitted provided that the following conditions are met: first"),
    ("mit", "// SPDX-License-Identifier: MIT"),
    ("gpl-3.0", "# SPDX-License-Identifier: GPL-3.0-or-later"),
    ("mit", "The whole package is available under the MIT licence."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("boost", "// Distributed under the Boost Software License, Version 1.0. (See the file)"),
    ("", "The shop was closed and the sign said released under the MIT License only in jest"),
    ("", "You cannot assume this work is licensed under the GNU General Public License, version 3"),
    ("", "The drawings are neither licensed under CC BY 4.0 nor sold"),
    ("", "Until 2010 it was licensed under the Apache License, Version 2.0"),
    ("", "The tribes have all rights reserved to them by treaty"),
    ("", "In fact the file is not licensed under the Apache License, Version 2.0 at all"),
    ("", "Nobody here believes it is released under the BSD License any more"),
]


@pytest.fixture(scope="module")
def license_model(spark):
    rng = random.Random(14)
    plain = lambda: " ".join(rng.choice("ther and shing onea the of to ernd that wher inble".split()) for _ in range(30))
    own = [(f"p{k}", plain()) for k in range(60)]
    docs = spark.createDataFrame(own + [(f"h{k}", f"{plain()}\n{t}\n{plain()}") for k, (_, t) in enumerate(HELD_OUT)], "doc_id string, text string")
    return docs, *licenses.fit(spark.createDataFrame(own, "doc_id string, text string"))


def test_classifier_decides_where_templates_cannot(license_model):
    """On held-out paragraphs, amid other text, the classifier with the comparison is right more often than the comparison alone."""
    docs, model, temperature = license_model
    rows = licenses.classified(docs, model, temperature).collect()
    said = lambda column: [",".join(sorted({r["family"] for r in rows if r["doc_id"] == f"h{k}" and r[column]})) for k in range(len(HELD_OUT))]
    wrong = lambda column: [(b, a) for a, b in zip(said(column), HELD_OUT) if a != b[0]]
    assert len(wrong("confirmed")) <= 3 and len(wrong("held")) >= 8, (wrong("confirmed"), wrong("held"))
    assert not [r for r in rows if r["doc_id"][0] == "p" and r["confirmed"]]


def test_every_confirmed_stretch_has_a_needed_word():
    every = set(licenses.needed())
    for ts in licenses.SHINGLES.values():
        for t in ts:
            assert sum(not every & set(g.split()) for g in t) < licenses.CONFIRM * len(t)


# --- op10 ---


def test_replication_follows_rates(spark):
    df = spark.createDataFrame([(i, "t", "a" if i % 10 else "b") for i in range(4000)], "doc_id long, text string, source string")
    out = mixing.replicate(df, {"a": 1, "b": 1}, total=8000).cache()
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["a"] - 4000) < 4 * 63 and abs(n["b"] - 4000) < 4 * 63
    assert out.collect() == mixing.replicate(df.repartition(5), {"a": 1, "b": 1}, total=8000).collect()
    by = {r["doc_id"]: r["n_copies"] for r in out.collect()}
    rate = 4000 / 3600
    share = sum(1 for i in range(4000) if i % 10 and i not in by) / 3600
    assert abs(share - np.exp(-rate)) < 0.04


def test_large_rates_are_exact_sums(spark):
    df = spark.createDataFrame([(i, "one") for i in range(50)], "doc_id long, source string")
    n = mixing.replicate(df, {"one": 1}, total=50 * 500).count()
    assert abs(n - 25_000) < 5 * 25_000**0.5


def test_mixing_of_odd_rows(odd, empty):
    out = mixing.replicate(odd, {None: 1, "s0": 2, "s9": 1}, total=300)
    assert {r["source"] for r in out.collect()} <= {None, "s0"} and set(out.columns) == set(odd.columns) | {"copy", "n_copies", "shuffle_key"}
    assert mixing.replicate(empty).count() == 0 and mixing.replicate(odd, {"none": 1}).count() == 0


def test_mixing_leaves_all_other_columns_alone(spark):
    names = ["__src", "__id", "__us", "__draws", "__of", "__cdf", "src", "id", "us", "draws", "of", "cdf", "order", "given0", "given3", "n", "w", "rate", "a.b", "Copy"]
    df = spark.createDataFrame([(i, "t", f"s{i % 3}") for i in range(60)], "doc_id long, text string, source string")
    more = df.select("*", *[F.lit(f"own {c}").alias(c) for c in names])
    plain, clash = mixing.replicate(df, seed=3), mixing.replicate(more, seed=3)
    assert clash.columns == [*df.columns, *[c for c in names if c != "Copy"], "copy", "n_copies", "shuffle_key"]
    assert clash.select(*plain.columns).collect() == plain.collect()
    assert all(r[c] == f"own {c}" for r in clash.collect() for c in names if c != "Copy")


def test_grades_sample_is_bounded(spark):
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    ids = [i for i in range(40) if not held(i)][:6]
    rows = [(ids[0], f"text number {k}") for k in range(4000)] + [(i, "word " * 50 + str(i)) for i in ids[1:5]] + [(ids[5], " ".join(map(str, range(60_000))))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    ratings = spark.createDataFrame([(i, k % 3) for k, i in enumerate(ids)], "doc_id long, grade int")
    for n in (2, 6):
        assert grades.sample(docs, ratings, fit_rows=n).count() == n
    short = grades.sample(docs, ratings, fit_entries=1000).collect()
    assert 1 <= len(short) <= 5 and sum(len(r["index"]) // 4 for r in short) <= 1000
    assert sorted(map(tuple, short)) == sorted(map(tuple, grades.sample(docs.repartition(7), ratings, fit_entries=1000).collect()))
    assert grades.fit(docs, ratings, fit_rows=2).weights.shape == (grades.DIM,)
