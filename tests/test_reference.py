"""Semantics that the SQL comparisons do not reach, and the comparisons themselves on the smallest tables."""

import contextlib
import io
import json
import os
import random
import zipfile
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.functions import hosts, patterns, pdf, quality, text
from foliospark.operators import archive, entities, pages, redaction, signatures, sql
from foliospark.plans import catalogue
from foliospark.plans.extract import extract
from foliospark.sources import files, formats
from foliospark.sources.formats import decode_name, read
from foliospark.streaming import incremental

SF = "/root/testdata/sf0.001"


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c"))).first()[0]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("+370 612 34567", ["+37061234567"]),
        ("370 61234567", ["+37061234567"]),
        ("8 612 34567", ["+37061234567"]),
        ("(8-5) 2123456", ["+37052123456"]),
        ("0 612 34567", ["+37061234567"]),
        ("tel.:61234567", ["+37061234567"]),
        (",61234567", []),
        ("a61234567", []),
        ("37052345", ["+37052345"]),
        ("+370 1 1234567", []),
        ("612345678", []),
        ("", []),
        (None, []),
    ],
)
def test_phones(spark, raw, expected):
    assert one(spark, raw, patterns.phones) == expected


@pytest.mark.parametrize(
    "raw, kind, expected",
    [
        ("ąinfo@x.lt", "email", ["info@x.lt"]),
        ("see http://a.lt/ąą now", "link", ["http://a.lt"]),
        ("http://a.lt/b/.", "link", ["http://a.lt/b"]),
        ("HTTP://a.lt", "link", []),
        ("http://a b.lt", "link", ["http://a b.lt"]),
        ("x123456789 123456789", "company_code", ["123456789"]),
        ("LT121000011101001000 lt121000011101001000", "iban", ["LT121000011101001000"]),
    ],
)
def test_boundaries(spark, raw, kind, expected):
    assert one(spark, raw, patterns.KINDS[kind]) == expected


@pytest.mark.parametrize("uri, host", [("http://WWW.A.lt/x", "a.lt"), ("https://u:p@a_b.lt:80/", "a_b.lt"), ("mailto:a@b.lt", None), ("tel:1", None), ("http:///", None)])
def test_ascii_host(spark, uri, host):
    assert one(spark, uri, patterns.ascii_host) == host


@pytest.mark.parametrize(
    "raw, host",
    [
        ("127.1", "127.0.0.1"), ("0x7f.1", "127.0.0.1"), ("256.256.256.256", None), ("a<b", None), (None, None), ("", None), ("A.LT", "a.lt"), ("%41.lt", "a.lt"),
        # the four deviations, in their non-transitional form (examples of the standard)
        ("fa\u00df.de", "xn--fa-hia.de"), ("\u03b2\u03cc\u03bb\u03bf\u03c2.com", "xn--nxasmm1c.com"), ("\u0dc1\u0dca\u200d\u0dbb\u0dd3.com", "xn--10cl1a0b660p.com"), ("\u0646\u0627\u0645\u0647\u200c\u0627\u06cc.com", "xn--mgba3gch31f060k.com"),
        ("STRA\u1e9eE.lt", "xn--strae-oqa.lt"), ("stra\u00dfe.lt", "xn--strae-oqa.lt"), ("strasse.lt", "strasse.lt"), ("B\u00fccher.lt", "xn--bcher-kva.lt"), ("bu\u0308cher.lt", "xn--bcher-kva.lt"),
        # joiners where they may not stand
        ("a\u200db.lt", None), ("a\u200cb.lt", None), ("\u0627\u200c\u0628.lt", None), ("\u200d.lt", None),
        # characters that are mapped or vanish
        ("a\u00adb.lt", "ab.lt"), ("\uff21\uff22\uff0elt", "ab.lt"), ("a\u3002lt", "a.lt"), ("a\ufe0f.lt", "a.lt"), ("\u2603.net", "xn--n3h.net"), ("xn--n3h.net", "xn--n3h.net"), ("\u2460.lt", "1.lt"),
        # right to left
        ("\u05d0\u05d0.com", "xn--4dba.com"), ("\u05d0a.com", None), ("a\u05d0.com", None), ("1a.\u05d0", None), ("\u06271.com", "xn--1-ymc.com"), ("\u0627\u0661" + "1.com", None), ("a.\u05d0", "a.xn--4db"),
        # what may not stand at all
        ("\u0300a.lt", None), ("a\ue000.lt", None), ("a\u0378.lt", None), ("a\u00a0b.lt", None), ("xn--.lt", None), ("xn--a.lt", None), ("xn--a-\u00fc.lt", None), ("XN--BCHER-KVA.lt", "xn--bcher-kva.lt"), ("a\u2028.lt", None),
    ],
)
def test_host_by_rules(raw, host):
    assert hosts.host_by_rules(raw) == host


def test_domains_of_other_scripts(spark):
    """In a query: with and without Arrow, the same rules."""
    uris = ["http://www.stra\u00dfe.lt/x", "https://\u05d0\u05d0.com:80/", "http://xn--a.lt/", "http://a.lt/", "http://a\u200db.lt/"]
    found = spark.createDataFrame([(k, "link", u) for k, u in enumerate(uris)], "doc_id int, kind string, key string")
    assert sorted((r["doc_id"], r["domain"]) for r in entities.hosts(found).collect()) == [(0, "xn--strae-oqa.lt"), (1, "xn--4dba.com"), (3, "a.lt")]


@pytest.mark.parametrize("raw, iso", [("D:2024", "2024-01-01T00:00:00Z"), ("D:20240203040506+02'30'", "2024-02-03T04:05:06+02:30"), ("D:202402-", "2024-02-01T00:00:00-00:00"), ("2024", None), (None, None)])
def test_pdf_dates(spark, raw, iso):
    assert one(spark, raw, pdf.iso_date) == iso


@pytest.mark.parametrize("raw, hexed", [([0.0], "#000000"), ([1.0, 0.0, 0.5], "#ff0080"), ([0.0, 0.0, 0.0, 1.0], "#000000"), ([], None), (None, None)])
def test_colors(spark, raw, hexed):
    assert one(spark, raw, pdf.hex_color, "array<double>") == hexed


def test_text_functions(spark):
    assert one(spark, "Signer Certificate Common-Name", text.camel_case) == "signerCertificateCommonName"
    assert one(spark, " ﻿ a  b\t", text.collapse) == "a b"
    assert one(spark, "a😀", text.utf16_length) == 3
    assert [one(spark, x, text.extension) for x in ("a.TXT", ".b", "a.", "x/.a.b")] == ["txt", "", "", "b"]
    assert one(spark, "x/y/", text.base_name) == "y"


@pytest.mark.parametrize("value, criterion, score", [("", "not_empty", -100.0), ("", "capitalised", 0.5), ("aaaaaaaaaaaaa", "word_length", 0.0), ("", "junk_symbols", 0.0), ("ab1cd efg", "inner_digits", 0.0), ("2024 abc", "inner_digits", 1.0), ("aBc def", "inner_capitals", 0.0), (None, "not_empty", None)])
def test_quality_edges(spark, value, criterion, score):
    df = quality.with_measures(spark.createDataFrame([(value,)], "t string"), "t", "m")
    assert df.select(quality.scores("m", F.col("t"))[criterion]).first()[0] == score


def test_a_thirteenth_criterion_and_weights_as_a_table(spark):
    own = quality.Criterion(measure="{vowels} / {count}", score="CASE WHEN {m} > 1 THEN 1.0D ELSE 0.5D END", weight=3.0, counts={"vowels": "CAST(regexp_count({text}, '[aeiou]') AS DOUBLE)"})
    criteria = quality.CRITERIA | {"vowels": own}
    df = spark.createDataFrame([(1, "aa ee io"), (2, "a b c"), (3, None)], "k int, t string")
    measured = quality.with_measures(df, "t", "m", criteria)
    assert {r["k"]: r["s"] for r in measured.select("k", quality.scores("m", F.col("t"), criteria)["vowels"].alias("s")).collect()} == {1: 1.0, 2: 0.5, 3: None}
    plain, more = ({r["k"]: r["x"] for r in quality.with_total(df, "t", "x", c).collect()} for c in (quality.CRITERIA, criteria))
    assert more[1] == pytest.approx(plain[1] + 3) and more[2] == pytest.approx(plain[2] + 1.5) and more[3] is None
    weights = spark.createDataFrame([("vowels", 2.0), ("vowels", 1.0), ("not_empty", 4.0), ("unknown", 9.0)], "criterion string, weight double")
    assert {r["k"]: r["x"] for r in quality.with_total(df, "t", "x", criteria, weights).collect()} == {1: 7.0, 2: 5.5, 3: None}
    assert quality.with_total(df, "t", "x", criteria, weights.limit(0)).where("x <> 0").count() == 0
    # what is not asked for is not counted: of all patterns only that of the new criterion is in the plan
    said = plan(measured.select("k", "m_vowels"))
    assert "aeiou" in said and quality.JUNK not in said and "[.!?]" not in said
    with pytest.raises(ValueError, match="another count"):
        quality.with_measures(df, "t", "m", {"x": quality.Criterion("{size}", "{m}", counts={"size": "1"})})


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("extended")
    return out.getvalue().split("== Optimized Logical Plan ==")[1]


def test_sql_functions(spark):
    sql.register(spark, quality.CRITERIA | {"length": quality.Criterion("{size}", "{m}", 0.0)})
    text = "a@b.lt http://www.Straße.lt/ and https://A.LT:8080/x 123456789, +370 (612) 34567 or 8 612 34567 mailto:q@w.lt LT121234567890123456 tel:1"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "plain")], "k int, text string")
    own = {(r["kind"], r["pos"]): r["key"] for r in entities.hits(df.select(F.col("k").alias("doc_id"), F.lit(1).alias("page"), "text")).collect()}
    found = spark.sql("SELECT k, e.*, entity_domain(e.kind, e.key) AS domain FROM {df} d, LATERAL extract_entities(d.text) e", df=df)
    assert {(r["kind"], r["pos"]): r["key"] for r in found.collect()} == own and len(own) == 9
    assert sorted(r["domain"] for r in found.collect() if r["domain"]) == ["a.lt", "b.lt", "w.lt", "xn--strae-oqa.lt"]
    assert "Join" not in plan(found.drop("domain")) and "Generate" in plan(found)
    by_columns = {r["k"]: r["t"] for r in quality.with_total(df, "text", "t").collect()}
    got = {r["k"]: r for r in spark.sql("SELECT k, quality_total(text) AS t, quality_scores(text) AS s FROM {df}", df=df).collect()}
    assert {k: r["t"] for k, r in got.items()} == by_columns and got[1]["s"]["length"] == len(text) and got[2]["s"]["length"] is None
    sql.register(spark)


def test_better_prefers_first_of_equals(spark):
    df = spark.createDataFrame([("same text here", "same text here"), (None, "b"), ("a", ""), ("Gera diena visiems.", "%%% ### $$$")], "a string, b string")
    assert [r[0] for r in quality.with_better(df, "a", "b", "o").select("o").collect()] == ["same text here", "b", "a", "Gera diena visiems."]


def test_entity_lists_keep_first_seen_order(spark):
    rows = pages.page_rows(spark.createDataFrame([(1, ["b@x.lt a@x.lt", "a@x.lt b@x.lt b@x.lt"])], "doc_id long, p array<string>"), F.col("p"))
    assert [(e["key"], e["pages"]) for e in entities.lists(rows, "email").first()["entities"]] == [("b@x.lt", [1, 2]), ("a@x.lt", [1, 2])]


def test_mail_links_become_emails(spark):
    rows = pages.page_rows(spark.createDataFrame([(1, ["mailto:me@x.lt", "me@x.lt"])], "doc_id long, p array<string>"), F.col("p"))
    got = {(r["kind"], r["key"]): r["pages"] for r in entities.everything(rows).collect()}
    assert got[("email", "me@x.lt")] == [1, 2] and got[("link", "mailto:me@x.lt")] == [1] and ("domain", "x.lt") in got


def test_signature_report(spark):
    report = "Signature #1:\n  - Signer Certificate Common Name: A B\n  - Signed Ranges: [0 - 10], [20 - 30]\n  - Total document signed\nSignature #2:\n  - Signing Time: Jan 02 2024 03:04:05\n"
    got = {r["signature"]: r for r in signatures.signatures(spark.createDataFrame([(1, report), (2, "none")], "doc_id long, report string")).collect()}
    assert got[1]["signed_ranges"] == [[0.0, 10.0], [20.0, 30.0]] and got[1]["total_document_signed"] and not got[2]["total_document_signed"]
    assert str(got[2]["signing_time"]) == "2024-01-02 03:04:05" and got[1]["fields"]["signerCertificateCommonName"] == "A B"


def test_redactions_skip_blank_and_bright(spark):
    items = spark.createDataFrame([(1, 1, 1, "a", 0.0, 0.0, 10.0, 10.0), (1, 1, 2, " ", 0.0, 0.0, 10.0, 10.0), (1, 1, 3, "b", 5.0, 0.0, 5.0, 5.0)], "doc_id int, page int, ord int, str string, x double, y double, width double, height double")
    areas = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 20.0, 20.0, "#000000", 1.0, "SQUARE"), (1, 1, 2, 0.0, 0.0, 20.0, 21.0, "#00ff00", 1.0, "SQUARE"), (1, 1, 3, 0.0, 0.0, 20.0, 22.0, "#ff0000", 0.0, "SQUARE")], "doc_id int, page int, annot_id int, x0 double, y0 double, x1 double, y1 double, color string, opacity double, annotation_type string")
    got = redaction.sloppy_redactions(items, areas).collect()
    assert len(got) == 1 and got[0]["text"] == "a b"


def slow_redactions(items, areas, t=2.0):
    out = {}
    for doc, page, ord_, text, x, y, w, h in sorted(items, key=lambda r: r[2]):
        for d, p, n, x0, y0, x1, y1, color, opacity, kind in sorted(areas, key=lambda r: r[2]):
            if (d, p) == (doc, page) and text.strip() and color in ("#000000", "#ff0000") and opacity != 0 and not (x0 - (x + w) > t or y0 - (y + h) > t or x1 - x < t or y1 - y < t):
                out.setdefault((doc, page, x0, y0, x1, y1), []).append((ord_, n, text))
    return {k: " ".join(x[2] for x in sorted(v)) for k, v in out.items()}


ITEM, AREA = "doc_id long, page int, ord long, str string, x double, y double, width double, height double", "doc_id long, page int, annot_id long, x0 double, y0 double, x1 double, y1 double, color string, opacity double, annotation_type string"


@pytest.mark.parametrize("span", [40.0, 700.0, 1e7])
def test_redactions_of_all_sizes(spark, span):
    """Boxes of all sizes, turned ones, ones on the edges of cells, repeated ones, and coordinates that are no numbers."""
    rng = random.Random(int(span))
    at = lambda: rng.choice([rng.uniform(-span, span), 32.0 * rng.randint(-9, 9), 0.0])
    size = lambda: rng.choice([0.0, 1.0, 10.0, 32.0, 64.0, rng.uniform(0, span), -5.0])
    items = [(rng.randint(1, 2), rng.randint(1, 2), k, rng.choice(["a", "b", " "]), at(), at(), size(), size()) for k in range(150)]
    corner = [(at(), at()) for _ in range(110)]
    areas = [(rng.randint(1, 2), rng.randint(1, 2), k, x, y, x + size(), y + size(), rng.choice(["#000000", "#ff0000", "#00ff00"]), rng.choice([1.0, 0.0, None]), "SQUARE") for k, (x, y) in enumerate(corner)]
    items, areas = items + items[:9], areas + [(d, p, k + 1000, *r) for d, p, k, *r in areas[:9]]
    bad = float("nan")
    got = redaction.sloppy_redactions(
        spark.createDataFrame(items + [(1, 1, 900, "x", bad, 1.0, 1.0, 1.0), (1, 1, 901, "x", None, 1.0, 1.0, 1.0), (None, 1, 902, "x", 0.0, 0.0, 9.0, 9.0), (1, 1, 903, "x", float("inf"), 1.0, 1.0, 1.0)], ITEM),
        spark.createDataFrame(areas + [(1, 1, 900, bad, 0.0, 9.0, 9.0, "#000000", 1.0, "x"), (1, None, 901, 0.0, 0.0, 9.0, 9.0, "#000000", 1.0, "x")], AREA),
    ).collect()
    want = slow_redactions(items, areas)
    assert len(want) > 10 and {(r["doc_id"], r["page"], *r["rect"]): r["text"] for r in got} == want and len(got) == len(want)
    assert redaction.sloppy_redactions(spark.createDataFrame([], ITEM), spark.createDataFrame(areas, AREA)).count() == 0


def test_one_page_with_many_items_and_areas(spark):
    """100,000 of each on one page: 10 billion pairs, of which only those of one cell meet."""
    n = 100_000
    place = lambda a, b: (F.pmod(F.xxhash64(F.lit(a), "id"), F.lit(b)) / 10.0)
    ids = spark.range(0, n, 1, 8)
    items = ids.select(F.lit(1).cast("long").alias("doc_id"), F.lit(1).alias("page"), F.col("id").alias("ord"), F.col("id").cast("string").alias("str"), place("x", 300_000).alias("x"), place("y", 300_000).alias("y"), F.lit(40.0).alias("width"), F.lit(10.0).alias("height"))
    areas = ids.select(F.lit(1).cast("long").alias("doc_id"), F.lit(1).alias("page"), F.col("id").alias("annot_id"), place("ax", 300_000).alias("x0"), place("ay", 300_000).alias("y0"), F.lit("#000000").alias("color"), F.lit(1.0).alias("opacity"), F.lit("SQUARE").alias("annotation_type")).withColumns({"x1": F.col("x0") + 60.0, "y1": F.col("y0") + 30.0})
    own, covering = redaction.item_boxes(items), redaction.area_boxes(areas)
    key = ["level", "cx", "cy"]
    pairs = redaction.in_cells(own, covering).groupBy(key).count().join(redaction.in_cells(covering, own).groupBy(key).agg(F.count("*").alias("m")), key).select((F.col("count") * F.col("m")).alias("n"))
    most = pairs.agg(F.max("n"), F.sum("n")).first()
    assert most[0] < 1000 and most[1] < 10 * n
    x, y, ax, ay = (np.array([r[0] for r in df.select(c).collect()]) for df, c in ((items, "x"), (items, "y"), (areas, "x0"), (areas, "y0")))
    count = sum(int(((ax - (a + 40) <= 2) & (ay - (b + 10) <= 2) & (ax + 60 - a >= 2) & (ay + 30 - b >= 2)).sum()) for a, b in zip(x[:2000], y[:2000]))
    met = redaction.sloppy_redactions(items.where("ord < 2000"), areas)
    assert met.agg(F.sum("n_items")).first()[0] == count > 10
    assert redaction.sloppy_redactions(items, areas).agg(F.sum("n_items")).first()[0] > 20 * count


def test_tree_has_folders_without_entries(spark):
    rows = archive.tree(spark.createDataFrame([(1, "a/b/c.TXT", False), (1, "a/", True)], "doc_id int, path string, is_directory boolean")).collect()
    got = {r["path"]: (r["name"], r["is_directory"], r["extension"]) for r in rows}
    assert got == {"a": ("a", True, None), "a/b": ("b", True, None), "a/b/c.TXT": ("c.TXT", False, "txt")}


JS_SPACE = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def slow_clean(x):
    if isinstance(x, str):
        return x.replace("\x00", "").strip(JS_SPACE)
    return [slow_clean(y) for y in x] if isinstance(x, list) else {k: slow_clean(v) for k, v in x.items()} if isinstance(x, dict) else x


@pytest.mark.parametrize("form", [{"ensure_ascii": False}, {"ensure_ascii": True}, {"indent": 1}])
def test_metadata_is_clean_at_any_depth(spark, form):
    rng = random.Random(2)
    some = [*"ab:,{}[]", '"', "\\", "\x00", "é", "🙂", " ", "\t", "\n", "\u00a0", "\ufeff", '\\"', "\\u0000", "null"]
    string = lambda: "".join(rng.choice(some) for _ in range(rng.randint(0, 9)))

    def value(depth):
        kind = rng.randint(0, 6 if depth < 4 else 3)
        if kind < 4:
            return string() if kind else rng.choice([1, 2.5, True, False, None, -7])
        return [value(depth + 1) for _ in range(rng.randint(0, 4))] if kind == 4 else {string(): value(depth + 1) for _ in range(rng.randint(0, 4))}

    rows = [(k, value(0)) for k in range(600)] + [(600, {"long": '"\\\n ' * 20_000}), (601, "")]
    df = spark.createDataFrame([(k, json.dumps(v, **form)) for k, v in rows] + [(700, None)], "k int, j string")
    got = {r["k"]: r["c"] for r in df.select("k", text.clean_json(F.col("j")).alias("c")).collect()}
    assert got.pop(700) is None and all(json.loads(got[k]) == slow_clean(v) for k, v in rows)
    whole = df.select("k", text.clean_variant(F.parse_json("j")).alias("v")).where("k < 600").collect()
    assert all(r["v"].toPython() == pytest.approx(slow_clean(rows[r["k"]][1])) if isinstance(rows[r["k"]][1], (int, float)) else json.loads(r["v"].toJson()) == slow_clean(rows[r["k"]][1]) for r in whole)


def test_metadata_keeps_kinds_and_dates(spark):
    rows = [('{"info":{"ModDate":"D:2024 ","dates":{"x":"D:2024"},"Pages":3,"Title":"\\u0000 t "},"annotation_links":[]}', {"ModDate": "2024-01-01T00:00:00Z", "dates": {"x": "D:2024"}, "Pages": 3, "Title": "t"}), ('{"info":" no map ","a":[" b "]}', {"info": "no map", "a": ["b"]}), ("{}", {}), ("not json", None), (None, None)]
    got = spark.createDataFrame([(k, j) for k, (j, _) in enumerate(rows)], "k int, j string").select("k", pdf.metadata(F.col("j")).alias("v")).orderBy("k").collect()
    assert [None if r["v"] is None else r["v"].toPython() for r in got] == [w for _, w in rows]


def slow_tree(entries):
    """Nested lists of one archive, by plain recursion."""
    top = {}
    for path, is_dir, info in entries:
        parts, at = [p for p in path.split("/") if p], top
        for k, name in enumerate(parts):
            node = at.setdefault(name, {"dir": False, "files": 0, "info": None, "path": "/".join(parts[: k + 1]), "children": {}})
            last = k == len(parts) - 1
            node["dir"] |= is_dir or not last
            node["files"] += not is_dir
            node["info"] = max(x for x in (node["info"], info if last else None) if x is not None) if last or node["info"] is not None else None
            at = node["children"]

    def listed(at):
        out = []
        for name in sorted(at):
            n = at[name]
            one = {"name": name, "path": n["path"], "is_directory": n["dir"], "n_files": n["files"]}
            if not n["dir"]:
                one["extension"] = name.rsplit(".", 1)[1].lower() if "." in name[1:] else ""
            if n["info"] is not None:
                one["size"] = n["info"]
            out.append(one | ({"children": listed(n["children"])} if n["dir"] else {}))
        return out

    return listed(top)


def test_nested_tree(spark):
    rng = random.Random(8)
    names = ["a", "b.TXT", "č \"q\"", ".hidden", "x\\y", "ę.tar.gz"]
    entries = [(k % 3, "/".join(rng.choice(names) for _ in range(rng.choice([1, 2, 3, 4, 17]))) + rng.choice(["", "", "/"]), rng.random() < 0.2, (rng.randint(0, 9),)) for k in range(150)]
    entries += [(0, "", False, (1,)), (0, "//", False, (1,)), (4, "only/", True, (7,)), (5, "deep/" * 30 + "end", False, (3,)), *[(6, f"many/{k}", False, (k,)) for k in range(3000)]]
    df = spark.createDataFrame(entries, "doc_id int, path string, is_directory boolean, info struct<size:int>").repartition(5)
    got = {r["doc_id"]: json.loads(r["tree"]) for r in archive.nested(archive.tree(df)).collect()}
    want = {}
    for d, path, is_dir, info in entries:
        want.setdefault(d, []).append((path, is_dir, info[0]))
    assert set(got) == set(want) and all(got[d] == slow_tree(v) for d, v in want.items())
    walk = [r["path"] for r in archive.flattened(archive.tree(df)).where("doc_id = 1").orderBy("rank").collect()]

    def walked(nodes):
        return [p for n in nodes for p in [n["path"], *walked(n.get("children", []))]]

    assert walk == walked(got[1])
    assert archive.nested(archive.tree(df.limit(0))).collect() == []


def test_archives_have_their_tree_in_the_result(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a/b/c.txt", b"hello")
        z.writestr("a/", b"")
    got = extract(spark.createDataFrame([(None, "zip", out.getvalue()), (None, "txt", b"x")], "doc_id int, extension string, content binary")).collect()
    trees = [json.loads(r["files_tree"]) if r["files_tree"] else None for r in got]
    top = next(t for t in trees if t)[0]
    assert None in trees and top["name"] == "a" and top["children"][0]["children"][0]["size"] == 5 and top["n_files"] == 1


def test_names():
    assert [decode_name("žąsis.txt".encode(e)) for e in ("utf-8", "cp1257")] == ["žąsis.txt"] * 2


def test_bad_files_are_errors_of_their_rows(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("d/.hidden", b"x")
    rows = [(1, "zip", out.getvalue()), (2, "zip", b"junk"), (3, "rar", b""), (4, "nope", b""), (5, None, b"%PDF nothing"), (6, "txt", b"a\r\nb"), (7, "txt", None), (8, "7z", b"")]
    got = {r["doc_id"]: r for r in files.decoded(files.dispatched(spark.createDataFrame(rows, "doc_id int, extension string, content binary"))).collect()}
    assert got[1]["error"] is None and got[1]["files"][0]["extension"] == "" and got[6]["pages"] == ["a\nb"]
    assert all(got[k]["error"] for k in (2, 3, 4, 5, 7, 8)) and "unsupported extension: nope" == got[4]["error"]


def test_extract_end_to_end(spark):
    rows = [(1, "txt", b"write me@x.lt or http://y.lt/", None), (2, "nope", b"", None)]
    got = {r["doc_id"]: r for r in extract(spark.createDataFrame(rows, "doc_id int, extension string, content binary, alt_pages array<string>")).collect()}
    assert got[1]["success"] and {e["key"] for e in got[1]["entities"]["domain"]} == {"x.lt", "y.lt"} and got[1]["word_count"] == 4
    assert not got[2]["success"] and got[2]["page_count"] == 0


def test_chosen_alternatives_are_collapsed(spark):
    from foliospark.plans import fixtures

    docs = spark.createDataFrame([(1, "%%% ### $$$", "lt", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = fixtures.built(docs, "pdf").withColumn("alt_pages", F.array(F.lit("Gera  diena\n\nvisiems   zmonems  "), F.lit("beyond")))
    got = extract(rows).first()
    assert got["pages"] == ["Gera diena visiems zmonems"] and got["character_count"] == 26 and got["page_count"] == 1


def test_mail_fields_are_searched_but_not_counted(spark):
    raw = b"From: Me <me@a.lt>\r\nTo: You <you@b.lt>\r\nSubject: see http://c.lt/x or +370 612 34567\r\nContent-Type: text/plain\r\n\r\nhello you@b.lt\r\n"
    got = extract(spark.createDataFrame([(1, "eml", raw)], "doc_id int, extension string, content binary")).first()
    keys = {k: [e["key"] for e in v] for k, v in got["entities"].items()}
    assert keys["email"] == ["me@a.lt", "you@b.lt"] and keys["phone"] == ["+37061234567"] and keys["link"] == ["http://c.lt/x"] and keys["domain"] == ["a.lt", "b.lt", "c.lt"]
    assert got["word_count"] == 2 and got["page_count"] == 1


def test_extracted_entities_keep_first_seen_order(spark):
    rows = [(1, "txt", b"z@x.lt http://z.lt/ a@x.lt mailto:m@x.lt z@x.lt", None)]
    got = extract(spark.createDataFrame(rows, "doc_id int, extension string, content binary, alt_pages array<string>")).first()["entities"]
    assert [e["key"] for e in got["email"]] == ["m@x.lt", "z@x.lt", "a@x.lt"] and [e["key"] for e in got["link"]] == ["http://z.lt", "mailto:m@x.lt"] and [e["key"] for e in got["domain"]] == ["x.lt", "z.lt"]


def test_extract_joins_annotations_items_and_reports(spark):
    from foliospark.plans import fixtures

    docs = spark.createDataFrame([(1, "first page\nsecond page", "lt", "s", 9), (2, "alone", "lt", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    area = "struct<page:int,subtype:string,rect:array<double>,color:array<double>,opacity:double,annotationType:int,creationDate:string,annotationFlags:bigint,borderWidth:int>"
    more = spark.createDataFrame(
        [(1, [(2, "Square", [0.0, 0.0, 50.0, 20.0], [0.0], 1.0, 5, "D:2024", 4, 3), (2, "Ink", [0.0, 0.0, 9.0, 9.0], None, None, 15, None, 0, None)], [(2, "secret", 1.0, 1.0, 30.0, 10.0), (1, "open", 1.0, 1.0, 30.0, 10.0)], "Signature #1:\n  - Signing Time: Jan 02 2024 03:04:05\n"), (2, None, None, None)],
        f"doc_id long, annotations array<{area}>, items array<struct<page:int,str:string,x:double,y:double,width:double,height:double>>, signature_report string",
    )
    got = {r["doc_id"]: r for r in extract(fixtures.built(docs, "pdf").join(more, "doc_id")).collect()}
    first, second = got[1]["page_annotations"]
    one = json.loads(second[0])
    assert first is None and one["color"] == "#000000" and one["created"] == "2024-01-01T00:00:00Z" and one["flags"]["Print"] and one["annotationType"] == "SQUARE" and one["borderStyle"] == {"borderWidth": "3px", "borderStyle": "solid"} and one["title"] == ""
    assert json.loads(second[1])["color"] is None and json.loads(second[1])["flags"] is None
    assert got[1]["sloppy_redactions"][0] is None and got[1]["sloppy_redactions"][1]["count"] == 1 and got[1]["sloppy_redactions"][1]["findings"][0]["text"] == "secret"
    assert [s["signature"] for s in got[1]["signatures"]] == [1] and got[2]["signatures"] is None and got[2]["page_annotations"] == [None] and got[2]["sloppy_redactions"] == [None]


def test_requests_without_ids_or_with_equal_ones(spark):
    area = "struct<page:int,subtype:string,rect:array<double>,color:array<double>,opacity:double,annotationType:int>"
    box = lambda c: [(1, "Square", [0.0, 0.0, 50.0, 20.0], [c], 1.0, 5)]
    item = lambda t: [(1, t, 1.0, 1.0, 30.0, 10.0)]
    rows = [
        (None, "a", "txt", b"a@x.lt one", ["zzz"], box(0.0), item("first"), "Signature #1:\n  - Signing Time: Jan 02 2024 03:04:05\n"),
        (None, "b", "txt", b"b@y.lt one two", None, box(0.0), item("second"), None),
        (7, "c", "txt", b"same http://z.lt/", None, None, None, None),
        (7, "c", "txt", b"same http://z.lt/", None, None, None, None),
        (7, "c", "txt", b"other c@z.lt", None, None, None, None),
        (7, None, "txt", b"x", None, None, None, None),
        (None, "", "nope", None, None, None, None, None),
        (None, "e", "nope", None, None, None, None, None),
        (None, "f", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, f"doc_id int, uri string, extension string, content binary, alt_pages array<string>, annotations array<{area}>, items array<struct<page:int,str:string,x:double,y:double,width:double,height:double>>, signature_report string")
    got = extract(df.repartition(4)).collect()
    keys = lambda r: sorted(e["key"] for v in (r["entities"] or {}).values() for e in v)
    by = {(r["doc_id"], r["pages"][0] if r["pages"] else None): r for r in got}
    assert len(got) == len(rows) and sorted((r["doc_id"], r["success"], r["error"]) for r in got if r["doc_id"]) == [(7, False, "missing uri"), (7, True, None), (7, True, None), (7, True, None)]
    assert sorted(r["error"] for r in got if r["doc_id"] is None and not r["success"]) == ["missing uri", "no content", "unsupported extension: nope"]
    first, second = by[None, "a@x.lt one"], by[None, "b@y.lt one two"]
    assert (keys(first), first["word_count"], keys(second), second["word_count"]) == (["a@x.lt", "x.lt"], 2, ["b@y.lt", "y.lt"], 3)
    assert [r["sloppy_redactions"][0]["findings"][0]["text"] for r in (first, second)] == ["first", "second"] and len(first["signatures"]) == 1 and second["signatures"] is None
    assert keys(by[7, "other c@z.lt"]) == ["c@z.lt", "z.lt"] and keys(by[7, "same http://z.lt/"]) == ["http://z.lt", "z.lt"] and by[7, "same http://z.lt/"]["page_count"] == 1
    same = [r["request_key"] for r in got if r["pages"] == ["same http://z.lt/"]]
    assert len(same) == 2 and len(set(same)) == 1 and len({r["request_key"] for r in got}) == len(rows) - 1
    again = extract(df.repartition(2)).select("request_key").collect()
    assert sorted(r["request_key"] for r in got) == sorted(r["request_key"] for r in again)


def test_alternatives_for_other_readers(spark):
    rows = [(1, "txt", b"%%% ### $$$", ["Gera  diena visiems zmonems"])]
    df = spark.createDataFrame(rows, "doc_id int, extension string, content binary, alt_pages array<string>")
    assert [extract(df, a).first()["pages"] for a in (("pdf",), ("plain",), None)] == [["%%% ### $$$"], ["Gera diena visiems zmonems"], ["Gera diena visiems zmonems"]]


def test_rejects_are_written_apart(spark, tmp_path):
    from foliospark.plans.extract import write_results

    write_results(extract(spark.createDataFrame([(1, "txt", b"x"), (2, "nope", b"")], "doc_id int, extension string, content binary")), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/results").count() == 1 and [tuple(r) for r in spark.read.parquet(f"{tmp_path}/rejects").collect()] == [(2, "unsupported extension: nope")]


def test_shared_folder(spark, tmp_path):
    from types import SimpleNamespace

    from foliospark.session import discard, shared_root, work_dir

    def fake(conf, given, master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf), sparkContext=SimpleNamespace(getCheckpointDir=lambda: given, master=master))

    assert shared_root(fake("/a", "file:/b/x", "yarn")) == "file:///a" and shared_root(fake(None, "file:/b/x", "yarn")) == "file:///b/x" and shared_root(fake("hdfs://n/c", None, "yarn")) == "hdfs://n/c"
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:7077"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_root(fake(None, None, master))
    path = work_dir(spark, "t")
    spark.range(3).write.parquet(path)
    discard(path)
    discard(path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_measures_of_odd_texts(spark):
    """Letters and digits beyond the Basic Multilingual Plane, dashes, capitals and digits in all places of words."""
    texts = ["𝐀𝐁 𝟏𝟐x", "a1b a12b a1 1a 1a1 a1b2 12a a123b a-1b x–1y", "aB Ab ABC aBc AbC aBcD ąČę", "", " \n", "x" * 21 + " " + "y" * 20, "ab 1 c"]
    df = quality.with_measures(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "t", "m")
    got = {r["k"]: r for r in df.collect()}
    for k, t in enumerate(texts):
        units = lambda w: sum(2 if ord(c) > 0xFFFF else 1 for c in w)
        words = [w for w in "".join(c if c.isalnum() else " " for c in t).split(" ") if w]
        dashed = [w for w in "".join(c if c.isalnum() or c in "-–—" else " " for c in t).split(" ") if w]
        n = max(1, len(words))
        caps = [w for w in words if units(w) > 2 and any(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZĄČĘĖĮŠŲŪŽ" for c in w[1:-1])]
        digits = [w for w in dashed if units(w) > 2 and not set(w) & set("-–—") and sum(c in "0123456789" for c in w) < 3 and any(c in "0123456789" for c in w[1:-1])]
        long = lambda ws: sum(units(w) > 2 for w in ws)
        want = {"word_length": sum(map(units, words)) / n, "long_words": sum(units(w) > 20 for w in words) / n, "short_words": (n - sum(units(w) > 3 for w in words)) / n, "single_letters": sum(units(w) == 1 for w in words) / n}
        want |= {"inner_capitals": len(caps) / long(words) * 100 if long(words) else None, "inner_digits": len(digits) / long(dashed) * 100 if long(dashed) else None}
        for c, v in want.items():
            assert got[k][f"m_{c}"] == (None if v is None else pytest.approx(v)), (t, c)


def test_quality_looks_at_each_text_once(spark):
    """The criteria share one pass over a text and no pattern is tried on it, in SQL too, where scores and their total stand side by side."""
    sql.register(spark)
    df = spark.createDataFrame([(1, "Gera diena visiems"), (2, None)], "k int, text string")
    by_sql = spark.sql("SELECT k, quality_scores(text) AS s, quality_total(text) AS t FROM {df}", df=df)
    for out in (by_sql, quality.with_total(df, "text", "t")):
        said = plan(out).split("== Physical Plan ==")[1]
        assert said.count("ArrowEvalPython") == 1 and said.count("text_counts(") == 1 and "regexp" not in said and "RLIKE" not in said
    own = quality.Criterion(measure="{lower}", score="{m}", weight=0.0, counts={"lower": "CAST(regexp_count({dashed}, '[a-z]') AS DOUBLE)"})
    sql.register(spark, quality.CRITERIA | {"lower": own})
    assert [r[0] for r in spark.sql("SELECT quality_scores(text).lower FROM {df} ORDER BY k", df=df).collect()] == [15.0, None]
    sql.register(spark)


def test_counts_of_long_texts_and_batches(spark, monkeypatch):
    """Texts that are parted at spaces, share a piece, are empty or null, or are no UTF-8, as whole texts one by one."""
    import pyarrow as pa
    from foliospark.functions import counting

    texts = ["aB1c Žą-x! " * 50, "", None, "x" * 400, " a1b", "-c d1e𝐀 \n@", "ė" * 90 + " 1a1b" * 40, None, "end"]
    one = lambda t: counting.text_counts.func(pa.array([t], pa.string())).to_pylist()[0]
    alone = [one(t) for t in texts]
    assert (alone[0]["count"], alone[0]["inner"], alone[0]["digits"], alone[0]["dashed2"], alone[0]["marks"], alone[1]["count"], alone[1]["filled"]) == (150, 50, 50, 100, 50, 1, 0)
    for piece in (1, 16, 64, 1 << 18):
        monkeypatch.setattr(counting, "PIECE", piece)
        for kind in (pa.string(), pa.large_string()):
            assert counting.text_counts.func(pa.array(texts, kind)).to_pylist() == alone
            assert counting.text_counts.func(pa.array(["before", *texts, "after"], kind)[1:-1]).to_pylist() == alone
    monkeypatch.undo()
    odd = spark.sql("SELECT CAST(unhex(h) AS STRING) AS t FROM VALUES ('61FF6220C42E'), ('6162') v(h)")
    assert sorted((r["c"]["count"], r["c"]["marks"], r["c"]["size"]) for r in odd.select(counting.text_counts("t").alias("c")).collect()) == [(1, 0, 2), (2, 1, 6)]


def test_words_between_all_kinds_of_white_space(spark):
    texts = ["", " ", "a", " a", "a ", "a\u0085", "a \u0085", "\ufeffa\u2003b\u3000", "a\n\nb \u180e c", "ą\u00a0č\u1680ę", "a\x0bb\x0cc\x1cd", "😀 😀"]
    white = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = {r["t"]: (r["n"], r["c"]) for r in df.select("t", text.word_count(F.col("t")).alias("n"), text.collapse(F.col("t")).alias("c")).collect()}
    words = {t: "".join(" " if c in white else c for c in t).split(" ") for t in texts}
    assert {t: n for t, (n, _) in got.items()} == {t: sum(w != "" for w in ws) for t, ws in words.items()} | {None: None}
    assert all(got[t][1] == " ".join(w for w in ws if w) for t, ws in words.items() if "\u0085" not in t) and got[None][1] is None


def pdf_of(*shown):
    stream = zlib.compress(b"BT\n" + b"\n".join(shown) + b"\nET")
    return b"%PDF-1.7\n1 0 obj\n<< /Type /Page /Contents 2 0 R >>\nendobj\n2 0 obj\n<< /Filter /FlateDecode /Length " + str(len(stream)).encode() + b" >>\nstream\n" + stream + b"\nendstream\nendobj\n"


@pytest.mark.parametrize(
    "shown, page",
    [
        ([b"<feff00410042> Tj", b"<FEFF0043>'"], "AB C"), ([b"<feffd83d> Tj", b"<feffde00> Tj"], "\ufffd \ufffd"), ([b"<feffd83dde00> Tj"], "😀"), ([b"<feff> Tj"], ""), ([], ""),
        ([b"<feff0041> Tj", b"(b\\)c) Tj"], "A b)c"), ([b"<feff 0041> Tj", b"<feff004> Tj"], "A @"), ([b"<feff0041> Tj", b"[<feff0042> -3 (c)] TJ"], "A Bc"), ([b"<41> Tj", b"<feff0041> Tj"], "A A"), ([b"<feff0041> Td", b"<feff0042> Tj"], "B"),
    ],
)
def test_strings_of_pdf_pages(shown, page, monkeypatch):
    """Streams of marked strings only are decoded at once, others string by string: the text is the same."""
    assert formats.read("pdf", pdf_of(*shown))[0] == [page]
    monkeypatch.setattr(formats, "_marked_text", lambda data: None)
    assert formats.read("pdf", pdf_of(*shown))[0] == [page]


def test_marked_strings_are_not_taken_one_by_one(monkeypatch):
    monkeypatch.setattr(formats, "_pdf_string", None)
    assert formats.read("pdf", pdf_of(*[b"<feff0041> Tj"] * 1000))[0] == [" ".join("A" * 1000)]


def test_pages_are_chosen_without_a_join(spark):
    """Alternatives meet their pages in the row of their request: neither a join nor a shuffle, and pages without one are not scored."""
    from foliospark.operators import compare
    from foliospark.plans import extract as plans

    rows = [
        (1, "pdf", ["%%% ###", "second  page", ""], "{}", [], None, ["Gera  diena visiems zmonems", None, "Gera  diena", "beyond"]),
        (2, "plain", ["%%% ###"], "{}", [], None, ["Gera diena visiems zmonems"]),
        (3, "pdf", [], "{}", [], None, ["Gera diena visiems zmonems"]),
        (4, "pdf", ["same", "x"], "{}", [], None, None),
        (5, "nope", [], "{}", [], "unsupported", ["a"]),
    ]
    df = spark.createDataFrame(rows, "doc_id long, reader string, pages array<string>, metadata string, files array<string>, error string, alt_pages array<string>")
    out = plans.page_and_request_rows(df, ("pdf",))
    said = plan(out)
    assert "Join" not in said and "Exchange" not in said
    got = sorted((r["doc_id"], r["page"], r["text"], r["request"] and r["request"]["reader"]) for r in out.collect())
    assert got == [(1, 1, "Gera diena visiems zmonems", "pdf"), (1, 2, "second  page", None), (1, 3, "Gera diena", None), (2, 1, "%%% ###", "plain"), (3, None, None, "pdf"), (4, 1, "same", "pdf"), (4, 2, "x", None), (5, None, None, "nope")]
    good = df.where("error is null")
    by_join = compare.with_alternatives(pages.page_rows(good, F.col("pages")), pages.page_rows(good.where("reader = 'pdf'"), F.col("alt_pages")), collapsed=True)
    assert sorted(map(tuple, by_join.collect())) == [r[:3] for r in got if r[1]]
    assert sorted(r["page"] for r in plans.page_and_request_rows(df.drop("alt_pages"), None).where("page is not null").collect()) == [1, 1, 1, 2, 2, 3]


def test_stream_extracts_new_files_once(spark, tmp_path):
    out = str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.txt").write_text(f"a{k}@x.lt")
        incremental.extract_stream(incremental.arriving(spark, str(tmp_path / "in")), out, str(tmp_path / "ck")).awaitTermination(120)
    assert incremental.results(spark, out).count() == 2 and incremental.rejects(spark, out).count() == 0 and [r["number"] for r in incremental.commits(spark, out).orderBy("number").collect()] == [1, 2]


@pytest.mark.parametrize("where", ["results/", "rejects/", "seen/"])
def test_stream_that_stops_between_its_writes(spark, tmp_path, monkeypatch, where):
    """Nothing of a batch is seen before all of it is; the next start runs it again."""
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "first.txt").write_text("a@x.lt")
    run = lambda: incremental.extract_stream(incremental.arriving(spark, str(tmp_path / "in")), out, ck).awaitTermination(120)
    run()
    (tmp_path / "in" / "good.txt").write_text("b@x.lt")
    (tmp_path / "in" / "bad.nope").write_text("c")
    put = incremental.put

    def stopping(df, path):
        if f"/{where}" in path:
            raise RuntimeError("stopped here")
        put(df, path)

    monkeypatch.setattr(incremental, "put", stopping)
    with pytest.raises(Exception, match="stopped here"):
        run()
    counts = lambda: (incremental.results(spark, out).count(), incremental.rejects(spark, out).count())
    assert counts() == (1, 0)
    monkeypatch.setattr(incremental, "put", put)
    run()
    assert counts() == (2, 1) and incremental.rejects(spark, out).first()["error"] == "unsupported extension: nope"
    incremental.commit(incremental.as_requests(spark.read.format("binaryFile").load(str(tmp_path / "in"))), out, "stream-000000001")  # committed, but the checkpoint was lost
    assert counts() == (2, 1)


def test_files_that_change(spark, tmp_path):
    """A file that is written over counts with its new content, one that is only touched is not extracted again, one that turns bad leaves the results."""
    out, one, two = str(tmp_path / "out"), tmp_path / "in" / "one.txt", tmp_path / "in" / "two.txt"
    one.parent.mkdir()
    one.write_text("a@x.lt")
    two.write_text("b@x.lt")
    scan = lambda: incremental.extract_changes(spark, str(one.parent), out)
    keys = lambda: sorted(e["key"] for r in incremental.results(spark, out).collect() for e in r["entities"]["email"])
    assert incremental.results(spark, out) is None and scan() == 1 and keys() == ["a@x.lt", "b@x.lt"] and scan() == 0
    one.write_text("changed@x.lt")
    os.utime(two, (1, 1))
    assert scan() == 2 and keys() == ["b@x.lt", "changed@x.lt"] and incremental.committed(spark, out, "results").count() == 3
    incremental.extract_stream(incremental.arriving(spark, str(one.parent)), out, str(tmp_path / "ck")).awaitTermination(120)
    assert incremental.commits(spark, out).count() == 2 and keys() == ["b@x.lt", "changed@x.lt"]
    one.rename(one.with_suffix(".zip"))
    assert scan() == 3 and incremental.rejects(spark, out).count() == 1
    one.with_suffix(".zip").write_bytes(zipped())
    assert scan() == 4 and incremental.rejects(spark, out).count() == 0 and incremental.results(spark, out).count() == 3


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", b"x")
    return out.getvalue()


def test_read_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("x")
    assert [(r["extension"], bytes(r["content"])) for r in files.read_files(spark, str(tmp_path)).collect()] == [("txt", b"x")]


def test_read_files_has_large_ones(spark, tmp_path):
    with open(tmp_path / "large.txt", "wb") as f:
        f.truncate((50 << 20) + 1)
    (tmp_path / "small.txt").write_text("x")
    sizes = lambda df: sorted(r[0] for r in df.select(F.length("content")).collect())
    assert sizes(files.read_files(spark, str(tmp_path))) == [1, (50 << 20) + 1]
    assert sizes(files.read_files(spark, str(tmp_path), most_bytes=1000)) == [1]


def workbook(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in parts.items():
            z.writestr("xl/" + name.replace("__", "/").replace("_x", ".x").replace("_bin", ".bin"), content)
    return out.getvalue()


def test_what_would_be_read_wrong_is_an_error():
    """Workbooks with other cells than shared strings, binary ones, PDF pages out of order and text in composite fonts."""
    shared = "<sst xmlns='x'><si><t>one</t></si></sst>"
    sheet = lambda c: f"<worksheet xmlns='x'><sheetData><row>{c}</row></sheetData></worksheet>"
    assert read("office", workbook(sharedStrings_xml=shared, worksheets__sheet1_xml=sheet("<c t='s'><v>0</v></c><c r='B1'/>")))[0] == ["one"]
    for c in ("<c><v>7</v></c>", "<c t='inlineStr'><is><t>x</t></is></c>", "<c t='str'><f>A1</f><v>x</v></c>"):
        assert read("office", workbook(sharedStrings_xml=shared, worksheets__sheet1_xml=sheet(c)))[3] == "unsupported: workbook with cells that are no shared strings"
    assert read("office", workbook(workbook_bin=b"x"))[3] == "unsupported: binary workbook"

    def made(kids, font=b"", shown=(b"(first)", b"(second)")):
        page = lambda n, k: b"%d 0 obj << /Type /Page /Parent 2 0 R /Contents %d 0 R >> endobj\n" % (n, n + 2) + b"%d 0 obj << /Length %d >>\nstream\nBT %s Tj ET\nendstream endobj\n" % (n + 2, len(shown[k]) + 9, shown[k])
        return b"%PDF-1.7\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages " + kids + b" >> endobj\n" + page(3, 0) + page(4, 1) + font + b"trailer << /Root 1 0 R >>"

    type0 = b"9 0 obj << /Type /Font /Subtype /Type0 /Encoding /Identity-H >> endobj\n"
    assert read("pdf", made(b"/Kids [3 0 R 4 0 R]"))[0] == ["first", "second"] == read("pdf", made(b""))[0]
    assert read("pdf", made(b"/Kids [4 0 R 3 0 R]"))[3] == "unsupported: PDF pages that stand in another order in the file"
    assert read("pdf", made(b"", type0))[3] == "unsupported: PDF text in composite fonts"
    assert read("pdf", made(b"", type0, (b"<FEFF0061>", b"<feff0062>")))[0] == ["a", "b"]


def test_office_defaults():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("docProps/custom.xml", '<Properties xmlns="p" xmlns:vt="v"><property name="Case"><vt:lpwstr>7</vt:lpwstr></property></Properties>')
    meta = json.loads(read("office", out.getvalue())[1])
    assert meta["Case"] == "7" and meta["Title"] == "" and meta["wordCount"] == 0 and meta["Author"] == ""


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    own = catalogue.QUERIES[name](spark, SF)
    cols = sorted(own.columns)
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    left = sorted(tuple(plain(r[c]) for c in cols) for r in own.collect())
    right = sorted(tuple(map(plain, r)) for r in con.execute(f"SELECT {', '.join(f'"{c}"' for c in cols)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall())
    assert left == right
