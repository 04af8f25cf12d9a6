"""Licence families of paragraphs, with DataFrame and SQL functions and the DataFrame-based machine learning library only.

A paragraph, for this purpose, is a stretch of words, across line ends, that holds 5-grams of one family's templates, at most GAP words apart, and
CONTEXT words on either side. A multinomial logistic regression on its hashed words and pairs of words says which family it states, or that
it is "unknown": it mentions a licence, denies it, or is about something else. A temperature, fitted on rows kept back, calibrates the
probabilities. A prediction counts if it names the family whose templates gave the stretch, with a probability of AT_LEAST, and the stretch
holds CONFIRM of the 5-grams of one of these templates (of a shorter template, all of it). So the comparison alone cannot tell apart
versions and kin of one licence, whose long notices share more than CONFIRM of their 5-grams, nor a denial from a statement; the classifier does.

The regression is trained on variants of the templates (a word left out, cut short, corpus text beside them), on sentences that speak of licences
without stating one, and on a bounded sample of the corpus as unknown. Text that holds no 5-gram of any template could not be confirmed
whatever the prediction, and is passed over after a search for words that every confirmed stretch must have.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import written

#: Sentences by which licences are stated (fixed values).
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Available under the MIT licence.",
        "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "either version 3 of the License, or (at your option) any later version",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "either version 2 of the License, or (at your option) any later version",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "agpl-3.0": [
        "This program is licensed under the GNU Affero General Public License.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD License.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    ],
    "epl-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": [
        "This work is dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "proprietary": ["All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited."],
}
#: Short names of the families' licences in the SPDX list (fixed values); each is stated by a line of its own.
SPDX = {
    "apache-2.0": ["Apache-2.0"],
    "mit": ["MIT"],
    "isc": ["ISC"],
    "gpl-3.0": ["GPL-3.0"],
    "gpl-2.0": ["GPL-2.0"],
    "lgpl": ["LGPL-2.1", "LGPL-3.0"],
    "agpl-3.0": ["AGPL-3.0"],
    "bsd": ["BSD-3-Clause", "BSD-2-Clause"],
    "mpl-2.0": ["MPL-2.0"],
    "epl-2.0": ["EPL-2.0"],
    "unlicense": ["Unlicense"],
    "cc-by": ["CC-BY-4.0"],
    "cc-by-sa": ["CC-BY-SA-4.0"],
    "cc-by-nc": ["CC-BY-NC-4.0"],
    "cc0": ["CC0-1.0"],
    "boost": ["BSL-1.0"],
}
for _family, _names in SPDX.items():
    TEMPLATES[_family] += [f"SPDX-License-Identifier: {x}" for x in _names]
#: Sentences that speak of licences without stating one (fixed values): unknown.
OTHERS = [
    "The driver must carry a valid license at all times.",
    "The committee discussed license fees and public rights.",
    "A general version of the work was released under pressure.",
    "Version 2 of the file is free of charge.",
    "The license plate was reserved for the director.",
    "The text is not licensed under CC BY 4.0.",
    "The library was never released under the MIT License.",
    "The library is no longer released under the BSD License.",
    "It is not true that this work is licensed under a Creative Commons Attribution 4.0 International License.",
    "The code was not licensed under the Apache License, Version 2.0.",
    "The author denies that this project is licensed under the MIT License.",
    "Ask why this work is not licensed under the GNU General Public License, version 3.",
    "The court held that not all rights reserved to the states were lost.",
    "The states have all rights reserved to them by the constitution.",
    "A lawyer explains what licensed under the Apache License, Version 2.0 means.",
    "What does it mean when it says released under the MIT License?",
    "Choose whether your code should be released under the MIT License or the BSD License.",
    "He asks if it could be licensed under CC BY-SA 4.0 or CC BY-NC 4.0.",
    "Never write that it is released under the BSD License.",
    "No part of this work is licensed under the GNU General Public License, version 2.",
]
#: What may stand before a statement without changing it (fixed values).
LEADS = ["note that", "it is", "this was", "the work is", "the text is", "the library is", "the code was", "they say that it is", "what is said on it", "a library", "the author", "and to the"]
#: What takes a statement back, before and behind it (fixed values): with these it is unknown.
DENIED = ["it is not true that it is", "it is not", "this was never", "you cannot assume it is", "it is neither", "neither it nor its parts are", "it is no longer", "until last year it was", "until 1999 it was", "before the change it was", "nobody said that it is", "they wrongly claim it is", "do not say that it is", "we doubt that it is", "it would be false to say", "we would never say", "if only it were", "it used to be", "unlike the other it is not"]
TAKEN_BACK = ["only in jest", "is a joke", "is wrong", "is not true", "but no more", "until last year", "is what they wrongly say", "they falsely claim", "in your dreams", "is no longer true"]
FAMILIES = ["unknown", *TEMPLATES]
DIM, SHINGLE, CONFIRM, AT_LEAST = 1 << 12, 5, 0.8, 0.5
#: Words between two 5-grams of one stretch, at most, and words beside a stretch that the classifier sees.
GAP, CONTEXT = 12, 4
#: Documents whose stretches are the sample of unknown ones, about, and stretches of it at most; words of one; stretches that lend the
#: words beside templates.
SAMPLE_DOCS, SAMPLE_ROWS, SAMPLE_WORDS, FRAMES = 1000, 1500, 24, 40


def words(column: str) -> str:
    """SQL for the lower-case words of a text: runs of letters and digits."""
    return f"filter(split(lower({column}), '[^\\\\p{{L}}\\\\p{{N}}]+'), w -> w <> '')"


def template_words(text: str) -> list[str]:
    """The same for a template, which is plain ASCII."""
    return re.findall("[a-z0-9]+", text.lower())


def grams(own: list[str], size: int = SHINGLE) -> list[str]:
    return [" ".join(own[k : k + size]) for k in range(max(1, len(own) - size + 1))]


#: For each family its templates as lists of distinct 5-grams (of a shorter template, one of all its words).
SHINGLES = {f: [list(dict.fromkeys(grams(template_words(t)))) for t in ts] for f, ts in TEMPLATES.items()}
#: Sizes of the shingles: SHINGLE and the lengths of shorter templates.
SIZES = sorted({len(g.split()) for ts in SHINGLES.values() for t in ts for g in t}, reverse=True)


def needed() -> list[str]:
    """Words of which every text that holds CONFIRM of a template has one: for each template the longest ones, until the 5-grams that have one are
    more than it may lack."""
    out: set[str] = set()
    for t in (t for ts in SHINGLES.values() for t in ts):
        mine, lost = sorted({w for g in t for w in g.split()}, key=lambda w: (w not in out, -len(w), w)), set()
        for w in mine:
            if len(t) - len(lost) < CONFIRM * len(t):
                break
            lost |= {g for g in t if w in g.split()}
            out.add(w)
    return sorted(out)


def literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def once(c: Column) -> Column:
    """A generator of one row: the value is computed once, not anew wherever a filter further up uses it."""
    return F.explode(F.array(c))


def shingled(column: str, size: int) -> str:
    """SQL for the word n-grams that begin at each word; those at the end are shorter."""
    parts = ", ".join(f"get({column}, i + {k})" for k in range(size))
    return f"if(size({column}) = 0, cast(array() as array<string>), transform(sequence(0, size({column}) - 1), i -> concat_ws(' ', {parts})))"


def stretches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, label, core, words): for each family the stretches that hold 5-grams of its templates, without and with the words beside them."""
    text = F.col(f"`{text_col}`")
    low = docs.where(text != "").select(F.col(f"`{id_col}`").alias("doc_id"), once(F.lower(text)).alias("low"))
    some = low.where(reduce(or_, [F.contains("low", F.lit(w)) for w in needed()])).select("doc_id", once(F.expr(words("low"))).alias("own"))
    every = literals(sorted({g for ts in SHINGLES.values() for t in ts for g in t}))
    cut = some.select("doc_id", "own", *[F.expr(shingled("own", n)).alias(f"g{n}") for n in SIZES])
    found = cut.select("*", once(F.array_intersect(F.concat(*[F.col(f"g{n}") for n in SIZES]), every)).alias("found")).where(F.size("found") > 0)
    families = F.array(*[F.struct(F.lit(FAMILIES.index(f)).alias("label"), literals(sorted({g for t in ts for g in t})).alias("grams")) for f, ts in SHINGLES.items()])
    mine = found.select("*", F.explode(families).alias("f")).select("doc_id", "own", *[f"g{n}" for n in SIZES], "f.label", once(F.array_intersect("found", "f.grams")).alias("hits")).where(F.size("hits") > 0)
    is_hit = " or ".join(f"array_contains(hits, get(g{n}, i))" for n in SIZES)
    at = mine.select("doc_id", "own", "label", once(F.expr(f"filter(sequence(0, size(own) - 1), i -> {is_hit})")).alias("at"))
    edges = f"zip_with(filter(at, (p, k) -> k = 0 or p - get(at, k - 1) > {GAP}), filter(at, (p, k) -> k = size(at) - 1 or get(at, k + 1) - p > {GAP}), (a, b) -> named_struct('a', a, 'b', b))"
    each = at.select("doc_id", "own", "label", F.explode(F.expr(edges)).alias("s"))
    wide = f"greatest(0, s.a - {CONTEXT})"
    return each.select("doc_id", "label", F.expr(f"slice(own, s.a + 1, s.b - s.a + {SHINGLE})").alias("core"), F.expr(f"slice(own, {wide} + 1, s.b + {SHINGLE + CONTEXT} - {wide})").alias("words"))


def holds(label: Column, core: str) -> Column:
    """Whether a stretch of words (the name of its column) holds CONFIRM of a template of the family."""
    own = F.concat(*[F.expr(shingled(core, n)) for n in SIZES])
    listed = F.array(*[F.struct(F.lit(FAMILIES.index(f)).alias("label"), literals(t).alias("grams")) for f, ts in SHINGLES.items() for t in ts])
    return F.exists(listed, lambda t: (t["label"] == label) & (F.size(F.array_intersect(t["grams"], own)) >= F.lit(CONFIRM) * F.size(t["grams"])))


def vectors(rows: DataFrame) -> DataFrame:
    """rows (with an array `words`) with a column `features`."""
    pairs = NGram(n=2, inputCol="words", outputCol="pairs").transform(rows).withColumn("terms", F.concat("words", "pairs"))
    counted = HashingTF(numFeatures=DIM, binary=True, inputCol="terms", outputCol="counts").transform(pairs)
    return Normalizer(inputCol="counts", outputCol="features").transform(counted).drop("pairs", "terms", "counts")


def sentences(spark: SparkSession, rows: list[tuple[int, str]]) -> DataFrame:
    """(label, own) of sentences given as literals: one inline table."""
    quoted = lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({label}, {quoted(t)})" for label, t in rows) + " AS t(label, text)").select("label", F.expr(words("text")).alias("own"))


def sampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(words, h): at most SAMPLE_ROWS stretches of SAMPLE_WORDS words from about SAMPLE_DOCS documents, chosen by the hash of id and text, that
    share no 5-gram with a template. The count of documents sets the share that is looked at."""
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    share = min(1.0, SAMPLE_DOCS / max(1, rows.count()))
    picked = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("doc_id", F.expr(words("coalesce(text, '')")).alias("own")).where("size(own) > 0")
    cut = picked.select("doc_id", F.posexplode(F.expr(f"transform(sequence(0, (size(own) - 1) div {SAMPLE_WORDS}), k -> slice(own, k * {SAMPLE_WORDS} + 1, {SAMPLE_WORDS}))")).alias("part", "words"))
    every = literals(sorted({g for ts in SHINGLES.values() for t in ts for g in t}))
    own = F.concat(*[F.expr(shingled("words", n)) for n in SIZES])
    return cut.withColumn("h", F.xxhash64("doc_id", "part", "words")).where(~F.arrays_overlap(own, every)).orderBy("h").limit(SAMPLE_ROWS).select("words", "h")


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(label, words): variants of templates and of sentences about licences, and the sample of the corpus as unknown."""
    spark = docs.sparkSession
    unknown = written(sampled(docs, id_col, text_col), "unknown")
    few = [r["words"] for r in unknown.orderBy("h").limit(FRAMES).collect()] or [["the"]]
    beside = F.array(*[literals(w[: 2 * CONTEXT]) for w in few])
    own = sentences(spark, [(FAMILIES.index(f), t) for f, ts in TEMPLATES.items() for t in ts] + [(0, t) for t in OTHERS])
    whole = own.select("label", "own", F.explode(F.expr("sequence(1, 6)")).alias("k")).select("label", F.col("own").alias("words"))
    lacking = own.select("label", "own", F.explode(F.expr("sequence(1, least(size(own), 12))")).alias("k")).select("label", F.expr("concat(slice(own, 1, k - 1), slice(own, k + 1, size(own)))").alias("words"))
    short = own.where("size(own) > 12").select("label", F.explode(F.expr("array(slice(own, 1, size(own) * 9 div 10), slice(own, size(own) div 10 + 1, size(own)))")).alias("words"))
    form = f"element_at(array(concat(slice(o, 1, {CONTEXT}), own), concat(own, slice(o, 1, {CONTEXT})), concat(slice(o, 1, {CONTEXT}), own, slice(o, {CONTEXT + 1}, {CONTEXT}))), k % 3 + 1)"
    framed = own.select("label", "own", F.posexplode(beside).alias("k", "o")).select("label", F.expr(form).alias("words"))
    led = own.where("label > 0").select("label", "own", F.explode(F.array(*[literals(x.split()) for x in LEADS])).alias("o")).select("label", F.concat("o", "own").alias("words"))
    brief = own.where("label > 0 and size(own) <= 16").select("own", F.explode(F.expr("sequence(1, 2)")).alias("k")).select("own")
    before = brief.select("own", F.explode(F.array(*[literals(x.split()) for x in DENIED])).alias("o")).select(F.lit(0).alias("label"), F.concat("o", "own").alias("words"))
    denied = before.unionByName(brief.select("own", F.explode(F.array(*[literals(x.split()) for x in TAKEN_BACK])).alias("o")).select(F.lit(0).alias("label"), F.concat("own", "o").alias("words")))
    rows = reduce(DataFrame.unionByName, [whole, lacking, short, framed, led, denied])
    return rows.unionByName(unknown.select(F.lit(0).alias("label"), "words"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """The classifier and its temperature. Training rows are bounded by the number of templates and SAMPLE_ROWS."""
    rows = written(vectors(training_rows(docs, id_col, text_col)).withColumn("back", F.pmod(F.xxhash64("words"), F.lit(4)) == 0).coalesce(4), "training")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # one row for each family
    weight = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, (sum(counts.values()) / n) ** 0.5)])[F.col("label")]
    weighted = rows.withColumn("weight", weight).coalesce(2)  # a few thousand short rows, read once for each iteration
    model = LogisticRegression(family="multinomial", weightCol="weight", regParam=2e-4, maxIter=25, standardization=False).fit(weighted.where("not back"))
    tried = model.transform(weighted.where("back")).select("label", "weight", vector_to_array("rawPrediction").alias("raw"), F.explode(F.array(*[F.lit(x) for x in (0.4, 0.6, 0.8, 1.0, 1.25, 1.6, 2.0, 2.5, 3.2)])).alias("t"))
    loss = tried.groupBy("t").agg(F.sum(F.expr("weight * (ln(aggregate(raw, 0D, (acc, x) -> acc + exp((x - array_max(raw)) / t))) - (element_at(raw, label + 1) - array_max(raw)) / t)")).alias("loss")).orderBy("loss", "t").first()
    return model, float(loss["t"]) if loss else 1.0


def classified(docs: DataFrame, model, temperature: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, family, predicted, probability, held, confirmed) for each stretch: the family whose templates gave it, the one that the classifier
    names and its probability, whether a template is held, and whether both agree."""
    rows = model.transform(vectors(stretches(docs, id_col, text_col))).select("doc_id", "label", "core", F.col("prediction").cast("int").alias("predicted"), vector_to_array("rawPrediction").alias("raw"))
    rows = rows.withColumn("probability", F.expr(f"1D / aggregate(raw, 0D, (acc, x) -> acc + exp((x - array_max(raw)) / {temperature}D))"))
    rows = rows.select("*", once(holds(F.col("label"), "core")).alias("held"))
    name = lambda c: F.element_at(literals(FAMILIES), F.col(c) + 1)
    confirmed = F.col("held") & (F.col("predicted") == F.col("label")) & (F.col("probability") >= AT_LEAST)
    return rows.select("doc_id", name("label").alias("family"), name("predicted").alias("predicted"), "probability", "held", confirmed.alias("confirmed"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, family, families, n_paragraphs, n_confirmed, probability) for each distinct id: the confirmed family of the highest probability,
    "unknown" where there is none; all confirmed families; the number of lines, and of confirmed stretches.

    Null and empty texts are unknown, with no confirmed stretch; null has no line. Rows that share an id count as one document. An empty table
    gives an empty result.
    """
    model, temperature = fit(docs, id_col, text_col)
    text = F.col(f"`{text_col}`")
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    every = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(lines, F.lit(0)).cast("long").alias("lines"), F.lit(None).cast("struct<probability:double,family:string>").alias("hit"))
    hits = classified(docs, model, temperature, id_col, text_col).where("confirmed").select("doc_id", F.lit(0).cast("long").alias("lines"), F.struct("probability", "family").alias("hit"))
    out = every.unionByName(hits).groupBy("doc_id").agg(F.max("hit").alias("best"), F.array_sort(F.collect_set("hit.family")).alias("found"), F.sum("lines").alias("n_paragraphs"), F.count("hit").alias("n_confirmed"))
    return out.select("doc_id", F.coalesce("best.family", F.lit("unknown")).alias("family"), F.array_join("found", ",").alias("families"), "n_paragraphs", "n_confirmed", F.coalesce("best.probability", F.lit(0.0)).alias("probability"))
