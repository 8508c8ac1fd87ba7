"""Licence scans: a trained paragraph classifier, DataFrame operations only.

Paragraphs are the lines of a text, and its blocks of two or more lines up to a blank one (a
notice may be wrapped); their features are the words and word pairs
present (lower case, runs of a-z and 0-9). A sparse multinomial logistic
regression (L1) tells licence families from ``unknown``. It is trained on

* the family templates below, each in ``VARIANTS`` variants with words dropped or the
  ends cut (those that lose a deciding pair are left out), and
* ``unknown`` paragraphs: a sample of the corpus (``SAMPLE_PARAGRAPHS`` in expectation)
  without a template's word pairs, the same with a few template words put in
  front (near misses), and single template words.

Probabilities are calibrated by one temperature, chosen on a held-out fold by
log loss; a family is predicted only where its calibrated probability reaches
``ACCEPT``, all else is ``unknown``. Each prediction is then compared with the
family's templates: the share of the best template's word pairs that the paragraph
has. It is ``confirmed`` by a template of which it has ``CONFIRM`` of the pairs and every
deciding one (:func:`deciding_pairs`: pairs with a number, and those that set the template apart
from a similar one of another family), unless the paragraph says that something is not
licensed, released or granted (``DENIED``). A block also has every family of which it holds a
whole template. A block gives way to a confirmed line of its family inside it (and an
unconfirmed one to anything confirmed inside it); unconfirmed lines of a block's family, and
those of any family with a similarity below ``PIECE`` inside a confirmed block, are parts of
its notice and not reported again.

Scoring all paragraphs stays cheap and exact: a family can win only with a positive
margin over ``unknown``; common words whose terms cannot lift any family that far, all
together, are left out, and a paragraph without any of the other words
(:func:`gate_words`) is ``unknown`` and is not exploded. The weights (bounded by ``VOCABULARY`` terms)
are the only broadcast table.

Cases: null and empty texts have no paragraph; repeated rows get equal results;
null ids are matched as null; an empty table gives an empty result (and is
not trained on); extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.sources.staging import stage

# Families and wordings of public licence notices.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
            "and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
                   "except in compliance with the License."),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                "GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the "
                "GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the "
                 "GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                 "GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 "
                        "International License."),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("proprietary", "All rights reserved. No part of this work may be reproduced or distributed without prior written permission."),
)
UNKNOWN = "unknown"
VARIANTS = 40
SAMPLE_PARAGRAPHS = 2_000
VOCABULARY = 4_096
ACCEPT = 0.5
CONFIRM = 0.8
ALIKE = 0.5                  # a template with this share of its pairs in one of another family must show the rest
DENIED = (r"(?i)\b(?:not|never|no longer|cannot|[a-z]+n['’]t)\s+(?:[a-z]+\s+)?"
          r"(?:licen[sc]ed|released|distributed|redistribute|granted|permitted|subject|covered|available|under)\b")
PIECE = 0.5                  # a line below this inside a confirmed block is a piece of the block's notice
TEMPERATURES = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)
L1 = 5e-4


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def pairs(w: Column) -> Column:
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def with_terms(df: DataFrame, text: str) -> DataFrame:
    """Adds __w (words), __pairs and terms (distinct words and pairs)."""
    df = df.withColumn("__w", words(F.col(text)))
    df = df.withColumn("__pairs", pairs(F.col("__w")))
    return df.withColumn("terms", F.array_distinct(F.concat("__w", "__pairs")))


@dataclass
class Model:
    """``weights``: term, w (by family in order, difference to unknown); biases by family."""
    weights: DataFrame
    biases: dict[str, float]
    temperature: float
    gate: list[str]                  # words without which every paragraph is unknown


def deciding_pairs(table: tuple[tuple[str, str], ...] = TEMPLATES) -> list[list[str]]:
    """For each template the word pairs that must be there: those with a number, and those missing
    from a template of another family that has at least ``ALIKE`` of its pairs."""
    each = []
    for _, text in table:
        w = [x for x in re.split("[^a-z0-9]+", text.lower()) if x]
        each.append({f"{a} {b}" for a, b in zip(w, w[1:])})
    out = []
    for (family, _), own in zip(table, each):
        need = {p for p in own if re.search("[0-9]", p)}
        for (other, _), theirs in zip(table, each):
            if other != family and len(own & theirs) >= ALIKE * len(own):
                need |= own - theirs
        out.append(sorted(need))
    return out


def probes() -> list[str]:
    """One word pair of every template: its longest."""
    longest = lambda w: max((f"{a} {b}" for a, b in zip(w, w[1:])), key=len)
    return sorted({longest([x for x in re.split("[^a-z0-9]+", t.lower()) if x]) for _, t in TEMPLATES})


def templates(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(k, f, t, need) for k, ((f, t), need) in enumerate(zip(TEMPLATES, deciding_pairs()))],
                                 "template int, family string, line string, need array<string>")
    return with_terms(rows, "line")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, at, last, line): the lines of every text (last = at), and its blocks of several
    lines without a blank one between, joined by spaces."""
    full = lambda k: F.coalesce(F.get("__lines", k).rlike(r"\S"), F.lit(False))
    places = F.sequence(F.lit(0), F.size("__lines") - 1)
    first = F.filter(places, lambda k: full(k) & ~full(k - 1))
    last = F.filter(places, lambda k: full(k) & ~full(k + 1))
    lines = F.transform("__lines", lambda t, k: F.struct(k.alias("at"), k.alias("last"), t.alias("line")))
    blocks = F.transform(F.filter(F.zip_with(first, last, lambda a, b: F.struct(a.alias("at"), b.alias("last"))), lambda x: x["last"] > x["at"]),
                         lambda x: F.struct(x["at"].alias("at"), x["last"].alias("last"),
                                            F.array_join(F.slice("__lines", x["at"] + 1, x["last"] - x["at"] + 1), " ").alias("line")))
    split = docs.filter("text is not null").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k1"),
                                                   F.split("text", "\n").alias("__lines"))
    return split.select("doc_id", "k1", F.explode(F.concat(lines, blocks)).alias("p")).select("doc_id", "k1", "p.*")


def training_rows(docs: DataFrame, sample: int = SAMPLE_PARAGRAPHS, variants: int = VARIANTS) -> DataFrame:
    """(family, terms, fold): bounded by the templates and the sample."""
    spark = docs.sparkSession
    base = templates(spark)
    chance = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1000))
    many = base.select("template", "family", "need", "__w", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))).alias("v"))
    dropped = F.filter(F.transform("__w", lambda w, i: F.when((F.col("v") == 0) | (chance("template", "v", i) >= 120), w)),
                       lambda w: w.isNotNull())
    cut = F.when(F.col("v") % 4 == 3, F.expr("slice(__d, 1, greatest(3, cast(size(__d) * 0.7 as int)))")).otherwise(F.col("__d"))
    known = many.withColumn("__d", dropped).select("family", "need", F.concat_ws(" ", cut).alias("line"))
    known = known.filter(F.size(F.array_except("need", pairs(words(F.col("line"))))) == 0).select("family", "line")

    total = max(1, docs.count())
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / 4 / total)) + 1
    licence_pairs = sorted({r["p"] for r in base.select(F.explode("__pairs").alias("p")).collect()})
    licence_words = sorted({r["w"] for r in base.select(F.explode("__w").alias("w")).collect()})
    some = with_terms(paragraphs(docs.filter(draw)).filter("at = last and trim(line) != ''"), "line")
    plain = some.filter(F.size(F.array_intersect("__pairs", F.array(*map(F.lit, licence_pairs)))) < 2)
    plain = plain.filter(F.pmod(F.xxhash64("line", "at"), F.lit(4)) == 0).select("line")
    pick = lambda k: F.element_at(F.array(*map(F.lit, licence_words)),
                                  (F.pmod(F.xxhash64("line", F.lit(k)), F.lit(len(licence_words))) + 1).cast("int"))
    misses = plain.select(F.concat_ws(" ", pick(1), pick(2), F.substring("line", 1, 60), pick(3)).alias("line"))
    single = spark.createDataFrame([(w,) for w in licence_words], "line string")
    rest = plain.unionAll(misses).unionAll(single).select(F.lit(UNKNOWN).alias("family"), "line")
    rows = with_terms(known.unionAll(rest), "line").select("family", "terms", F.pmod(F.xxhash64("line"), F.lit(5)).alias("fold"))
    return rows.filter(F.size("terms") > 0)


def fit(docs: DataFrame, **bounds) -> Model:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer

    spark = docs.sparkSession
    rows = stage(training_rows(docs, **bounds), "licence-rows")
    families = sorted({r["family"] for r in rows.select("family").distinct().collect()} | {UNKNOWN})
    number = F.create_map(*[x for k, f in enumerate(families) for x in (F.lit(f), F.lit(float(k)))])
    rows = rows.withColumn("label", number[F.col("family")])
    # Families count alike; unknown counts as much as all of them, as most paragraphs are.
    sizes = {r["family"]: r["n"] for r in rows.groupBy("family").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {f: (len(families) - 1 if f == UNKNOWN else 1) * sum(sizes.values()) / len(sizes) / n for f, n in sizes.items()}
    weight = F.create_map(*[x for f, v in share.items() for x in (F.lit(f), F.lit(float(v)))])
    rows = rows.withColumn("w", weight[F.col("family")])
    vector = CountVectorizer(inputCol="terms", outputCol="features", vocabSize=VOCABULARY, minDF=2.0, binary=True).fit(rows)
    model = LogisticRegression(featuresCol="features", labelCol="label", weightCol="w", family="multinomial",
                               elasticNetParam=1.0, regParam=L1, maxIter=80, standardization=False).fit(
        vector.transform(rows.filter("fold > 0")))
    unknown = families.index(UNKNOWN)
    table, biases = [], {}
    matrix, intercept = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    for k, f in enumerate(families):
        if k != unknown:
            biases[f] = float(intercept[k] - intercept[unknown])
            table += [(t, f, float(w)) for t, w in zip(vector.vocabulary, matrix[k] - matrix[unknown]) if w != 0.0]
    if any(b >= 0 for b in biases.values()):        # nothing known at all must stay unknown
        biases = {f: min(b, -1e-6) for f, b in biases.items()}
    common = {r["t"]: r["n"] for r in rows.filter(F.col("family") == UNKNOWN).select(F.explode("terms").alias("t"))
              .groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    gate = gate_words(table, biases, common)
    order = {f: k for k, f in enumerate(sorted(biases))}
    rows_of: dict[str, list[float]] = {}
    for t, f, w in table:
        rows_of.setdefault(t, [0.0] * len(order))[order[f]] = w
    weights = spark.createDataFrame(list(rows_of.items()), "term string, w array<double>")
    out = Model(weights, biases, 1.0, gate)
    held = rows.filter("fold = 0").select(F.monotonically_increasing_id().alias("row"), "family", "terms", "w")
    out.temperature = _temperature(stage(held, "licence-held"), out)
    return out


def gate_words(table: list[tuple[str, str, float]], biases: dict[str, float], common: dict[str, int]) -> list[str]:
    """Words without which no family can reach the margin 0. Common words are left out
    one by one, as long as all terms made of left-out words together cannot lift any
    family's bias to 0 (a term counts once in a paragraph, so their sum is a bound)."""
    lifting: dict[str, list[tuple[str, float]]] = {}
    for term, family, w in table:
        if w > 0:
            lifting.setdefault(term, []).append((family, w))
    names = sorted({w for t in lifting for w in t.split(" ")}, key=lambda w: (-common.get(w, 0), w))
    out: set[str] = set()
    room = {f: -b - 1e-9 for f, b in biases.items()}
    for name in names:
        if common.get(name, 0) == 0:
            break
        need: dict[str, float] = {}
        for term, uses in lifting.items():
            parts = term.split(" ")
            if name in parts and all(p == name or p in out for p in parts):
                for f, w in uses:
                    need[f] = need.get(f, 0.0) + w
        if all(room[f] > x for f, x in need.items()):
            out.add(name)
            for f, x in need.items():
                room[f] -= x
    return [w for w in names if w not in out]


def _margins(rows: DataFrame, keys: list[str], model: Model) -> DataFrame:
    """``keys`` and margins: array of (margin over unknown, family), from exploded terms."""
    names = sorted(model.biases)
    met = (rows.select(*keys, F.explode("terms").alias("term")).join(F.broadcast(model.weights), "term")
           .groupBy(*keys).agg(*[F.sum(F.get("w", F.lit(k))).alias(f"__m{k}") for k in range(len(names))]))
    return met.select(*keys, F.array(*[F.struct((F.col(f"__m{k}") + F.lit(model.biases[f])).alias("margin"), F.lit(f).alias("family"))
                                       for k, f in enumerate(names)]).alias("margins"))


def _probabilities(margins: Column, temperature: float) -> Column:
    """Calibrated (probability, family) pairs."""
    top = F.greatest(F.array_max(F.transform(margins, lambda m: m["margin"])), F.lit(0.0))     # unknown has margin 0
    raised = F.transform(margins, lambda m: F.struct(F.exp((m["margin"] - top) / temperature).alias("e"), m["family"].alias("family")))
    total = F.aggregate(raised, F.exp(-top / temperature), lambda a, m: a + m["e"])
    return F.transform(raised, lambda m: F.struct((m["e"] / total).alias("probability"), m["family"].alias("family")))


def _temperature(held: DataFrame, model: Model) -> float:
    """The temperature with the least weighted log loss on the held-out fold."""
    rows = held.join(_margins(held, ["row"], model), "row", "left").withColumn(
        "margins", F.coalesce("margins", F.array(*[F.struct(F.lit(b).alias("margin"), F.lit(f).alias("family"))
                                                   for f, b in sorted(model.biases.items())])))
    losses = []
    for t in TEMPERATURES:
        p = _probabilities(F.col("margins"), t)
        own = F.aggregate(p, F.lit(0.0), lambda a, m: a + F.when(m["family"] == F.col("family"), m["probability"]).otherwise(0.0))
        other = F.lit(1.0) - F.aggregate(p, F.lit(0.0), lambda a, m: a + m["probability"])
        truth = F.when(F.col("family") == UNKNOWN, other).otherwise(own)
        losses.append(F.sum(-F.col("w") * F.log(F.greatest(truth, F.lit(1e-9)))).alias(f"t{len(losses)}"))
    got = rows.agg(*losses).first()
    best = [(x, t) for x, t in zip(got, TEMPERATURES) if x is not None]
    return min(best)[1] if best else 1.0


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, k1, at, last, family, probability, similarity, confirmed) of every line and block
    that is given a family."""
    lines = paragraphs(docs).withColumn("__w", words(F.col("line")))
    lines = lines.filter(F.arrays_overlap("__w", F.array(*map(F.lit, model.gate)))) if model.gate else lines.filter("false")
    # Text is staged and shuffled, not the terms, which are several times as large.
    lines = stage(lines.drop("__w").dropDuplicates(["doc_id", "k1", "at", "last"]), "licence-lines")
    lines = lines.withColumn("id", F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), "k1", "at", "last"))
    margins = _margins(with_terms(lines, "line"), ["id"], model)
    # A family of probability ACCEPT (a half at least) has a margin of 0 or more; a block with a whole template has its probe.
    hint = F.arrays_overlap("terms", F.array(*map(F.lit, probes())))
    likely = F.array_max(F.transform("margins", lambda m: m["margin"])) >= 0
    met = with_terms(lines.join(margins, "id"), "line").filter(likely | ((F.col("at") < F.col("last")) & hint))
    scored = met.drop("terms", "__w", "__pairs").withColumn("each", _probabilities(F.col("margins"), model.temperature))
    scored = scored.withColumn("best", F.array_max("each"))
    one = F.filter("each", lambda x: (x["family"] == F.col("best.family")) & (x["probability"] >= ACCEPT))
    tried = with_terms(scored, "line").select("doc_id", "k1", "at", "last", "terms", "best", F.col("line").rlike(DENIED).alias("denied"),
                          F.explode(F.when(F.col("at") == F.col("last"), one).otherwise(F.col("each"))).alias("x"))
    accepted = (F.col("x.family") == F.col("best.family")) & (F.col("x.probability") >= ACCEPT)
    tried = tried.select("doc_id", "k1", "at", "last", "terms", "denied", F.col("x.family").alias("family"),
                         F.col("x.probability").alias("probability"), accepted.alias("accepted"))
    known = F.broadcast(templates(docs.sparkSession).select(F.col("family").alias("f"), F.col("__pairs").alias("own"), "need"))   # fixed values
    # Terms hold the pairs: no word has a space in it.
    share = F.size(F.array_intersect("terms", "own")) / F.size(F.array_distinct("own"))
    proven = (F.col("share") >= CONFIRM) & (F.size(F.array_except("need", "terms")) == 0) & ~F.col("denied")
    compared = tried.join(known, F.col("family") == F.col("f")).withColumn("share", share).filter("accepted or share = 1")
    return (compared.groupBy("doc_id", "k1", "at", "last", "family", "probability")
            .agg(F.max("share").alias("similarity"), F.max(proven).alias("confirmed")))


def _once(found: Column) -> Column:
    """The lines and blocks of a document without those that report a notice again."""
    block = lambda x: x["last"] > x["at"]
    inside = lambda y, x: (y["at"] >= x["at"]) & (y["last"] <= x["last"])
    blocks = F.filter(found, lambda x: block(x) & ~F.exists(found, lambda y: y["confirmed"] & inside(y, x) & F.when(
        x["confirmed"], ~block(y) & (y["family"] == x["family"])).otherwise(F.lit(True))))
    lines = F.filter(found, lambda x: ~block(x) & (x["confirmed"] | ~F.exists(
        blocks, lambda y: inside(x, y) & ((y["family"] == x["family"]) | (y["confirmed"] & (x["similarity"] < PIECE))))))
    return F.concat(lines, blocks)


def licence_report(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, n_licences, n_confirmed, families, probability (the
    greatest) and paragraphs (at, family, probability, similarity, confirmed)."""
    rows = docs.select("doc_id", "text")
    found = scan(rows, model or fit(rows))
    per = stage(found.groupBy(F.col("doc_id").alias("d"), F.col("k1").alias("k")).agg(
        F.collect_list(F.struct("at", "last", "family", "probability", "similarity", "confirmed")).alias("found"))
        .select("d", "k", F.sort_array(F.transform(_once(F.col("found")), lambda x: F.struct(
            *[x[c].alias(c) for c in ("at", "family", "probability", "similarity", "confirmed")]))).alias("paragraphs")),
        "licence-found")
    keyed = rows.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k1"))
    out = keyed.join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("k1") == F.col("k")), "left")
    p = F.coalesce("paragraphs", F.array().cast(per.schema["paragraphs"].dataType))
    return out.select(
        "doc_id", F.size(p).alias("n_licences"), F.size(F.filter(p, lambda x: x["confirmed"])).alias("n_confirmed"),
        F.array_sort(F.array_distinct(F.transform(p, lambda x: x["family"]))).alias("families"),
        F.array_max(F.transform(p, lambda x: x["probability"])).alias("probability"), p.alias("paragraphs"))
