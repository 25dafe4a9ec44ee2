"""Licence paragraphs, by a trained classifier.

Paragraphs (lines) are turned into sparse word 1- and 2-grams and classified by a
multinomial logistic regression into licence families and a class for anything else. A second logistic regression turns
the best family's log-odds into the probability that it is right; under ``min_probability`` the paragraph is unknown. It
learns from what the first hasn't seen: licence texts with a part of their words gone (a quarter, a half and three
quarters), as paragraphs that are worded otherwise are, and a third of all other sentences and paragraphs. The family's templates must confirm it: most of the paragraph's word
pairs come from them, or the paragraph holds most of one of them.

The model learns from the templates below, whole and in pieces, from sentences that use the same words otherwise, and
from at most ``max_negatives`` paragraphs of the documents (those that hash lowest and share no three words with a
template). All is DataFrame and SQL functions and the DataFrame-based ML library, all in the JVM. Candidates are the
paragraphs that the templates of some family can confirm: what isn't classified could not pass the final test, so no
licence is lost by it. Documents are joined with their findings only.

Defined results: a null or empty text has no paragraphs. Rows that repeat are scanned each. Columns of the input stay, but for the text and those named like the results.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, NO_ID, materialise, whole

#: Words that the templates have; they decide nothing.
CUES = r"(?i)licen[sc]|copyright|copyleft|warrant|permission|permitted|redistribut|public domain|creative commons|cc0|cc by"
#: Sentences of public licences and of their customary notices, by family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU GPL v3 license.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0, the public domain dedication."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, without permission, for any purpose, commercial or non-commercial."],
}
#: Sentences with the same words that are no licence.
OTHERS = [
    "Her driving license was renewed in May.",
    "He lost his fishing licence and had to ask for permission to stay.",
    "The court found no warrant for the search.",
    "The warranty covers parts and labour for two years.",
    "Copyright law is taught in the second term.",
    "Smoking is not permitted in the building.",
    "The library asks for permission before it lends old maps.",
    "The city grants a license to each taxi.",
    "All rights reserved. Copyright 2019 The Authors.",
    "Wealth was redistributed among the farmers after the war.",
    "The photograph has been in the public domain since 1950.",
    "You need written permission of the owner to enter the software laboratory.",
]
UNKNOWN = "unknown"
FAMILIES = [*TEMPLATES, UNKNOWN]
NEW = ["n_paragraphs", "n_candidates", "licences", "families"]


def words(paragraph: Column) -> Column:
    """Runs of letters, digits and full stops between them, in lower case."""
    return F.regexp_extract_all(F.lower(paragraph), F.lit(r"[\p{L}\p{N}]+(?:\.[\p{N}]+)*"), F.lit(0))


def split_words(template: str) -> list[str]:
    """What words() makes of a template."""
    return re.findall(r"[^\W_]+(?:\.\d+)*", template.lower())


def grams(tokens: str, n: int) -> Column:
    return F.expr(f"if(size({tokens}) >= {n}, transform(sequence(1, size({tokens}) - {n - 1}), i -> array_join(slice({tokens}, i, {n}), ' ')), cast(array() as array<string>))")


def with_terms(df: DataFrame, paragraph: str) -> DataFrame:
    """df with __w (words), __two (pairs) and __terms (both)."""
    return df.withColumn("__w", words(F.col(paragraph))).withColumn("__two", grams("__w", 2)).withColumn("__terms", F.concat("__w", "__two"))


def _literal(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(a).alias("family"), F.lit(b).alias("paragraph")) for a, b in rows))).alias("x")).select("x.*")


class Model:
    """What a scan needs: the vocabulary, both regressions, and the templates' pairs."""

    def __init__(self, terms: CountVectorizerModel, families: LogisticRegressionModel, right: LogisticRegressionModel):
        self.terms, self.families, self.right = terms, families, right

    def predict(self, df: DataFrame) -> DataFrame:
        """df (with __terms) with family, the best but for the unknown class, and probability, that it is right."""
        out = self.families.transform(self.terms.transform(df.withColumn("__has", F.size("__terms") > 0)))
        out = out.withColumn("__p", vector_to_array("__probability")).drop("__raw", "__probability", "__vector", "__label")
        best = F.array_max(F.transform(F.slice("__p", 1, len(FAMILIES) - 1), lambda p, i: F.struct(p.alias("p"), (-i).alias("i"))))
        out = out.withColumn("__best", best)
        out = out.withColumns({"family": F.element_at(F.array(*map(F.lit, TEMPLATES)), 1 - F.col("__best.i")), "__odds": F.log(F.greatest(F.col("__best.p"), F.lit(1e-12)) / F.greatest(1 - F.col("__best.p"), F.lit(1e-12)))})
        out = self.right.transform(out.withColumn("__one", array_to_vector(F.array("__odds"))))
        return out.withColumn("probability", F.element_at(vector_to_array("__right"), 2)).drop("__p", "__best", "__odds", "__one", "__right", "__right_raw", "__right_label", "__has")


def examples(spark: SparkSession, docs: DataFrame, max_negatives: int) -> DataFrame:
    """family and __w (words): templates whole and in pieces, other sentences, and paragraphs of the documents."""
    known = with_terms(_literal(spark, [(f, t) for f, ts in TEMPLATES.items() for t in ts]), "paragraph")
    pieces = known.select("family", F.explode(F.expr("concat(array(__w), flatten(transform(array(10, 16, 24), n -> if(size(__w) > n, transform(sequence(1, size(__w) - n + 1, 3), i -> slice(__w, i, n)), cast(array() as array<array<string>>)))))")).alias("__w"))
    pieces = pieces.union(pieces.filter(F.size("__w") < 24).withColumn("__w", F.concat(F.array(F.lit("the"), F.lit("software")), "__w")))
    others = with_terms(_literal(spark, [(UNKNOWN, t) for t in OTHERS]), "paragraph").select("family", "__w")
    runs = F.split(F.lit("|".join(sorted({" ".join(w[i : i + 3]) for ts in TEMPLATES.values() for t in ts for w in [split_words(t)] for i in range(len(w) - 2)}))), "[|]")
    # The ids first: texts aren't sorted, and max_negatives rows of two numbers are a bounded size to broadcast.
    few = docs.select(F.xxhash64("text", "doc_id").alias("h")).distinct().orderBy("h").limit(max_negatives)
    lines = docs.select(F.xxhash64("text", "doc_id").alias("h"), whole(F.col("text")).alias("text")).join(F.broadcast(few), "h", "left_semi")
    lines = lines.select("h", F.explode(F.split("text", "\n", -1)).alias("paragraph")).orderBy(F.xxhash64("h", "paragraph"), "paragraph").limit(max_negatives)
    lines = lines.withColumn("__w", words(F.col("paragraph"))).filter(~F.arrays_overlap(grams("__w", 3), runs))
    lines = lines.select(F.lit(UNKNOWN).alias("family"), "__w")
    return pieces.unionByName(others).unionByName(lines).filter(F.size("__w") > 0)


def thinned(rows: DataFrame) -> DataFrame:
    """Examples with a quarter, a half and three quarters of their words gone, by a hash of the word and its place."""
    gone = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    left = rows.withColumn("__gone", gone).withColumn("__w", F.expr("filter(__w, (x, i) -> pmod(xxhash64(x, i, __gone), 4) >= __gone)"))
    return left.filter(F.size("__w") > 0).drop("__gone")


def fit(docs: DataFrame, max_negatives: int = 1000) -> Model:
    """Learns from the templates and at most max_negatives paragraphs; the calibration from thinned templates and a third of what is no licence."""
    spark = docs.sparkSession
    label = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family")).cast("double") - 1
    rows = materialise(examples(spark, docs.select("doc_id", "text"), max_negatives).withColumn("label", label).coalesce(1), "examples")
    # The vocabulary is that of the templates: its size is fixed by them.
    vocabulary = with_terms(_literal(spark, [(f, t) for f, ts in [*TEMPLATES.items(), (UNKNOWN, OTHERS)] for t in ts]), "paragraph").select(F.explode("__terms").alias("t")).distinct().orderBy("t")
    terms = CountVectorizerModel.from_vocabulary([r["t"] for r in vocabulary.collect()], "__terms", "__vector")
    terms.setBinary(True)
    ready = lambda df: terms.transform(df.withColumn("__two", grams("__w", 2)).withColumn("__terms", F.concat("__w", "__two")).drop("__two"))
    other, kept_out = F.col("family") == UNKNOWN, F.pmod(F.xxhash64("__w"), F.lit(3)) == 0
    learn = lambda df: LogisticRegression(featuresCol="__vector", labelCol="label", predictionCol="__label", probabilityCol="__probability", rawPredictionCol="__raw", family="multinomial", maxIter=60, regParam=0.002, elasticNetParam=0.5).fit(df)
    first = learn(ready(rows.filter(~(other & kept_out))))
    seen = first.transform(ready(thinned(rows.filter(~other)).unionByName(rows.filter(other & kept_out)))).withColumn("__p", vector_to_array("__probability"))
    best = F.array_max(F.transform(F.slice("__p", 1, len(FAMILIES) - 1), lambda p, i: F.struct(p.alias("p"), (-i).alias("i"))))
    seen = seen.withColumn("__best", best).select(F.when(-F.col("__best.i") == F.col("label"), 1.0).otherwise(0.0).alias("right"), array_to_vector(F.array(F.log(F.greatest(F.col("__best.p"), F.lit(1e-12)) / F.greatest(1 - F.col("__best.p"), F.lit(1e-12))))).alias("__one"))
    right = LogisticRegression(featuresCol="__one", labelCol="right", predictionCol="__right_label", probabilityCol="__right", rawPredictionCol="__right_raw", family="binomial", maxIter=60, regParam=0.01).fit(seen)
    return Model(terms, first, right)


def confirmed(spark: SparkSession) -> Column:
    """How well a paragraph (with __two) agrees with the templates of its family: the larger share of word pairs, of its own or of a template's."""
    pairs = {f: [list(dict.fromkeys(zip(w, w[1:], strict=False))) for t in ts for w in [split_words(t)]] for f, ts in TEMPLATES.items()}
    texts = F.create_map(*(x for f, ts in pairs.items() for x in (F.lit(f), F.array(*(F.array(*(F.lit(" ".join(p)) for p in t)) for t in ts)))))
    own = F.array_distinct("__two")
    mine = F.element_at(texts, F.col("family"))
    share = F.size(F.array_intersect(own, F.flatten(mine))) / F.greatest(F.size(own), F.lit(1))
    theirs = F.array_max(F.transform(mine, lambda t: F.size(F.array_intersect(own, t)) / F.greatest(F.size(t), F.lit(1))))
    return F.greatest(share, theirs)


def bound(value: Column, body) -> Column:
    """body of a variable, so that the value is worked out once, not at each use in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def may_agree(paragraph: Column, min_agreement: float) -> Column:
    """Whether some family's templates could agree with a paragraph by min_agreement, which confirmed() asks of one family: implied by the final test."""
    pairs = [list(dict.fromkeys(" ".join(p) for p in zip(w, w[1:], strict=False))) for ts in TEMPLATES.values() for t in ts for w in [split_words(t)]]
    known = sorted({p for t in pairs for p in t})
    texts = F.array(*(F.array(*map(F.lit, t)) for t in pairs))
    least = math.ceil(min_agreement * min(map(len, pairs)))

    def two(w: Column) -> Column:
        return F.when(F.size(w) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat(F.get(w, i - 1), F.lit(" "), F.get(w, i))))).otherwise(F.array().cast("array<string>"))

    def enough(own: Column, hits: Column) -> Column:
        of_one = F.exists(texts, lambda t: F.size(F.array_intersect(hits, t)) / F.size(t) >= min_agreement)
        return (F.size(hits) / F.greatest(F.size(own), F.lit(1)) >= min_agreement) | ((F.size(hits) >= least) & of_one)

    return bound(words(paragraph), lambda w: bound(two(w), lambda own: bound(F.filter(own, lambda p: p.isin(*known)), lambda hits: enough(own, hits))))


def scan(docs: DataFrame, model: Model | None = None, min_probability: float = 0.5, min_agreement: float = 0.6, **options) -> DataFrame:
    """docs without the text, with n_paragraphs (lines with a word), n_candidates (those that templates of some family agree with), licences (place, family, probability, agreement) and families."""
    spark = docs.sparkSession
    model = model or fit(docs, **options)
    key = {"__li_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__li_text": F.xxhash64("text")}
    t = whole(F.col("text"))
    lines = F.split(t, "\n", -1)
    found = docs.select(*(c.alias(n) for n, c in key.items()), F.posexplode(lines).alias("place", "paragraph")).filter(F.length(F.btrim("paragraph", F.lit(BLANKS))) > 0).filter(may_agree(F.col("paragraph"), min_agreement))
    found = model.predict(with_terms(found, "paragraph")).withColumn("agreement", confirmed(spark))
    licence = F.when((F.col("probability") >= min_probability) & (F.col("agreement") >= min_agreement), F.struct("place", "family", F.round("probability", 6).alias("probability"), F.round("agreement", 6).alias("agreement")))
    # A document's findings, once for rows of the same document and text.
    found = found.groupBy("__li_doc", "__li_text").agg(F.count_distinct("place").alias("n_candidates"), F.array_sort(F.collect_set(licence)).alias("licences"))
    kept = [c for c in docs.columns if c not in ("text", *NEW)]
    out = docs.select(*kept, *(c.alias(n) for n, c in key.items()), F.size(F.filter(lines, lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)).cast("long").alias("n_paragraphs")).join(found, ["__li_doc", "__li_text"], "left")
    none = F.array().cast("array<struct<place:int,family:string,probability:double,agreement:double>>")
    out = out.withColumns({"n_candidates": F.coalesce("n_candidates", F.lit(0)), "licences": F.coalesce("licences", none)})
    return out.withColumn("families", F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["family"])))).select(*kept, *NEW)
