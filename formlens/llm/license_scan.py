"""Licence scan: a trained paragraph classifier with an unknown class, confirmed by templates; native.

A paragraph is a line, or a line and those after it up to a blank one or to the length of the longest
template, so notices and licence texts that wrap are seen whole. A multinomial logistic regression over word 1- and 2-gram indicators is
fitted on notices, headers and body passages of each licence family and, as the unknown class, on
paragraphs of the corpus and on sentences that name other licences, refuse one or speak of licences
otherwise. A second, one-feature regression turns the margin over the unknown class into a calibrated
probability; it learns from wordings that the first hasn't seen, weighed as such paragraphs are frequent. A predicted family is confirmed if one of its templates shares
enough words with the paragraph. Scoring is one projection without a shuffle.

Lines far from any word of a "strong" gram are left out before. The other grams' leads over the unknown
class add up to too little to reach the least probability, so this can't change a result.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formlens.llm.common import Scratch

#: Licence families and the names by which notices call them.
NAMES = {
    "AGPL": ["GNU Affero General Public License, version 3", "GNU AGPLv3", "AGPL-3.0"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"],
    "BSD": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD license", "New BSD License"],
    "CC-BY": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0"],
    "CC-BY-NC": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"],
    "CC-BY-SA": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"],
    "CC0": ["CC0 1.0 Universal", "Creative Commons Zero", "CC0-1.0"],
    "EPL": ["Eclipse Public License 2.0", "Eclipse Public License, version 1.0", "EPL-2.0"],
    "GPL": ["GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL v3", "GPL-3.0"],
    "ISC": ["ISC License", "ISC licence"],
    "LGPL": ["GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPL-3.0"],
    "MIT": ["MIT License", "MIT licence", "Expat License"],
    "MPL": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
#: Headers and body passages of the licences' texts.
PASSAGES = {
    "AGPL": [
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source of your version",
    ],
    "Apache-2.0": [
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,",
    ],
    "CC-BY": ["To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"],
    "CC-BY-NC": ["To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/", "You may not use the material for commercial purposes; attribution, non-commercial use only under Creative Commons"],
    "CC-BY-SA": ["To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/", "If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original under Creative Commons ShareAlike"],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "GPL": [
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL": [
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction,",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,"],
}
#: Wordings of a notice, and those that calibration keeps to itself.
NOTICES = [
    "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Released under {}.", "This work is licensed under the {}.",
    "This program is free software: you can redistribute it under the terms of the {}.", "This software is available under {}.",
    "License: {}", "SPDX-License-Identifier: {}", "See the {} for details.", "Code is under the {}, all rights reserved by the authors.", "{}",
]
KEPT_OUT = ["You may use this file under the terms of the {}.", "The sources are published under {} only.", "Distribution is governed by the {}.", "Project license is {}; contributions welcome.", "Copyright the authors, {}"]
#: Sentences that speak of licences without giving one.
MENTIONS = [
    "He renewed his driving licence at the city office.", "The restaurant lost its license to serve alcohol.", "A fishing license costs twelve dollars.", "Poetic license allows for many things.",
    "The company sold a license for the patent to a competitor.", "Please check the license plate of the car.", "Her medical license was suspended in version 2 of the story.", "All rights reserved by the hotel for early check in.",
    "The terms of the agreement were published on Monday.", "Students at MIT built a robot.", "The Apache helicopter landed near the river.", "Permission to leave the room was granted to everyone.",
    "You may not park here without permission of the owner.", "The software is available for download.", "This version of the general public transport plan was released in May.", "Public notice: the office is closed and all copies of the form are gone.",
    "The work was released to the public last year.", "Free software downloads are listed for details below.", "Creative people share their attribution of success in the commons.", "The following conditions are met by most of the applicants.",
    "The license bureau closes its desk at noon.", "The committee reserves all rights to change the program.", "The office has the permission of the owner to copy the keys.", "Reserved seats are released at the desk an hour before the show.", "He granted the public free use of the garden.", "The foundation published a general report in version 2.",
    "The right to close the road is reserved by the city.", "They modified the form and distributed copies in the building.", "Visitors need permission from the front desk.", "The bar kept its license, and the rights of its owner were upheld.",
    "Warranty claims must be made in writing, and the purchase receipt must be included.", "License fees rose, said the ministry, and the code of conduct was revised.", "Licensed electricians only.", "The universal rule under the old law was simple.",
]
#: Licences of no family here, then those that calibration keeps to itself.
OTHERS = [
    "zlib License", "Artistic License 2.0", "Microsoft Public License", "Open Software License 3.0", "Common Development and Distribution License", "SIL Open Font License, Version 1.1",
    "PostgreSQL License", "Python Software Foundation License", "Academic Free License", "Sleepycat License", "company's commercial license", "end user license agreement", "Server Side Public License", "proprietary license",
]
OTHERS_KEPT_OUT = ["Boost Software License", "European Union Public Licence", "Educational Community License", "W3C Software Notice"]
#: Sentences that refuse a licence.
REFUSALS = [
    "No license is given for any use of this software.", "No rights are granted to copy or distribute these files.", "You may not use, copy, modify or distribute this software without written permission.", "Permission to use this software is not granted to anyone.",
    "This software is confidential and may not be redistributed in source or binary form.", "All rights reserved; no part may be copied, modified, merged, published or sold.", "Redistribution and use are not permitted under any conditions.", "Nothing here grants a license to the software, its copies or its documentation.",
    "No permission is hereby given to deal in the software.", "The use of this program is forbidden without a license from the vendor.", "You must not sublicense or sell copies of the software.", "Neither copying nor modification of this work is allowed.",
    "No licence, express or implied, is granted to use, modify or distribute the program.", "The right to copy, merge or publish is withheld.", "It is not free software and cannot be redistributed.",
]
UNKNOWN = "unknown"
FAMILIES = sorted(NAMES)
CLASSES = [*FAMILIES, UNKNOWN]
LONGEST = max(len(p.split()) for passages in PASSAGES.values() for p in passages)  # words after which a joined paragraph ends
NEAR = 4  # lines that may lie between two parts of a licence's text
MARGIN = 1e-3  # over rounding


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and inner dots."""
    return F.array_remove(F.split(F.btrim(F.lower(text), F.lit(".")), r"\.*[^a-z0-9.]+\.*"), "")


def grams(w: Column) -> Column:
    """Distinct 1- and 2-grams."""
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(w, pairs))


def _values(spark: SparkSession, rows: list[tuple], names: list[str], kinds: str) -> DataFrame:
    """A small literal table, made from one JSON literal."""
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{kinds}>>")))


def templates(spark: SparkSession) -> DataFrame:
    """(family, template) of every name and passage."""
    return _values(spark, [(f, n) for f in FAMILIES for n in NAMES[f] + PASSAGES[f]], ["family", "template"], "family:string,template:string")


@dataclass
class LicenceModel:
    vocabulary: list[str]
    fit: LogisticRegressionModel
    slope: float
    offset: float
    least: float
    prior: dict[str, float]  # shares of paragraphs that are known, speak of licences otherwise, and are plain
    strong: list[str]  # a paragraph without these words isn't judged known; empty: no such promise

    def scored(self, df: DataFrame) -> DataFrame:
        """``df`` with g (grams) -> the same with family (the best) and p_known, without g."""
        vector = CountVectorizerModel.from_vocabulary(self.vocabulary, inputCol="g", outputCol="_x").setBinary(True)
        raw = self.fit.transform(vector.transform(df)).withColumn("_s", vector_to_array("rawPrediction"))
        best = F.greatest(*(F.struct(F.col("_s")[i].alias("s"), F.lit(f).alias("f")) for i, f in enumerate(FAMILIES)))
        raw = raw.withColumn("_best", best).withColumn("margin", F.round(F.col("_best.s") - F.col("_s")[len(FAMILIES)], 6))
        p = 1 / (1 + F.exp(-(F.lit(self.slope) * F.col("margin") + F.lit(self.offset))))
        keep = [c for c in df.columns if c != "g"]
        return raw.select(*keep, "g", F.col("_best.f").alias("family"), "margin", F.round(p, 6).alias("p_known"))


def _joined(lines: Column, i: Column) -> Column:
    """Text and last line of the paragraph from line i on: up to a blank line, or until it holds ``LONGEST`` words."""
    start = F.struct(F.lit("").alias("t"), F.lit(0).alias("n"), F.lit(0).alias("lines"), F.lit(False).alias("over"))

    def add(at: Column, x: Column) -> Column:
        over = at["over"] | (F.btrim(x) == "")
        n = at["n"] + F.size(F.split(F.btrim(x), r"\s+"))
        longer = F.struct(F.concat_ws(" ", at["t"], x).alias("t"), n.alias("n"), (at["lines"] + 1).alias("lines"), (n >= LONGEST).alias("over"))
        return F.when(over, F.struct(at["t"].alias("t"), at["n"].alias("n"), at["lines"].alias("lines"), F.lit(True).alias("over"))).otherwise(longer)

    # Each line holds a word, so there are LONGEST lines at most.
    return F.aggregate(F.slice(lines, i + 1, LONGEST), start, add, lambda at: F.struct((i + F.greatest(at["lines"] - 1, F.lit(0))).alias("last"), at["t"].alias("t")))


def _earliest(lines: Column, i: Column) -> Column:
    """First line whose paragraph may reach line i."""
    since = F.greatest(i - LONGEST + 1, F.lit(0))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("lines"), F.lit(False).alias("over"))

    def add(at: Column, x: Column) -> Column:
        n = at["n"] + F.size(F.split(F.btrim(x), r"\s+"))
        stop = at["over"] | (F.btrim(x) == "") | (at["n"] >= LONGEST)
        return F.when(stop, F.struct(at["n"].alias("n"), at["lines"].alias("lines"), F.lit(True).alias("over"))).otherwise(F.struct(n.alias("n"), (at["lines"] + 1).alias("lines"), F.lit(False).alias("over")))

    return F.aggregate(F.reverse(F.slice(lines, since + 1, i - since)), start, add, lambda at: i - at["lines"])


def paragraphs(docs: DataFrame, strong: list[str]) -> DataFrame:
    """(row, doc_id, text) -> row, doc_id, paragraph (line number from 0), last (its last line), joined (of several lines), g (its grams).

    Of each text the lines that hold a ``strong`` word, and the joined paragraphs that reach them; all if there is none.
    """
    holds = (lambda x: F.arrays_overlap(words(x), F.array(*map(F.lit, strong)))) if strong else (lambda x: F.lit(True))
    rows = docs.filter("text <> ''").select("row", "doc_id", F.split("text", "\n").alias("lines"))
    rows = rows.withColumn("held", F.filter(F.transform("lines", lambda x, i: F.when(holds(x), i)), lambda i: i.isNotNull())).filter(F.size("held") > 0)
    first = F.array_distinct(F.flatten(F.transform("held", lambda i: F.sequence(_earliest(F.col("lines"), i), i))))
    one = F.transform("held", lambda i: F.struct(i.alias("paragraph"), i.alias("last"), F.lit(False).alias("joined"), F.get("lines", i).alias("t")))

    def more(i: Column) -> Column:
        whole = _joined(F.col("lines"), i)
        return F.struct(i.alias("paragraph"), whole["last"].alias("last"), F.lit(True).alias("joined"), whole["t"].alias("t"))

    rows = rows.select("row", "doc_id", F.inline(F.concat(one, F.transform(first, more))))
    rows = rows.select("row", "doc_id", "paragraph", "last", "joined", words(F.col("t")).alias("w")).filter(F.size("w") > 0)
    return rows.select("row", "doc_id", "paragraph", "last", "joined", grams(F.col("w")).alias("g"))


def known_wordings(spark: SparkSession) -> DataFrame:
    """family, line, kept_out: notices in all wordings, and passages whole and in halves; of long ones the middle is kept out."""
    rows = [(f, w.format(n), False) for f in FAMILIES for n in NAMES[f] for w in NOTICES]
    rows += [(f, w.format(n), True) for f in FAMILIES for n in NAMES[f] for w in KEPT_OUT]
    for f in FAMILIES:
        for p in PASSAGES[f]:
            w = p.split(" ")
            half = len(w) // 2
            rows += [(f, p, False), (f, " ".join(w[:half]), False), (f, " ".join(w[half:]), False)]
            if len(w) >= 24:
                rows.append((f, " ".join(w[half // 2 : half + half // 2]), True))
    rows += [(UNKNOWN, w.format(n), n in OTHERS_KEPT_OUT or w in KEPT_OUT) for n in OTHERS + OTHERS_KEPT_OUT for w in NOTICES + KEPT_OUT if n in OTHERS or w in KEPT_OUT]
    rows += [(UNKNOWN, m, i % 4 == 0) for i, m in enumerate(MENTIONS + REFUSALS)]
    return _values(spark, rows, ["family", "line", "kept_out"], "family:string,line:string,kept_out:boolean")


def train_licences(docs: DataFrame, scratch: Scratch, max_negatives: int = 250, common: float = 0.01, least: float = 0.5) -> LicenceModel:
    """Fit on the wordings, and on one paragraph each of about ``max_negatives`` documents, chosen by a hash, as unknown.

    Paragraphs that hold a licence's full name are not taken as unknown. The vocabulary is every gram of
    the training rows, but for grams whose words all stand in more than a ``common`` share of the corpus
    paragraphs. Calibration weighs the rows it keeps to itself by how often the sampled paragraphs name a
    licence of the families, speak of a licence otherwise (at least as often), or do neither. ``least`` is the probability from
    which a paragraph counts as known.
    """
    spark = docs.sparkSession
    count = docs.count()
    share = math.ceil(min(1.0, max_negatives / max(count, 1)) * 1_000_000)
    hashed = F.xxhash64("doc_id", "text")
    some = docs.filter(F.pmod(hashed, F.lit(1_000_000)) < share).select(F.split("text", "\n").alias("lines"), hashed.alias("h")).filter(F.col("lines").isNotNull())
    some = some.withColumn("line", _joined(F.col("lines"), F.pmod(F.col("h"), F.size("lines")).cast("int"))["t"])
    named = reduce(or_, (F.contains(F.lower("line"), F.lit(n.lower())) for f in FAMILIES for n in NAMES[f]))
    drawn, speaks, names = some.agg(F.count("*"), F.count_if(~named & F.lower("line").rlike("licen[cs]e")), F.count_if(named)).first()
    prior = {"known": (names + 1) / (drawn + 3), "speaks": (max(speaks, names) + 1) / (drawn + 3)}
    prior["plain"] = 1 - sum(prior.values())
    none = some.filter(~named).select(F.lit(UNKNOWN).alias("family"), "line", (F.pmod(F.col("h"), F.lit(5)) == 0).alias("kept_out"), F.lit("plain").alias("kind"))
    kind = F.when(F.col("family") == UNKNOWN, "speaks").otherwise("known")
    rows = known_wordings(spark).withColumn("kind", kind).unionByName(none).select("family", "kept_out", "kind", grams(words(F.col("line"))).alias("g")).filter(F.size("g") > 0)
    label = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("family")).cast("double") - 1
    rows = scratch.save(rows.select("g", "kept_out", "kind", label.alias("label")).coalesce(4), "training")
    known = F.col("label") < len(FAMILIES)
    counts = rows.filter("not kept_out").select(F.col("kind") == "plain", F.explode("g").alias("g")).toDF("plain", "g").groupBy("g").agg(F.count_if("plain").alias("n"))
    seen = {r.g: r.n for r in counts.collect()}
    often = common * rows.filter("kind = 'plain' and not kept_out").count()
    vocabulary = sorted(g for g in seen if any(seen.get(w, 0) <= often for w in g.split(" ")))
    vector = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="g", outputCol="_x").setBinary(True)
    data = vector.transform(rows)
    # The unknown class is the last, so that it is there even without rows of its own.
    fit = LogisticRegression(featuresCol="_x", labelCol="label", family="multinomial", regParam=5e-4, elasticNetParam=0.5, maxIter=30, standardization=False).fit(data.filter("not kept_out"))
    model = LicenceModel(vocabulary, fit, 1.0, 0.0, least, prior, [])
    held = model.scored(rows.filter("kept_out")).select("margin", "kind", known.cast("double").alias("known"))
    sizes = {r["kind"]: r["count"] for r in held.groupBy("kind").count().collect()}
    weight = reduce(lambda w, k: w.when(F.col("kind") == k, prior[k] / sizes[k]), sizes, F.when(F.lit(False), 0.0))
    held = VectorAssembler(inputCols=["margin"], outputCol="m").transform(held.withColumn("weight", weight * sum(sizes.values())))
    one = LogisticRegression(featuresCol="m", labelCol="known", weightCol="weight", regParam=1e-4, maxIter=50).fit(held)
    model.slope, model.offset, model.prior = float(one.coefficients[0]), float(one.intercept), prior
    model.strong = _strong_words(model, seen)
    return model


def _strong_words(model: LicenceModel, seen: dict[str, int]) -> list[str]:
    """A word of each strong gram of each family; empty if a paragraph without any gram would be judged known.

    The others' leads over the unknown class, all together, don't reach the least probability. The
    words most often ``seen`` in the corpus are left to those as far as they go.
    """
    matrix, bias = model.fit.coefficientMatrix.toArray(), model.fit.interceptVector.toArray()
    rare = [min(g.split(" "), key=lambda w: (seen.get(w, 0), -len(w))) for g in model.vocabulary]
    order = sorted(range(len(rare)), key=lambda j: -seen.get(rare[j], 0))
    strong: set[str] = set()
    for f in range(len(FAMILIES)):
        lead = matrix[f] - matrix[-1]
        room = (math.log(model.least / (1 - model.least)) - model.offset) / model.slope - (bias[f] - bias[-1]) if model.slope > 0 else 0.0
        if room <= MARGIN:
            return []
        for j in order:
            if lead[j] > 0:
                if lead[j] < room - MARGIN:
                    room -= lead[j]
                else:
                    strong.add(rare[j])
    return sorted(strong)


def _rank() -> Column:
    """A joined paragraph as it is compared: confirmed, similarity, probability, then the earlier one."""
    better = F.struct("confirmed", "similarity", "p_known", (-F.col("paragraph")).alias("first"))
    return F.struct("paragraph", "last", better.alias("better"))


def _best_apart(found: Column) -> Column:
    """Of paragraphs in order of their first line, the better of two that overlap, from the top."""
    kind = "array<struct<paragraph:int,last:int,better:struct<confirmed:boolean,similarity:double,p_known:double,first:int>>>"
    start = F.struct(F.array().cast(kind).alias("done"), F.slice(found, 1, 1).cast(kind).alias("now"))

    def add(at: Column, x: Column) -> Column:
        now = at["now"][0]
        apart = F.struct(F.concat(at["done"], at["now"]).alias("done"), F.array(x).cast(kind).alias("now"))
        kept = F.struct(at["done"].alias("done"), F.when(x["better"] > now["better"], F.array(x).cast(kind)).otherwise(at["now"]).alias("now"))
        return F.when(x["paragraph"] > now["last"], apart).otherwise(kept)

    return F.aggregate(F.slice(found, F.lit(2), F.greatest(F.size(found) - 1, F.lit(0))), start, add, lambda at: F.concat(at["done"], at["now"]))


def scan_licences(docs: DataFrame, model: LicenceModel, scratch: Scratch, similarity: float = 0.6) -> DataFrame:
    """(doc_id, text) -> doc_id, paragraph, joined, family, p_known, template, similarity, confirmed of every notice.

    ``similarity`` is the share that the best template of the family must have in common with the
    paragraph: of its 1- and 2-grams or, for paragraphs of 12 grams and more, of the paragraph's. Single
    lines that are confirmed are notices; so are the joined paragraphs that hold no such line, of two that
    overlap the better, from the top; and single lines that stay unconfirmed and lie in none of those. A joined
    paragraph ends before a blank line, or with the line that brings it to as many words as the longest template
    has; one starts at every line. Families that score alike: the last by name. Whole texts are scanned. Null and empty texts have no paragraph; rows with equal ids are scanned on their own; a
    null doc_id stays null.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = model.scored(paragraphs(rows, model.strong)).filter(F.col("p_known") >= model.least)
    form = templates(docs.sparkSession).select("family", F.col("template"), grams(words(F.col("template"))).alias("tg"))
    form = form.groupBy("family").agg(F.sort_array(F.collect_list(F.struct("template", "tg"))).alias("forms"))
    common = lambda t: F.size(F.array_intersect(t["tg"], F.col("g")))
    share = lambda t: F.round(F.greatest(common(t) / F.size(t["tg"]), F.when(F.size("g") >= 12, common(t) / F.size("g")).otherwise(0.0)), 6)
    best = F.array_max(F.transform("forms", lambda t: F.struct(share(t).alias("s"), F.length(t["template"]).alias("n"), t["template"].alias("t"))))
    found = found.join(F.broadcast(form), "family").withColumn("m", best)
    found = found.select("row", "doc_id", "paragraph", "last", "joined", "family", "p_known", F.col("m.t").alias("template"), F.col("m.s").alias("similarity"), (F.col("m.s") >= similarity).alias("confirmed"))
    found = scratch.save(found, "found")
    by_row = Window.partitionBy("row").orderBy("paragraph")
    sure = ~F.col("joined") & F.col("confirmed")
    following = F.min(F.when(sure, F.col("paragraph"))).over(by_row.rangeBetween(0, Window.unboundedFollowing))
    free = found.withColumn("sure", following).filter(F.col("joined") & (F.col("sure").isNull() | (F.col("sure") > F.col("last")))).select("row", _rank().alias("x"))
    chosen = free.groupBy("row").agg(_best_apart(F.array_sort(F.collect_list("x"), lambda a, b: a["paragraph"] - b["paragraph"])).alias("x")).select("row", F.explode("x").alias("x"))
    chosen = chosen.select("row", F.col("x.paragraph").alias("paragraph"), F.lit(True).alias("joined"), F.lit(True).alias("chosen"))
    found = found.join(chosen, ["row", "paragraph", "joined"], "left")
    reached = F.max(F.when(F.col("chosen"), F.col("last"))).over(by_row.rangeBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("inside", F.coalesce(reached >= F.col("paragraph"), F.lit(False)))
    found = found.filter(sure | F.col("chosen") | (~F.col("joined") & ~F.col("confirmed") & ~F.col("inside")))
    # A licence's text in several paragraphs on end is one notice.
    order = Window.partitionBy("row").orderBy("paragraph", "joined")
    body = F.col("joined") | ~F.col("template").isin([n for f in FAMILIES for n in NAMES[f]])
    again = body & (F.lag("family").over(order) == F.col("family")) & (F.col("paragraph") - F.lag("last").over(order) <= NEAR)
    found = found.withColumn("again", F.coalesce(again, F.lit(False))).withColumn("notice", F.sum(F.when(F.col("again"), 0).otherwise(1)).over(order))
    parts = F.struct("confirmed", "similarity", "p_known", "joined", "template")
    out = found.groupBy("row", "doc_id", "family", "notice").agg(F.min("paragraph").alias("paragraph"), F.max(parts).alias("m"))
    return out.select("doc_id", "paragraph", "m.joined", "family", "m.p_known", "m.template", "m.similarity", "m.confirmed")


def document_licences(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per input row: doc_id, n_notices, n_confirmed, families (sorted, confirmed ones only); rows of equal ids share their notices."""
    found = scan_licences(docs, train_licences(docs, scratch), scratch)
    by = found.groupBy("doc_id").agg(F.count("*").alias("n_notices"), F.count_if("confirmed").alias("n_confirmed"), F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("families"))
    ids, by = docs.select(F.col("doc_id").cast("long").alias("doc_id")), by.withColumnRenamed("doc_id", "_id")
    out = ids.join(by, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return out.select("doc_id", F.coalesce("n_notices", F.lit(0)).alias("n_notices"), F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"), F.coalesce("families", F.array().cast("array<string>")).alias("families"))
