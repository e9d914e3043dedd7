import re
from dataclasses import replace

from pyspark.sql import functions as F

from formlens.llm.common import Scratch, table
from formlens.llm.license_scan import LONGEST, OTHERS_KEPT_OUT, PASSAGES, document_licences, grams, known_wordings, paragraphs, scan_licences, train_licences, words

SF = "/root/testdata/sf0.01"
#: The notices that the corpus plants.
PLANTED = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC", "This work is licensed under the GNU General Public License, version 3.": "GPL", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT"}


def test_planted_and_new_wordings_and_odd_rows(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    model = train_licences(docs, Scratch(spark, "t"))
    found = scan_licences(docs, model, Scratch(spark, "t")).filter("confirmed").select("doc_id", "paragraph", "family").collect()
    want = {(r.doc_id, i, PLANTED[line]) for r in docs.collect() for i, line in enumerate(r.text.split("\n")) if line in PLANTED}
    assert {tuple(r) for r in found} == want and len(want) > 20
    odd = [(1, None), (2, ""), (3, "Copyright 2020 A. Nobody.\nYou can use this under the Mozilla Public License 2.0"), (None, "Code released under BSD license"), (5, "the of for and"), (5, "\n\n"), (6, "word " * 30000 + "\nSPDX-License-Identifier: AGPL-3.0")]
    got = scan_licences(spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "1 as family", "2 as w"), model, Scratch(spark, "t")).filter("confirmed").collect()
    assert {(r.doc_id, r.paragraph, r.family) for r in got} == {(3, 1, "MPL"), (None, 0, "BSD"), (6, 1, "AGPL")}
    assert scan_licences(docs.limit(0), model, Scratch(spark, "t")).collect() == []

    # Wrapped notices, licence texts and unseen wordings; none of these lines is a training line.
    lines = {r.line for r in known_wordings(spark).collect()}
    filler = "Some words of a plain story that goes on.\nAnd on it goes, line by line.\n"
    new = {
        1: ("This program is distributed under the terms of the GNU\nGeneral Public License, version 3.", "GPL"),
        2: ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the Software), to deal in the\nSoftware without restriction, including without limitation the rights to use, copy,\nmodify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "MIT"),
        3: ("Redistribution and use in source and binary\nforms, with or without modification, are permitted provided that\nthe following conditions are met:", "BSD"),
        4: ("These files may be shared, as the Apache License, Version 2.0 allows.", "Apache-2.0"),
        5: ("The images of this book come under the Creative Commons Attribution-ShareAlike 4.0\nInternational License", "CC-BY-SA"),
        6: ("distributed freely; you can redistribute it and/or modify it\nunder the terms of the GNU Lesser General Public License as published by the\nFree Software Foundation", "LGPL"),
    }
    same = lines & {x for t, _ in new.values() for x in t.split("\n")}
    assert same == set()
    rows = [(i, f"{filler}{t}\n{filler}") for i, (t, _) in new.items()] + [(9, filler + "\nShe got her driving licence in version 3 of the tests.\nThe general public was happy."), (10, "The license office reserved all rights to close the permission desk.")]
    got = scan_licences(spark.createDataFrame(rows, "doc_id long, text string"), model, Scratch(spark, "t")).collect()
    assert {(r.doc_id, r.family) for r in got if r.confirmed} == {(i, f) for i, (_, f) in new.items()}
    assert {r.doc_id for r in got} == set(new)


def test_leaving_out_texts_changes_nothing(spark):
    """The words that texts must hold are a promise of the model: without them the result is the same."""
    docs = table(spark, SF, "documents").select("doc_id", "text")
    model = train_licences(docs, Scratch(spark, "t"))
    assert 0 < len(model.strong) < 300
    some = docs.filter("doc_id % 5 = 0")
    rows = lambda m: sorted(map(str, scan_licences(some, m, Scratch(spark, "t")).collect()))
    assert rows(model) == rows(replace(model, strong=[]))


def test_one_row_per_document(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License.\nReleased under the MIT License."), (2, None), (2, "plain text of no licence"), (None, "Apache-2.0")], "doc_id long, text string")
    rows = document_licences(docs, Scratch(spark, "t")).collect()
    assert len(rows) == 4 and [(r.n_confirmed, r.families) for r in rows if r.doc_id == 1] == [(2, ["MIT"])]
    assert all(not re.search("MIT", str(r.families)) for r in rows if r.doc_id != 1)
    assert document_licences(docs.limit(0), Scratch(spark, "t")).collect() == []


def test_other_licences_and_refusals_are_unknown_and_probabilities_hold(spark):
    """None of these sentences is a training or calibration line; bins of p hold about as many notices as they say."""
    docs = table(spark, SF, "documents").select("doc_id", "text")
    model = train_licences(docs, Scratch(spark, "t"))
    none = ["The license office reserved all rights to close the permission desk.", "No license is granted to use, copy or modify the files.", "No license is granted to use, copy or modify these sources or their parts."]
    none += [w.format(n) for n in OTHERS_KEPT_OUT for w in ("licensed under the {}", "The tool comes under the {}.", "It is subject to the {}.")] + OTHERS_KEPT_OUT
    none += ["The license for the shop was renewed by the council.", "All rights to the song are reserved by its writer.", "You need permission before you copy the key of the building."]
    some = [w.format(n) for n in ("MIT License", "Apache License 2.0", "GNU General Public License, version 2", "Mozilla Public License 2.0", "CC BY-SA 4.0", "BSD 3-Clause License") for w in ("We give this away under the {}.", "Use of the data follows the {}.", "The team chose the {} for it.")]
    parts = [" ".join(p.split(" ")[2 * len(p.split(" ")) // 3 :]) for f in PASSAGES for p in PASSAGES[f] if len(p.split(" ")) >= 24]
    rows = [(x, "speaks") for x in none] + [(x, "known") for x in some + parts]
    assert not {x for x, _ in rows} & {r.line for r in known_wordings(spark).collect()}
    plain = docs.filter("doc_id % 3 = 0").selectExpr("explode(split(text, '\\n')) as line").filter("not lower(line) rlike 'licen|spdx|mozilla|creative commons|apache'").distinct()
    lines = spark.createDataFrame(rows, "line string, kind string").unionByName(plain.withColumn("kind", F.lit("plain")))
    got = model.scored(lines.select("line", "kind", grams(words(F.col("line"))).alias("g")).filter("size(g) > 0")).collect()
    assert [r.line for r in got if r.kind == "speaks" and r.p_known >= model.least] == []
    assert sum(r.p_known >= model.least for r in got if r.line in some) >= 17
    # Notices and parts of passages have the shares that the rows kept for calibration have.
    kept = [r.line for r in known_wordings(spark).filter("kept_out and family <> 'unknown'").collect()]
    body = sum(any(x in p for ps in PASSAGES.values() for p in ps) for x in kept) / len(kept)
    many = {k: sum(r.kind == k for r in got) for k in model.prior}
    share = lambda r: (body / len(parts) if r.line in parts else (1 - body) / len(some)) if r.kind == "known" else 1 / many[r.kind]
    # Single bins hold few sentences, so the gaps between what p says and what is so are weighed by the bins' mass.
    gap = mass = 0.0
    for lo, hi in ((0.05, 0.5), (0.5, 0.95), (0.95, 1.01)):
        held = [(model.prior[r.kind] * share(r), r.p_known, r.kind == "known") for r in got if lo <= r.p_known < hi]
        mass += sum(w for w, *_ in held)
        gap += abs(sum(w * p for w, p, _ in held) - sum(w * k for w, _, k in held))
    assert mass > 0.005 and gap / mass < 0.15


def test_paragraphs_end_at_blank_lines_or_at_the_longest_template(spark):
    """A text that wraps after every other word is one paragraph; a blank line ends it."""
    text = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files".split(" ")
    narrow = "\n".join(" ".join(text[i : i + 2]) for i in range(0, len(text), 2))
    rows = spark.createDataFrame([(0, 1, narrow), (1, 2, "one\n\ntwo"), (2, 3, "x\n" * 500)], "row long, doc_id long, text string")
    found = paragraphs(rows, []).filter("joined").collect()
    assert (0, len(text) // 2 - 1) in {(r.paragraph, r.last) for r in found if r.doc_id == 1}
    assert {(r.paragraph, r.last) for r in found if r.doc_id == 2} == {(0, 0), (2, 2)}
    assert max(r.last - r.paragraph for r in found if r.doc_id == 3) == LONGEST - 1 and len([r for r in found if r.doc_id == 3]) == 500
    docs = table(spark, SF, "documents").select("doc_id", "text")
    got = scan_licences(spark.createDataFrame([(1, "Some story.\n\n" + narrow + "\n\nAnd more.")], "doc_id long, text string"), train_licences(docs, Scratch(spark, "t")), Scratch(spark, "t")).collect()
    assert [(r.family, r.confirmed) for r in got] == [("MIT", True)]
