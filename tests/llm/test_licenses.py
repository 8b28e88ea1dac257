import math
import random
import re

from hitwatch.llm import licenses

BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def report(docs):
    return licenses.report(licenses.scan(docs, licenses.build_index(licenses.document_frequencies(docs))))


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for label, phrase in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_columns_equal_brute_force(odd_docs):
    rows = report(odd_docs).join(odd_docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(rows) >= 60
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(r["text"]), r["doc_id"]
        assert 0 <= r["score"] <= 1


def test_every_row_is_kept(odd_docs, no_docs):
    assert report(odd_docs).count() == odd_docs.count()
    assert report(no_docs).count() == 0


def test_overlaps_repeats_and_text_edges(spark):
    line = "under the mit license "
    texts = [line * 2000, "mit license", "cc by nc by nc", "the mit license", "UNDER-THE*MIT_LICENSE", "under thé mit license", line.strip()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in report(df).join(df, "doc_id").collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(r["text"])


def test_own_labels(spark):
    texts = [
        "This work is licensed under the GNU General Public License, version 3.", "All rights reserved.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "GNU General Public License", "plain words about a license", "Licensed under a Creative Commons Attribution 4.0 International License",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["labels"] for r in report(df).orderBy("doc_id").collect()]
    assert got == ["gpl-3", "all-rights-reserved", "bsd", "", "", "cc-by"]


def plain_expression(words):
    """Labels of an SPDX expression, word by word."""
    table = {tuple(name.split()): label for name, label in licenses.SPDX}
    words, labels, i = words[: licenses.EXPRESSION], [], 0
    while True:
        name = max((n for n in table if tuple(words[i : i + len(n)]) == n), key=len, default=None)
        if name is None:
            return labels
        i += len(name)
        i += 2 if words[i : i + 2] == ["or", "later"] else words[i : i + 1] == ["only"]
        after = words[i] if i < len(words) else None
        if after in licenses.CONTINUES:
            return labels
        labels += [table[name]] if table[name] else []
        if after not in ("and", "or", "with"):
            return labels
        i += 1


def brute_labels(text, index, least=0.3):
    """Labels and score of the whole method: every notice at every start of the text."""
    words = licenses.split_words(text)
    labels, best = set(), 0.0
    for n in index:
        for start in range(-60, len(words)):
            if all(start + at >= 0 and tuple(words[start + at : start + at + len(p)]) == p for at, p in n.phrases):
                share = sum(x for w, i, x in n.words if 0 <= start + i < len(words) and words[start + i] == w) / sum(x for *_, x in n.words)
                if n.base or share >= least:
                    own = [n.label] if n.label != "spdx" else plain_expression(words[start + 3 :])
                    labels |= set(own)
                    best = max(best, share if own else 0.0)
    return ",".join(sorted(labels)), best


def test_labels_and_scores_equal_brute_force(spark, odd_docs):
    notices = {t: label for label, t, _, _ in licenses.NOTICES}
    texts = [f"start {t} end" for t in notices] + [t.title() for t in notices] + [" ".join(t.split()[2:]) for t in notices] + [" ".join(t.split()[:-1]) for t in notices] + [r["text"] for r in odd_docs.collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = licenses.build_index(licenses.document_frequencies(df))
    for r in licenses.report(licenses.scan(df, index)).collect():
        labels, score = brute_labels(texts[r["doc_id"]], index)
        assert r["labels"] == labels and abs(r["score"] - score) < 1e-9, texts[r["doc_id"]]
        if r["doc_id"] < 2 * len(notices) and "spdx" not in texts[r["doc_id"]].lower():
            assert notices[list(notices)[r["doc_id"] % len(notices)]] in labels.split(",")


def test_customary_notices_and_near_misses(spark):
    texts = [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "// SPDX-License-Identifier: BSD-3-Clause", "# SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: BSD-4-Clause", "SPDX-License-Identifier: Proprietary",
        "under the terms of the GNU General Public Licence as published by the Free Software Foundation", "you can redistribute it under the terms of some General Public License, version 3 of the License",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose is refused", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["labels"] for r in report(df).orderBy("doc_id").collect()] == ["gpl-3", "bsd-3", "gpl-2", "", "", "", "", "bsd-3", "", "cc-by-sa"]


def test_index_always_holds_a_word_of_each_key_phrase():
    for n in licenses.build_index({"": 1000, "mit": 999, "nc": 1000, "license": 3}):
        assert all(any(at <= p < at + len(words) for _, p, _ in n.words) for at, words in n.phrases)
        assert all(math.isfinite(x) and x > 0 for *_, x in n.words)


def test_plan_has_no_python(spark, odd_docs):
    plan = report(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


EXPRESSIONS = {
    "SPDX-License-Identifier: MIT-0": "mit-0", "SPDX-License-Identifier: BSD-3-Clause-Clear": "bsd-3-clear", "SPDX-License-Identifier: MIT OR Apache-2.0": "apache-2,mit", "SPDX-License-Identifier: (BSD-3-Clause AND MIT)": "bsd-3,mit",
    "SPDX-License-Identifier: LGPL-2.0-only": "lgpl", "SPDX-License-Identifier: 0BSD": "0bsd", "SPDX-License-Identifier: CC-BY-NC-SA-4.0": "cc-by-nc,cc-by-nc-sa", "# SPDX-License-Identifier: MIT\n# Copyright 2020 and Apache-2.0 is not meant": "mit",
    "SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 OR (Apache-2.0 AND ISC) */ int x": "apache-2,gpl-2,isc", "SPDX-License-Identifier: BSD-4-Clause OR MIT": "", "SPDX-License-Identifier: MIT OR Proprietary OR ISC": "mit",
    "SPDX-License-Identifier: BSD-3-Clause-Attribution": "", "SPDX-License-Identifier: GPL-3.0-only AND MPL-2.0": "gpl-3,mpl-2", "SPDX-License-Identifier:": "", "SPDX-License-Identifier: MIT AND": "mit", "SPDX-License-Identifier: MIT SPDX-License-Identifier: ISC": "isc,mit",
    "Mozilla Public License Version 2.0": "mpl-2", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International": "cc-by-nc-sa", "or later only and with": "", "SPDX-License-Identifier: MITX": "",
}


def test_expressions(spark):
    df = spark.createDataFrame(list(enumerate(EXPRESSIONS)), "doc_id long, text string")
    got = {list(EXPRESSIONS)[r["doc_id"]]: r["labels"] for r in report(df).collect()}
    assert got == EXPRESSIONS


def test_expressions_equal_brute_force(spark):
    """Expressions at random of identifiers, their parts, operators and other words."""
    rng = random.Random(8)
    parts = [n for n, _ in licenses.SPDX] + ["and", "or", "with", "or later", "only", "mit", "copyright", "0", "clause", "spdx license identifier", "bsd", "cc by"]
    texts = ["spdx license identifier " + " ".join(rng.choice(parts) if i % 2 else rng.choice(parts[: len(licenses.SPDX)]) for i in range(rng.randrange(1, 60))) for _ in range(400)]
    texts += ["spdx license identifier " + " ".join(rng.choice([n for n, _ in licenses.SPDX]) + rng.choice([" and ", " or ", " with ", " or later or ", " only and "]) for _ in range(rng.randrange(1, 30))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = licenses.build_index(licenses.document_frequencies(df))
    for r in licenses.report(licenses.scan(df, index)).collect():
        assert (r["labels"], r["score"]) == (brute_labels(texts[r["doc_id"]], index)[0], r["score"]), texts[r["doc_id"]]
