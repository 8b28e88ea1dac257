"""License scans over a positional rare-token index of licence notices.

The index holds, for each notice, its words of highest inverse document frequency (counted over all texts)
with their positions. Each text's occurrences of such words are looked up; a posting's position in its
notice puts the notice at one start in the text, so occurrences that belong together meet at the same
relative position. There the share of the notice's indexed weight that stands in place is summed and all its
mandatory key phrases are verified word by word. Each key phrase's own rarest word is always indexed, so no
place of a key phrase is missed. Notices are the customary passages of each licence; the words of an SPDX line are an anchor in the same
index, and the expression after it (identifiers joined by and, or, with) gives a label for each identifier it names.

Built-in functions only; each text is handled in its own row, nothing is exploded or shuffled but the
document frequencies of the notices' words (a fixed, small vocabulary).

Defined cases: a null text counts as empty: no words, no labels, score 0; repeated rows are scanned alike;
columns of the input other than id and text are ignored; places that overlap all count.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence notices as (label, notice, mandatory key phrases, whether the notice is one of the base set's phrases).
NOTICES = (
    ("mit", "under the mit license", ("under the mit license",), True),
    ("apache-2", "apache license version 2", ("apache license version 2",), True),
    ("cc-by-nc", "cc by nc", ("cc by nc",), True),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted free of charge to any person obtaining a copy",), False),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("you may not use this file except in compliance with the license", "apache org licenses license 2 0"), False),
    ("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license as published by the free software foundation", "version 2 of the license"), False),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license as published by the free software foundation", "version 3 of the license"), False),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",), False),
    ("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",), False),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",), False),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license as published by the free software foundation",), False),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license version 3",), False),
    ("agpl-3", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("gnu affero general public license as published by the free software foundation", "version 3 of the license"), False),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license v 2 0",), False),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "provided that the following conditions are met"), False),
    ("bsd-3", "may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software", "without specific prior written permission"), False),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("distribute this software for any purpose with or without fee is hereby granted",), False),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("without any express or implied warranty", "in no event will the authors be held liable"), False),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("free of charge to any person or organization", "accompanying documentation covered by this license"), False),
    ("boost", "distributed under the boost software license version 1 0", ("boost software license version 1 0",), False),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0", ("eclipse public license v 2 0",), False),
    ("epl-2", "terms of the eclipse public license 2 0 which is available at", ("eclipse public license 2 0",), False),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international",), False),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4 0 international",), False),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial 4 0 international",), False),
    ("cc-by-nd", "licensed under a creative commons attribution noderivatives 4 0 international license", ("creative commons attribution noderivatives 4 0 international",), False),
    ("cc0", "creative commons cc0 1 0 universal public domain dedication", ("cc0 1 0 universal",), False),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",), False),
    ("all-rights-reserved", "all rights reserved", ("all rights reserved",), False),
    ("mpl-2", "licensed under the mozilla public license version 2 0", ("mozilla public license version 2 0",), False),
    ("cc-by-nc-sa", "licensed under a creative commons attribution noncommercial sharealike 4 0 international license", ("creative commons attribution noncommercial sharealike 4 0 international",), False),
    ("cc-by-nc-nd", "licensed under a creative commons attribution noncommercial noderivatives 4 0 international license", ("creative commons attribution noncommercial noderivatives 4 0 international",), False),
    ("spdx", "spdx license identifier", ("spdx license identifier",), False),
)
#: Words of SPDX identifiers and exceptions (without a label) that an expression may name.
SPDX = (
    ("mit", "mit"), ("mit 0", "mit-0"), ("apache 1 1", "apache-1"), ("apache 2 0", "apache-2"), ("gpl 2 0", "gpl-2"), ("gpl 3 0", "gpl-3"), ("lgpl 2 0", "lgpl"), ("lgpl 2 1", "lgpl"), ("lgpl 3 0", "lgpl"), ("agpl 3 0", "agpl-3"),
    ("mpl 1 1", "mpl-1"), ("mpl 2 0", "mpl-2"), ("bsd 2 clause", "bsd"), ("bsd 2 clause patent", "bsd-patent"), ("bsd 3 clause", "bsd-3"), ("bsd 3 clause clear", "bsd-3-clear"), ("0bsd", "0bsd"), ("isc", "isc"), ("zlib", "zlib"), ("bsl 1 0", "boost"),
    ("epl 1 0", "epl-1"), ("epl 2 0", "epl-2"), ("cc by 3 0", "cc-by"), ("cc by 4 0", "cc-by"), ("cc by sa 3 0", "cc-by-sa"), ("cc by sa 4 0", "cc-by-sa"), ("cc by nc 4 0", "cc-by-nc"), ("cc by nd 4 0", "cc-by-nd"),
    ("cc by nc sa 4 0", "cc-by-nc-sa"), ("cc by nc nd 4 0", "cc-by-nc-nd"), ("cc0 1 0", "cc0"), ("unlicense", "unlicense"),
    ("classpath exception 2 0", ""), ("gcc exception 3 1", ""), ("llvm exception", ""), ("linux syscall note", ""), ("autoconf exception 3 0", ""),
)
#: Words that go on with an identifier, so that what stands before them is another one than it seems.
CONTINUES = (*"0123456789", "clause", "clear", "patent", "attribution", "lbnl", "modification", "open", "views", "nc", "nd", "sa", "igo", "cmu", "feh", "festival", "enna", "wu", "advertising", "variant", "exception")
#: Words of an SPDX expression that are looked at.
EXPRESSION = 64
#: Words are runs of a-z, 0-9 and anything beyond ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Added to a start, which is negative where a text lacks a notice's beginning.
OFFSET = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Notice:
    """A notice's indexed words as (word, position, weight), and its key phrases with their places in it."""

    label: str
    base: bool
    words: tuple[tuple[str, int, float], ...]
    phrases: tuple[tuple[int, tuple[str, ...]], ...]


def words(text_col: str) -> Column:
    """Words of a text, lower-cased in A to Z only."""
    plain = F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(plain, SEPARATORS), lambda w: w != "")


def vocabulary(notices=NOTICES) -> list[str]:
    return sorted({w for _, text, *_ in notices for w in text.split()})


def document_frequencies(docs: DataFrame, text_col: str = "text", notices=NOTICES) -> dict[str, int]:
    """In how many texts each word of the notices occurs, and the number of texts under ``""``. At most as many rows as the notices have words."""
    terms = vocabulary(notices)
    found = docs.select(F.explode(F.array_append(F.array_intersect(words(text_col), F.array(*map(F.lit, terms))), F.lit(""))).alias("w"))
    return {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}


def build_index(frequencies: dict[str, int], notices=NOTICES, most: int = 12) -> list[Notice]:
    """Index of the notices: the rarest words of each, the rarest of each of its key phrases among them."""
    n = frequencies.get("", 0)
    idf = lambda w: math.log((n + 1) / (frequencies.get(w, 0) + 0.5)) + 1e-6
    index = []
    for label, text, phrases, base in notices:
        own, keys = text.split(), [p.split() for p in phrases]
        at = [next(i for i in range(len(own)) if own[i : i + len(k)] == k) for k in keys]
        anchors = {max(range(i, i + len(k)), key=lambda j: (idf(own[j]), -j)) for i, k in zip(at, keys, strict=True)}
        least = 0.5 * max(idf(own[i]) for i in anchors)
        rest = sorted((i for i in range(len(own)) if i not in anchors and idf(own[i]) >= least), key=lambda i: (-idf(own[i]), i))
        chosen = sorted([*anchors, *rest[: max(0, most - len(anchors))]])
        index.append(Notice(label, base, tuple((own[i], i, max(idf(own[i]), 1e-6)) for i in chosen), tuple((i, tuple(k)) for i, k in zip(at, keys, strict=True))))
    return index


def _expression(tail: Column) -> Column:
    """Labels of the SPDX expression that an array of words starts with: identifiers joined by and, or and with, up to the first word that is none.

    Of identifiers that start alike the longest counts; one that a word of ``CONTINUES`` follows is not in the table, and ends the expression without a label.
    """
    names = sorted((name for name, _ in SPDX), key=lambda n: (-len(n), n))
    labels = F.create_map(*[F.lit(x) for pair in SPDX for x in pair])
    text = F.regexp_replace(F.array_join(tail, " "), " (?:or later|only)(?= |$)", "")

    def step(state: Column, operand: Column) -> Column:
        name = F.regexp_extract(operand, f"^({'|'.join(names)})(?= |$)", 1)
        rest = F.substring(operand, F.char_length(name) + 1, F.char_length(operand))
        known = state["open"] & (name != "") & ~F.regexp_extract(rest, "^ ([^ ]+)", 1).isin(*CONTINUES)
        label = F.coalesce(F.try_element_at(labels, name), F.lit(""))
        return F.struct((known & (rest == "")).alias("open"), F.when(known & (label != ""), F.array_append(state["labels"], label)).otherwise(state["labels"]).alias("labels"))

    start = F.struct(F.lit(True).alias("open"), F.array().cast("array<string>").alias("labels"))
    return F.array_distinct(F.aggregate(F.split(text, " (?:and|or|with) "), start, step, lambda s: s["labels"]))


def _scan(text_words: Column, index: list[Notice], least: float) -> Column:
    """Struct of a text's findings, from its array of words."""
    rare = sorted({w for n in index for w, *_ in n.words})
    postings = F.create_map(*[x for w in rare for x in (F.lit(w), F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.lit(p).cast("long").alias("p")) for t, n in enumerate(index) for v, p, _ in n.words if v == w]))])
    table = F.array(*[F.struct(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(p).alias("p"), F.lit(x).alias("x")) for w, p, x in n.words]).alias("words"), F.lit(sum(x for *_, x in n.words)).alias("all"), F.array(*[F.struct(F.lit(at).alias("at"), F.array(*map(F.lit, p)).alias("words")) for at, p in n.phrases]).alias("phrases"), F.lit(n.label).alias("label"), F.lit(n.base).alias("base")) for n in index])
    spread = 1 << 40  # notice number times this, plus start: one number for each place

    def of(w: Column) -> Column:
        hits = F.filter(F.transform(w, lambda x, i: F.when(x.isin(rare), i)), lambda i: i.isNotNull())
        codes = F.array_distinct(F.flatten(F.transform(hits, lambda i: F.transform(F.try_element_at(postings, F.get(w, i)), lambda p: p["t"] * spread + (i - p["p"] + OFFSET)))))

        def judge(code: Column) -> Column:
            notice, start = F.get(table, (code / spread).cast("long").cast("int")), (code % spread - OFFSET).cast("int")
            stands = lambda p: (start + p["at"] >= 0) & (F.slice(w, F.greatest(start + p["at"], F.lit(0)) + 1, F.size(p["words"])) == p["words"])
            whole = F.forall(notice["phrases"], stands)
            share = F.aggregate(notice["words"], F.lit(0.0), lambda s, x: s + F.when((start + x["p"] >= 0) & (F.get(w, start + x["p"]) == x["w"]), x["x"]).otherwise(0.0)) / notice["all"]
            return F.struct(notice["label"].alias("label"), notice["base"].alias("base"), start.alias("start"), whole.alias("whole"), share.alias("share"))

        def named(f: Column) -> Column:
            """A finding for each label of the expression that an SPDX anchor introduces."""
            return F.transform(_expression(F.slice(w, f["start"] + 4, EXPRESSION)), lambda label: F.struct(label.alias("label"), f["base"].alias("base"), f["start"].alias("start"), f["whole"].alias("whole"), f["share"].alias("share")))

        def told(found: Column) -> Column:
            anchors, others = (F.filter(found, lambda f: (f["label"] == "spdx") == spdx) for spdx in (F.lit(True), F.lit(False)))
            return F.concat(others, F.flatten(F.transform(anchors, named)))

        kept = F.filter(F.transform(codes, judge), lambda f: f["whole"] & (f["base"] | (f["share"] >= least)))
        return F.struct(F.size(w).cast("long").alias("n_words"), F.get(F.transform(F.array(kept), told), F.lit(0)).alias("found"))

    # as the item of a one-element array the words are split once, whatever refers to them
    return F.get(F.transform(F.array(text_words), of), F.lit(0))


def scan(docs: DataFrame, index: list[Notice], *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3) -> DataFrame:
    """Rows (id, n_words, found): the notices found, each with label, base, start and share of its weight in place."""
    return docs.select(F.col(id_col), _scan(words(text_col), index, least).alias("_s")).select(id_col, "_s.n_words", "_s.found")


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, labels and score of a scan; the score is the largest share."""
    base = F.filter("found", lambda f: f["base"])
    starts = F.transform("_base", lambda f: f["start"].cast("long"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda f: f["label"]))), ",")
    score = F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0))
    return found.withColumn("_base", base).select(id_col, "n_words", F.size("_base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined("_base").alias("base_labels"), joined("found").alias("labels"), F.least(score, F.lit(1.0)).alias("score"))


def split_words(text: str | None) -> list[str]:
    """The words of one text; for tests and small tools."""
    return [w for w in re.split(SEPARATORS, (text or "").translate(str.maketrans(_UPPER, _LOWER))) if w]
