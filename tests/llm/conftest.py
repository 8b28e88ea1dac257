import random

import pytest

WORDS = "the of and thing over stone river light under mill green water house quiet north seven".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, blanks, odd characters, very long texts, copies, repeated rows and clashing extra columns."""
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    long = prose(40_000)
    copy = prose(80)
    texts = {
        0: None, 1: "", 2: " \n\t ", 3: "a", 4: "Ünïcödé straße été", 5: "日本語の テキスト", 6: "x<|endoftext|>y  z\n\n", 7: long, 8: copy, 9: copy, 10: copy + " end",
        11: "Under the MIT License. under the MIT LICENSE", 12: "Apache License, Version 2.0; CC BY-NC 4.0", 13: "\x00\x1c control \x85 marks",
    }
    texts |= {i: prose(rng.randrange(1, 120)) for i in range(14, 60)}
    rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in texts.items()]
    rows += [rows[8], (None, copy, "en", "s0", 1)]
    rows = [(*r, 0.5, -1, "x", "y", "z", 3) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, ids long, fingerprint string, _id string, _text string, n_words int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
