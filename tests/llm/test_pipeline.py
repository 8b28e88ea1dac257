"""The corpus pipeline, stage by stage, against what each stage's operator says about its own input."""

import hashlib
import math
from collections import Counter

import corpus_pipeline as cp
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hitwatch.llm import common, toxicity
from tests.llm.test_learned import plain_grams
from tests.llm.test_mixing import copies
from tests.llm.test_simhash import plain_components, plain_fingerprint

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = common.read(spark, DATA, "documents"), [common.read(spark, DATA, "documents").collect()]
    for name, stage in cp.STAGES:
        docs = common.Stored(stage(spark, docs, DATA), f"test-{len(out)}").df
        out.append(docs.collect())
    return out


def test_columns_and_filters(stages):
    for rows in stages[1:-1]:
        assert tuple(rows[0].__fields__) == cp.COLUMNS
    for before, after in zip(stages[:3], stages[1:4], strict=True):
        assert not Counter(after) - Counter(before) and len(after) > 0.7 * len(before)


def plain_toxicity(text, model):
    """A text's score, gram by gram."""
    margin = model.bias + sum(model.weight[model.slot[b]] for b in plain_grams(text) if model.slot[b])
    return 1 / (1 + math.exp(-margin))


def test_toxicity_stage_decides_by_the_score(spark, stages):
    """The model is trained again on the same rows; every short enough document's score is worked out by loops, and every decision recomputed."""
    docs = common.read(spark, DATA, "documents")
    model = toxicity.train(docs, common.read(spark, DATA, "labels").filter(common.crc_fold("doc_id", 4) != 2))
    scores = dict(zip([r["doc_id"] for r in stages[0]], toxicity.score_texts([r["text"] for r in stages[0]], model), strict=True))
    for r in stages[0]:
        if len(r["text"] or "") < 6_000:
            assert abs(plain_toxicity(r["text"], model) - scores[r["doc_id"]]) < 1e-9
    kept = Counter(r for r in stages[0] if scores[r["doc_id"]] < 0.3)
    assert Counter(stages[1]) == kept and len(kept) < len(stages[0])


def test_odd_documents_go_through(spark, odd_docs):
    """Nulls, blanks, odd characters, very long texts, copies, repeated rows and columns named as helpers, stage by stage."""
    docs = odd_docs
    for i, (_, stage) in enumerate(cp.STAGES):
        before, docs = docs, common.Stored(stage(spark, docs, DATA), f"odd-{i}").df
        rows, given = docs.collect(), before.select(*cp.COLUMNS).collect() if i < len(cp.STAGES) else []
        if i == 0:
            assert not Counter(rows) - Counter(given) and {None, 0, 1, 2} <= {r["doc_id"] for r in rows}  # empty texts are not toxic
        elif i == 1:
            assert Counter(rows) == Counter(r for r in given if r["text"] and any(c.isalpha() for c in r["text"]))
        elif i == 2:
            prints = [plain_fingerprint(r["text"]) for r in given]
            firsts = {}
            for r, p in zip(given, prints, strict=True):
                firsts.setdefault(p, []).append(r)
            assert len(rows) <= len(firsts) and len(rows) == len({plain_fingerprint(r["text"]) for r in rows}) and 8 in {r["doc_id"] for r in rows} and 9 not in {r["doc_id"] for r in rows}
        elif i == 3:
            assert docs.columns == list(cp.COLUMNS) and set(rows) <= set(given)
        else:
            lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            assert Counter((r["doc_id"], r["n_tokens"]) for r in rows) == Counter((r["doc_id"], len(lib.encode(r["text"] or "", add_special_tokens=False).ids)) for r in given)


def test_no_documents_go_through(spark, no_docs):
    docs = no_docs
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_language_stage_keeps_what_has_letters(stages):
    assert Counter(stages[2]) == Counter(r for r in stages[1] if r["text"] and any(c.isalpha() for c in r["text"]))


def test_one_document_of_each_group_stays(stages):
    rows = stages[2]
    roots = plain_components([plain_fingerprint(r["text"]) for r in rows], [r["doc_id"] for r in rows])
    assert sorted(r["doc_id"] for r in stages[3]) == sorted(set(roots))


def test_mixing_stage(stages):
    sizes = Counter(r["source"] for r in stages[3])
    weights = {s: n**0.5 for s, n in sizes.items()}
    total = sum(weights.values())
    want = Counter()
    for r in stages[3]:
        want[r] += copies(r["doc_id"], weights[r["source"]] / total * len(stages[3]) / sizes[r["source"]])
    assert Counter(stages[4]) == +want


def test_tokens_of_every_copy(stages):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in stages[4]:
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        want[(r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, stages[5])) == want


def test_run_gives_the_last_stage(spark, stages):
    assert Counter(cp.run(spark, DATA).collect()) == Counter(stages[-1])
