"""Corpus pipeline: toxicity, language, near-duplicates, source mixing, token ids; each stage takes what the one before kept.

Defined cases: a null text counts as empty; an empty one, or one without letters, passes toxicity (unless the model calls texts without features
toxic) and leaves at language ID, as its language is unknown. Of repeated rows, and of rows that share an id but not their text, each is judged by its own
text; of each group of near duplicates one row stays, so one of repeated rows. Rows with a null id take part, and are the first of their group only if
all its rows are such. A null source is a source of its own. Columns besides ``COLUMNS`` are dropped by the first stage, whatever their names. An empty table gives an
empty result, as does one that a stage leaves nothing of; without labelled rows the toxicity stage keeps or drops all by the smoothed share of label 1.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hitwatch.llm import bpe, common, langid, mixing, simhash, toxicity
from hitwatch.llm.queries import TOXIC_FROM, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject; it learns from the labelled ones among them."""
    model = toxicity.train(docs, common.read(spark, sf_dir, "labels").filter(common.crc_fold("doc_id", 4) != 2))
    return docs.select(*COLUMNS).filter(toxicity.scorer(docs, model) < TOXIC_FROM)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; those without any letter go."""
    model = langid.train(docs.filter(common.crc_fold("doc_id", 5) != 0))
    return docs.select(*COLUMNS).filter(langid.predictor(docs, model)["lang_pred"] != langid.UNKNOWN)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest id, nulls last, then by the row's hashes.

    Near duplicates are those of the SimHash operator: three-word shingles, 3 or fewer of 64 bits apart.
    """
    return simhash.keep_first(docs.select(*COLUMNS), repeats=False)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their sources' target weights and shuffled."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document copy: digests of its token ids and of the text decoded from them."""
    return bpe.digests(bpe.round_trip(docs, tokenizer_path("byte_bpe_50k.json")))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", clean),
    ("language ID", known_language),
    ("SimHash near-dedup", one_of_each),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", tokens),
]

#: The learned stages have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result but the last is a table in the shared folder."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.Stored(stage(spark, docs, sf_dir), name.replace(" ", "_")).df
    return STAGES[-1][1](spark, docs, sf_dir)
