"""Registered queries of the subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitwatch.llm import bpe, common, langid, licenses, media, mixing, periodic, quality, simhash, tokenstore, topk, toxicity, variants, warc

#: Documents with a toxicity score of at least this are called toxic.
TOXIC_FROM = 0.3
#: Documents with a quality score of at least this are called good.
GOOD_FROM = 0.3


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of every document."""
    docs = common.read(spark, sf_dir, "documents")
    index = licenses.build_index(licenses.document_frequencies(docs))
    return licenses.report(licenses.scan(docs, index))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents replicated to weights by the square roots of their sources' sizes, and shuffled with their texts."""
    mixed = mixing.mix(common.read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "n_copies", "copy_no", "mix_key", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; labels of rows with crc32(doc_id) mod 4 = 2 are never used."""
    docs, labels = common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(common.crc_fold("doc_id", 4) != 2))
    scored = docs.select("doc_id", F.coalesce(common.crc_fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), toxicity.scorer(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of the text decoded from them."""
    docs = common.read(spark, sf_dir, "documents")
    return bpe.digests(bpe.round_trip(docs, tokenizer_path("byte_bpe_50k.json")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(common.read(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums and audio features of every document's bytes, read back from their stored form."""
    return media.digests(media.store(common.read(spark, sf_dir, "documents")), common.scratch(spark, "tensors"))


def op7_tokenstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the token shards, and a checksum of its ids read back from them."""
    folder = common.scratch(spark, "tokens")
    manifest = tokenstore.write(common.read(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"))
    return tokenstore.read(spark, folder, manifest)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from the archives that its legacy record was converted to."""
    folder = common.scratch(spark, "warc")
    files = warc.write(common.read(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; rows with crc32(doc_id) mod 5 = 0 are never learned from."""
    docs = common.read(spark, sf_dir, "documents")
    model = langid.train(docs.filter(common.crc_fold("doc_id", 5) != 0))
    held = F.coalesce(common.crc_fold("doc_id", 5) == 0, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), langid.predictor(docs, model).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best rows for every vector whose id is divisible by 50."""
    return topk.search(common.read(spark, sf_dir, "embeddings"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of rows with crc32(doc_id) mod 5 = 0 are never used."""
    docs, labels = common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels")
    model = quality.train(docs, labels.filter(common.crc_fold("doc_id", 5) != 0))
    held = F.coalesce(common.crc_fold("doc_id", 5) == 0, F.lit(False))
    scored = docs.select("doc_id", held.alias("held_out"), quality.scorer(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= GOOD_FROM).cast("int"))


def misspelt(docs: DataFrame, least: int = 7) -> DataFrame:
    """(word): the letter runs of every text in lower case (A to Z), some of which lose a letter, as a crc32 of document and run says; words of at least ``least`` code points."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    # a run that is too short stays so
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-z\u00C0-\u00FF]{{{least},}}"), F.lit(0))).alias("run"))
    low = found.select("doc_id", F.translate("run", capitals, capitals.lower()).alias("run"))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    hashed = low.select("run", F.crc32(name.cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return hashed.select(F.when(F.col("h") % 31 == 0, less).otherwise(F.col("run")).alias("word")).filter(F.char_length("word") >= least)


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents that occur twice at least."""
    return variants.groups(variants.counted(misspelt(common.read(spark, sf_dir, "documents"))))


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in documents whose id's crc32 is divisible by 10, the words from a place on repeat with a period; both follow from that crc32."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.filter(F.split("text", "[ \t-\r]+"), lambda w: w != "")).alias("w"))
    sized = words.select("*", F.size("w").cast("long").alias("n"), F.floor(F.col("h") / 10).alias("g"))
    placed = sized.select("*", F.when(F.col("n") > 0, F.col("g") % F.col("n")).alias("a"))
    period = F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8))
    ready = placed.select("*", period.alias("p"))
    cut = lambda x, a, n: F.slice(x, a.cast("int"), n.cast("int"))
    tail = F.flatten(F.array_repeat(cut("w", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    made = F.array_join(F.concat(cut("w", F.lit(1), F.col("a")), cut(tail, F.lit(1), F.col("n") - F.col("a"))), " ")
    return ready.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), made).otherwise(F.col("text")).alias("text"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, with repeats put in as the contract says."""
    docs = with_repeats(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    found = docs.select("doc_id", periodic.periodic_runs(F.col("text")).alias("r")).select("doc_id", "r.*").withColumn("b", F.get("runs", F.col("best")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    exponent = F.expr("b.length * 1000 div b.period")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "b.start", "b.length", "b.period", exponent.alias("exponent_milli"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"), "n_words")


QUERIES = {f.__name__: f for f in (op1_licenses, op2_mix, op3_toxicity, op4_bpe, op5_simhash, op6_media, op7_tokenstore, op8_warc, op9_langid, op10_topk, op11_quality, op12_variants, op13_periodic)}

#: DuckDB twins, for what SQL can express.
ORACLE: dict[str, str] = {
    "op2_mix": mixing.ORACLE_SQL,
    "op8_warc": warc.ORACLE_SQL,
    "op12_variants": variants.ORACLE_SQL,
    "op10_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.w) = len(c.w)),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
}
