"""Mixing sources to target weights by Poisson replication.

Each source's mean repetition rate is what brings its expected share of the output to its target weight. A
document's number of copies is the inverse Poisson distribution function, with its source's rate as mean, at
a number hashed from seed and id, so a document's copies never depend on partitioning or retries. Documents
are exploded by their counts and shuffled globally, by the hash of seed, id and copy.

Built-in functions only. Rates above ``PART`` are sums of several independent draws of equal mean.

Defined cases: a null source is a source of its own; a source without a target has weight 0 and is left
out, as is one with weight 0; a null id hashes like an empty one; rows with equal ids are drawn alike; with
an empty table or no positive weight the result is empty. The added columns must not be in ``docs``; columns of any other name may.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitwatch.functions.names import fresh
from hitwatch.llm import common

#: Mean of one draw at most: its probabilities stay clear of underflow.
PART = 500
#: Sources' names and distribution tables of up to so many bytes are broadcast; beyond it, both sides are salted and shuffled.
BROADCAST_BYTES = 16 << 20
SALTS = 32


def uniform(text: Column) -> Column:
    """Number in [0, 1) from the first 52 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_cdf(mean: Column) -> Column:
    """Array of the Poisson distribution function from 0 up to where its rest is lost in rounding."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.exp(-mean)
    state = F.struct(start.alias("p"), F.array(start).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), last), state, lambda s, j: F.struct((s["p"] * mean / j).alias("p"), F.array_append(s["c"], F.element_at(s["c"], -1) + s["p"] * mean / j).alias("c")), lambda s: s["c"])


def rates(docs: DataFrame, targets: dict[str | None, float] | None, *, source_col: str, temperature: float, total: int | None) -> DataFrame:
    """Rows (_hw_source, _hw_rate) of sources with a positive rate."""
    # a table, as it is used several times: the documents are counted once
    sizes = common.Stored(docs.groupBy(F.col(source_col).alias("_hw_source")).agg(F.count("*").alias("_hw_n")), "sources").df
    if targets is None:
        weighted = sizes.withColumn("_hw_w", F.pow(F.col("_hw_n").cast("double"), F.lit(temperature)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], "_hw_target string, _hw_w double")
        weighted = sizes.join(given, F.col("_hw_source").eqNullSafe(F.col("_hw_target"))).drop("_hw_target")
    sums = weighted.agg(F.sum("_hw_w").alias("w")).first()
    whole = sizes.agg(F.sum("_hw_n").alias("n")).first()["n"] if total is None else total
    share = F.col("_hw_w") / F.lit(sums["w"] or 1.0)
    return weighted.filter("_hw_w > 0").select("_hw_source", (share * F.lit(float(whole or 0)) / F.col("_hw_n")).alias("_hw_rate")).filter("_hw_rate > 0")


def mix(docs: DataFrame, targets: dict[str | None, float] | None = None, *, id_col: str = "doc_id", source_col: str = "source", temperature: float = 0.5, total: int | None = None, seed: int = 2024, copy_col: str = "copy_no", count_col: str = "n_copies", key_col: str = "mix_key") -> DataFrame:
    """``docs`` replicated to the target weights and shuffled, with copy number, number of copies and shuffle key.

    ``targets`` maps sources to weights; without it a source's weight is its size to the power
    ``temperature``. ``total`` is the expected number of rows, by default that of ``docs``.
    """
    if clash := {copy_col, count_col, key_col} & set(docs.columns):
        raise ValueError(f"columns are there already: {sorted(clash)}")
    rate = rates(docs, targets, source_col=source_col, temperature=temperature, total=total)
    source, parts, cdf, salt, own = fresh([*docs.columns, copy_col, count_col, key_col], "_hw_source", "_hw_parts", "_hw_cdf", "_hw_salt", "_hw_own")
    n_parts = F.ceil(F.col("_hw_rate") / PART).cast("int")
    table = rate.select(F.col("_hw_source").alias(source), n_parts.alias(parts), "_hw_rate").select(source, parts, poisson_cdf(F.col("_hw_rate") / F.col(parts)).alias(cdf))
    size = table.agg(F.sum(F.size(cdf) * 8 + F.coalesce(F.octet_length(F.col(source).cast("string")), F.lit(0)) + 64)).first()[0] or 0
    same = F.col(source_col).eqNullSafe(F.col(source))
    if size <= BROADCAST_BYTES:
        joined = docs.join(F.broadcast(table), same)
    else:
        salted = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.withColumn(own, F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int")).join(salted, same & (F.col(own) == F.col(salt))).drop(own, salt)
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    draw = lambda part: uniform(F.concat_ws("|", F.lit(str(seed)), part.cast("string"), name))
    # the array of one element holds each number, so that it is hashed once and not for each step of the function
    inverse = lambda u: F.size(F.filter(cdf, lambda c: c <= u))
    number = F.aggregate(F.transform(F.sequence(F.lit(1), F.col(parts)), draw), F.lit(0), lambda n, u: n + inverse(u))
    counted = joined.withColumn(count_col, number).drop(source, parts, cdf).filter(F.col(count_col) > 0)
    copies = counted.withColumn(copy_col, F.explode(F.sequence(F.lit(0), F.col(count_col) - 1)))
    keyed = copies.withColumn(key_col, F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("shuffle"), name, F.col(copy_col).cast("string")).cast("binary")))
    return keyed.repartition(key_col).sortWithinPartitions(key_col)


ORACLE_SQL = """
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
sums AS (SELECT sum(sqrt(n::DOUBLE)) AS w, sum(n) AS total FROM sizes),
rates AS (SELECT source, sqrt(n::DOUBLE) / w * total::DOUBLE / n AS rate FROM sizes, sums),
steps AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS j FROM rates),
cdf AS (SELECT source, j, sum(exp(-rate + j * ln(rate) - lgamma(j::DOUBLE + 1))) OVER (PARTITION BY source ORDER BY j) AS c FROM steps),
drawn AS (SELECT doc_id, source, text, ('0x' || substr(md5('2024|1|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496::DOUBLE AS u FROM documents),
counted AS (SELECT d.doc_id, d.source, d.text, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND c <= d.u) AS n_copies FROM drawn d)
SELECT doc_id, source, n_copies::INT AS n_copies, copy_no::INT AS copy_no,
  md5('2024|shuffle|' || coalesce(doc_id::VARCHAR, '') || '|' || copy_no) AS mix_key, md5(text) AS text_md5
FROM (SELECT *, unnest(range(0, n_copies)) AS copy_no FROM counted)
"""
