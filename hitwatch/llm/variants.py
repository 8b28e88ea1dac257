"""Spelling variants: words one edit apart, found by asymmetric q-chunks, and the frequent form that each rare word stands for.

Of two words that differ by one inserted, deleted or replaced code point, the longer one (of equals: the one that sorts first)
contributes two disjoint chunks, its halves; the other contributes positional grams of the chunk's length. One edit leaves one chunk
whole, and as that is taken from the longer word, the gram that equals it stands at the chunk's place or one place to the left: the join is
within a shift of one. Grams at other places can meet no chunk and are not sent.

What a key leaves open is a gap in a word: the other half, where the edit must be. Keys with so many words that their pairs would cost more than
another key (``HOT``) are split: the gap's halves are chunks again, one of which is whole in both words, so that the key takes it up and the gap is half as long.
That goes on, for hot keys alone, down to a gap of one code point, where a key's words of one length differ only there: no key holds
more of them than there are letters. Nothing is capped, and no group is gathered. Pairs that share a key are verified
in the join itself (distance exactly one, first difference inside the gap), so each pair leaves it once.

Defined cases: null words are left out; words of any length take part, the empty one too; equal words must have been counted as one row
(``counted`` does so); an empty table gives an empty result. Order of words is by code point.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitwatch.llm import common

#: Pairs of a key from which it is split.
HOT = 4096


def counted(words: DataFrame, word_col: str = "word", *, least: int = 2) -> DataFrame:
    """Rows (word, n) of the words that occur at least so often; hot words are combined before the exchange."""
    return words.select(F.col(word_col).alias("word")).filter("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows (word, n, short, a, b, size) with the key of what stands outside the gap [a, b) of a word of ``size`` code points.

    ``short`` rows lack one code point of the gap, so what follows it stands one place to the left.
    """
    after = F.substring("word", F.col("b") + 1 - F.col("short").cast("int"), F.col("size"))
    return rows.withColumn("key", F.xxhash64("size", "a", "b", F.substring("word", F.lit(1), F.col("a")), after))


def _halves(first: Column, last: Column) -> Column:
    middle = F.floor((first + last) / 2).cast("int")
    parts = F.array(F.struct(first.alias("a"), middle.alias("b")), F.struct(middle.alias("a"), last.alias("b")))
    return F.filter(parts, lambda p: p["a"] < p["b"])


def _gaps(words: DataFrame) -> DataFrame:
    """Both halves of every word as gaps, among words of its length (chunks) and of those one longer (grams)."""
    size = F.char_length("word")
    roles = F.array(F.struct(F.lit(False).alias("short"), size.alias("size")), F.struct(F.lit(True).alias("short"), (size + 1).alias("size")))
    placed = words.select("word", "n", F.inline(roles))
    return placed.select("word", "n", "short", "size", F.inline(_halves(F.lit(0), F.col("size"))))


def _keys(words: DataFrame, hot: int) -> DataFrame:
    """Every word under keys of which none has more than ``hot`` pairs, but for those with gaps of one code point."""
    settled: list[DataFrame] = []
    rows = common.Stored(_keyed(_gaps(words)), "gaps").df
    while True:
        long, short = F.sum((~F.col("short")).cast("long")), F.sum(F.col("short").cast("long"))
        sizes = rows.filter("b > a + 1").groupBy("key").agg(long.alias("long"), short.alias("short"))
        # a key is a few words at least for each in this table, so it is a small part of them
        crowded = common.Stored(sizes.filter(F.col("long") * (F.col("long") + F.col("short")) > hot).select("key"), "crowded").df
        n = crowded.count()
        if not n:
            return reduce(DataFrame.unionByName, settled, rows)
        side = F.broadcast(crowded) if n <= common.BROADCAST_ROWS else crowded
        settled.append(rows.join(side, "key", "left_anti").select(*rows.columns))
        split = rows.join(side, "key", "left_semi").select("word", "n", "short", "size", F.inline(_halves(F.col("a"), F.col("b"))))
        rows = common.Stored(_keyed(split), "gaps").df


def near_pairs(words: DataFrame, *, hot: int = HOT) -> DataFrame:
    """Rows (u, u_n, v, v_n) of words (word, n; each once) one edit apart: u the longer one, or of equal length the one that sorts first."""
    rows = _keys(words.filter("word IS NOT NULL").select("word", "n"), hot)
    chunks = rows.filter("NOT short").select("key", "a", "b", F.col("word").alias("u"), F.col("n").alias("u_n"))
    grams = rows.select(F.col("key").alias("own"), "short", F.col("word").alias("v"), F.col("n").alias("v_n"))
    start = lambda word, end: F.substring(word, F.lit(1), F.col(end))
    met = (F.col("key") == F.col("own")) & (F.col("short") | (F.col("u") < F.col("v")))
    told = (start("u", "b") != start("v", "b")) & (start("u", "a") == start("v", "a")) & (F.levenshtein("u", "v", 1) == 1)
    return chunks.join(grams, met & told).select("u", "u_n", "v", "v_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: the last word on the way from form to form, in steps that double."""
    now = common.Stored(forms.select("word", F.col("form").alias("root")), "roots").df
    while True:
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        # only words whose root so far has a form itself move on; each form is the more frequent by a factor, so ways are short
        moved = common.Stored(now.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots").df
        now = moved.select("word", "root")
        if not moved.filter("moved").limit(1).count():
            return now


def groups(words: DataFrame, *, factor: int = 10, hot: int = HOT) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) for each word (word, n; each once).

    ``form`` is the most frequent word one edit away (ties: the one that sorts first) if it is ``factor`` times as frequent at least,
    and ``root`` where the way from form to form ends.
    """
    if factor < 2:
        raise ValueError("factor must be at least 2")
    words = common.Stored(words.filter("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n")), "words").df
    pairs = common.Stored(near_pairs(words, hot=hot), "near").df
    best = lambda n, word: F.struct((-F.col(n)).alias("less"), F.col(word).alias("form"))
    ways = [pairs.select(F.col(x).alias("word"), F.col(f"{x}_n").alias("n"), best(f"{y}_n", y).alias("near")) for x, y in ("uv", "vu")]
    alone = words.select("word", "n", F.lit(None).cast("struct<less:long,form:string>").alias("near"))
    told = alone.unionByName(ways[0]).unionByName(ways[1]).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), F.min("near").alias("near"))
    much = -F.col("near.less") >= factor * F.col("n")
    summed = common.Stored(told.select("word", "n", "n_near", F.when(much, F.col("near.form")).alias("form"), F.when(much, -F.col("near.less")).alias("form_n")), "variants").df
    roots = _roots(summed.filter("form IS NOT NULL"))
    return summed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE_SQL = """
WITH RECURSIVE crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
named AS (SELECT run, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs WHERE length(run) >= 7),
hashed AS (SELECT run, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM named, crc),
words AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word FROM hashed) WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
cuts AS MATERIALIZED (SELECT word, n, i, word[1 : i - 1] AS a, word[i + 1 :] AS b FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (SELECT x.word, x.n, y.word AS other, y.n AS other_n FROM cuts x JOIN cuts y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, x.n, y.word, y.n FROM cuts x JOIN words y ON x.a || x.b = y.word
  UNION SELECT y.word, y.n, x.word, x.n FROM cuts x JOIN words y ON x.a || x.b = y.word),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS r, count(*) OVER (PARTITION BY word) AS n_near FROM near),
told AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.r = 1),
way AS (SELECT word, word AS root FROM told UNION ALL SELECT way.word, told.form FROM way JOIN told ON way.root = told.word WHERE told.form IS NOT NULL),
last AS (SELECT way.word, way.root FROM way JOIN told ON way.root = told.word WHERE told.form IS NULL)
SELECT t.word, form, root, n::BIGINT AS n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM told t JOIN last USING (word)
"""
