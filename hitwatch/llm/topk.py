"""Exact top-k inner-product search over an impact-ordered, score-at-a-time index, in DataFrame functions alone.

Vectors become whole numbers (floor of ``scale`` times each component). A component's impact is its magnitude,
quantised against its vector's largest one in two digits, each with its sign: the first segment of postings holds the
leading digits, the second the next ones. A segment keeps a vector's postings as sets of dimensions, one 64-bit word
for each bit of impact, so 64 postings are scored by one ``bit_count`` of two words. Segments are taken up by descending
impact; what is left of a vector after a segment has a known length, which bounds (Cauchy-Schwarz) what the rest of
its postings can add.

Vectors lie in bands of length, the largest impacts of all being those of the longest vectors, and bands in blocks.

1. The longest vectors, and part of the others (``FIRST`` of ``PARTS`` hash classes), give each query a bar: the ``k``-th largest of the scores
   that different vectors are proved to reach. It only decides how early others can be left.
2. By descending length: a band whose longest vector cannot reach the bars of a pack of queries, and with it all shorter ones, is proved out and never
   meets that pack. Elsewhere a pair is left after the first segment, or after the second, if its bound proves that it stays below the
   bar. All others are possible members and are rescored exactly.

Equal vectors are one row of the index with their ``k + 1`` smallest ids, as no others can be among a query's best; so
a vector that very many rows share costs what one row costs. Rows are dealt by a hash of the vector, and so is a copy
of each group of queries; blocks shrink with the table so that all cores have some. Vectors of more than 64 dimensions use the same words
by a loop, which is not compiled and some hundred times slower a pair.

Defined cases: vectors that are null, empty or have null or non-finite components take no part, nor do
null ids; vectors of different lengths are not compared; a query's own id is no candidate, whatever rows
carry it; repeated query rows count once, rows of one id with different vectors are queries of their own; repeated candidate rows each count; ties go to the smaller id; fewer
candidates than ``k`` give them all; an empty table gives an empty result. Whole numbers beyond 64 bits become the
nearest 64-bit ones, and so do scores, which are then ordered by their floating-point values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hitwatch.functions.vectors import bound
from hitwatch.llm import common

#: Index rows of a block at most (about), and queries that meet a block together.
BLOCK_ROWS, PACK_ROWS, GROUP_PACKS = 16_384, 256, 16
#: Hash classes of vectors, and how many of them set the bars.
PARTS, FIRST = 64, 16
#: A block's rows that set bars are looked at in so many lots: each gives a query one score that is reached.
SLOTS = 4
#: Bands of length for each power of two.
BANDS = 4
#: Bits of impact of a vector's leading and next digits, and of a query's.
LEADING, NEXT, QUERY = 3, 3, 5
RADIX = 1 << NEXT
#: Share of a product of lengths that covers rounding in floating point.
SLACK = 1e-9
MOST = (1 << 63) - 1


def _words(digits: str, bits: int, words: int) -> list[Column]:
    """For each bit of the digits' magnitudes and then for their signs: sets of dimensions, ``words`` words each."""
    places = F.array(*[F.lit(1 << i if i < 63 else -1 << 63).cast("long") for i in range(64)])
    of = lambda x, p: F.when(x, p).otherwise(F.lit(0).cast("long"))
    tests = [lambda x, b=b: F.abs(x).cast("int").bitwiseAND(F.lit(1 << b)) != 0 for b in range(bits)]
    tests.append(lambda x: x < 0)
    sets = []
    for test in tests:
        one = [F.aggregate(F.zip_with(F.slice(digits, 64 * w + 1, 64), places, lambda x, p: of(test(x), p)), F.lit(0).cast("long"), lambda s, p: s.bitwiseOR(p)) for w in range(words)]
        sets.append(one[0] if words == 1 else F.array(*one))
    return sets


def _length(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x))


def _digits(df: DataFrame, top: int) -> DataFrame:
    """With the vector as doubles, its length, its step (the value of a last digit) and its digits up to ``top``."""
    x = df.withColumn("_x", F.transform("v", lambda e: e.cast("double")))
    largest = x.withColumn("_top", F.array_max(F.transform("_x", F.abs)))
    stepped = largest.withColumn("step", F.when(F.col("_top") > 0, F.col("_top") / top).otherwise(1.0)).withColumn("length", _length(F.col("_x")))
    return stepped.withColumn("_t", F.transform("_x", lambda e: F.rint(e / F.col("step")))).drop("_top")


def _rest(digits: str, unit: Column) -> Column:
    """Length of what the digits leave of the vector."""
    return _length(F.zip_with("_x", digits, lambda x, t: x - t * unit))


def _band(length: Column) -> Column:
    """Band of a length, or of a bar for one; those of 0 or less, and of lengths beyond all, are the lowest and the highest."""
    return F.when(length > 0, F.floor(F.log2(F.least(length, F.lit(1e300))) * BANDS)).otherwise(-BANDS * 1100).cast("int")


def index_rows(rows: DataFrame, words: int) -> DataFrame:
    """(dim, v, ids, block, part, band, length, step, rest_1, rest_2, a_*, b_*): the posting segments of each row's vector ``v``."""
    top = ((1 << LEADING) - 1) * RADIX + RADIX // 2 - 1
    split = _digits(rows, top).withColumn("_a", F.transform("_t", lambda t: F.rint(t / RADIX)))
    split = split.withColumn("_b", F.zip_with("_t", "_a", lambda t, a: t - a * RADIX))
    a, b = _words("_a", LEADING, words), _words("_b", NEXT, words)
    named = [c.alias(f"a_{i}") for i, c in enumerate(a)] + [c.alias(f"b_{i}") for i, c in enumerate(b)]
    return split.select("dim", "v", "place.*", _band(F.col("length")).alias("band"), "length", "step", _rest("_a", F.col("step") * RADIX).alias("rest_1"), _rest("_t", F.col("step")).alias("rest_2"), *named)


def query_rows(asked: DataFrame, words: int) -> DataFrame:
    """(dim, id, mark, v, q): ``q`` holds a query's length, step, rest and words."""
    made = _digits(asked, (1 << QUERY) - 1)
    sets = [c.alias(f"q_{i}") for i, c in enumerate(_words("_t", QUERY, words))]
    return made.select("dim", "id", "mark", "v", F.col("length").alias("q_length"), F.col("step").alias("q_step"), _rest("_t", F.col("step")).alias("q_rest"), *sets)


def _products(segment: str, bits: int, words: int) -> Column:
    """Inner product of a query's digits and those of a segment, from their sets of dimensions."""

    def of(q: list[Column], v: list[Column]) -> Column:
        other = q[-1].bitwiseXOR(v[-1])
        total = F.lit(0.0)
        for i in range(QUERY):
            for j in range(bits):
                both = q[i].bitwiseAND(v[j])
                total = total + F.bit_count(both).cast("double") * float(1 << i + j) + F.bit_count(both.bitwiseAND(other)).cast("double") * float(-2 << i + j)
        return total

    q, v = [F.col(f"q_{i}") for i in range(QUERY + 1)], [F.col(f"{segment}_{i}") for i in range(bits + 1)]
    if words == 1:
        return of(q, v)
    return F.aggregate(F.sequence(F.lit(0), F.lit(words - 1)), F.lit(0.0), lambda s, w: s + of([F.get(c, w) for c in q], [F.get(c, w) for c in v]))


def _never_null(df: DataFrame) -> DataFrame:
    """The same rows, with numbers that Spark knows are never null: code without null checks stays small enough to be compiled."""
    zero = {"bigint": F.lit(0).cast("long"), "double": F.lit(0.0)}
    return df.select(*[F.coalesce(F.col(c), zero[t]).alias(c) if t in zero else F.col(c) for c, t in df.dtypes])


def _exact(a: Column, b: Column) -> Column:
    """Struct (score, order): inner product as a 64-bit number, the nearest one where it does not fit, and as a double."""
    pairs = F.zip_with(a, b, lambda x, y: F.try_multiply(x, y))
    whole = F.aggregate(pairs, F.lit(0).cast("long"), lambda s, x: F.try_add(s, x))
    rough = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    near = F.when(rough >= float(MOST), F.lit(MOST)).when(rough <= -float(MOST), F.lit(-MOST)).otherwise(rough.cast("long"))
    return bound(whole, lambda w: F.when(w.isNotNull(), F.struct(w.alias("score"), w.cast("double").alias("order"))).otherwise(F.struct(near.alias("score"), rough.alias("order"))))


class Index:
    """Distinct vectors of a table with their posting segments, stored in the shared folder and dealt in blocks."""

    def __init__(self, base: DataFrame, k: int) -> None:
        facts = base.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
        n, self.words = facts["n"], max(1, -(-(facts["dim"] or 1) // 64))
        self.blocks = max(-(-n // BLOCK_ROWS), min(3 * base.sparkSession.sparkContext.defaultParallelism, -(-n // 128)), 1)
        # a row an id and vector; of each vector's ids the k + 1 smallest, cut down before rows are exchanged
        counted = base.groupBy("h", "dim", "v", "id").agg(F.count("*").alias("n"))
        ranked = counted.withColumn("r", F.row_number().over(W.partitionBy("h", "dim", "v").orderBy("id"))).filter(F.col("r") <= k + 1)
        merged = ranked.groupBy("h", "dim", "v").agg(F.sort_array(F.collect_list(F.struct("id", F.least("n", F.lit(k)).cast("int").alias("n")))).alias("ids"))
        block, part = F.pmod("h", F.lit(self.blocks)).cast("int"), F.pmod(F.shiftright("h", 32), F.lit(PARTS)).cast("int")
        placed = merged.select("dim", "v", F.struct("ids", block.alias("block"), part.alias("part")).alias("place"))
        self.rows = common.Stored(index_rows(placed, self.words), "topk").df
        # a row for each number of dimensions and band: lengths of doubles span some 8,000 bands at most
        self.bands = common.Stored(self.rows.groupBy("dim", "band").agg(F.max("length").alias("far"), F.count("*").alias("rows")), "topk_bands").df
        self.few = self.bands.count() <= common.BROADCAST_ROWS

    def longest(self) -> int:
        """The band from which up an eighth of the rows lie at most, over all numbers of dimensions."""
        sizes = self.bands.groupBy("band").agg(F.sum("rows").alias("rows")).orderBy(F.desc("band")).collect()
        most, above = sum(r["rows"] for r in sizes) // 8, 0
        for r in sizes:
            above += r["rows"]
            if above > most:
                return r["band"] + 1
        return 0

    def met(self, queries: DataFrame, rows: DataFrame, n_queries: int) -> DataFrame:
        """Pairs of queries and index rows: rows, and packs of queries, are dealt by band, block and group of packs; then packs are opened.

        Where queries have a ``bar``, packs hold queries of like bars for their length, and meet the bands alone that can reach the lowest of them.
        """
        packs = max(1, -(-n_queries // PACK_ROWS))
        groups = -(-packs // GROUP_PACKS)
        fields = [c for c in queries.columns if c != "dim"]
        # what a vector's length must be at least for the bar to be reached
        need = F.when((F.col("bar") > 0) & (F.col("q_length") > 0), F.col("bar") / F.col("q_length") * (1 - 2 * SLACK)).otherwise(0.0) if "bar" in fields else F.lit(0.0)
        rows, queries = _never_null(rows), _never_null(queries)
        packed = queries.groupBy("dim", F.floor(_band(need) / BANDS).alias("level"), F.pmod(F.xxhash64("id", "mark"), F.lit(packs)).cast("int").alias("pack")).agg(F.collect_list(F.struct(*fields)).alias("queries"), F.min(need).alias("need"))  # about PACK_ROWS each
        bands = self.bands.select("dim", "band", "far")
        reach = packed.join(F.broadcast(bands) if self.few else bands, "dim").filter("far >= need")
        asked = reach.select("dim", "band", "queries", F.pmod("pack", F.lit(groups)).alias("group"), F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))).alias("block"))
        dealt = rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        key, parts = ["block", "group", "dim", "band"], min(self.blocks * groups, 20_000)
        joined = dealt.repartition(parts, *key).join(asked.repartition(parts, *key), key)
        opened = joined.select(*dealt.columns, F.inline("queries").alias(*["q_v" if f == "v" else f for f in fields]))
        # a row that holds nothing but the query's own id is no candidate for it
        return opened.filter((F.size("ids") > 1) | (F.col("ids")[0]["id"] != F.col("id")))


def _bounds(words: int) -> tuple[Column, Column, Column, Column]:
    """After the first segment and after the second: score so far, and how far the exact score can be from it."""
    unit = F.col("q_step") * F.col("step")
    first = _products("a", LEADING, words) * RADIX
    both = first + _products("b", NEXT, words)
    slack = F.col("q_length") * F.col("length") * SLACK
    left = lambda rest: F.col("q_length") * rest + F.col("q_rest") * (F.col("length") + rest) + slack
    return first * unit, left(F.col("rest_1")), both * unit, left(F.col("rest_2"))


def with_bars(index: Index, asked: DataFrame, k: int) -> tuple[DataFrame, int]:
    """Queries with the score that their ``k`` best vectors reach at least, from part of the index, and the number of queries."""
    queries = common.Stored(query_rows(asked, index.words), "topk_queries").df
    n_queries, key = queries.count(), ["id", "mark"]
    *_, score, error = _bounds(index.words)
    first = index.rows.filter((F.col("part") < FIRST) | (F.col("band") >= index.longest())).drop("v").withColumn("slot", F.col("part") % SLOTS)
    shown = index.met(queries.drop("v"), first, n_queries).withColumn("least", F.explode(F.array(score - error)))
    reached = shown.groupBy("block", "band", "group", "dim", "slot", *key).agg(F.max("least").alias("bar"))
    place = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("bar"), "block", "band", "slot"))
    bars = reached.withColumn("r", place).filter(F.col("r") <= k).filter(F.col("r") == k).select(*key, "bar")
    return common.Stored(queries.join(bars, key, "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf")))), "topk_bars").df, n_queries


def search(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` best rows of ``vectors`` for those with ids divisible by ``every``."""
    x, most = F.col("_x").cast("array<double>"), float(MOST)
    sound = F.col("_x").isNotNull() & (F.size("_x") > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(x, lambda v: F.greatest(F.floor(F.greatest(F.least(v * float(scale), F.lit(most)), F.lit(-most))), F.lit(-MOST)))
    known = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("_x")).filter(F.col("id").isNotNull() & sound)
    base = known.select("id", whole.alias("v")).select("id", "v", F.size("v").alias("dim"), F.xxhash64("v").alias("h"))
    asked = base.filter(F.pmod("id", F.lit(every)) == 0).select("dim", "id", F.col("h").alias("mark"), "v").distinct()
    index, key = Index(base, k), ["id", "mark"]
    barred, n_queries = with_bars(index, asked, k)
    score_1, error_1, score_2, error_2 = _bounds(index.words)
    pairs = index.met(barred, index.rows, n_queries)
    left = pairs.filter(score_1 + error_1 >= F.col("bar"))
    # as a generated row the second bound is worked out behind the first filter, in a method of its own that is small enough to be compiled
    possible = left.withColumn("most", F.explode(F.array(score_2 + error_2))).filter("most >= bar")
    scored = possible.select(*key, "ids", _exact(F.col("q_v"), F.col("v")).alias("s"))
    members = scored.select(*key, "s", F.inline("ids").alias("vec_id", "n")).filter("vec_id <> id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    best = W.partitionBy(*key).orderBy(F.desc("s.score"), F.desc("s.order"), "vec_id", "copy")
    ranked = members.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select(F.col("id").alias("query_id"), "rank", "vec_id", F.col("s.score").alias("score"))
