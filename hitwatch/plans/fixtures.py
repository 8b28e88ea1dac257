"""Event, hit, vector and score tables over the driver's star-schema files, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitwatch.operators.hits import index_hits
from hitwatch.operators.index import event_order, indexed
from hitwatch.operators.windows import Layout, frames_of_hits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, subrun, evt, file_idx, entry): an event for each order."""
    key = F.col("o_orderkey").cast("long")
    return table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("run"), F.month("o_orderdate").cast("long").alias("subrun"), key.alias("evt"), (F.col("o_custkey") % 4).cast("long").alias("file_idx"), key.alias("entry"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(evt, plane, channel, integral, wire, tpc): a hit for each order line."""
    as_long = lambda c: F.col(c).cast("long")
    return table(spark, sf_dir, "lineitem").select(as_long("l_orderkey").alias("evt"), (as_long("l_linenumber") % 3).alias("plane"), as_long("l_suppkey").alias("channel"), F.col("l_quantity").cast("double").alias("integral"), as_long("l_partkey").alias("wire"), (as_long("l_linenumber") % 2).alias("tpc"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, x, label)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"), (F.col("label") == 0).cast("int").alias("label"))


def ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(evt, channel, quantity, discount, tax): arrays of an order's lines, a few at most, in a fixed order."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("evt")).agg(F.sort_array(F.collect_list(line)).alias("_l"))
    pick = lambda f: F.transform("_l", lambda s: s[f])
    return rows.select("evt", F.transform("_l", lambda s: s["l_suppkey"] - 5).alias("channel"), pick("l_quantity").alias("quantity"), pick("l_discount").alias("discount"), pick("l_tax").alias("tax"))


def labelled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(score, label): text length and toxicity label of labelled documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("label")), "doc_id").select("score", "label")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, v, label): values of the event stream; event ids are dense and in time order."""
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("t"), F.col("value").cast("double").alias("v"), (F.col("event_type") == "error").cast("int").alias("label"))


def files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(path, run) and (run, good): a file for each customer."""
    rows = table(spark, sf_dir, "customer")
    paths = rows.select(F.concat(F.lit("/data/DQM_"), "c_name", F.lit(".root")).alias("path"), F.col("c_custkey").cast("long").alias("run"))
    return paths, rows.select(F.col("c_custkey").cast("long").alias("run"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD").alias("good"))


class Prepared:
    """Indexed events, their number, and indexed hits of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.events, self.n = indexed(events(spark, sf_dir), event_order(), "event_idx")
        self.hits = index_hits(hits(spark, sf_dir), self.events, n_events=self.n)

    def frames(self, layout: Layout) -> DataFrame:
        return frames_of_hits(self.hits, layout, self.n)


#: SQL of the indexed events (idx) and hits (ih).
SQL_HITS = """
ev AS (SELECT year(o_orderdate)::BIGINT AS run, month(o_orderdate)::BIGINT AS subrun, o_orderkey::BIGINT AS evt, (o_custkey % 4)::BIGINT AS file_idx, o_orderkey::BIGINT AS entry FROM orders),
idx AS (SELECT *, row_number() OVER (ORDER BY run, subrun, evt, file_idx, entry) - 1 AS event_idx FROM ev),
hit AS (SELECT l_orderkey::BIGINT AS evt, l_suppkey::BIGINT AS channel, l_quantity::DOUBLE AS integral FROM lineitem),
ih AS (SELECT h.*, i.event_idx FROM hit h JOIN idx i USING (evt))"""

#: SQL of the order lines with their place in the order.
SQL_LINES = """
lines AS (SELECT l_orderkey::BIGINT AS evt, l_suppkey - 5 AS channel, l_quantity, l_discount, l_tax,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax) - 1 AS i,
  count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"""


def sql_bin(pos: str, layout: Layout) -> str:
    q, r = divmod(layout.size, layout.bins)
    return f"({pos}) // {q + 1}" if q == 0 else f"CASE WHEN ({pos}) < {r * (q + 1)} THEN ({pos}) // {q + 1} ELSE {r} + (({pos}) - {r * (q + 1)}) // {q} END"


def sql_frames(layout: Layout) -> str:
    """SQL of window count (nw), frames and assembled windows (asm), by the plain definition."""
    return f"""{SQL_HITS},
nw AS (SELECT CASE WHEN count(*) >= {layout.span} THEN (count(*) - {layout.span}) // {layout.stride} + 1 ELSE 0 END AS nw FROM ev),
wins AS (SELECT unnest(range(0, nw)) AS window_id FROM nw),
uses AS (SELECT window_id, w, window_id * {layout.stride} + w * {layout.size} AS frame_start FROM wins, (SELECT unnest(range(0, {layout.history + 1})) AS w)),
starts AS (SELECT DISTINCT frame_start FROM uses),
raw AS MATERIALIZED (SELECT frame_start, channel, {sql_bin("event_idx - frame_start", layout)} AS bin, sum(integral) AS sum, count(*) AS cnt, min(integral) AS min, max(integral) AS max, sum(integral * integral) AS sq
  FROM (SELECT *, unnest(range(greatest(event_idx - {layout.size - 1}, 0), event_idx + 1)) AS frame_start FROM ih) JOIN starts USING (frame_start) GROUP BY ALL),
frames AS MATERIALIZED (SELECT frame_start, channel, bin, sum, cnt, sum / cnt AS mean, min, max, sqrt(greatest(sq / cnt - (sum / cnt) * (sum / cnt), 0)) AS stdev FROM raw),
asm AS MATERIALIZED (SELECT window_id, w, f.* FROM uses u JOIN frames f USING (frame_start))"""


SQL_NODES = """
act AS MATERIALIZED (SELECT window_id, channel FROM asm WHERE w < {history} GROUP BY ALL HAVING sum(abs(sum) + abs(min) + abs(max) + abs(stdev) + abs(cnt)) > 1e-6),
kept AS (SELECT * FROM act UNION ALL SELECT window_id, 0 FROM wins WHERE window_id NOT IN (SELECT window_id FROM act)),
nodes AS MATERIALIZED (SELECT window_id, channel, row_number() OVER (PARTITION BY window_id ORDER BY channel) - 1 AS node_rank, count(*) OVER (PARTITION BY window_id) AS m FROM kept)"""
