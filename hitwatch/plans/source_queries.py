"""Queries over sources and sinks, names and keys, pairs, caps and losses. Files are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitwatch.functions import keys
from hitwatch.functions import vectors as vec
from hitwatch.operators import geometry, hits, index, metrics, score, splits, windows
from hitwatch.operators.windows import Layout
from hitwatch.plans import fixtures as fx
from hitwatch.plans.registry import query, rounded
from hitwatch.sources import event_batches, files
from hitwatch.sources import event_store as store
from hitwatch.sources.scratch import scratch

# --- files ------------------------------------------------------------------------------------------------------


def _event_files(spark: SparkSession, sf_dir: str) -> str:
    """Folder with the events, a subfolder of Parquet files for each source file number."""
    path = scratch(spark, "files")
    fx.events(spark, sf_dir).withColumnRenamed("file_idx", "file").write.partitionBy("file").parquet(path)
    return path


def _with_folder_index(df: DataFrame) -> DataFrame:
    """``file_idx`` by the subfolder that a row's file lies in."""
    return files.with_file_index(df.withColumn("source_file", F.regexp_extract("source_file", r"^(.*)/[^/]*$", 1)))


@query("SELECT year(o_orderdate)::BIGINT AS run, o_orderkey::BIGINT AS evt, (o_custkey % 4)::BIGINT AS file_idx FROM orders")
def event_files(spark, sf_dir):
    """Events of the files that a list names by globs, with the number of their source."""
    path = _event_files(spark, sf_dir)
    spark.createDataFrame([("# sources",), ("",), (f"{path.removeprefix('file://')}/file=[01]/*.parquet ",), (f"{path.removeprefix('file://')}/file=[23]/*.parquet",)], "value string").coalesce(1).write.text(f"{path}-list/inputs.txt")
    paths = files.resolve_inputs(spark, files.read_manifest(spark, f"{path}-list/inputs.txt"))
    rows = files.read_events(spark, paths, files.input_columns(["run", "evt"], ["evt"]))
    return _with_folder_index(rows).select("run", "evt", "file_idx")


@query("SELECT year(o_orderdate)::BIGINT AS run, o_orderkey::BIGINT AS evt FROM orders WHERE o_custkey % 4 IN (1, 2)")
def event_file_slice(spark, sf_dir):
    """Events of the second and third source, as one of several jobs would take them."""
    path = _event_files(spark, sf_dir)
    paths = files.file_slice(files.resolve_inputs(spark, f"{path.removeprefix('file://')}/file=*"), 1, 2)
    return files.read_events(spark, paths, ["run", "evt"]).select("run", "evt")


@query("SELECT year(o_orderdate)::BIGINT AS run, o_orderkey::BIGINT AS evt, 1::BIGINT AS n_unread FROM orders")
def lenient_event_files(spark, sf_dir):
    """Events of all sound files, beside one that is missing and one that cannot be read, which is reported."""
    path = _event_files(spark, sf_dir)
    spark.range(1).select(F.lit("no Parquet").alias("value")).coalesce(1).write.text(f"{path}-bad")
    bad = files.resolve_inputs(spark, f"{path.removeprefix('file://')}-bad/part-*")
    schema = fx.events(spark, sf_dir).drop("file_idx").schema
    paths = [*files.resolve_inputs(spark, f"{path.removeprefix('file://')}/file=*"), *bad, f"{path}/absent"]
    rows = files.read_events(spark, paths, ["run", "evt"], schema=schema, on_missing="skip")
    unread = files.unread_files(rows, paths, pattern="part-*").agg(F.count("*").alias("n_unread"))
    return rows.select("run", "evt").crossJoin(F.broadcast(unread))


@query("SELECT value, count(*) AS n FROM (SELECT l_quantity AS value FROM lineitem UNION ALL SELECT l_discount FROM lineitem) GROUP BY value")
def flat_values(spark, sf_dir):
    """How often each value of a nested branch occurs."""
    rows = fx.ragged(spark, sf_dir).select(F.array("quantity", "discount").alias("nested"))
    return files.flat_values(rows, "nested").groupBy("value").agg(F.count("*").alias("n"))


@query(f"WITH {fx.SQL_HITS}, c AS (SELECT event_idx, count(*) AS n, sum(integral) AS total FROM ih GROUP BY event_idx) SELECT event_idx, run, subrun, evt, coalesce(n, 0)::BIGINT AS n_hits, coalesce(total, 0)::DOUBLE AS total, 0::BIGINT AS n_times FROM idx LEFT JOIN c USING (event_idx)")
def event_store(spark, sf_dir):
    """Indexed events and hits saved and loaded; columns that were not saved are null."""
    p, path = fx.Prepared(spark, sf_dir), scratch(spark, "store")
    files.save_events(p.events, p.hits.select("event_idx", "channel", "integral"), path)
    events, rows = files.load_events(spark, path)
    counts = rows.groupBy("event_idx").agg(F.count("*").alias("n"), F.sum("integral").alias("t"), F.count("time").alias("times"))
    filled = lambda c, zero: F.coalesce(c, F.lit(zero))
    return events.join(counts, "event_idx", "left").select("event_idx", "run", "subrun", "evt", filled("n", 0).cast("long").alias("n_hits"), filled("t", 0.0).alias("total"), filled("times", 0).cast("long").alias("n_times"))


def _sorted_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """Folders of four sources of different sizes, each one Parquet file of events sorted by their number, with small row groups."""
    path = scratch(spark, "sources")
    rows = fx.events(spark, sf_dir).select("run", "evt", F.least(F.col("evt") % 7, F.lit(3)).alias("file"))
    rows.repartition("file").sortWithinPartitions("file", "evt").write.option("parquet.block.size", 1 << 20).partitionBy("file").parquet(path)
    return [f"{path}/file={i}" for i in range(4)]


_NUMBERED = "WITH e AS (SELECT year(o_orderdate)::BIGINT AS run, o_orderkey::BIGINT AS evt, row_number() OVER (ORDER BY least(o_orderkey % 7, 3), o_orderkey) - 1 AS i FROM orders)"


@query(f"{_NUMBERED} SELECT run, evt, i // 512 AS batch, i % 512 AS place FROM e")
def event_batches_over_files(spark, sf_dir):
    """Events of several files in batches of 512 that go over file borders."""
    return event_batches.with_batches(spark, _sorted_files(spark, sf_dir), 512)


@query(f"{_NUMBERED} SELECT run, evt, i // 4096 AS batch, i % 4096 AS place, i // 4096 AS arrival FROM e")
def event_batch_stream(spark, sf_dir):
    """The same events by streams that admit 4,096 a micro-batch, each a stretch of the batches."""
    paths, folder = _sorted_files(spark, sf_dir), scratch(spark, "arrivals")
    schema = spark.read.parquet(paths[0]).schema
    streams = min(8, spark.sparkContext.defaultParallelism)
    return event_batches.side_by_side(spark, paths, schema, 4096, f"{folder}/rows", f"{folder}/checkpoint", streams)


_STORE_LAYOUT = Layout(20, 20, 4, 4)


@query(f"WITH {fx.sql_frames(_STORE_LAYOUT)} SELECT frame_start, channel, bin, sum, cnt, round(mean, 6) AS mean, min, max, round(stdev, 6) AS stdev FROM frames")
def event_store_frames(spark, sf_dir):
    """Frames from the bucketed event store, which needs no index and no join: the first half of its windows and the rest, read apart."""
    p, path = fx.Prepared(spark, sf_dir), scratch(spark, "buckets")
    store.save(p.events, p.hits.select("event_idx", "channel", "integral", "plane"), path, per_bucket=1000)
    n, step = _STORE_LAYOUT.count(p.n), _STORE_LAYOUT.stride
    half, last_frame = n // 2, _STORE_LAYOUT.span - _STORE_LAYOUT.size
    frames = windows.frames_of_hits(store.hits_of(store.load_windows(spark, path, _STORE_LAYOUT, 0, half - 1)), _STORE_LAYOUT, p.n).filter(F.col("frame_start") <= (half - 1) * step + last_frame)
    rest = windows.frames_of_hits(store.hits_of(store.load_windows(spark, path, _STORE_LAYOUT, half, n - 1)), _STORE_LAYOUT, p.n)
    # a frame of both halves comes from the first, and one whose events are not all there from neither
    frames = frames.union(rest.filter(F.col("frame_start") > (half - 1) * step + last_frame))
    return rounded(frames, "mean", "stdev")


@query("SELECT year(o_orderdate)::BIGINT AS run, count(*) AS n_events, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY run")
def csv_summary(spark, sf_dir):
    """A summary by run, written as CSV and read back."""
    path = scratch(spark, "csv")
    rows = fx.table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("run")).agg(F.count("*").alias("n_events"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    files.write_csv(rows, path)
    return spark.read.option("header", True).schema("run long, n_events long, total double").csv(path)


@query("SELECT o_orderkey::BIGINT AS evt, (year(o_orderdate) * 100 + month(o_orderdate))::BIGINT AS run, month(o_orderdate) % 2 = 1 AS good FROM orders")
def good_runs(spark, sf_dir):
    """Events with the verdict on their run, from a JSON file of run lists."""
    path = scratch(spark, "runs")
    events = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("evt"), (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long").alias("run"))
    months = events.select("run").distinct()  # a row a month
    lists = months.agg(*[F.collect_list(F.when(F.col("run") % 2 == odd, F.col("run"))).alias(name) for name, odd in (("good", 1), ("bad", 0))])
    lists.withColumn("good", F.concat("good", F.slice("good", 1, 1))).coalesce(1).write.json(path)  # one run is listed twice
    return events.join(F.broadcast(files.read_runs(spark, path)), "run").select("evt", "run", "good")


@query("SELECT 'root://server//data/DQM_' || c_name || '.root' AS path, c_custkey::BIGINT AS run FROM customer")
def rewritten_paths(spark, sf_dir):
    """Data files with their paths as seen from elsewhere."""
    paths, _ = fx.files(spark, sf_dir)
    return splits.data_files(paths).select(splits.rewrite_url(F.col("path"), "/data/", "root://server//data/").alias("path"), "run")


@query("""WITH p AS (SELECT p_size::BIGINT AS channel, arg_max(p_partkey, p_partkey)::DOUBLE AS x, arg_max(p_retailprice, p_partkey) AS y, (max(p_partkey) % 7)::DOUBLE AS z FROM part GROUP BY p_size)
SELECT l_orderkey::BIGINT AS evt, l_linenumber::BIGINT AS number, (l_suppkey % 60)::BIGINT AS channel, x, y, z FROM lineitem LEFT JOIN p ON p.channel = l_suppkey % 60""")
def hit_positions(spark, sf_dir):
    """Hits with the position of their channel, from an XML file in which names repeat: the last one counts."""
    path = scratch(spark, "xml")
    places = fx.table(spark, sf_dir, "part").select(F.format_string("posWire_U_%d", "p_size").alias("_name"), F.col("p_partkey").alias("_x"), F.col("p_retailprice").alias("_y"), (F.col("p_partkey") % 7).alias("_z"))
    places.write.format("xml").option("rootTag", "positions").option("rowTag", "position").save(path)
    known = geometry.position_lookup(geometry.read_positions(spark, path, prefix="posWire_"), "x")
    rows = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("evt"), F.col("l_linenumber").cast("long").alias("number"), (F.col("l_suppkey") % 60).cast("long").alias("channel"))
    return geometry.add_positions(rows, known.withColumn("channel", F.col("channel").cast("long"))).select("evt", "number", "channel", "x", "y", "z")


# --- names and keys ---------------------------------------------------------------------------------------------


@query(f"""WITH {fx.SQL_LINES} SELECT evt, evt AS "event_key", 0 AS plane_ord, row_number() OVER (PARTITION BY evt ORDER BY i) - 1 AS pos, channel, l_quantity AS integral FROM lines WHERE channel >= 0
UNION ALL SELECT evt, evt, 1, (SELECT count(*) FROM lines k WHERE k.evt = l.evt AND k.channel >= 0) + row_number() OVER (PARTITION BY evt ORDER BY i) - 1, channel, l_tax FROM lines l WHERE channel >= 0""")
def discovered_hits(spark, sf_dir):
    """Hits of the planes that the column names tell of; a plane without charge column is skipped, metadata are told apart."""
    rows = fx.ragged(spark, sf_dir).select(F.col("evt").alias("meta.evt"), F.col("channel").alias("hits0.h.channel"), F.col("quantity").alias("hits0.h.integral"), F.col("channel").alias("hits1.h.channel"), F.col("tax").alias("hits1.h.integral"), F.col("channel").alias("hits2.h.channel"))
    own = keys.key_columns(rows.columns)
    metadata, features = keys.split_metadata(keys.ordered_union(rows.columns, rows.columns), list(own.values()))
    planes = [{"channel": f"{p}.channel", "integral": f"{p}.integral"} for p in keys.hit_prefixes(features)]
    named = rows.select(F.col(f"`{own['evt']}`").alias("evt"), F.col(f"`{metadata[0]}`").alias("event_key"), *[F.col(f"`{c}`").alias(c) for c in features])
    return hits.explode_hits(named, planes, ["evt", "event_key"])


@query(f"""WITH {fx.SQL_LINES}, v AS (SELECT evt, i AS slot, l_quantity AS value FROM lines UNION ALL SELECT evt, n, evt FROM lines WHERE i = 0 UNION ALL SELECT evt, n + 1 + i, l_tax FROM lines),
m AS (SELECT 2 * max(n) + 1 AS m FROM lines), s AS (SELECT evt, l_quantity AS first, unnest(range(0, m)) AS slot FROM lines, m WHERE i = 0)
SELECT s.evt, s.first, s.slot::INT AS slot, round(coalesce(value, 0)::DOUBLE, 6) AS value FROM s LEFT JOIN v ON v.evt = s.evt AND v.slot = s.slot""")
def event_metadata(spark, sf_dir):
    """All metadata values of each event in one array as long as the longest, and the first one of its first column."""
    rows = hits.concat_metadata(fx.ragged(spark, sf_dir), ["quantity", "absent", "evt", "tax"])
    padded = vec.pad_to_longest(rows.select("evt", vec.first_value(F.col("quantity")).alias("first"), "meta_values"), "meta_values")
    return padded.select("evt", "first", F.posexplode("meta_values").alias("slot", "value")).select("evt", "first", "slot", F.round("value", 6).alias("value"))


@query("SELECT o_orderkey::BIGINT AS evt, CASE WHEN o_custkey % 5 < 2 THEN -1 ELSE o_custkey END::BIGINT AS run FROM orders")
def whole_keys(spark, sf_dir):
    """Keys read as floats: NaN and null become -1."""
    x = F.when(F.col("o_custkey") % 5 == 0, float("nan")).when(F.col("o_custkey") % 5 != 1, F.col("o_custkey").cast("double"))
    return fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("evt"), keys.whole_or_minus_one(x).alias("run"))


@query("""WITH e AS (SELECT year(o_orderdate)::BIGINT AS run, (month(o_orderdate) % 3)::BIGINT AS subrun, (o_orderkey - 1)::BIGINT AS evt, o_orderkey AS entry FROM orders)
SELECT run, CASE subrun WHEN 0 THEN -1 ELSE subrun END AS subrun, CASE evt WHEN 0 THEN -1 ELSE evt END AS evt,
row_number() OVER (ORDER BY run, CASE subrun WHEN 0 THEN 999999999 ELSE subrun END, CASE evt WHEN 0 THEN 999999999 ELSE evt END, entry) - 1 AS event_idx FROM e""")
def event_index_without_zeros(spark, sf_dir):
    """Events in order where a key of 0 counts as missing: it goes last, and comes out as -1."""
    e = fx.events(spark, sf_dir).withColumn("subrun", F.col("subrun") % 3).withColumn("evt", F.col("evt") - 1).withColumn("file_idx", F.lit(0).cast("long"))
    ordered = index.order_events(e, zero_is_missing=True)
    return ordered.select(*[keys.provenance_key(F.col(c), zero_is_missing=True).alias(c) for c in ("run", "subrun", "evt")], "event_idx")


@query("SELECT o_orderkey::BIGINT AS evt, row_number() OVER (ORDER BY o_custkey % 4, o_orderkey) - 1 AS event_idx FROM orders")
def event_index_without_keys(spark, sf_dir):
    """Events whose key columns are absent stay in the order of files and entries."""
    e = fx.events(spark, sf_dir).select("file_idx", "entry")
    return index.order_events(e).select(F.col("entry").alias("evt"), "event_idx")


# --- pairs, labels, caps, losses --------------------------------------------------------------------------------


@query("""WITH a AS (SELECT o_orderkey::BIGINT AS evt, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders), b AS (SELECT o_orderkey::BIGINT AS other, row_number() OVER (ORDER BY (o_orderkey * 7919) % 1000003, o_orderkey) AS i FROM orders)
SELECT evt, other FROM a JOIN b USING (i)""")
def positional_pairs(spark, sf_dir):
    """Rows of two tables of equal length paired by their places."""
    key = F.col("o_orderkey").cast("long")
    left = fx.table(spark, sf_dir, "orders").select(key.alias("evt"))
    mixed = (key * 7919 % 1000003).cast("string")
    right = fx.table(spark, sf_dir, "orders").select(F.concat(F.lpad(mixed, 8, "0"), F.lpad(key.cast("string"), 20, "0")).alias("place"), key.alias("other"))
    return score.pair_by_position(left.withColumn("place", F.lpad(F.col("evt").cast("string"), 20, "0")), right, "place").select("evt", F.col("right_other").alias("other"))


@query("SELECT doc_id::BIGINT AS doc_id, n_chars::BIGINT AS n_chars, toxic::INT AS label FROM documents LEFT JOIN labels USING (doc_id)")
def labelled_documents(spark, sf_dir):
    """Every document with its label, where it has one."""
    docs = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"))
    labels = fx.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    return score.with_labels(docs, labels, "doc_id")


@query("SELECT round(sum(loss * n) / sum(n), 9) AS mean_loss FROM (SELECT avg(l_discount) AS loss, count(*) AS n FROM lineitem GROUP BY l_suppkey)")
def mean_loss(spark, sf_dir):
    """Mean loss over batches of different sizes, a batch for each supplier."""
    batches = fx.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("loss"), F.count("*").alias("n"))
    return rounded(score.weighted_mean_loss(batches), "mean_loss", digits=9)


@query("SELECT year(o_orderdate)::BIGINT AS run, o_orderkey::BIGINT AS evt FROM orders ORDER BY o_custkey % 4, o_orderkey LIMIT 1000")
def first_events(spark, sf_dir):
    """The first events in the order of files and entries."""
    return splits.first_rows(fx.events(spark, sf_dir), 1000, "file_idx", "entry").select("run", "evt")


@query(f"""WITH {fx.sql_frames(Layout(20, 20, 4, 4))} SELECT window_id, window_id * 20 AS start, window_id * 20 + 99 AS "end" FROM wins WHERE window_id < 25""")
def first_windows(spark, sf_dir):
    """The first windows over the events."""
    return windows.windows(spark, Layout(20, 20, 4, 4), fx.table(spark, sf_dir, "orders").count(), max_windows=25)


@query("""WITH s AS (SELECT n_chars::DOUBLE AS score FROM documents ORDER BY doc_id LIMIT 400)
SELECT round(avg(score), 4) AS mean, round(stddev_pop(score), 4) AS std, min(score) AS min, max(score) AS max, round(quantile_cont(score, 0.5), 4) AS p50, round(quantile_cont(score, 0.95), 4) AS p95, round(quantile_cont(score, 0.99), 4) AS p99 FROM s""")
def capped_score_stats(spark, sf_dir):
    """Statistics of the first scores only, as a cap on the work for metrics."""
    scores = fx.table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return rounded(metrics.score_stats(splits.first_rows(scores, 400, "doc_id")), "mean", "std", "p50", "p95", "p99", digits=4)


@query("""WITH l AS (SELECT unnest(range(0, len(embedding)))::BIGINT AS feature, unnest(embedding)::DOUBLE AS x FROM embeddings), b AS (SELECT feature, -0.2::DOUBLE AS lo, 0.2::DOUBLE AS hi, quantile_cont(x, 0.95) AS p95, quantile_cont(x, 0.99) AS p99 FROM l GROUP BY feature)
SELECT feature, least(floor((least(greatest(x, lo), hi) - lo) / (hi - lo) * 20), 19)::BIGINT AS bin, count(*) AS n, round(p95, 6) AS p95, round(p99, 6) AS p99 FROM l JOIN b USING (feature) GROUP BY feature, bin, p95, p99""")
def feature_histograms(spark, sf_dir):
    """Histogram of each feature, what lies under or over the bounds in the outer bins, with percentile markers."""
    return rounded(metrics.feature_histograms(fx.vectors(spark, sf_dir), "x", -0.2, 0.2, bins=20), "p95", "p99")
