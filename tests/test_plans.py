"""Physical plans: what is read, how often rows are exchanged, and that no pairs are enumerated."""

import re

import pytest

from hitwatch.operators import graph, hits, score
from hitwatch.operators.windows import Layout
from hitwatch.plans import fixtures as fx
from hitwatch.plans.queries import LAYOUT, QUERIES, Graph


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def prepared(spark, sf_dir):
    return fx.Prepared(spark, sf_dir)


def test_only_used_columns_are_read(prepared):
    schema = [s for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(hits.channel_partials(prepared.hits))) if "l_" in s]
    assert [sorted(c.split(":")[0] for c in s.split(",")) for s in schema] == [["l_orderkey", "l_quantity", "l_suppkey"]]


def test_key_filters_reach_the_scan(spark, sf_dir):
    plan = plan_of(fx.table(spark, sf_dir, "orders").filter("o_orderkey < 10").select("o_orderkey"))
    assert "LessThan(o_orderkey,10)" in plan


def test_frames_exchange_once_and_combine_before(prepared):
    """By (frame, channel, bin); the exchange by part has a row a partition of the index. Where frames overlap more, partials by event and channel come first."""
    for layout, exchanges in ((LAYOUT, 1), (Layout(20, 10, 2, 4), 1), (Layout(20, 7, 4, 3), 2)):
        plan = plan_of(prepared.frames(layout))
        assert len(re.findall(r"Exchange hashpartitioning\((?!_part)", plan)) == exchanges
        assert "partial_sum" in plan and not re.search("Cartesian|NestedLoop", plan)


def test_windows_are_dealt_once(spark, sf_dir):
    g = Graph(spark, sf_dir)
    for df in (g.nodes, score.forecast_node_scores(g.rows, LAYOUT, g.n)):
        plan = plan_of(df)
        # the rows of the windows, and one spare row a window
        assert len(re.findall(r"Exchange hashpartitioning\(window_id", plan)) <= 2 and not re.search("Cartesian|NestedLoop|Join", plan)


def test_assembly_needs_no_exchange(spark, sf_dir):
    g = Graph(spark, sf_dir)
    assert not re.search("Exchange|Join", plan_of(g.rows))


def test_edges_are_made_without_a_join(spark, sf_dir):
    assert not re.search("Join|Cartesian", plan_of(graph.pruned_edges(Graph(spark, sf_dir).nodes)))


def test_node_vectors_come_from_one_deal(spark, sf_dir):
    plan = plan_of(graph.node_vectors(Graph(spark, sf_dir).cells, LAYOUT))
    # the rows of the windows, and one spare row a window
    assert len(re.findall(r"Exchange hashpartitioning\(window_id", plan)) <= 2 and "Join" not in plan


def test_values_meet_their_nodes_without_a_join(spark, sf_dir):
    g = Graph(spark, sf_dir)
    values = g.rows.filter("w = 3").groupBy("window_id", "channel").agg({"sum": "sum"}).withColumnRenamed("sum(sum)", "value")
    for made in (graph.neighbour_sum(g.nodes, values), graph.neighbour_norm(g.nodes, values)):
        assert not re.search("Join|Cartesian", plan_of(made))


def test_the_grid_is_made_where_its_scores_are(spark, sf_dir):
    """Windows x channels rows come last: they meet no scores by a join and are not exchanged."""
    plan = plan_of(QUERIES["node_score_grid"](spark, sf_dir))
    after = plan.partition("MapInArrow")[0]
    assert "Generate" in after and not re.search("Exchange|Join", after)


def test_copies_to_overlapping_frames_are_not_exchanged(prepared):
    """Where an event is in many frames, rows go to their frames after the last exchange."""
    plan = plan_of(prepared.frames(Layout(20, 7, 4, 3)))
    after = plan.partition("Exchange")[0]
    assert "MapInArrow" in after and "HashAggregate" not in after and "frame_start" not in plan.partition("Exchange")[2]


@pytest.mark.parametrize("name", ["node_vector_sums", "node_vectors", "stacked_propagation"])
def test_windows_are_assembled_after_the_last_exchange(spark, sf_dir, name):
    """Hits are exchanged once, by ranges of windows; what is made of the windows comes from that task alone."""
    plan = plan_of(QUERIES[name](spark, sf_dir))
    after = plan.partition("Exchange")[0]
    assert "MapInArrow" in after and not re.search("Aggregate|Window|Join", after) and not re.search(r"Exchange hashpartitioning\(window_id", plan)
