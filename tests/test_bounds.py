"""Vertices made of a few bytes of a file pass neither through the driver nor through one task."""

import pytest
from pyspark.sql import functions as F

from survperf.operators import graph
from survperf.sources import testdata as td


@pytest.fixture(scope="module")
def corners(spark):
    """Unit squares in a row, whose plan is guessed to be far smaller than they are."""
    k = spark.range(500).selectExpr("id k", "explode(array(0, 1)) dx")
    return k.selectExpr("k", "dx", "explode(array(0, 1)) dy").selectExpr("cast(k as string) district", "cast(k + dx as double) x", "cast(dy as double) y")


def test_contiguity_broadcasts_no_vertices(spark, corners):
    found = graph.contiguity(corners)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(map(int, r)) for r in found.collect()} == {(a, b) for a in range(500) for b in (a - 1, a + 1) if 0 <= b < 500}


def test_islands_are_linked_without_a_broadcast_of_all_centres(spark):
    centres = spark.range(2000).selectExpr("cast(id as string) district", "cast(id * id as double) cx", "0D cy")
    found = graph.nearest(centres, centres)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(map(int, r)) for r in found.collect()} == {(0, 1)} | {(k, k - 1) for k in range(1, 2000)}


@pytest.mark.parametrize("made", [td.parcels, td.drawn_parcels])
def test_no_task_makes_the_shapes_of_all_keys(spark, tmp_path, made):
    spark.range(100_000).selectExpr("id c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    sizes = made(spark, str(tmp_path)).groupBy(F.spark_partition_id()).agg(F.count_distinct("district").alias("n")).collect()
    assert sum(r.n for r in sizes) == 100_000 and max(r.n for r in sizes) <= 15_000


def most_rows(spark, first, kind="Join"):
    """The most rows that an operator of a kind gave in the executions from ``first`` on, by Spark's own counts."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    listed = lambda seq: [seq.apply(i) for i in range(seq.size())]
    most = 0
    for run in [x.executionId() for x in listed(store.executionsList()) if x.executionId() >= first]:
        values = store.executionMetrics(run)
        for node in listed(store.planGraph(run).allNodes()):
            for m in listed(node.metrics()) if kind in node.name() else []:
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_a_crowd_on_a_wide_map_is_not_held_against_all_seekers(spark):
    crowd = spark.range(3000).selectExpr("cast(id as string) district", "cast(id % 40 as double) cx", "cast(id div 40 as double) cy")
    far = spark.range(700).selectExpr("concat('far', id) district", "1000D + 50 * id * id cx", "0D cy")
    first = spark._jsparkSession.sharedState().statusStore().executionsCount()
    found = {r.focal: r.neighbour for r in graph.nearest(far, crowd.union(far)).collect()}
    assert found == {"far0": "far1", **{f"far{k}": f"far{k - 1}" for k in range(1, 700)}}
    assert 700 <= most_rows(spark, first) <= 100 * 700


def test_districts_at_one_place_are_not_held_against_each_other(spark):
    same = spark.range(3000).selectExpr("cast(id as string) district", "7D cx", "7D cy")
    first = spark._jsparkSession.sharedState().statusStore().executionsCount()
    found = {int(r.focal): int(r.neighbour) for r in graph.nearest(same, same).collect()}
    assert found == {0: 1, **dict.fromkeys(range(1, 3000), 0)}
    assert 3000 <= most_rows(spark, first) <= 100 * 3000


@pytest.mark.parametrize("away", [0.0, 300000.1, 8e8])
def test_centroids_far_from_the_origin(spark, away):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0), (0.0, 0.0)]
    hole = [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0), (1.0, 1.0)]
    rows = [("a", 0, i, s, away + x, 2 * away + y) for i, points in enumerate([ring, hole]) for s, (x, y) in enumerate(points)]
    got = graph.centroids(spark.createDataFrame(rows, "district string, part int, ring int, seq int, x double, y double")).first()
    assert abs(got.cx - away - (12 * 2.0 - 1.5) / 11) < 1e-6 and abs(got.cy - 2 * away - (12 * 1.5 - 1.5) / 11) < 1e-6


def test_corners_at_round_places_look_into_one_cell(spark):
    corners = spark.range(1000).selectExpr("cast(id as string) district", "cast(id % 40 as double) x", "cast(id div 40 as double) y")
    first = spark._jsparkSession.sharedState().statusStore().executionsCount()
    assert graph.meeting(corners).count() == 1000
    assert most_rows(spark, first, "Generate") == 1000
