"""What the operators' many short jobs leave in the driver."""

import sys

import pytest

from palimpsest.llm import _graph
from palimpsest.llm._util import release_driver


def _plain(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return sorted((x, root(x)) for x in [*up])


EDGES = [(i + 1, i) for i in range(60)] + [(1000 - i, 500) for i in range(90)] + [(-7, 900), (200, 201), (201, 202), (200, 202), (200, 201)]


def test_small_graph_takes_few_jobs(spark):
    """A chain of 60 edges and a star took rounds of jobs, each with its plans, threads and code in the driver."""
    df = spark.createDataFrame([*EDGES, (5, 5), (None, 3), (300, 300)], "a long, b long").repartition(3)
    spark.sparkContext.setJobGroup("small graph", "")
    try:
        found = sorted(map(tuple, _graph.components(df).collect()))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == _plain(EDGES)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("small graph")) <= 8


@pytest.mark.parametrize("edges", [[], [(4, 4)], [(None, 1)]])
def test_graph_without_links(spark, edges):
    assert _graph.components(spark.createDataFrame(edges, "a long, b long")).collect() == []


def test_large_graph_is_finished_in_one_task(spark, monkeypatch):
    """Rounds over many tasks, until few enough edges are left for one."""
    edges = [(i, j) for i in range(6) for j in range(i)] + [(10, 11), (11, 12)]
    monkeypatch.setattr(_graph, "TOGETHER", 8)
    assert sorted(map(tuple, _graph.components(spark.createDataFrame(edges, "a long, b long")).collect())) == _plain(edges)


@pytest.mark.skipif(sys.platform != "linux", reason="the JVM gives memory back on Linux")
def test_driver_gives_memory_back(spark):
    assert release_driver(spark)
