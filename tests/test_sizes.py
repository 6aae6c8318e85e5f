"""Steps that must not gather a whole table in one task, against their plain forms."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.ordering import following
from tessera.operators import balls, crypto, graph, risk, strong
from tessera.plans import inputs, java, syntax

DATA = "/root/testdata/sf0.001"


def test_next_row_by_ranges_is_that_of_one_window(spark):
    rows = spark.createDataFrame([((i * 37) % 101, f"v{i % 7}" if i % 5 else None) for i in range(101)], "k long, v string")
    window = Window.orderBy("k")
    for some in (rows, rows.where("k < 1"), rows.where("k < 0")):
        want = {tuple(r) for r in some.select("k", "v", F.lead("v", 1).over(window), F.lead("v", 1, "end").over(window)).collect()}
        got = following(some, ["k"], {"a": "v", "b": "v"}, {"b": F.lit("end")})
        assert {tuple(r) for r in got.collect()} == want


def test_files_are_parsed_in_many_tasks(spark):
    """The neighbour's window and the few row groups of a small table put all files in one task."""
    whole = inputs.load(spark, DATA, java.PARTS)
    assert {tuple(r) for r in java.numbered(spark, DATA).select(whole.columns).collect()} == {tuple(r) for r in whole.collect()}
    assert java.sources(spark, DATA).rdd.getNumPartitions() == 4
    assert syntax.files(spark, DATA).rdd.getNumPartitions() == 4


@pytest.mark.parametrize("seed", range(3))
def test_components_in_numbers_and_in_blocks(spark, seed, monkeypatch):
    """Random graphs, a long way between blocks with loops, self-loops and vertices of their own."""
    r = random.Random(seed)
    pairs = {(f"v{r.randrange(60)}", f"v{r.randrange(60)}") for _ in range(70 + 30 * seed)} | {(f"w{i:03}", f"w{i + 1:03}") for i in range(120)} | {("w060", "w020"), ("w110", "w100"), ("x", "x")}
    e = spark.createDataFrame(sorted(pairs), "src string, dst string")
    rows = lambda df: {tuple(x) for x in df.collect()}
    want = rows(graph.components(e))
    assert ("w020", "w020", 41, False, True) in want
    assert rows(graph.components(e, kernel_edges=0, block_edges=40)) == want
    monkeypatch.setattr(graph, "KERNEL_EDGES", 1)
    assert rows(graph.components(e)) == want  # by number, in one task


def test_components_along_a_way_take_few_rounds(spark, monkeypatch):
    """A cycle of 3,000 vertices: a round for each edge of the way would be thousands of jobs."""
    steps, step = [], strong.stored
    monkeypatch.setattr(strong, "stored", lambda df, name: steps.append(name) or step(df, name))
    e = spark.range(3000).selectExpr("id as src", "(id + 1) % 3000 as dst")
    got = graph.components(e, kernel_edges=0, block_edges=500)
    assert got.where("component = 0 and size = 3000 and cyclic").count() == 3000 and steps.count("labels") < 40


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_counts_with_the_graph_are_those_of_reach(spark, depth, monkeypatch):
    """Hubs beside one another, self-loops, targets outside; several tasks."""
    r = random.Random(depth)
    monkeypatch.setattr(balls, "WORTH", 20)
    monkeypatch.setattr(balls, "HEAVY", 8)
    pairs = [(f"v{i}", f"h{i % 3}") for i in range(60)] + [("h0", "h1"), ("v1", "h1"), ("v5", "v5")] + [(f"v{r.randrange(60)}", f"v{r.randrange(60)}") for _ in range(40)]
    e = spark.createDataFrame(pairs, "src string, dst string")
    targets = spark.createDataFrame([(f"v{i}",) for i in range(60)] + [("h0",), ("h1",), ("h2",), ("none",)], "target string")
    rows = lambda df: sorted(tuple(x) for x in df.collect())
    for direction in ("in", "out", "both"):
        assert rows(graph.radius(e, targets, depth, 64, direction)) == rows(graph.radius(e, targets, depth, 64, direction, kernel_edges=0))
    users = targets.selectExpr("concat('k', length(target) + ascii(substring(target, -1)) % 3) as key", "target").union(spark.createDataFrame([("k2", "h0"), ("alone", "none"), (None, "v7")], "key string, target string"))
    scores = spark.createDataFrame([(f"v{i}", i / 7) for i in range(0, 60, 2)] + [("h1", None)], "id string, score double")
    near = lambda n: [(*x[:5], round(x[5], 9), x[6]) for x in map(tuple, crypto.blast_radius(users, e, scores, depth, kernel_edges=n).orderBy("key").collect())]
    assert near(None) == near(0)


def test_a_hub_makes_no_pairs(spark):
    """A vertex called by n others makes n * n pairs two calls apart, which were rows before."""
    n = 30_000
    e = spark.range(n).selectExpr("concat('v', id) as src", "'hub' as dst")
    got = graph.radius(e, e.selectExpr("src as target"), 2, direction="both")
    assert got.where(f"reached = {n}").count() == n


def test_next_events_by_ranges_are_those_of_the_window(spark):
    want = inputs.load(spark, DATA, inputs.USER_NEXT)
    got = inputs.user_next(spark, DATA)
    assert {tuple(r) for r in got.select(want.columns).collect()} == {tuple(r) for r in want.collect()}
    events = following(inputs.load(spark, DATA, "SELECT ts, event_id, user_id FROM events"), ["ts", "event_id"], {"dst": "user_id"})
    assert events.select(F.spark_partition_id()).distinct().count() > 1  # the window has one


def test_paths_are_joined_without_broadcasts(spark):
    """Small files, as those of ``part`` are, would be broadcast whatever number of ends their rows give."""
    rows = lambda c: inputs.load(spark, DATA, f"SELECT p_partkey AS id, concat('a/b/c/P', p_partkey, '.java') AS {c} FROM part")
    joined = risk.suffix_joined(rows("file"), rows("path").withColumnRenamed("id", "n"), "file", "path", "id")
    assert joined.where("n = id").count() == 200 and "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
