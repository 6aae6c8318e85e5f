import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.operators.components import components


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1) for a, b in pairs], "src string, dst string, call_count long")


def ranks(df):
    return {r["id"]: r["rank"] for r in df.collect()}


def test_calls_coalesce_and_self_loops_stay(spark):
    calls = spark.createDataFrame([("A", "B", i) for i in range(3)] + [("A", "A", 9)], "src string, dst string, line int")
    got = {(r["src"], r["dst"]): r for r in graph.coalesced(calls, "line").collect()}
    assert got["A", "B"]["call_count"] == 3 and got["A", "B"]["weight"] == pytest.approx(2.0) and [d["line"] for d in got["A", "B"]["details"]] == [0, 1, 2]
    assert ("A", "A") in got


def test_boundary(spark):
    types = spark.createDataFrame([("app.A",)], "id string")
    calls = spark.createDataFrame([("app.A", "java.util.List"), ("java.x.Y", "app.A"), ("other.Z", "app.A")], "src string, dst string")
    assert {(r["id"], r["is_boundary"]) for r in graph.with_boundary(types, calls).collect()} == {("app.A", False), ("java.util.List", True), ("java.x.Y", True), ("other.Z", True)}
    assert {(r["src"], r["dst"]) for r in graph.without_boundary(calls, types).collect()} == {("other.Z", "app.A")}


@pytest.mark.parametrize("kernel", [None, 0])
def test_pagerank_shapes(spark, kernel):
    star = graph.pagerank(edges(spark, [(f"c{i}", "hub") for i in range(10)]), kernel_edges=kernel)
    top = graph.hotspots(star, edges(spark, [(f"c{i}", "hub") for i in range(10)])).where("position = 1").first()
    assert (top["id"], top["in_degree"], top["out_degree"], top["minmax_score"]) == ("hub", 10, 0, 100.0) and sum(ranks(star).values()) == pytest.approx(1)
    chain = ranks(graph.pagerank(edges(spark, [("A", "B"), ("B", "C")]), kernel_edges=kernel))
    assert chain["C"] > chain["B"] > chain["A"]


def test_pagerank_without_edges(spark):
    alone = spark.createDataFrame([("x",), ("y",), ("z",)], "id string")
    none = edges(spark, [])
    got = graph.hotspots(graph.pagerank(none, alone), none, alone).collect()
    assert [r["minmax_score"] for r in got] == [100.0] * 3


def test_kernel_and_loop_agree_on_random_graphs(spark):
    r = random.Random(4)
    pairs = [(f"v{a}", f"v{b}") for a in range(25) for b in range(25) if r.random() < 0.06]
    e = edges(spark, pairs)
    a, b = ranks(graph.pagerank(e, tolerance=0, iterations=6)), ranks(graph.pagerank(e, tolerance=0, iterations=6, kernel_edges=0))
    assert set(a) == set(b) and all(a[k] == pytest.approx(b[k]) for k in a)
    want = {r["id"]: r["component"] for r in graph.components(e).collect()}
    assert want == {r["id"]: r["component"] for r in graph.components(e, kernel_edges=0).collect()}
    after = defaultdict(set)
    for x, y in pairs:
        after[x].add(y)

    def reaches(x):
        seen, todo = {x}, [x]
        while todo:
            new = after[todo.pop()] - seen
            seen |= new
            todo += new
        return seen

    reach = {v: reaches(v) for v in want}
    assert want == {v: min(w for w in reach[v] if v in reach[w]) for v in want}


def paths(df):
    return [r["path"] for r in df.orderBy("component", "nth").collect()]


def test_cycles(spark):
    assert paths(graph.cycles(edges(spark, [("A", "B"), ("B", "A")]))) == [["A", "B", "A"]]
    three = [("A", "B"), ("B", "C"), ("C", "A"), ("B", "A"), ("C", "B"), ("A", "C")]
    found = paths(graph.cycles(edges(spark, three), total=100, per_component=100))
    assert sorted(p for p in found if len(p) == 4) == [["A", "B", "C", "A"], ["A", "C", "B", "A"]] and len(found) == 5
    assert graph.cycles(edges(spark, [("A", "B"), ("B", "C")])).count() == 0
    loop = edges(spark, [("A", "A"), ("A", "B")])
    assert graph.cycles(loop).count() == 0 and paths(graph.cycles(loop, include_self_loops=True)) == [["A", "A"]]


def test_dense_cycles_are_capped(spark):
    dense = edges(spark, [(f"l{a}", f"r{b}") for a in range(5) for b in range(5)] + [(f"r{b}", f"l{a}") for a in range(5) for b in range(5)])
    rows = graph.cycles(dense).collect()
    assert len(rows) == 10 and all(r["truncated"] for r in rows)


def test_reach_and_impact(spark):
    e = edges(spark, [("client", "controller"), ("controller", "service"), ("service", "repo")])
    targets = spark.createDataFrame([("repo",), ("absent",)], "target string")
    got = {r["id"]: r["depth"] for r in graph.reach(e, targets).collect()}
    assert got == {"service": 1, "controller": 2, "client": 3}
    assert {r["id"] for r in graph.reach(e, targets, 1).collect()} == {"service"}
    looped = edges(spark, [("A", "A"), ("B", "A"), ("A", "B"), ("C", "B")])
    got = graph.reach(looped, spark.createDataFrame([("A",)], "target string"))
    assert {r["id"]: r["depth"] for r in got.collect()} == {"B": 1, "C": 2}
    scores = spark.createDataFrame([("B", 0.5)], "id string, score double")
    assert tuple(graph.impact(got, scores).first()) == ("A", 1, 2, pytest.approx(0.5 + 0.01 / 2))


def test_shortest_path_takes_the_least_of_several(spark):
    e = edges(spark, [("s", "b"), ("s", "c"), ("b", "z"), ("c", "y"), ("y", "g"), ("z", "g"), ("s", "a"), ("g", "s")])
    assert [(r["src"], r["dst"]) for r in graph.shortest_path(e, "s", "g").collect()] == [("s", "b"), ("b", "z"), ("z", "g")]
    assert graph.shortest_path(e, "s", "s").count() == graph.shortest_path(e, "s", "g", 2).count() == graph.shortest_path(e, "a", "s").count() == 0


def test_views(spark):
    e = spark.createDataFrame([("A", "B", 5), ("B", "A", 2), ("A", "C", 2), ("C", "A", 9)], "src string, dst string, call_count long")
    weak = graph.weakest_links(graph.cycles(e), e).orderBy("nth").collect()
    assert [(r["src"], r["dst"], r["call_count"]) for r in weak] == [("B", "A", 2), ("A", "C", 2)]
    assert {r["id"]: r["instability"] for r in graph.instability(e).collect()} == {"A": 0.5, "B": 0.5, "C": 0.5}
    one = graph.top_neighbours(e, 1).where("src = 'A'").first()
    assert (one["dst"], one["remainder"], one["two_way"]) == ("B", 1, True)
    assert graph.radius(e, spark.createDataFrame([("B",)], "target string"), 1).first()["band"] == "Wide"


def test_names(spark):
    rows = spark.createDataFrame([("p.ATest",), ("p.TestA",), ("p.test.X",), ("p.ait",), ("p.AIT",)], "id string").where(graph.is_test(F.col("id")))
    assert {r["id"] for r in rows.collect()} == {"p.ATest", "p.test.X", "p.AIT"}
    v = spark.createDataFrame([("q.A", "A"), ("p.A", "A"), ("A", "Z")], "id string, simple_name string")
    assert graph.lookup(v, "q.A") == "q.A" and graph.lookup(v, "Z") == "A" and graph.lookup(v, "A") == "A" and graph.lookup(v, "none") is None


@pytest.mark.parametrize("together", [None, -1])
def test_weak_components_on_random_graphs(spark, together):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame([*pairs, (None, 3)], "src long, dst long"), together=together).collect()}
    group = {v: v for p in pairs for v in p}
    for _ in range(400):
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    assert got == group
    assert components(spark.createDataFrame([], "src long, dst long"), together=together).count() == 0
    names = components(spark.createDataFrame([("b", "c"), ("a", "c"), ("x", "x")], "src string, dst string"), together=together)
    assert sorted(map(tuple, names.collect())) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x")]


def test_positions_by_ranges_are_those_of_one_task(spark):
    ranks = spark.createDataFrame([(f"v{i}", (i * 7 % 13) / 100.0) for i in range(60)], "id string, rank double")
    edges = spark.createDataFrame([("v1", "v2")], "src string, dst string")
    rows = lambda n: sorted((r["position"], r["id"]) for r in graph.hotspots(ranks, edges, one_task=n).collect())
    assert rows(0) == rows(None) and [p for p, _ in rows(0)] == list(range(1, 61))


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_of_large_components_are_those_of_the_kernel(spark, seed):
    r = random.Random(seed)
    pairs = {(f"n{r.randrange(9)}", f"n{r.randrange(9)}") for _ in range(22)}
    rows = lambda n: [(x["component"], x["nth"], x["path"]) for x in graph.cycles(edges(spark, sorted(pairs)), total=1000, per_component=15, length=5, kernel_edges=n).collect()]
    assert rows(0) == rows(None)


def test_a_narrow_front_loses_no_cycle(spark):
    pairs = [(f"n{i}", f"n{j}") for i in range(5) for j in range(5) if i != j]
    df = edges(spark, pairs).select("src", "dst")
    wide, _ = graph._large_cycles(df, "string", 30, 4)
    assert graph._large_cycles(df, "string", 30, 4, width=3)[0] == wide and len(wide) == 30
