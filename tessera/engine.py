"""The library's front: one object that reads a source tree and gives its tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.storage import stored
from tessera.javasrc import resolve, stage
from tessera.operators import crypto, graph, risk, safety, views
from tessera.sources import git


class Engine:
    """Tables of a repository of Java sources; each is computed when first asked for and written once."""

    def __init__(self, spark: SparkSession, root: str, include_tests: bool = False, history_days: int = 90):
        self.spark, self.root, self.include_tests, self.days = spark, root, include_tests, history_days
        self.rule_errors: list[tuple[str, str]] = []

    @cached_property
    def units(self) -> DataFrame:
        return stored(stage.parsed(stage.source_files(self.spark, self.root, self.include_tests)), "units")

    @cached_property
    def types(self) -> DataFrame:
        return stored(stage.types(self.units), "types")

    @cached_property
    def invocations(self) -> DataFrame:
        return stored(resolve.invocations(self.units, self.types), "invocations")

    @cached_property
    def edges(self) -> DataFrame:
        calls = self.invocations.select(F.col("caller").alias("src"), F.col("target").alias("dst"), "caller_method", "method", "signature", "kind", "line", "col")
        return stored(graph.coalesced(calls.where("src <> ''"), "caller_method", "method", "signature", "kind", "line", "col"), "edges")

    @cached_property
    def vertices(self) -> DataFrame:
        declared = self.types.select(F.col("fqcn").alias("id"), "simple_name", "package", "kind", "path")
        rows = graph.with_boundary(declared, self.edges)
        simple = F.element_at(F.split("id", r"\."), -1)
        return stored(rows.withColumn("simple_name", F.coalesce("simple_name", simple)).withColumn("kind", F.coalesce("kind", F.lit("CLASS"))), "vertices")

    @cached_property
    def hotspots(self) -> DataFrame:
        return stored(graph.hotspots(graph.pagerank(self.edges, self.vertices), self.edges, self.vertices), "hotspots")

    @cached_property
    def cycles(self) -> DataFrame:
        return stored(graph.cycles(self.edges), "cycles")

    @cached_property
    def history(self) -> DataFrame | None:
        """Churn and bus factor by file; None without a repository."""
        if not git.available(self.root):
            return None
        changes = git.changes(self.spark, self.root, self.days)
        return stored(risk.churn(changes).join(risk.bus_factor(changes), "path"), "history")

    @cached_property
    def risk(self) -> DataFrame:
        inside = self.cycles.select(F.explode("path").alias("id")).distinct().withColumn("in_cycle", F.lit(True))
        rows = self.hotspots.join(self.vertices.select("id", "path"), "id").join(inside, "id", "left").withColumn("in_cycle", F.coalesce("in_cycle", F.lit(False)))
        return stored(risk.composite(rows, self.history), "risk")

    @cached_property
    def usages(self) -> DataFrame:
        return stored(stage.crypto_usages(self.units), "usages")

    def findings(self, registry: crypto.Registry | None = None) -> DataFrame:
        """Findings of all rules that work. A rule that fails, when planned or run, is in ``rule_errors`` with its error; the others are not touched by it."""
        registry = registry or crypto.Registry()
        found, wrong = crypto.isolated(lambda rules: crypto.findings(self.usages, crypto.Registry(tuple(rules))), registry.rules)
        if registry.call_rules:
            of_calls, more = crypto.isolated(lambda rules: crypto.call_findings(self.invocations, rules), registry.call_rules)
            found, wrong = found.unionByName(of_calls, allowMissingColumns=True), wrong + more
        self.rule_errors = wrong
        return crypto.ordered(crypto.deduplicated(found))

    def architectural_findings(self) -> DataFrame:
        places = self.types.select(F.col("fqcn").alias("id"), "path", F.col("range.line").alias("line"), F.col("range.col").alias("col"))
        return views.architectural(self.cycles, self.risk.join(self.hotspots.select("id", "rank", "in_degree"), "id"), places)

    def demonstration_findings(self, hook: str = "demoHook") -> DataFrame:
        return crypto.ordered(crypto.deduplicated(crypto.demonstration(self.invocations, hook)))

    @cached_property
    def errors(self) -> DataFrame:
        """``(path, error)`` of what couldn't be parsed."""
        return self.units.select("path", F.explode("errors").alias("error"))

    @cached_property
    def classes(self) -> DataFrame:
        return stored(views.classes(self.vertices, self.hotspots, self.risk, self.cycles, self.history, self.edges), "classes")

    @cached_property
    def described(self) -> DataFrame:
        return stored(crypto.described(self.usages), "described")

    @cached_property
    def assets(self) -> DataFrame:
        return stored(crypto.inventory(self.described), "assets")

    def assessments(self, depth: int = 10, with_graph: bool = True) -> DataFrame:
        """Assets with exposure, advice and the blast radius of the types that use them. Without a graph the radius is empty, the rest is the same.

        Types that use an asset are those its usages are in; where none is known, those declared in its files.
        """
        assessed = crypto.advised(crypto.exposure(self.assets))
        if with_graph:
            users = self.described.select("key", F.nullif("enclosing", F.lit("")).alias("target"), "path")
            known = users.where("target is not null").select("key", "target")
            lost = users.join(known.select("key").distinct(), "key", "left_anti").join(self.vertices.select(F.col("id").alias("_id"), F.col("path").alias("_path")), F.col("path") == F.col("_path")).select("key", F.col("_id").alias("target"))
            radius = crypto.blast_radius(known.union(lost), self.edges, self.hotspots.select("id", F.col("rank").alias("score")), depth, names=True)
            rows = assessed.join(radius, "key", "left")
        else:
            rows = assessed.withColumns({"direct": F.lit(0), "transitive_only": F.lit(0), "reachable": F.lit(0), "max_depth": F.lit(0), "cumulative_risk": F.lit(0.0), "shared_utility": F.lit(False), **{c: F.lit(None).cast("array<string>") for c in ("direct_classes", "transitive_classes")}})
        rows = rows.fillna({"direct": 0, "transitive_only": 0, "reachable": 0, "max_depth": 0, "cumulative_risk": 0.0, "shared_utility": False})
        return self.ranked(rows)

    @staticmethod
    def ranked(rows: DataFrame) -> DataFrame:
        rank = F.when(F.col("priority") == "REVIEW_REQUIRED", 1).when(F.col("priority") == "PRIORITY_UNDETERMINED", 2).otherwise(3)
        return rows.orderBy(rank, F.desc("reachable"), F.lower("name"), "key")

    def method_path(self, start: str, goal: str, max_hops: int = 10, forward: bool = True) -> DataFrame:
        """The shortest path between two methods (``Type.method``); backward: from callee to caller."""
        edges = graph.method_edges(self.invocations)
        return graph.shortest_path(edges if forward else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "call_count"), start, goal, max_hops)

    def impact(self, name: str, depth: int = 3) -> tuple[str, DataFrame] | None:
        found = graph.lookup(self.vertices, name)
        if found is None:
            return None
        return found, stored(graph.reach(self.edges, self.spark.createDataFrame([(found,)], "target string"), depth), "impact")

    def trace(self, start: str, goal: str, max_hops: int = 10) -> DataFrame | None:
        ends = graph.lookup(self.vertices, start), graph.lookup(self.vertices, goal)
        return None if None in ends else graph.shortest_path(self.edges, *ends, max_hops)

    def diff_impact(self, base: str = "", depth: int = 3) -> dict[str, DataFrame]:
        return safety.diff_impact(self.vertices, self.edges, git.modified(self.spark, self.root, base), depth)
