"""Registered queries of the report operators: hierarchy, radius, facts, change safety, asset radius, architectural findings and table filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.storage import stored
from tessera.javasrc import resolve, stage
from tessera.operators import crypto, graph, risk, safety, views

from . import catalog as C
from . import inputs as I
from . import java as J
from .catalog import query, six
from .inputs import load

AREAS = """SELECT concat('P', CAST(p_partkey AS VARCHAR(20))) AS id, p_brand AS area, CASE WHEN p_size >= 38 THEN 'HIGH' WHEN p_size >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS shown_level FROM part"""


@query(f"{C._BACK} SELECT target, CAST(depth AS INT) AS depth, area, count(*) AS n FROM r JOIN ({AREAS}) a ON a.id = r.id GROUP BY target, depth, area")
def radius_by_area(spark, d):
    return views.radius_by_area(graph.reach(load(spark, d, I.PART_CALLS), load(spark, d, C.TARGETS), 3), load(spark, d, AREAS))


@query(f"""{C._BACK} SELECT r.target, CAST(depth AS INT) AS depth, a.area, count(*) AS n FROM r JOIN ({AREAS}) a ON a.id = r.id JOIN ({AREAS}) o ON o.id = r.target WHERE a.area <> o.area GROUP BY r.target, depth, a.area""")
def radius_cross_area(spark, d):
    return views.radius_by_area(graph.reach(load(spark, d, I.PART_CALLS), load(spark, d, C.TARGETS), 3), load(spark, d, AREAS), "cross-area")


@query(f"""{C._BACK} SELECT target, CAST(depth AS INT) AS depth, area, count(*) AS n FROM r JOIN ({AREAS}) a ON a.id = r.id WHERE shown_level = 'HIGH' GROUP BY target, depth, area""")
def radius_high_risk(spark, d):
    return views.radius_by_area(graph.reach(load(spark, d, I.PART_CALLS), load(spark, d, C.TARGETS), 3), load(spark, d, AREAS), "high-risk")


_OUT = C._BOTH.replace("SELECT src, dst FROM b UNION SELECT dst, src FROM b", "SELECT dst AS src, src AS dst FROM b")


@query(f"{_OUT} SELECT target, coalesce(reached, 0) AS reached FROM ({C.TARGETS}) t LEFT JOIN q USING (target)")
def radius_outgoing(spark, d):
    return graph.radius(load(spark, d, I.PART_CALLS), load(spark, d, C.TARGETS), 2, direction="out").select("target", "reached")


@query(f"SELECT id, CASE WHEN minmax_score >= 50 THEN 'HIGH' WHEN minmax_score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS shown_level FROM ({C.HOT}) h")
def display_levels(spark, d):
    return load(spark, d, C.HOT).select("id", views.display_level(F.col("minmax_score")).alias("shown_level"))


FACTS = """SELECT CAST(user_id AS VARCHAR(20)) AS id, CAST(count(*) % 13 AS INT) AS in_degree, user_id % 3 = 0 AS in_loop, CAST(CASE WHEN user_id % 4 = 0 THEN 0 ELSE count(*) % 50 END AS BIGINT) AS churn, count(DISTINCT CASE WHEN user_id % 5 = 0 THEN 'one' ELSE event_type END) AS authors FROM events GROUP BY user_id"""


@query(f"""SELECT id, CASE WHEN in_degree >= 10 THEN 'hi' WHEN in_degree >= 4 THEN 'med' ELSE 'low' END AS dependents, CASE WHEN in_loop THEN 'hi' ELSE 'low' END AS loop,
  CASE WHEN churn >= 30 THEN 'hi' WHEN churn > 0 THEN 'med' ELSE 'low' END AS churned, CASE WHEN churn > 0 AND authors = 1 THEN 'med' ELSE 'low' END AS ownership,
  CASE WHEN in_loop AND in_degree >= 8 THEN 'handle-with-care' WHEN in_loop THEN 'untangle' WHEN churn >= 30 THEN 'add-tests' WHEN in_degree >= 10 THEN 'keep-stable' ELSE 'healthy' END AS advice FROM ({FACTS}) f""")
def facts_users(spark, d):
    return views.facts(load(spark, d, FACTS))


RISKY = f"SELECT id, CAST(length(id) * 10 + ascii(substring(id, 2, 1)) AS DOUBLE) AS overall, CAST(coalesce(n, 0) AS INT) AS in_degree FROM ({C.PARTS}) p LEFT JOIN (SELECT dst, count(*) AS n FROM ({I.PART_CALLS}) e GROUP BY dst) q ON q.dst = p.id"


@query(f"""WITH RECURSIVE e AS ({I.PART_CALLS}), w AS (SELECT id AS target, id, 0 AS depth FROM ({C.PARTS}) p UNION SELECT target, e.src, depth + 1 FROM w JOIN e ON e.dst = w.id WHERE depth < 4),
  x AS (SELECT 'risk' AS list, 6 AS top, id, overall AS value FROM ({RISKY}) a UNION ALL SELECT 'dependents', 3, id, CAST(in_degree AS DOUBLE) FROM ({RISKY}) b
    UNION ALL SELECT 'radius', 5, target, CAST(count(DISTINCT id) FILTER (id <> target) AS DOUBLE) FROM w GROUP BY target)
  SELECT list, CAST(k AS INT) AS position, id, value FROM (SELECT *, row_number() OVER (PARTITION BY list ORDER BY value DESC, id) AS k FROM x) q WHERE k <= top""")
def leading_parts(spark, d):
    return views.leading(load(spark, d, RISKY), load(spark, d, I.PART_CALLS))


NAMED = """SELECT concat('com.', lower(replace(p_brand, '#', '')), '.P', CAST(p_size AS VARCHAR(9))) AS id, concat('P', CAST(p_size AS VARCHAR(9))) AS simple_name, false AS is_boundary FROM part GROUP BY p_brand, p_size"""


@query(f"SELECT id, CASE WHEN count(*) OVER (PARTITION BY simple_name) > 1 THEN id ELSE simple_name END AS display FROM ({NAMED}) n")
def display_ids(spark, d):
    return views.display_ids(load(spark, d, NAMED)).select("id", "display")


PARENTS = """SELECT concat('c', CAST(c_custkey AS VARCHAR(20))) AS child, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE concat('geo.', n_name) END AS parent, 'extends' AS kind FROM customer JOIN nation ON c_nationkey = n_nationkey"""


@query("SELECT concat('geo.', n_name) AS target, concat('c', CAST(c_custkey AS VARCHAR)) AS child, 'extends' AS kind FROM customer JOIN nation ON c_nationkey = n_nationkey")
def subtypes_geo(spark, d):
    return resolve.subtypes(load(spark, d, PARENTS), load(spark, d, "SELECT concat('geo.', n_name) AS target FROM nation"))


#: Of the types of HIERARCHY, all but customers have m0, those above nations and segments m1, and customers one of m0 to m2 of their own.
DECLARED = f"""SELECT DISTINCT name AS fqcn, 'p' AS path, CASE WHEN name LIKE 'c%' THEN concat('m', CAST(CAST(substring(name, 2) AS INT) % 3 AS VARCHAR(9))) ELSE 'm0' END AS m FROM (SELECT child AS name FROM ({C.HIERARCHY}) h UNION ALL SELECT parent FROM ({C.HIERARCHY}) g) x
  UNION ALL SELECT DISTINCT parent, 'p', 'm1' FROM ({C.HIERARCHY}) h WHERE child NOT LIKE 'c%'"""


@query(f"""WITH RECURSIVE s AS ({C.ORACLES['hierarchy_supertypes']}), d AS ({DECLARED}),
  o AS (SELECT fqcn, m AS name, fqcn AS declarer, 0 AS position FROM d UNION ALL SELECT s.child, d.m, d.fqcn, s.position FROM s JOIN d ON d.fqcn = s.parent)
  SELECT fqcn, name, arg_min(declarer, position) AS declarer FROM o GROUP BY fqcn, name""")
def method_lookup_geo(spark, d):
    declared = load(spark, d, DECLARED).select("fqcn", "path", F.array(F.struct(F.col("m").alias("name"))).alias("methods"))
    return resolve.find_method(declared, resolve.supertypes(load(spark, d, C.HIERARCHY)))


@query(f"{J._P} SELECT path, next_name AS target, CASE WHEN ok OR k % 3 = 0 THEN concat(next_package, '.', next_name) ELSE next_name END AS resolved, CASE WHEN next_name <> 'P0' AND next_package = package THEN 'same-package' WHEN k % 3 = 0 THEN 'explicit-import' WHEN ok THEN 'wildcard-import' ELSE 'external' END AS handler FROM t")
def resolve_chain(spark, d):
    units = J._units(spark, d)
    names = stage.calls(units).where("method = '<init>'").select("path", "package", "target")
    return resolve.chain(names, stored(stage.types(units), "types"), stage.imports(units)).select("path", "target", "resolved", "handler")


@query(f"{J._C} SELECT concat(caller, '.run') AS src, concat(target, '.', method) AS dst, count(*) AS call_count FROM c GROUP BY caller, target, method")
def java_method_edges(spark, d):
    units = J._units(spark, d)
    return graph.method_edges(resolve.invocations(units, stored(stage.types(units), "types"))).select("src", "dst", "call_count")


CODE = """SELECT concat('com.P', CAST(p_partkey AS VARCHAR(20))) AS id, CASE WHEN p_partkey % 4 = 0 THEN concat('src/test/P', CAST(p_partkey - 1 AS VARCHAR(20)), CASE WHEN p_partkey % 8 = 0 THEN 'Test' ELSE 'Tests' END, '.java') ELSE concat('src/main/P', CAST(p_partkey AS VARCHAR(20)), '.java') END AS path FROM part"""


IMPACTED = "SELECT concat('P', CAST(p_partkey AS VARCHAR(20))) AS simple_name FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)"


@query(f"""SELECT DISTINCT path AS file, simple_name FROM ({CODE}) c JOIN ({IMPACTED}) i ON contains(replace(regexp_extract(path, '[^/]*$'), '.java', ''), simple_name)
  WHERE regexp_matches(path, '(Test|Tests|TestCase)\\.java$')""")
def suggested_tests(spark, d):
    return safety.suggested_tests(load(spark, d, CODE), load(spark, d, IMPACTED))


FILES = """SELECT concat('P', CAST(p_partkey AS VARCHAR(20))) AS id, concat('src/', replace(lower(p_brand), '#', ''), '/P', CAST(p_partkey AS VARCHAR(20)), '.java') AS path, concat('P', CAST(p_partkey AS VARCHAR(20))) AS simple_name FROM part"""
CHANGED = "SELECT concat('module/src/', replace(lower(p_brand), '#', ''), '/P', CAST(p_partkey AS VARCHAR(20)), '.java') AS file FROM part WHERE p_size = 1"


@query(f"""WITH RECURSIVE e AS ({I.PART_CALLS}), t AS (SELECT concat('P', CAST(p_partkey AS VARCHAR)) AS target FROM part WHERE p_size = 1),
  w AS (SELECT target, target AS id, 0 AS depth FROM t UNION SELECT target, e.src, depth + 1 FROM w JOIN e ON e.dst = w.id WHERE depth < 2)
  SELECT id, CAST(min(depth) AS INT) AS depth FROM w WHERE id <> target GROUP BY id""")
def diff_impact_parts(spark, d):
    return safety.diff_impact(load(spark, d, FILES), load(spark, d, I.PART_CALLS), load(spark, d, CHANGED), 2)["callers"]


LEFT = "SELECT p_partkey AS id, concat('src/main/b', CAST(p_size AS VARCHAR(9)), '/P', CAST(p_partkey AS VARCHAR(20)), '.java') AS file FROM part"
RIGHT = """SELECT CASE p_partkey % 4 WHEN 0 THEN concat('P', CAST(p_partkey AS VARCHAR(20)), '.java') WHEN 1 THEN concat('m/src/main/b', CAST(p_size AS VARCHAR(9)), '/P', CAST(p_partkey AS VARCHAR(20)), '.java')
  WHEN 2 THEN concat('b', CAST(p_size AS VARCHAR(9)), '/P', CAST(p_partkey AS VARCHAR(20)), '.java') ELSE concat('zz/P', CAST(p_partkey AS VARCHAR(20)), '.java') END AS path, p_size AS n FROM part"""


@query(f"SELECT p_partkey AS id, r.path, CAST(CASE WHEN p_partkey % 4 < 3 THEN p_size END AS INT) AS n FROM part LEFT JOIN (SELECT CAST(regexp_extract(path, 'P([0-9]+)\\.java', 1) AS BIGINT) AS k, path FROM ({RIGHT}) x WHERE path NOT LIKE 'zz/%') r ON r.k = p_partkey")
def suffix_join(spark, d):
    return risk.suffix_joined(load(spark, d, LEFT), load(spark, d, RIGHT), "file", "path", "id").select("id", "path", F.col("n").cast("int"))


USERS = "SELECT concat(p_brand, p_type) AS key, concat('P', CAST(p_partkey AS VARCHAR(20))) AS target FROM part"


@query(f"""WITH RECURSIVE e AS ({I.PART_CALLS}), u AS ({USERS}), w AS (SELECT target, target AS id, 0 AS depth FROM u UNION SELECT target, e.src, depth + 1 FROM w JOIN e ON e.dst = w.id WHERE depth < 3),
  r AS (SELECT target, id, min(depth) AS depth FROM w WHERE id <> target GROUP BY target, id), n AS (SELECT key, id, min(depth) AS depth FROM u JOIN r USING (target) GROUP BY key, id),
  f AS (SELECT key, max(c) >= 5 AS shared FROM u JOIN (SELECT target, count(*) AS c FROM r WHERE depth = 1 GROUP BY target) x USING (target) GROUP BY key)
  SELECT k.key, count(*) FILTER (n.depth = 1) AS direct, count(*) FILTER (n.depth > 1) AS transitive_only, count(n.id) AS reachable, CAST(coalesce(max(n.depth), 0) AS INT) AS max_depth,
    round(coalesce(sum(CASE WHEN n.id IS NOT NULL THEN coalesce(CAST(s.score AS DOUBLE), 0.01) / pow(2, n.depth - 1) END), 0), 6) AS cumulative_risk, coalesce(any_value(f.shared), false) AS shared_utility
  FROM (SELECT DISTINCT key FROM u) k LEFT JOIN n ON n.key = k.key LEFT JOIN ({C.SCORES}) s ON s.id = n.id LEFT JOIN f ON f.key = k.key GROUP BY k.key""")
def asset_blast_radius(spark, d):
    return crypto.blast_radius(load(spark, d, USERS), load(spark, d, I.PART_CALLS), load(spark, d, C.SCORES), 3).withColumn("cumulative_risk", F.round("cumulative_risk", 6))


HOT_TYPES = "SELECT n_name AS id, 0.5 AS rank, CAST(n_regionkey AS BIGINT) AS in_degree, CASE n_nationkey % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'CRITICAL' ELSE 'MEDIUM' END AS level FROM nation"
PLACES = "SELECT n_name AS id, concat('src/', n_name, '.java') AS path, CAST(1 AS INT) AS line, CAST(1 AS INT) AS col FROM nation UNION ALL SELECT DISTINCT event_type, concat('src/', event_type, '.java'), CAST(1 AS INT), CAST(1 AS INT) FROM events"


@query(f"""{C._CYCLES}, x AS (SELECT path[1] AS raw, 'CC001' AS rule_id, 'HIGH' AS severity, concat('Architectural cycle detected: ', array_to_string(path, ' -> ')) AS message FROM c
  UNION ALL SELECT id, 'CC002', 'MEDIUM', concat('High-risk architectural hotspot: ', id, ' (PageRank: 0.5000, In-degree: ', in_degree, ', Risk: ', level, ')') FROM ({HOT_TYPES}) h WHERE level IN ('HIGH', 'CRITICAL'))
  SELECT concat('src/', raw, '.java') AS path, 1::INT AS line, raw, rule_id, severity, message FROM x""")
def findings_architecture(spark, d):
    cycles = graph.cycles(load(spark, d, I.FUNNEL), total=10_000, per_component=10_000)
    return views.architectural(cycles, load(spark, d, HOT_TYPES).withColumn("rank", F.col("rank").cast("double")), load(spark, d, PLACES)).select("path", "line", "raw", "rule_id", "severity", "message")


@query(f"{C._DISTINCT} SELECT * FROM g WHERE severity = 'HIGH' AND (lower(rule_id) LIKE '%des%' OR lower(message) LIKE '%des%' OR lower(path) LIKE '%des%')")
def findings_search(spark, d):
    return crypto.searched(crypto.deduplicated(crypto.findings(load(spark, d, I.USAGES))), " DES ", severity="HIGH")


@query(f"""{C._DISTINCT} SELECT path, line, col, rule_id, severity, CAST(row_number() OVER (ORDER BY path, line, col, rule_id, CASE severity WHEN 'INFO' THEN 0 WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END, message) AS INT) AS position FROM g""")
def findings_sorted(spark, d):
    from pyspark.sql import Window

    rows = crypto.deduplicated(crypto.findings(load(spark, d, I.USAGES)))
    order = Window.orderBy("path", "line", "col", "rule_id", crypto.severity_rank(F.col("severity")), "message")
    return rows.select("path", "line", "col", "rule_id", "severity", F.row_number().over(order).alias("position"))


@query(f"{C._A} SELECT DISTINCT key, usage_id FROM r WHERE NOT ok")
def unresolved_usages(spark, d):
    return crypto.unresolved(C._described(spark, d)[0]).select("key", "usage_id")


@query(f"{C._A} SELECT asset_family, count(*) AS n FROM d GROUP BY asset_family")
def family_counts(spark, d):
    return crypto.breakdown(C._described(spark, d)[0], "asset_family")


@query(f"{C._A} SELECT primitive, count(*) AS n FROM d GROUP BY primitive")
def primitive_counts(spark, d):
    return crypto.breakdown(C._described(spark, d)[0], "primitive")


@query(f"""{C._P} SELECT key, CASE priority WHEN 'LOW' THEN 1 WHEN 'REVIEW_REQUIRED' THEN 3 ELSE 0 END AS shown_priority, CASE exposure WHEN 'QUANTUM_VULNERABLE' THEN 4 WHEN 'CLASSICALLY_WEAK' THEN 3 WHEN 'QUANTUM_IMPACTED' THEN 2 WHEN 'UNKNOWN' THEN 1 ELSE 0 END AS shown_exposure FROM y""")
def pqc_shown_ranks(spark, d):
    rows = crypto.exposure(C._described(spark, d)[1])
    return rows.select("key", crypto.shown_rank("priority").cast("int").alias("shown_priority"), crypto.shown_rank("exposure").cast("int").alias("shown_exposure"))


_STANDARD = " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in crypto.TEMPLATES.items())


@query(f"""{C._P} SELECT key, CASE recommendation {_STANDARD} END AS standard FROM y""")
def pqc_advice(spark, d):
    return crypto.advised(crypto.exposure(C._described(spark, d)[1])).select("key", "standard")


@query(f"SELECT id, round(rank, 6) AS rank FROM ({C._rank_sql(I.TRADE_EDGES, C.WEIGHT)}) q")
def pagerank_distributed(spark, d):
    edges = C._weighted(load(spark, d, I.TRADE_EDGES))
    return graph.pagerank(edges, iterations=C.STEPS, tolerance=0, kernel_edges=0).select("id", six("rank"))
