"""The registered queries: each operator bound to the given tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import crypto, graph, risk, safety

from . import inputs as I
from .inputs import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NATIONS = "SELECT n_name AS id FROM nation"
PARTS = "SELECT concat('P', CAST(p_partkey AS VARCHAR(20))) AS id FROM part"
TARGETS = "SELECT concat('P', CAST(p_partkey AS VARCHAR(20))) AS target FROM part"
#: Scores of the parts that have been ordered; others take the default.
SCORES = "SELECT concat('P', CAST(l_partkey AS VARCHAR(20))) AS id, CAST(count(*) AS DOUBLE) / 100 AS score FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY l_partkey"
STEPS = 20


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def six(c: str):
    return F.round(c, 6).alias(c)


@query(f"SELECT src, dst, call_count, round(ln(1 + call_count) / ln(2), 6) AS weight FROM ({I.TRADE_EDGES}) e")
def graph_edges_trade(spark, d):
    return graph.coalesced(load(spark, d, I.TRADE)).select("src", "dst", "call_count", six("weight"))


@query(f"""WITH e AS ({I.TRADE_EDGES}) SELECT n_name AS id, CAST((SELECT count(*) FROM e WHERE dst = n_name) AS BIGINT) AS in_degree,
  CAST((SELECT count(*) FROM e WHERE src = n_name) AS BIGINT) AS out_degree FROM nation""")
def graph_degrees_trade(spark, d):
    return graph.degrees(load(spark, d, I.TRADE_EDGES), load(spark, d, NATIONS)).select("id", F.col("in_degree").cast("long"), F.col("out_degree").cast("long"))


DECLARED = "SELECT n_name AS id FROM nation WHERE n_regionkey < 3"


@query(f"""WITH e AS ({I.TRADE_EDGES}), t AS ({DECLARED}) SELECT id, false AS is_boundary FROM t
  UNION SELECT x, true FROM (SELECT src AS x FROM e UNION SELECT dst FROM e) a WHERE x NOT IN (SELECT id FROM t)""")
def graph_vertices(spark, d):
    return graph.with_boundary(load(spark, d, DECLARED), load(spark, d, I.TRADE_EDGES))


@query(f"""SELECT src, dst, count(*) AS call_count FROM ({I.TRADE}) c WHERE dst IN ({DECLARED}) AND (src NOT LIKE 'java.%' OR src IN ({DECLARED})) GROUP BY src, dst""")
def graph_boundary_filter(spark, d):
    return graph.coalesced(graph.without_boundary(load(spark, d, I.TRADE), load(spark, d, DECLARED))).drop("weight")


def _rank_sql(edges: str, weight: str) -> str:
    ctes = [
        f"e AS MATERIALIZED (SELECT src, dst, CAST({weight} AS DOUBLE) AS w FROM ({edges}) x)",
        "v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)",
        "s AS MATERIALIZED (SELECT e.src, e.dst, w / t AS share FROM e JOIN (SELECT src, sum(w) AS t FROM e GROUP BY src) q ON q.src = e.src)",
        "r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS x FROM v)",
    ]
    for k in range(STEPS):
        loose = f"coalesce((SELECT sum(x) FROM r{k} WHERE id NOT IN (SELECT src FROM s)), 0)"
        ctes.append(
            f"r{k + 1} AS MATERIALIZED (SELECT v.id, (0.15 + 0.85 * {loose}) / (SELECT count(*) FROM v) + 0.85 * coalesce(g.x, 0) AS x FROM v "
            f"LEFT JOIN (SELECT s.dst, sum(r.x * s.share) AS x FROM s JOIN r{k} r ON r.id = s.src GROUP BY s.dst) g ON g.dst = v.id)"
        )
    return "WITH " + ", ".join(ctes) + f" SELECT id, x AS rank FROM r{STEPS}"


WEIGHT = "ln(1 + call_count) / ln(2)"


def _weighted(edges: DataFrame) -> DataFrame:
    return edges.withColumn("weight", F.log(1 + F.col("call_count").cast("double")) / F.log(F.lit(2.0)))


@query(f"SELECT id, round(rank, 6) AS rank FROM ({_rank_sql(I.USER_NEXT, WEIGHT)}) q")
def pagerank_usernext(spark, d):
    return graph.pagerank(_weighted(I.user_next(spark, d)), iterations=STEPS, tolerance=0).select("id", six("rank"))


@query(f"""SELECT id, round(rank, 6) AS rank, CAST(row_number() OVER (ORDER BY round(rank, 12) DESC, id) AS INT) AS position,
  round(100 * (rank - min(rank) OVER ()) / (max(rank) OVER () - min(rank) OVER ()), 4) AS minmax_score FROM ({_rank_sql(I.TRADE_EDGES, WEIGHT)}) q""")
def hotspots_trade(spark, d):
    edges = _weighted(load(spark, d, I.TRADE_EDGES))
    return graph.hotspots(graph.pagerank(edges, iterations=STEPS, tolerance=0), edges).select("id", six("rank"), "position", F.round("minmax_score", 4).alias("minmax_score"))


_REACH_ALL = "r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)"


@query(f"""WITH RECURSIVE e AS ({I.PART_CALLS}), {_REACH_ALL},
  v AS ({PARTS}), m AS (SELECT id, id AS other FROM v UNION SELECT a.src, a.dst FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src),
  c AS (SELECT id, min(other) AS component, CAST(count(*) AS BIGINT) AS size FROM m GROUP BY id)
  SELECT id, component, size, EXISTS (SELECT 1 FROM e WHERE src = id AND dst = id) AS self_loop, size > 1 AS cyclic FROM c""")
def scc_parts(spark, d):
    return graph.components(load(spark, d, I.PART_CALLS), load(spark, d, PARTS))


@query(ORACLES["scc_parts"])
def scc_parts_distributed(spark, d):
    return graph.components(load(spark, d, I.PART_CALLS), load(spark, d, PARTS), kernel_edges=0)


_CYCLES = f"""WITH RECURSIVE e AS ({I.FUNNEL}),
  p AS (SELECT src AS start, dst AS at, [src, dst] AS path FROM e WHERE dst > src
    UNION ALL SELECT start, e.dst, list_append(path, e.dst) FROM p JOIN e ON e.src = p.at WHERE e.dst > start AND NOT list_contains(path, e.dst) AND len(path) < {graph.MAX_LENGTH}),
  c AS (SELECT list_append(path, start) AS path FROM p JOIN e ON e.src = p.at AND e.dst = p.start)"""


@query(f"{_CYCLES} SELECT array_to_string(path, ' > ') AS path, CAST(len(path) - 1 AS INT) AS length FROM c")
def cycles_funnel(spark, d):
    found = graph.cycles(load(spark, d, I.FUNNEL), total=10_000, per_component=10_000)
    return found.select(F.array_join("path", " > ").alias("path"), "length")


@query(f"{_CYCLES} SELECT array_to_string(path, ' > ') AS path, CAST(row_number() OVER (ORDER BY path) AS INT) AS nth, true AS truncated FROM c ORDER BY path LIMIT {graph.PER_COMPONENT}")
def cycles_truncated(spark, d):
    """The caps of the operator, met: its first cycles in depth-first order."""
    return graph.cycles(load(spark, d, I.FUNNEL)).select(F.array_join("path", " > ").alias("path"), "nth", "truncated")


@query(f"""{_CYCLES}, h AS (SELECT path, i, path[i] AS src, path[i + 1] AS dst FROM (SELECT path, unnest(range(1, len(path))) AS i FROM c) x)
  SELECT array_to_string(path, ' > ') AS path, src, dst, call_count FROM (
    SELECT h.*, call_count, row_number() OVER (PARTITION BY path ORDER BY call_count, i) AS k FROM h JOIN e USING (src, dst)) q WHERE k = 1""")
def weakest_link(spark, d):
    edges = load(spark, d, I.FUNNEL)
    found = graph.cycles(edges, total=10_000, per_component=10_000)
    return graph.weakest_links(found, edges).join(found, ["component", "nth"]).select(F.array_join("path", " > ").alias("path"), "src", "dst", "call_count")


_BACK = f"""WITH RECURSIVE e AS ({I.PART_CALLS}), w AS (
  SELECT target, target AS id, 0 AS depth FROM ({TARGETS}) t UNION SELECT target, e.src, depth + 1 FROM w JOIN e ON e.dst = w.id WHERE depth < 3),
  r AS (SELECT target, id, min(depth) AS depth FROM w WHERE id <> target GROUP BY target, id)"""


@query(f"{_BACK} SELECT target, id, CAST(depth AS INT) AS depth FROM r")
def blast_radius_parts(spark, d):
    return graph.reach(load(spark, d, I.PART_CALLS), load(spark, d, TARGETS), 3)


@query(f"""{_BACK} SELECT target, count(*) FILTER (depth = 1) AS direct, count(*) AS total, round(sum(coalesce(CAST(score AS DOUBLE), 0.01) / pow(2, depth - 1)), 6) AS risk
  FROM r LEFT JOIN ({SCORES}) s USING (id) GROUP BY target""")
def impact_risk_parts(spark, d):
    reached = graph.reach(load(spark, d, I.PART_CALLS), load(spark, d, TARGETS), 3)
    return graph.impact(reached, load(spark, d, SCORES)).select("target", "direct", "total", six("risk"))


_BOTH = f"""WITH RECURSIVE b AS ({I.PART_CALLS}), e AS (SELECT src, dst FROM b UNION SELECT dst, src FROM b), w AS (
  SELECT target, target AS id, 0 AS depth FROM ({TARGETS}) t UNION SELECT target, e.src, depth + 1 FROM w JOIN e ON e.dst = w.id WHERE depth < 2),
  r AS (SELECT target, count(DISTINCT id) AS reached FROM w WHERE id <> target GROUP BY target),
  q AS (SELECT target, reached, 100.0 * reached / (SELECT count(*) - 1 FROM part) AS percent FROM r)"""


@query(f"""{_BOTH} SELECT target, reached, round(CAST(percent AS DOUBLE), 6) AS percent,
  CASE WHEN percent >= 60 THEN 'Critical' WHEN percent >= 30 THEN 'Wide' WHEN percent >= 10 THEN 'Moderate' ELSE 'Contained' END AS band FROM q""")
def radius_bands(spark, d):
    return graph.radius(load(spark, d, I.PART_CALLS), load(spark, d, TARGETS), 2, load(spark, d, PARTS).count(), "both").where("reached > 0").select("target", "reached", six("percent"), "band")


NAMES = "SELECT p_partkey, concat('com.', lower(p_brand), CASE WHEN p_partkey % 7 = 0 THEN '.test.' ELSE '.' END, 'P', CAST(p_size AS VARCHAR(9)), CASE p_partkey % 5 WHEN 0 THEN 'Test' WHEN 1 THEN 'IT' WHEN 2 THEN 'Tester' ELSE '' END) AS id FROM part"


@query(f"SELECT p_partkey, id FROM ({NAMES}) n WHERE regexp_matches(id, '(Test|Tests|IT|TestCase)$') OR id LIKE '%.test.%'")
def test_scope(spark, d):
    return load(spark, d, NAMES).where(graph.is_test(F.col("id")))


@query(f"""WITH RECURSIVE e AS ({I.PART_CALLS}), b AS (SELECT min(src) AS s FROM e),
  w AS (SELECT s AS id, 0 AS depth FROM b UNION SELECT e.dst, depth + 1 FROM w JOIN e ON e.src = w.id WHERE depth < 4),
  f AS (SELECT id, min(depth) AS depth FROM w GROUP BY id),
  p AS (SELECT s AS here, [s] AS path FROM b UNION ALL SELECT e.dst, list_append(path, e.dst) FROM p JOIN e ON e.src = p.here WHERE len(path) < 5 AND NOT list_contains(path, e.dst)),
  g AS (SELECT max(id) AS id FROM f WHERE depth = 4), k AS (SELECT path FROM p JOIN g ON here = id ORDER BY len(path), path LIMIT 1),
  h AS (SELECT i AS hop, path[i] AS src, path[i + 1] AS dst FROM (SELECT path, unnest(range(1, len(path))) AS i FROM k) x)
  SELECT CAST(hop AS INT) AS hop, src, dst, call_count FROM h JOIN e USING (src, dst)""")
def path_trace_parts(spark, d):
    """From the first part to the last of those four calls away; several paths are as short."""
    edges = load(spark, d, I.PART_CALLS)
    start = edges.agg(F.min("src")).first()[0]
    goal = graph.reach(edges, edges.select(F.lit(start).alias("target")).limit(1), 4, forward=True).where("depth = 4").agg(F.max("id")).first()[0]
    return graph.shortest_path(edges, start, goal, 7)


#: Two interfaces and a superclass for each nation and region: (child, parent, nth), the superclass first though its name is last.
HIERARCHY = """SELECT concat('c', CAST(c_custkey AS VARCHAR(20))) AS child, n_name AS parent, CAST(0 AS INT) AS nth FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT concat('c', CAST(c_custkey AS VARCHAR(20))), c_mktsegment, CAST(1 AS INT) FROM customer
  UNION ALL SELECT n_name, concat('Z', r_name), CAST(0 AS INT) FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT n_name, concat('A', r_name), CAST(1 AS INT) FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT DISTINCT c_mktsegment, concat('Z', r_name), CAST(0 AS INT) FROM customer, region WHERE r_regionkey = 0
  UNION ALL SELECT DISTINCT c_mktsegment, 'AMarket', CAST(1 AS INT) FROM customer"""


@query("""WITH p AS (SELECT concat('c', CAST(c_custkey AS VARCHAR)) AS child, n_name, c_mktsegment, r_name, (SELECT r_name FROM region WHERE r_regionkey = 0) AS zero FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  x AS (SELECT child, [n_name, c_mktsegment, 'Z' || r_name, 'A' || r_name, 'Z' || zero, 'AMarket'] AS ways FROM p
    UNION ALL SELECT n_name, ['Z' || r_name, 'A' || r_name] FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT DISTINCT c_mktsegment, ['Z' || zero, 'AMarket'] FROM p),
  u AS (SELECT child, ways, unnest(range(1, len(ways) + 1)) AS i FROM x), f AS (SELECT child, ways[i] AS parent, min(i) AS i, CASE WHEN any_value(len(ways)) = 2 OR min(i) <= 2 THEN 1 ELSE 2 END AS depth FROM u GROUP BY child, ways[i])
  SELECT child, parent, CAST(depth AS INT) AS depth, CAST(row_number() OVER (PARTITION BY child ORDER BY i) AS INT) AS position FROM f""")
def hierarchy_supertypes(spark, d):
    from tessera.javasrc import resolve

    return resolve.supertypes(load(spark, d, HIERARCHY))


@query(f"SELECT id, in_degree, out_degree, round(CASE WHEN in_degree + out_degree = 0 THEN 0 ELSE out_degree::DOUBLE / (in_degree + out_degree) END, 6) AS instability FROM (SELECT n_name AS id, (SELECT count(*) FROM ({I.TRADE_EDGES}) e WHERE dst = n_name AND src <> dst) AS in_degree, (SELECT count(*) FROM ({I.TRADE_EDGES}) e WHERE src = n_name AND src <> dst) AS out_degree FROM nation) q")
def instability_trade(spark, d):
    return graph.instability(load(spark, d, I.TRADE_EDGES), load(spark, d, NATIONS)).select("id", F.col("in_degree").cast("long"), F.col("out_degree").cast("long"), six("instability"))


@query(f"""WITH e AS ({I.TRADE_EDGES}) SELECT src, dst, call_count, CAST(k AS INT) AS position, CAST(greatest(n - 8, 0) AS BIGINT) AS remainder, EXISTS (SELECT 1 FROM e b WHERE b.src = q.dst AND b.dst = q.src) AS two_way
  FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY call_count DESC, dst) AS k, count(*) OVER (PARTITION BY src) AS n FROM e WHERE src <> dst) q WHERE k <= 8""")
def top_neighbours_trade(spark, d):
    return graph.top_neighbours(load(spark, d, I.TRADE_EDGES)).withColumn("remainder", F.col("remainder").cast("long"))


@query(f"SELECT path, count(DISTINCT commit) AS commits, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted, count(DISTINCT author) AS authors FROM ({I.CHANGES}) c GROUP BY path")
def churn_metrics(spark, d):
    return risk.churn(load(spark, d, I.CHANGES))


_BUS = """SELECT path, CASE WHEN count(*) <= 1 THEN 1.0 ELSE greatest(0, least(1, 1 + sum(p * log2(p)) / log2(count(*)))) END AS bus_factor FROM (
  SELECT path, author, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY path) AS p FROM ({0}) c GROUP BY path, author) q GROUP BY path"""


@query(f"SELECT path, round(CAST(bus_factor AS DOUBLE), 6) AS bus_factor FROM ({_BUS.format(I.CHANGES)}) b")
def bus_factor(spark, d):
    return risk.bus_factor(load(spark, d, I.CHANGES)).select("path", six("bus_factor"))


@query(f"SELECT path, round(CAST(bus_factor AS DOUBLE), 6) AS bus_factor FROM ({_BUS.format(I.SKEWED)}) b")
def bus_factor_skewed(spark, d):
    return risk.bus_factor(load(spark, d, I.SKEWED)).select("path", six("bus_factor"))


HOT = """SELECT concat('T', path) AS id, concat('src/main/', path) AS file, CAST(row_number() OVER (ORDER BY n DESC, path) AS INT) AS position,
  CAST(n * 100.0 / max(n) OVER () AS DOUBLE) AS minmax_score, n % 2 = 0 AS in_cycle FROM (SELECT CAST(user_id AS VARCHAR(20)) AS path, count(*) AS n FROM events GROUP BY user_id) q"""


@query(f"""WITH h AS ({HOT}), m AS (SELECT path, count(DISTINCT commit) + (sum(added) + sum(deleted)) / 10.0 AS churn FROM ({I.SKEWED}) c GROUP BY path), b AS ({_BUS.format(I.SKEWED)}),
  q AS (SELECT id, position, 0.4 * minmax_score + 0.3 * 100.0 * churn / greatest(1, (SELECT max(churn) FROM m)) + CASE WHEN in_cycle THEN 20 ELSE 0 END + 10.0 * bus_factor AS x
    FROM h JOIN m ON h.id = concat('T', m.path) JOIN b ON b.path = m.path),
  o AS (SELECT id, position, CAST(greatest(0, least(100, x)) AS DOUBLE) AS x FROM q)
  SELECT id, round(x, 4) AS overall, CASE WHEN x <= 25 THEN 'LOW' WHEN x <= 50 THEN 'MEDIUM' WHEN x <= 75 THEN 'HIGH' ELSE 'CRITICAL' END AS level, position FROM o""")
def composite_risk(spark, d):
    changes = load(spark, d, I.SKEWED)
    metrics = risk.churn(changes).join(risk.bus_factor(changes), "path")
    hot = load(spark, d, HOT).withColumnRenamed("file", "path")
    return risk.composite(hot, metrics).select("id", F.round("overall", 4).alias("overall"), "level", "position")


@query(f"SELECT path, count(DISTINCT commit) AS commits, count(DISTINCT author) AS authors FROM ({I.ORDER_CHANGES}) c GROUP BY path HAVING count(DISTINCT author) = 1 AND sum(added) + sum(deleted) + count(*) > 0")
def single_author_files(spark, d):
    return risk.single_author(risk.churn(load(spark, d, I.ORDER_CHANGES))).select("path", "commits", "authors")


_U = f"""u AS (SELECT *, trim(split_part(raw, '/', 1)) AS family, nullif(trim(split_part(raw, '/', 2)), '') AS mode, nullif(trim(split_part(raw, '/', 3)), '') AS padding FROM ({I.USAGES}) x),
  k AS (SELECT *, raw NOT LIKE '%/%' AS bare, regexp_matches(upper(family), 'RSA|ELGAMAL|ECIES') AS "asymmetric",
    coalesce(upper(mode) = 'ECB', false) AND NOT regexp_matches(upper(family), 'RSA|ELGAMAL|ECIES') AS ecb, upper(family) IN ('DES', 'RC2', 'RC4', 'ARCFOUR', 'BLOWFISH') AS legacy,
    upper(family) IN ('DESEDE', 'TRIPLEDES', '3DES') AS triple_des, replace(upper(family), '-', '') IN ('MD2', 'MD4', 'MD5', 'SHA1') AS weak_digest,
    upper(family) IN ('SSL', 'SSLV2', 'SSLV3', 'TLSV1', 'TLSV1.0', 'TLSV1.1') AS old_tls FROM u)"""
_F = " UNION ALL ".join(
    f"SELECT path, line, col, raw, '{r}' AS rule_id, '{s}' AS severity, '{c}' AS category, '{w}' AS cwe, concat('{a.replace(chr(39), chr(39) * 2)}', raw, '{b.replace(chr(39), chr(39) * 2)}') AS message, '{t}' AS status FROM k WHERE resolved AND confidence = 'HIGH' AND owner = '{o}' AND {p}{' AND NOT legacy' if p == 'triple_des' else ''}"
    for r, o, p, s, c, w, a, b, t in crypto.RULES
)
_DISTINCT = f"WITH {_U}, f AS ({_F}), g AS (SELECT DISTINCT * FROM f)"


@query(f"WITH {_U} SELECT path, line, col, raw, owner, family, mode, padding, bare, \"asymmetric\" AS public_key, ecb, legacy, triple_des, weak_digest, old_tls FROM k")
def crypto_classify(spark, d):
    names = "path line col raw owner family mode padding bare public_key ecb legacy triple_des weak_digest old_tls".split()
    return crypto.classified(load(spark, d, I.USAGES)).withColumnRenamed("asymmetric", "public_key").select(*names)


@query(f"WITH {_U} {_F}")
def findings_usages(spark, d):
    return crypto.findings(load(spark, d, I.USAGES))


@query(f"{_DISTINCT} SELECT * FROM g")
def findings_dedup(spark, d):
    usages = load(spark, d, I.USAGES)
    return crypto.ordered(crypto.deduplicated(crypto.findings(usages.union(usages))))


@query(f"""{_DISTINCT} SELECT s.severity, s.severity_rank, count(g.severity) AS n FROM (VALUES ('INFO', 0), ('LOW', 1), ('MEDIUM', 2), ('HIGH', 3), ('CRITICAL', 4)) s(severity, severity_rank)
  LEFT JOIN g ON g.severity = s.severity GROUP BY ALL""")
def severity_hist(spark, d):
    return crypto.severity_histogram(crypto.deduplicated(crypto.findings(load(spark, d, I.USAGES))))


@query(f"{_DISTINCT} SELECT count(*) FILTER (severity IN ('HIGH', 'CRITICAL')) AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity IN ('LOW', 'INFO')) AS low FROM g")
def severity_cards(spark, d):
    return crypto.severity_cards(crypto.deduplicated(crypto.findings(load(spark, d, I.USAGES))))


@query(f"{_DISTINCT} SELECT path, count(*) AS n FROM g GROUP BY path ORDER BY n DESC, path LIMIT 5")
def top_files(spark, d):
    return crypto.top_files(crypto.deduplicated(crypto.findings(load(spark, d, I.USAGES))))


@query(f"SELECT count(*) FILTER (resolved AND confidence = 'HIGH') AS resolved, count(*) FILTER (NOT (resolved AND confidence = 'HIGH')) AS unresolved, round(count(*) FILTER (resolved AND confidence = 'HIGH') / count(*), 6) AS ratio FROM ({I.USAGES}) u")
def resolution_ratio(spark, d):
    return crypto.resolution_ratio(load(spark, d, I.USAGES)).select("resolved", "unresolved", six("ratio"))


_A = f"""WITH {_U}, n AS (SELECT *, resolved AND confidence = 'HIGH' AS ok, replace(upper(family), '-', '') AS f,
    CASE WHEN mode IS NOT NULL AND padding IS NOT NULL THEN concat(upper(family), '/', upper(mode), '/', padding) WHEN mode IS NOT NULL THEN concat(upper(family), '/', upper(mode)) ELSE trim(raw) END AS canon FROM u),
  r AS (SELECT *, CASE WHEN ok THEN canon ELSE concat('UNKNOWN-', owner) END AS name, concat(owner, '|', CASE WHEN ok THEN upper(canon) ELSE 'UNKNOWN' END) AS key,
    concat(path, ':', line, ':', col) AS usage_id,
    CASE WHEN NOT ok THEN 'UNKNOWN' WHEN f IN ('AES', 'DES', 'RC2', 'MD2', 'MD4', 'MD5', 'DSA', 'RSA', 'ECDSA', 'EC') THEN f WHEN f IN ('DESEDE', '3DES', 'TRIPLEDES') THEN '3DES' WHEN f IN ('RC4', 'ARCFOUR') THEN 'RC4' WHEN f = 'BLOWFISH' THEN 'Blowfish'
      WHEN f LIKE 'CHACHA20%' THEN 'ChaCha20' WHEN f IN ('ECDH', 'DH') THEN 'Diffie-Hellman' WHEN f LIKE '%RSA%' THEN 'RSA' WHEN f LIKE '%ECDSA%' THEN 'ECDSA' WHEN f LIKE '%DSA%' THEN 'DSA' WHEN f LIKE '%ED25519%' THEN 'Ed25519' WHEN f LIKE 'HMAC%' THEN 'HMAC'
      WHEN f = 'SHA1' THEN 'SHA-1' WHEN f LIKE 'SHA2%' OR f IN ('SHA384', 'SHA512', 'SHA224') THEN 'SHA-2' WHEN f LIKE 'SHA3%' THEN 'SHA-3' WHEN f LIKE 'TLS%' OR f LIKE 'SSL%' THEN 'TLS' ELSE family END AS asset_family,
    CASE owner WHEN 'CIPHER' THEN CASE WHEN ok AND regexp_matches(upper(family), 'RSA|ELGAMAL|ECIES') THEN 'PUBLIC_KEY_ENCRYPTION' WHEN ok AND regexp_matches(upper(family), 'RC4|ARCFOUR|CHACHA20') THEN 'STREAM_CIPHER' ELSE 'BLOCK_CIPHER' END
      WHEN 'SSL_CONTEXT' THEN 'TLS_PROTOCOL' ELSE owner END AS primitive FROM n),
  d AS (SELECT DISTINCT ON (key, usage_id) * FROM r ORDER BY key, usage_id, name),
  a AS (SELECT concat('crypto-asset-', lower(hex(key))) AS asset_id, key, arg_min(name, (path, line, col, name)) AS name, min(asset_family) AS asset_family, min(primitive) AS primitive, bool_or(ok) AS is_resolved,
    count(*) AS usage_count, count(DISTINCT path) AS files, CASE WHEN bool_or(ok) THEN 'HIGH' ELSE 'LOW' END AS confidence FROM d GROUP BY key)"""
ASSET = "asset_id key name asset_family primitive is_resolved usage_count files confidence".split()


def _described(spark, d):
    rows = crypto.described(load(spark, d, I.USAGES))
    return rows, crypto.inventory(rows)


@query(f"{_A} SELECT {', '.join(ASSET)} FROM a")
def inventory_group(spark, d):
    return _described(spark, d)[1].select(*ASSET)


@query(f"""{_A} SELECT (SELECT count(*) FROM r) AS observations, (SELECT count(*) FROM d WHERE NOT ok) AS unresolved_usages, (SELECT count(DISTINCT path) FROM d) AS files,
  (SELECT count(*) FROM a) AS unique_assets, (SELECT count(*) FROM a WHERE is_resolved) AS resolved_assets""")
def inventory_summary(spark, d):
    return crypto.summary(*_described(spark, d))


@query(f"{_A} SELECT DISTINCT usage_id, concat('crypto-asset-', lower(hex(key))) AS asset_id, 'USES_ALGORITHM' AS relation FROM r")
def inventory_relationships(spark, d):
    return crypto.relationships(_described(spark, d)[0])


_P = f"""{_A}, x AS (SELECT *, CASE WHEN NOT is_resolved THEN 'UNKNOWN' WHEN regexp_matches(upper(name), 'ML-KEM|ML-DSA|SLH-DSA|KYBER|DILITHIUM|SPHINCS|FALCON|XMSS|LMS') THEN 'QUANTUM_SAFE'
    WHEN upper(asset_family) IN ('DES', '3DES', 'MD2', 'MD4', 'MD5', 'SHA-1', 'RC2', 'RC4', 'BLOWFISH') THEN 'CLASSICALLY_WEAK'
    WHEN regexp_matches(upper(asset_family), 'RSA|DIFFIE-HELLMAN|EC|ED25519') OR upper(asset_family) IN ('DH', 'DSA') OR regexp_matches(upper(name), 'RSA|ECDSA|DIFFIE|DH') OR primitive IN ('PUBLIC_KEY_ENCRYPTION', 'KEY_AGREEMENT', 'SIGNATURE', 'KEY_PAIR_GENERATOR') THEN 'QUANTUM_VULNERABLE'
    WHEN primitive IN ('BLOCK_CIPHER', 'STREAM_CIPHER', 'MESSAGE_DIGEST', 'MAC') THEN 'QUANTUM_IMPACTED' ELSE 'UNKNOWN' END AS exposure,
  CASE WHEN NOT is_resolved THEN 'UNKNOWN' ELSE CASE primitive WHEN 'BLOCK_CIPHER' THEN 'SYMMETRIC_ENCRYPTION' WHEN 'STREAM_CIPHER' THEN 'SYMMETRIC_ENCRYPTION' WHEN 'SIGNATURE' THEN 'DIGITAL_SIGNATURE'
    WHEN 'MESSAGE_DIGEST' THEN 'HASH_FUNCTION' WHEN 'KEY_PAIR_GENERATOR' THEN 'KEY_PAIR_GENERATION' WHEN 'TLS_PROTOCOL' THEN 'SECURE_TRANSPORT' ELSE primitive END END AS purpose FROM a),
  y AS (SELECT *, CASE WHEN NOT is_resolved THEN 'PRIORITY_UNDETERMINED' WHEN exposure = 'QUANTUM_SAFE' THEN 'LOW' ELSE 'REVIEW_REQUIRED' END AS priority,
    CASE WHEN NOT is_resolved OR exposure = 'UNKNOWN' THEN 'UNKNOWN_OR_UNRESOLVED' WHEN exposure = 'CLASSICALLY_WEAK' THEN 'CLASSICAL_REMEDIATION' WHEN exposure = 'QUANTUM_IMPACTED' THEN 'QUANTUM_CONSIDERATION' ELSE 'PQC_MIGRATION_CANDIDATE' END AS category,
    CASE WHEN NOT is_resolved OR purpose = 'SECURE_TRANSPORT' THEN 'none' WHEN exposure = 'CLASSICALLY_WEAK' THEN 'classicalRemediation' WHEN exposure = 'QUANTUM_VULNERABLE' THEN CASE purpose WHEN 'DIGITAL_SIGNATURE' THEN 'mlDsaSignature' WHEN 'KEY_AGREEMENT' THEN 'mlKemKeyExchange' WHEN 'PUBLIC_KEY_ENCRYPTION' THEN 'kemDemArchitecture' WHEN 'KEY_PAIR_GENERATION' THEN 'keyPairUsageDependent' ELSE 'none' END
      WHEN exposure = 'QUANTUM_IMPACTED' THEN CASE WHEN purpose = 'SYMMETRIC_ENCRYPTION' THEN 'symmetricUpgrade' ELSE 'hashBaseline' END WHEN exposure = 'QUANTUM_SAFE' THEN 'pqcApproved' ELSE 'none' END AS recommendation FROM x)"""


@query(f"{_P} SELECT key, name, exposure, purpose, priority, category, recommendation FROM y")
def pqc_assess(spark, d):
    return crypto.exposure(_described(spark, d)[1]).select("key", "name", "exposure", "purpose", "priority", "category", "recommendation")


@query(f"""{_P} SELECT count(*) AS assets, {', '.join(f"count(*) FILTER (exposure = '{x}') AS {x.lower()}" for x in ('QUANTUM_VULNERABLE', 'QUANTUM_IMPACTED', 'CLASSICALLY_WEAK', 'QUANTUM_SAFE', 'UNKNOWN'))},
  {', '.join(f"count(*) FILTER (priority = '{x}') AS {x.lower()}" for x in ('REVIEW_REQUIRED', 'PRIORITY_UNDETERMINED', 'LOW'))} FROM y""")
def pqc_report(spark, d):
    return crypto.report(crypto.exposure(_described(spark, d)[1]))


VERTICES = "SELECT CAST(page_id AS VARCHAR(20)) AS id, url AS path FROM pages"
MODIFIED = "SELECT url AS file FROM pages WHERE length(html) < (SELECT avg(length(html)) FROM pages)"
_NORM = "concat('/', regexp_replace({0}, '^([a-z]+://[^/]*)?/?|[?#].*$', '', 'g'))"


@query(f"""SELECT id, path FROM ({VERTICES}) v WHERE EXISTS (SELECT 1 FROM ({MODIFIED}) m WHERE suffix({_NORM.format('path')}, {_NORM.format('file')}) OR suffix({_NORM.format('file')}, {_NORM.format('path')}))""")
def touched_classes(spark, d):
    return safety.touched(load(spark, d, VERTICES), load(spark, d, MODIFIED))


@query(f"""SELECT DISTINCT url AS file FROM pages p WHERE NOT EXISTS (SELECT 1 FROM ({MODIFIED}) m WHERE suffix({_NORM.format('url')}, {_NORM.format('file')}) OR suffix({_NORM.format('file')}, {_NORM.format('url')}))""")
def plan_verify(spark, d):
    return safety.violations(load(spark, d, "SELECT url AS file FROM pages"), load(spark, d, MODIFIED))
