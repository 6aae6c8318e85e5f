"""The Java parser and resolver over sources generated from ``part``, one class for each row, with SQL that computes the same facts from the columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.ordering import following
from tessera.functions.storage import spread, stored
from tessera.javasrc import resolve, stage
from tessera.operators import crypto, graph

from .catalog import query
from .inputs import load

#: Each part, the class it becomes, and its neighbour's, which it calls.
PARTS = """SELECT p_partkey AS k, concat('com.', replace(lower(p_brand), '#', '')) AS package, concat('P', CAST(p_partkey AS VARCHAR(20))) AS name,
  lead(concat('P', CAST(p_partkey AS VARCHAR(20))), 1, 'P0') OVER (ORDER BY p_partkey) AS next_name,
  lead(concat('com.', replace(lower(p_brand), '#', '')), 1, 'com.none') OVER (ORDER BY p_partkey) AS next_package,
  CASE p_size % 6 WHEN 0 THEN 'AES/ECB/PKCS5Padding' WHEN 1 THEN 'DES' WHEN 2 THEN 'AES/GCM/NoPadding' WHEN 3 THEN 'DESede/CBC/PKCS5Padding' WHEN 4 THEN 'AES' ELSE 'RC4' END AS raw FROM part"""


#: The same without its neighbour, which :func:`following` finds by ranges; the window of PARTS would put all parts in one task, and the parser with them.
ALONE = """SELECT p_partkey AS k, concat('com.', replace(lower(p_brand), '#', '')) AS package, concat('P', CAST(p_partkey AS VARCHAR(20))) AS name,
  CASE p_size % 6 WHEN 0 THEN 'AES/ECB/PKCS5Padding' WHEN 1 THEN 'DES' WHEN 2 THEN 'AES/GCM/NoPadding' WHEN 3 THEN 'DESede/CBC/PKCS5Padding' WHEN 4 THEN 'AES' ELSE 'RC4' END AS raw FROM part"""


def numbered(spark, d) -> DataFrame:
    """PARTS, each part with its neighbour, dealt over tasks by its number."""
    alone = load(spark, d, ALONE)
    pairs = following(alone, ["k"], {"next_name": "name", "next_package": "package"}, {"next_name": F.lit("P0"), "next_package": F.lit("com.none")})
    return spread(pairs, "k", alone.count())


def sources(spark, d) -> DataFrame:
    parts = numbered(spark, d)
    imported = F.when(F.col("k") % 3 == 0, F.concat(F.lit("import "), "next_package", F.lit("."), "next_name", F.lit(";\n"))).when(F.col("k") % 3 == 1, F.concat(F.lit("import "), "next_package", F.lit(".*;\n"))).otherwise("")
    given = F.when(F.col("k") % 4 == 0, "args").when(F.col("k") % 4 == 1, F.concat(F.lit('"'), "raw", F.lit('"'))).otherwise("ALG")
    lines = [
        F.concat(F.lit("package "), "package", F.lit(";\n")), F.lit("import javax.crypto.Cipher;\n"), imported,
        F.concat(F.lit("/** No call: new Q().run(1); */\npublic class "), "name", F.lit(" {\n")),
        F.concat(F.lit('    private static final String ALG = "'), F.substring("raw", 1, 2), F.lit('" + "'), F.expr("substring(raw, 3)"), F.lit('";\n')),
        F.concat(F.lit("    public Object run(String args) throws Exception {\n        "), "next_name", F.lit(" next = new "), "next_name", F.lit("();\n        next.run(args);\n        return Cipher.getInstance("), given, F.lit(");\n    }\n}\n")),
    ]
    return parts.select(F.concat(F.lit("src/main/java/"), F.translate("package", ".", "/"), F.lit("/"), "name", F.lit(".java")).alias("path"), F.concat(*lines).alias("source"))


def _units(spark, d) -> DataFrame:
    return stored(stage.parsed(sources(spark, d)), "units")


_P = f"""WITH p AS (SELECT *, concat(package, '.', name) AS fqcn, concat('src/main/java/', replace(package, '.', '/'), '/', name, '.java') AS path FROM ({PARTS}) x),
  t AS (SELECT *, CASE WHEN next_name = 'P0' THEN false WHEN next_package = package OR k % 3 < 2 THEN true ELSE false END AS ok FROM p),
  r AS (SELECT *, CASE WHEN ok OR (k % 3 = 0) THEN concat(next_package, '.', next_name) ELSE next_name END AS target FROM t)"""
_C = f"""{_P}, c AS (SELECT path, fqcn AS caller, target, '<init>' AS method, '<init>()' AS signature, 'CONSTRUCTOR_CALL' AS kind, ok AS resolved_locally FROM r
  UNION ALL SELECT path, fqcn, target, 'run', CASE WHEN ok THEN 'run(String)' ELSE 'run(?)' END, 'METHOD_CALL', ok FROM r
  UNION ALL SELECT path, fqcn, 'javax.crypto.Cipher', 'getInstance', 'getInstance(?)', 'STATIC_METHOD_CALL', false FROM r)"""
COLUMNS = "path caller target method signature kind resolved_locally".split()


@query(f"{_P} SELECT fqcn, name AS simple_name, package, 'CLASS' AS kind, path, CAST(1 AS BIGINT) AS methods, CAST(1 AS BIGINT) AS fields FROM p")
def java_types(spark, d):
    n = lambda c: F.size(c).cast("long").alias(c)
    return stage.types(_units(spark, d)).select("fqcn", "simple_name", "package", "kind", "path", n("methods"), n("fields"))


@query(f"{_C} SELECT * FROM c")
def java_invocations(spark, d):
    units = _units(spark, d)
    return resolve.invocations(units, stored(stage.types(units), "types")).select(*COLUMNS)


@query(f"{_C} SELECT caller AS src, target AS dst, count(*) AS call_count, round(ln(1 + count(*)) / ln(2), 6) AS weight FROM c GROUP BY caller, target")
def java_edges(spark, d):
    units = _units(spark, d)
    calls = resolve.invocations(units, stored(stage.types(units), "types"))
    return graph.coalesced(calls.select(F.col("caller").alias("src"), F.col("target").alias("dst"))).select("src", "dst", "call_count", F.round("weight", 6).alias("weight"))


@query(f"{_C} SELECT path, count(*) AS total, count(*) FILTER (resolved_locally) AS internal, CAST(0 AS BIGINT) AS unresolvable, count(*) FILTER (NOT resolved_locally) AS external, 1.0::DOUBLE AS ratio FROM c GROUP BY path")
def java_resolution_metrics(spark, d):
    units = _units(spark, d)
    return resolve.metrics(resolve.invocations(units, stored(stage.types(units), "types")))


@query(f"{_P} SELECT path, 'CIPHER' AS owner, CASE WHEN k % 4 = 0 THEN NULL ELSE raw END AS raw, 'HIGH' AS confidence, k % 4 <> 0 AS resolved, fqcn AS enclosing, 'run' AS in_method FROM p")
def java_crypto_usages(spark, d):
    return stage.crypto_usages(_units(spark, d)).select("path", "owner", "raw", "confidence", "resolved", "enclosing", "in_method")


_RULES = """CASE WHEN raw LIKE '%/ECB/%' THEN ['CC-CRYPTO-001'] WHEN raw IN ('DES', 'RC4') THEN ['CC-CRYPTO-002', 'CC-CRYPTO-004'] WHEN raw LIKE 'DESede%' THEN ['CC-CRYPTO-002'] WHEN raw = 'AES' THEN ['CC-CRYPTO-004'] ELSE [] END"""


@query(f"{_P} SELECT path, raw, unnest({_RULES}) AS rule_id FROM p WHERE k % 4 <> 0")
def java_findings(spark, d):
    return crypto.deduplicated(crypto.findings(stage.crypto_usages(_units(spark, d)))).select("path", "raw", "rule_id")
