"""How the given tables stand in for graphs, change logs, usages and findings. The texts run in Spark and in the check's SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.ordering import following

TABLES = "region nation customer supplier part orders lineitem events documents pages".split()

TRADE = """SELECT ns.n_name AS src, nd.n_name AS dst FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation nd ON c_nationkey = nd.n_nationkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ns ON s_nationkey = ns.n_nationkey"""
TRADE_EDGES = f"SELECT src, dst, count(*) AS call_count FROM ({TRADE}) t GROUP BY src, dst"
#: Each part calls the next one of its brand, the next one of its size, and the first of its brand and size: sparse, with cycles, many components and long paths.
PART_CALLS = """SELECT concat('P', CAST(k AS VARCHAR(20))) AS src, concat('P', CAST(n AS VARCHAR(20))) AS dst, count(*) AS call_count FROM (
  SELECT p_partkey AS k, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part
  UNION ALL SELECT p_partkey, lead(p_partkey) OVER (PARTITION BY p_size ORDER BY p_partkey) FROM part
  UNION ALL SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_size) FROM part) x WHERE n IS NOT NULL GROUP BY k, n"""
USER_NEXT = """SELECT src, dst, count(*) AS call_count FROM (
  SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events) t WHERE dst IS NOT NULL GROUP BY src, dst"""
FUNNEL = """SELECT src, dst, count(*) AS call_count FROM (
  SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) t WHERE dst IS NOT NULL GROUP BY src, dst"""
CHANGES = """SELECT event_type AS path, event_id AS commit, CAST(user_id AS VARCHAR(20)) AS author,
  CAST(floor(value) AS BIGINT) AS added, CAST(floor(value / 2) AS BIGINT) AS deleted FROM events"""
#: Orders as changes of their customer's file, by priority as author; some customers have orders of one priority only.
ORDER_CHANGES = """SELECT CAST(o_custkey AS VARCHAR(20)) AS path, o_orderkey AS commit, o_orderpriority AS author,
  CAST(floor(o_totalprice / 1000) AS BIGINT) AS added, CAST(floor(o_totalprice / 2000) AS BIGINT) AS deleted FROM orders"""
SKEWED = """SELECT CAST(user_id AS VARCHAR(20)) AS path, event_id AS commit, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'main' END AS author,
  CAST(floor(value) AS BIGINT) AS added, CAST(floor(value / 2) AS BIGINT) AS deleted FROM events"""
#: A crypto call for each part: owner and transformation by its keys, some unresolved, some unconfirmed, some at the same place.
USAGES = """SELECT concat('src/main/', lower(p_brand), '/P', CAST(p_partkey % 40 AS VARCHAR(10)), '.java') AS path,
  CAST(p_partkey % 97 + 1 AS INT) AS line, CAST(p_size AS INT) AS col,
  CASE p_partkey % 9 WHEN 0 THEN 'CIPHER' WHEN 1 THEN 'CIPHER' WHEN 2 THEN 'CIPHER' WHEN 3 THEN 'MESSAGE_DIGEST' WHEN 4 THEN 'SIGNATURE'
    WHEN 5 THEN 'KEY_PAIR_GENERATOR' WHEN 6 THEN 'SSL_CONTEXT' WHEN 7 THEN 'MAC' ELSE 'KEY_AGREEMENT' END AS owner,
  CASE p_partkey % 9 WHEN 0 THEN CASE p_size % 5 WHEN 0 THEN 'AES/ECB/PKCS5Padding' WHEN 1 THEN 'aes/gcm/NoPadding' WHEN 2 THEN 'AES' WHEN 3 THEN 'DES' ELSE 'DESede/CBC/PKCS5Padding' END
    WHEN 1 THEN CASE p_size % 4 WHEN 0 THEN 'RSA/ECB/OAEPPadding' WHEN 1 THEN 'AES/GCM/NoPadding' WHEN 2 THEN 'RC4' ELSE 'ChaCha20-Poly1305' END
    WHEN 2 THEN CASE p_size % 3 WHEN 0 THEN 'Blowfish/CBC' WHEN 1 THEN 'AES/ECB' ELSE '3DES' END
    WHEN 3 THEN CASE p_size % 6 WHEN 0 THEN 'MD5' WHEN 1 THEN 'SHA-256' WHEN 2 THEN 'SHA1' WHEN 3 THEN 'sha-1' WHEN 4 THEN 'SHA3-256' ELSE 'SHA-512/256' END
    WHEN 4 THEN CASE p_size % 4 WHEN 0 THEN 'SHA256withRSA' WHEN 1 THEN 'SHA256withECDSA' WHEN 2 THEN 'Ed25519' ELSE 'ML-DSA' END
    WHEN 5 THEN CASE p_size % 3 WHEN 0 THEN 'RSA' WHEN 1 THEN 'EC' ELSE 'DSA' END
    WHEN 6 THEN CASE p_size % 4 WHEN 0 THEN 'TLSv1' WHEN 1 THEN 'TLSv1.2' WHEN 2 THEN 'SSLv3' ELSE 'TLS' END
    WHEN 7 THEN CASE p_size % 2 WHEN 0 THEN 'HmacSHA256' ELSE 'HmacMD5' END
    ELSE CASE p_size % 2 WHEN 0 THEN 'DH' ELSE 'ECDH' END END AS raw,
  CASE WHEN p_partkey % 11 = 0 THEN 'LOW' ELSE 'HIGH' END AS confidence, p_partkey % 13 <> 0 AS resolved FROM part"""


def tables(spark: SparkSession, sf_dir: str) -> None:
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def load(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    tables(spark, sf_dir)
    return spark.sql(text)


def user_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """USER_NEXT, the next event found by ranges instead of a window that puts all events in one task."""
    events = following(load(spark, sf_dir, "SELECT ts, event_id, user_id AS src FROM events"), ["ts", "event_id"], {"dst": "src"})
    return events.where("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("call_count"))
