"""The parser, scopes and resolver over richer sources generated from ``part``: all kinds of types, imports of all kinds, assignments and calls that climb, with SQL that states what each must give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.storage import spread, stored
from tessera.javasrc import resolve, stage
from tessera.operators import crypto

from .catalog import query
from .inputs import load

#: Each part: number, package, file and the argument its cipher ends up with.
PARTS = """SELECT CAST(p_partkey AS VARCHAR(20)) AS k, concat('org.', replace(lower(p_brand), '#', '')) AS package, concat('src/', replace(lower(p_brand), '#', ''), '/Q', CAST(p_partkey AS VARCHAR(20)), '.java') AS path,
  CASE p_size % 3 WHEN 0 THEN 'AES/ECB/NoPadding' WHEN 1 THEN 'DESede' ELSE 'AES/GCM/NoPadding' END AS raw FROM part"""
#: ``$`` stands for the part's number, ``#`` for its argument.
LINES = """
import javax.crypto.*;
import static javax.crypto.Mac.getInstance;
import java.security.SecureRandom;
@Deprecated
public abstract class Q$ extends Base$ implements Runnable, Comparable<Q$> {
    private static final String ALG = "AES";
    int[] plain, more;
    enum Mode { ON, OFF }
    record Pair(int a, String b) { }
    @interface Mark { }
    interface Shape extends Runnable { double area(int scale); }
    static class Inner { void go(String s) { helper(s); } void helper(String s) { } }
    Q$ make() { return this; }
    void work(String given) {
        String a = "DES"; a = "#";
        Cipher.getInstance(a);
        String b = "x"; b += "y";
        Cipher.getInstance(b);
        getInstance("HmacMD5");
        new SecureRandom();
        make().work(given);
    }
}
class Kid$ extends Base$ { void more() { shared(1); super.shared(2); this.twice("x"); } }
class Base$ { void shared(int a) { } void twice(int a) { } void twice(String s) { } }
"""


def files(spark, d) -> DataFrame:
    body = F.replace(F.replace(F.lit(LINES), F.lit("$"), F.col("k")), F.lit("#"), F.col("raw"))
    return spread(load(spark, d, PARTS), "k").select("path", F.concat(F.lit("package "), "package", F.lit(";"), body).alias("source"))


def _units(spark, d) -> DataFrame:
    return stored(stage.parsed(files(spark, d)), "units")


def _types(units: DataFrame) -> DataFrame:
    return stored(stage.types(units), "types")


def _each(columns: str, *rows: tuple) -> str:
    """SQL for ``rows`` of each part: ``$`` is its number, ``@`` its package and a point, ``#`` its argument, ``~`` its path, ``^`` the sign @; None is null."""
    value = lambda x: "CAST(NULL AS VARCHAR)" if x is None else f"replace(replace(replace(replace(replace('{x}', '$', k), '@', package || '.'), '~', path), '#', raw), '^', '@')" if isinstance(x, str) else str(x).lower()
    names = columns.split()
    return " UNION ALL ".join("SELECT " + ", ".join(f"{value(x)} AS {n}" for n, x in zip(names, row, strict=True)) + f" FROM ({PARTS}) p" for row in rows)


@query(_each(
    "fqcn simple_name kind superclass interfaces annotations path",
    ("@Q$", "Q$", "CLASS", "Base$", "Comparable,Runnable", "^Deprecated", "~"),
    ("@Q$|Mode", "Mode", "ENUM", None, "", "", "~"),
    ("@Q$|Pair", "Pair", "RECORD", None, "", "", "~"),
    ("@Q$|Mark", "Mark", "ANNOTATION", None, "", "", "~"),
    ("@Q$|Shape", "Shape", "INTERFACE", None, "Runnable", "", "~"),
    ("@Q$|Inner", "Inner", "CLASS", None, "", "", "~"),
    ("@Kid$", "Kid$", "CLASS", "Base$", "", "", "~"),
    ("@Base$", "Base$", "CLASS", None, "", "", "~"),
))
def java_declarations(spark, d):
    """Nested names are written with ``|`` here, since ``$`` has another meaning in this SQL."""
    rows = _types(_units(spark, d))
    return rows.select(F.translate("fqcn", "$", "|").alias("fqcn"), "simple_name", "kind", "superclass", F.array_join("interfaces", ",").alias("interfaces"), F.array_join("annotations", ",").alias("annotations"), "path")


@query(_each("path name is_static wildcard ord", ("~", "javax.crypto", False, True, 0), ("~", "javax.crypto.Mac.getInstance", True, False, 1), ("~", "java.security.SecureRandom", False, False, 2)))
def java_imports(spark, d):
    return stage.imports(_units(spark, d)).select("path", "name", "is_static", "wildcard", "ord")


@query(_each(
    "fqcn signature return_type",
    ("@Q$", "make()", "Q$"), ("@Q$", "work(String)", "void"), ("@Q$|Shape", "area(int)", "double"), ("@Q$|Inner", "go(String)", "void"), ("@Q$|Inner", "helper(String)", "void"),
    ("@Kid$", "more()", "void"), ("@Base$", "shared(int)", "void"), ("@Base$", "twice(int)", "void"), ("@Base$", "twice(String)", "void"),
))
def java_methods(spark, d):
    return stage.methods(_types(_units(spark, d))).where("not is_constructor").select(F.translate("fqcn", "$", "|").alias("fqcn"), "signature", "return_type")


@query(_each(
    "fqcn name type modifiers",
    ("@Q$", "ALG", "String", "private,static,final"), ("@Q$", "plain", "int", ""), ("@Q$", "more", "int", ""), ("@Q$|Pair", "a", "int", "private,final"), ("@Q$|Pair", "b", "String", "private,final"),
))
def java_fields(spark, d):
    return stage.fields(_types(_units(spark, d))).select(F.translate("fqcn", "$", "|").alias("fqcn"), "name", "type", F.array_join("modifiers", ",").alias("modifiers"))


@query(_each(
    "caller target method signature kind unresolved handler",
    ("@Q$|Inner", "@Q$|Inner", "helper", "helper(String)", "METHOD_CALL", False, "exact"),
    ("@Kid$", "@Base$", "shared", "shared(int)", "METHOD_CALL", False, "exact"),
    ("@Kid$", "@Base$", "shared", "shared(int)", "SUPER_CALL", False, "same-file"),
    ("@Kid$", "@Kid$", "twice", "twice(?)", "METHOD_CALL", False, "exact"),
    ("@Q$", "<unresolved>:make()", "work", "work(?)", "METHOD_CALL", True, "external"),
    ("@Q$", "@Q$", "make", "make()", "METHOD_CALL", False, "exact"),
))
def java_climbing_calls(spark, d):
    """Calls within the file: nested callers, one inherited, one through super, an overloaded one, and one on a call's result."""
    units = _units(spark, d)
    rows = resolve.invocations(units, _types(units)).where("method in ('helper', 'shared', 'twice', 'work', 'make')")
    return rows.select(F.translate("caller", "$", "|").alias("caller"), F.translate("target", "$", "|").alias("target"), "method", "signature", "kind", "unresolved", "handler")


@query(_each(
    "path owner status raw confidence in_method",
    ("~", "CIPHER", "RESOLVED", "#", "HIGH", "work"), ("~", "CIPHER", "UNKNOWN", None, "HIGH", "work"), ("~", "MAC", "RESOLVED", "HmacMD5", "HIGH", "work"), ("~", "SECURE_RANDOM", "RESOLVED", None, "HIGH", "work"),
))
def java_crypto_imports(spark, d):
    """A wildcard import, a static import, an object creation, a variable that is assigned and one that is added to."""
    return stage.crypto_usages(_units(spark, d)).select("path", "owner", "status", "raw", "confidence", "in_method")


@query(_each("path raw rule_id severity message", ("~", "shared", "OWN-1", "LOW", "Base$ is called"), ("~", "shared", "OWN-1", "LOW", "Base$ is called"), ("~", "<init>", "OWN-2", "INFO", "made: java.security.SecureRandom")))
def java_call_rules(spark, d):
    """A rule over calls and one over object creations, in one pass."""
    units = _units(spark, d)
    calls = resolve.invocations(units, _types(units))
    simple = F.element_at(F.split("target", r"\."), -1)
    rules = [
        crypto.CallRule("OWN-1", crypto.CALLS, F.col("method") == "shared", "LOW", "CODE_QUALITY", None, F.concat(simple, F.lit(" is called"))),
        crypto.CallRule("OWN-2", crypto.CREATIONS, F.col("target") == "java.security.SecureRandom", "INFO", "CRYPTOGRAPHY", None, F.concat(F.lit("made: "), "target")),
    ]
    return crypto.call_findings(calls, rules).select("path", "raw", "rule_id", "severity", "message")


@query("SELECT count(*) AS files, 8 * count(*) AS types, CAST(0 AS BIGINT) AS failed_files FROM part")
def java_scan_summary(spark, d):
    return stage.scan_summary(_units(spark, d)).select("files", F.col("types").cast("long").alias("types"), "failed_files")
