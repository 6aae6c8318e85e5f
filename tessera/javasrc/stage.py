"""The parse stage: source files in, one nested row for each file out; then the tables that come out of it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .extract import extracted
from .extract import scopes as scopes_of

RANGE = "struct<line:int,col:int,end_line:int,end_col:int>"
METHOD = f"struct<name:string,signature:string,return_type:string,param_types:array<string>,param_names:array<string>,modifiers:array<string>,is_constructor:boolean,range:{RANGE}>"
FIELD = f"struct<name:string,type:string,modifiers:array<string>,range:{RANGE}>"
TYPE = f"struct<fqcn:string,simple_name:string,package:string,kind:string,path:string,superclass:string,interfaces:array<string>,annotations:array<string>,range:{RANGE},methods:array<{METHOD}>,fields:array<{FIELD}>,nesting:int>"
CALL = f"struct<caller:string,caller_method:string,target:string,method:string,kind:string,how:string,arguments:int,range:{RANGE},ord:int>"
CRYPTO = f"struct<owner:string,method:string,class:string,in_method:string,receiver:string,argument:string,status:string,raw:string,confidence:string,source:string,range:{RANGE}>"
UNIT = f"path string, package string, types array<{TYPE}>, calls array<{CALL}>, crypto array<{CRYPTO}>, errors array<string>, imports array<struct<name:string,is_static:boolean,wildcard:boolean,ord:int>>"

IGNORED = (".git", ".github", ".gradle", "build", "target", "out", "node_modules", "dist", ".idea", ".vscode")


def is_test_path(path):
    """Column: whether a path below the root is of a test, by its name or one of its folders."""
    return path.rlike(r"(Test|Tests|TestCase|IT)\.java$") | path.rlike(r"(?i)(^|/)tests?(/|$)")


def source_files(spark: SparkSession, root: str, include_tests: bool = False) -> DataFrame:
    """``(path, source)`` of the Java files below ``root``, without ignored folders; only components below the root count.

    Paths are listed first, without content. Then the kept folders alone are loaded, so no content of
    an ignored one is read; the driver holds the names of the kept folders, as it does for any scan.
    """
    base = root.rstrip("/")
    head = spark._jvm.org.apache.hadoop.fs.Path(base).toUri().getPath().rstrip("/")
    below = F.expr(f"substring(regexp_replace(path, '^[a-z]+:/+[^/]*(?={head})|^[a-z]+:/*', '/'), {len(head) + 2})")
    kept = ~F.exists(F.split(below, "/"), lambda x: x.isin(*IGNORED))
    if not include_tests:
        kept &= ~is_test_path(below)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.java").load(base).select("path")
    folders = [r[0] for r in listed.where(kept).select(F.regexp_replace("path", "/[^/]*$", "")).distinct().collect()]
    if not folders:
        return spark.createDataFrame([], "path string, source string")
    content = spark.read.format("binaryFile").load([re.sub(r"([\\*?\[\]{}^,])", r"\\\1", f) + "/*.java" for f in sorted(folders)])
    return content.where(kept).select(below.alias("path"), F.decode("content", "UTF-8").alias("source"))


def parsed(files: DataFrame) -> DataFrame:
    """One nested row (UNIT) for each of ``files(path, source)``; each file is parsed once, errors are a column."""
    schema = to_arrow_schema(StructType.fromDDL(UNIT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                rows = [extracted(p, s) for p, s in zip(part.column("path").to_pylist(), part.column("source").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "source").mapInArrow(run, UNIT)


SCOPES = "path string, type string, method string, line int, method_end boolean, names array<struct<name:string,type:string>>"


def scopes(files: DataFrame) -> DataFrame:
    """``(path, type, method, line, method_end, names)``: what is in scope at the end of each block of ``files(path, source)``."""
    schema = to_arrow_schema(StructType.fromDDL(SCOPES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, s in zip(batch.column("path").to_pylist(), batch.column("source").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist(scopes_of(p, s), schema=schema)

    return files.select("path", "source").mapInArrow(run, SCOPES)


def types(units: DataFrame) -> DataFrame:
    """Declared types; of several of one name, that of the last path stays."""
    rows = units.select(F.explode("types").alias("t")).select("t.*")
    return rows.groupBy("fqcn").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "fqcn"]), F.struct("path", "range.line")).alias("t")).select("fqcn", "t.*")


def methods(declared: DataFrame) -> DataFrame:
    return declared.select("fqcn", "path", F.explode("methods").alias("m")).select("fqcn", "path", "m.*")


def fields(declared: DataFrame) -> DataFrame:
    return declared.select("fqcn", "path", F.explode("fields").alias("f")).select("fqcn", "path", "f.*")


def imports(units: DataFrame) -> DataFrame:
    return units.select("path", F.explode("imports").alias("i")).select("path", "i.*")


def calls(units: DataFrame) -> DataFrame:
    return units.select("path", "package", F.explode("calls").alias("c")).select("path", "package", "c.*")


def crypto_usages(units: DataFrame) -> DataFrame:
    """Cryptography calls in the shape that rules and inventory take."""
    rows = units.select("path", F.explode("crypto").alias("c")).select("path", "c.*")
    return rows.select("path", F.col("range.line").alias("line"), F.col("range.col").alias("col"), "owner", "raw", "confidence", (F.col("status") == "RESOLVED").alias("resolved"), "status", "method", F.col("class").alias("enclosing"), "in_method", "receiver", "argument", "source", F.col("range.end_line").alias("end_line"), F.col("range.end_col").alias("end_col"))


def scan_summary(units: DataFrame) -> DataFrame:
    return units.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.size("types")), F.lit(0)).alias("types"), F.count(F.when((F.size("errors") > 0) & (F.size("types") == 0), 1)).alias("failed_files"))
