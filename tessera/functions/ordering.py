"""Global order without gathering rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

#: Rows of a range where a table is large.
RANGE = 250_000


def by_range(df: DataFrame, keys: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """``df`` stored in ``parts`` ranges (as many as shuffle partitions) of ``keys``, with the range's number in ``_part``; ranges ascend with it.

    The table is written, so the number stays what it was when a task is run again.
    """
    parts = parts or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return stored(ranged.withColumn("_part", F.spark_partition_id()), name)


def with_start(ranged: DataFrame, keys: list[Column], amount: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``amount`` over all rows before this one in the order of ``keys``.

    ``ranged`` comes from :func:`by_range`. Only one sum for each range meets in a
    single task (as many rows as partitions); rows are summed within their range.
    """
    sums = ranged.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    order = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_part", F.coalesce(F.sum("_sum").over(order), F.lit(0)).cast("long").alias("_base"))
    within = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_before", F.coalesce(F.sum(amount).over(within), F.lit(0)))
        .join(F.broadcast(bases), "_part")
        .withColumn(out, (F.col("_base") + F.col("_before")).cast("long"))
        .drop("_base", "_before")
    )


def following(df: DataFrame, keys: list[str], columns: dict[str, str], others: dict[str, Column] | None = None) -> DataFrame:
    """Add, for each ``columns`` item (new name, column), that column's value in the next row in the order of ``keys``; the last row has null, or what ``others`` gives.

    As ``lead`` over the whole table, without gathering it in one task: rows look within their range,
    and a range's last row takes the first of the next range, of which there is one row for each.
    Ranges have RANGE rows at most, about, so that a task's memory doesn't grow with the table.
    """
    order = [F.col(k) for k in keys]
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE))
    ranged = by_range(df, order, "followed", parts)
    least = F.min(F.struct(*keys, *[F.col(c).alias(f"_next_{n}") for n, c in columns.items()])).alias("_first")
    firsts = ranged.groupBy("_part").agg(least)
    firsts = firsts.withColumn("_after", F.lead("_first").over(Window.orderBy("_part"))).select("_part", "_after")
    within = Window.partitionBy("_part").orderBy(*order)
    row = F.lead(F.struct(*[F.col(c).alias(f"_next_{n}") for n, c in columns.items()])).over(within)
    out = ranged.repartition(parts, "_part").withColumn("_row", row).join(F.broadcast(firsts), "_part")
    end = F.col("_row").isNull() & F.col("_after").isNull()
    value = lambda n: F.when(F.col("_row").isNotNull(), F.col(f"_row._next_{n}")).otherwise(F.col(f"_after._next_{n}"))
    new = [(F.when(end, others[n]).otherwise(value(n)) if n in (others or {}) else value(n)).alias(n) for n in columns]
    return out.select(*df.columns, *new)


def positioned(df: DataFrame, keys: list[Column], out: str = "position", one_task: int = 1_000_000) -> DataFrame:
    """Add ``out``: each row's place from 1 in the order of ``keys``. Up to ``one_task`` rows, which are counted, are numbered in one task; more by ranges."""
    if df.count() <= one_task:
        return df.withColumn(out, F.row_number().over(Window.orderBy(*keys)))
    return with_start(by_range(df, keys, "ordered"), keys, F.lit(1), "_rank").withColumn(out, (F.col("_rank") + 1).cast("int")).drop("_rank", "_part")
