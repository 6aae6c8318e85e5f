"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.ordering import by_range, with_start
from tessera.functions.storage import stored

from .common import lean, slices, table
from .words import Words, mixed, words

#: Hashed cells of the two models, the weight of one cell before any count, and bytes of text taken together.
CELLS, PRIOR, TOGETHER = 1 << 14, 1.0, 1 << 20
#: Labelled rows of the target that its model is fitted on, at most; the share of all rows that is drawn.
TARGETS, SHARE, SEED = 20_000, 0.25, 0


def cells(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed cells of the words and of the pairs of neighbours in a text, and the text of each."""
    one = w.hash % np.uint64(CELLS)
    same = w.row[1:] == w.row[:-1] if len(w.row) else np.empty(0, bool)
    two = mixed(w.hash[:-1] * np.uint64(0x9E3779B97F4A7C15) + w.hash[1:])[same] % np.uint64(CELLS)
    return np.concatenate((one, two)).astype(np.int64), np.concatenate((w.row, w.row[:-1][same]))


def models(docs: DataFrame, targets: set[int], id_col: str, text_col: str) -> np.ndarray:
    """For each cell the logarithm of its share in target text over that in raw text. Raw counts are over every row of ``docs``, target counts over the rows with the ids ``targets``."""
    shared = docs.sparkSession.sparkContext.broadcast(np.array(sorted(targets), np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64)
        for batch in slices(batches, "text", TOGETHER):
            cell, row = cells(words(batch.column("text")))
            raw += np.bincount(cell, minlength=CELLS)
            mine = np.isin(np.array(batch.column("id").fill_null(-1)), shared.value) & np.array(batch.column("id").is_valid())
            target += np.bincount(cell[mine[row]], minlength=CELLS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["cell", "raw", "target"])

    counts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(count), "cell long, raw long, target long")
    raw, target = np.full(CELLS, PRIOR), np.full(CELLS, PRIOR)
    for r in counts.groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # CELLS rows at most
        raw[r["cell"]] += r["raw"]
        target[r["cell"]] += r["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def resampled(docs: DataFrame, labels: DataFrame, share: float = SHARE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Importance weights of all rows of ``docs`` and a draw of ``share`` of them towards the rows that ``labels`` calls good (quality 1).

    Returns ``doc_id``, ``n_features`` (words and pairs), ``log_weight`` (the log-likelihood ratio
    of the text under the two models), ``quality`` (the ratio for a single feature as a chance,
    0.5 without features), ``gumbel_key`` (log weight and Gumbel noise), ``rank`` by that key from 1,
    and ``selected``: whether the rank is within the draw, which is drawing without replacement by
    the weights. Noise depends on the id, the text and ``seed`` only; ties go to the lesser id.

    The target model is fitted on at most TARGETS labelled rows, by the hash of the id; raw counts
    cover every row. Null and empty texts have no features and weight 0. An id that is labelled
    twice is good if any label says so; without good labels the weights are those of a flat target.
    Repeated rows have the same key, and a rank each. Extra columns are dropped; an empty table
    gives no rows.
    """
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("id")).where("id is not null").distinct()
    targets = {r["id"] for r in good.orderBy(F.xxhash64("id"), "id").limit(TARGETS).collect()}
    ratio = models(docs, targets, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TOGETHER):
            cell, row = cells(words(batch.column("text")))
            weight = np.bincount(row, shared.value[cell], minlength=len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("noise"), pa.array(np.bincount(row, minlength=len(batch))), pa.array(weight)], ["doc_id", "noise", "n_features", "log_weight"])

    noise = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit(seed))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), noise.alias("noise"), F.col(text_col).alias("text"))
    chance = (F.shiftrightunsigned("noise", 11).cast("double") + 0.5) / float(1 << 53)
    scored = rows.mapInArrow(lean(score), "doc_id long, noise long, n_features long, log_weight double").select(
        "doc_id",
        "n_features",
        "log_weight",
        (1 / (1 + F.exp(-F.col("log_weight") / F.greatest("n_features", F.lit(1))))).alias("quality"),
        (F.col("log_weight") - F.log(-F.log(chance))).alias("gumbel_key"),
    )
    scored = stored(scored, "weights")
    keys = [F.desc("gumbel_key"), F.asc("doc_id"), F.asc("n_features")]
    ranked = with_start(by_range(scored, keys, "ranked"), keys, F.lit(1), "_rank").drop("_part")
    drawn = int(round(share * scored.count()))
    return ranked.withColumn("rank", F.col("_rank") + 1).withColumn("selected", F.col("rank") <= drawn).drop("_rank")


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, keys and draw of all ``documents`` for a target of those labelled good; nulls, repeated rows, an empty table and other columns as in :func:`resampled`."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
