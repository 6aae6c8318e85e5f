"""From raw documents to sampled token pieces: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.storage import discarded, stored
from tessera.llm import decontaminate, langid, pieces, secrets, similar
from tessera.llm.common import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones among ``docs`` teach.

    Null texts, those without a letter, and those with most letters in scripts that nobody taught
    go. All columns stay, repeated rows share their fate, an empty table stays empty; where no row
    is labelled, nothing is taught, and all rows go.
    """
    return langid.accepted(docs, langid.learn(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each component of texts whose five-word shingles are similar at 0.8.

    SimHash finds the first candidates, an exact join those it can't tell. Null and empty texts are
    one class; all columns stay; an empty table stays empty.
    """
    return similar.deduplicated(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold 13 consecutive words of a benchmark item, wherever they are.

    Null texts and ids, repeated rows, short items and empty tables as in
    :func:`tessera.llm.decontaminate.decontaminated`; all columns stay.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret, in whatever encoding, replaced in the text; ``n_chars`` follows.

    A null text stays null, as does its ``n_chars``; all columns stay; an empty table stays empty.
    """
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, sampled under its id, and whether decoding gives the text back; null texts have null ids, an empty table gives no rows."""
    return pieces.digested(docs)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", clean_of_benchmark),
    ("secrets", without_secrets),
    ("pieces", tokenised),
]

#: Hashing, decoding and sampling aren't expressible in SQL; tests/llm hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``; what a stage returns is written and read again for the next, and then deleted."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discarded(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
