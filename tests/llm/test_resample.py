import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import resample
from tessera.llm.words import words

LABELS = "doc_id long, quality int, toxic int"


def cells_of(text):
    w = words(pa.array([text], pa.string()))
    return resample.cells(w)[0].tolist()


def test_weights_are_the_ratio_of_the_two_models(spark, docs):
    rows = [(i, ("clear prose about rivers " if i % 2 else "junk $$ junk click now ") * (i % 5 + 1)) for i in range(60)] + [(70, None), (71, ""), (3, "clear again")]
    labels = spark.createDataFrame([(i, int(i % 2 == 1), 0) for i in range(0, 60)] + [(None, 1, 0), (1, 0, 0)], LABELS)
    good = {i for i in range(60) if i % 2}
    raw, target = Counter(), Counter()
    for d, t in rows:
        c = Counter(cells_of(t))
        raw += c
        if d in good:
            target += c
    total = lambda c: sum(c.values()) + resample.CELLS
    weight = lambda t: sum(n * (math.log((target[c] + 1) / total(target)) - math.log((raw[c] + 1) / total(raw))) for c, n in Counter(cells_of(t)).items())
    got = resample.resampled(docs(rows), labels, share=0.3).collect()
    assert len(got) == len(rows) and sum(r["selected"] for r in got) == round(0.3 * len(rows))
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r["log_weight"])
    for d, t in rows:
        assert any(abs(x - weight(t)) < 1e-6 for x in by_id[d])
    order = sorted(got, key=lambda r: r["rank"])
    assert [r["rank"] for r in order] == list(range(1, len(rows) + 1))
    keys = [(-r["gumbel_key"], r["doc_id"]) for r in order]
    assert keys == sorted(keys) and all(r["selected"] == (r["rank"] <= round(0.3 * len(rows))) for r in got)
    mean = lambda odd: np.mean([r["quality"] for r in got if r["doc_id"] < 60 and r["doc_id"] % 2 == odd])
    assert mean(1) > 0.5 > mean(0)


def test_draws_follow_the_weights(spark, docs):
    rows = [(i, "same text") for i in range(4000)]
    got = resample.resampled(docs(rows), spark.createDataFrame([], LABELS), share=0.25).collect()
    noise = [r["gumbel_key"] - r["log_weight"] for r in got]
    assert abs(np.mean(noise) - 0.5772) < 0.08 and abs(np.var(noise) - math.pi**2 / 6) < 0.2
    assert sum(r["selected"] for r in got) == 1000


def test_features_are_words_and_pairs_within_a_text():
    w = words(pa.array(["A b", None, "", "c", "É x"], pa.string()))
    cell, row = resample.cells(w)
    assert Counter(row.tolist()) == {0: 3, 3: 1, 4: 3}
    assert cells_of("A b") == cells_of("a B") and cells_of("x y") != cells_of("y x")


def test_words_of_batches():
    texts = ["One two,three", None, "ÉÀ 日本x-7", "", "end"] * 3
    for arr in (pa.array(texts, pa.string()), pa.array(texts, pa.large_string()), pa.array(["skip", *texts], pa.string()).slice(1)):
        w = words(arr)
        got = [[w.data[a:b].tobytes().decode() for a, b in zip(w.begin[i:j], w.end[i:j], strict=True)] for i, j in zip(w.of, w.of[1:], strict=False)]
        assert got == [re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "") for t in texts]


@pytest.mark.parametrize("rows", [[], [(None, "a b"), (None, "a b")]])
def test_small_tables(spark, docs, rows):
    assert resample.resampled(docs(rows), spark.createDataFrame([(1, 1, 0)], LABELS)).count() == len(rows)


def test_a_very_long_text_and_clashing_columns(spark, docs):
    df = docs([(1, "long words " * 200_000), (2, "short words")]).withColumn("noise", F.lit("x")).withColumn("rank", F.lit("y")).withColumn("_part", F.lit(1))
    rows = {r["doc_id"]: r for r in resample.resampled(df, spark.createDataFrame([(2, 1, 0)], LABELS)).collect()}
    assert rows[1]["n_features"] == 2 * 400_000 - 1 and rows[2]["n_features"] == 3 and {r["rank"] for r in rows.values()} == {1, 2}
