import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")


def clustered(n, dim=32, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim)) + 2 * r.normal(size=(n // 20 + 1, dim))[r.integers(0, n // 20 + 1, n)]
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def brute(x, ids, q, measure, count=20):
    x = x.astype(np.float64)
    s = x @ x[q] if measure == "inner" else -((x - x[q]) ** 2).sum(axis=1)
    keep = np.arange(len(x)) != q
    order = np.lexsort((ids[keep], -s[keep]))[:count]
    return list(zip(ids[keep][order].tolist(), s[keep][order].tolist(), strict=True))


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 700)
    x = clustered(6000)
    ids = np.arange(len(x))
    found = ann.index(table(spark, x), sample=2000)
    for measure in ("inner", "l2"):
        rows = ann.nearest(found, F.col("vec_id") % 300 == 0, shortlist=60, measure=measure).collect()
        hit = total = 0
        for q in range(0, len(x), 300):
            got = [(r["vec_id"], r["score"]) for r in sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])]
            want = brute(x, ids, q, measure)
            assert [r for r, _ in enumerate(got)] == list(range(20)) and got == sorted(got, key=lambda g: (-g[1], g[0]))
            hit += len({g for g, _ in got} & {w for w, _ in want})
            total += 20
        assert hit / total >= 0.9


def test_small_tables_are_exact_and_several_passes_agree(spark, monkeypatch):
    x = clustered(120)
    x[50:60] = x[50]
    ids = np.arange(120) * 5
    monkeypatch.setattr(ann, "PASS", 2)
    rows = ann.nearest(ann.index(table(spark, x, ids)), F.col("vec_id") % 20 == 0).collect()
    for q in range(0, 120, 4):
        got = [r["vec_id"] for r in sorted((r for r in rows if r["query_id"] == ids[q]), key=lambda r: r["rank"])]
        assert got == [w for w, _ in brute(x, ids, q, "inner")]


def test_encoder_beats_greedy_and_norms_are_kept():
    x = clustered(3000)
    q = ann.fitted(x[:1500], 6)
    wide, norms = q.encode(x, 8)
    greedy, _ = q.encode(x, 1)
    error = lambda c: ((q.decode(c) - x) ** 2).sum(axis=1).mean()
    assert error(wide) < error(greedy) < (x**2).sum(axis=1).mean()
    assert np.allclose(norms, (q.decode(wide) ** 2).sum(axis=1), atol=1e-4)


def test_odd_vectors_take_no_part(spark):
    good = [(i, [float(i + 1), 1.0]) for i in range(5)]
    odd = [(20, None), (21, []), (22, [0.0, 0.0]), (23, [None, 1.0]), (24, [float("nan"), 1.0]), (25, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(good + odd + [(0, [1.0, 1.0])], "vec_id long, embedding array<double>").withColumn("row", F.lit("x")).withColumn("codes", F.lit(1))
    rows = ann.nearest(ann.index(df), F.col("vec_id") % 20 == 0).collect()
    assert {r["query_id"] for r in rows} == {0} and len(rows) == 10  # two rows have id 0; each has five others
    assert {r["vec_id"] for r in rows} == {0, 1, 2, 3, 4}


def test_each_length_is_a_search_of_its_own(spark, tmp_path):
    rows = [(i, [float(i + 1), 1.0]) for i in range(30)] + [(100 + i, [float(i), 1.0, 2.0]) for i in range(30)] + [(None, [1.0] * 4), (900, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    with pytest.raises(ValueError):
        ann.index(df)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in ann.op3_additive_quantisation(spark, str(tmp_path)).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(got) == {0, 20, 100, 120} and all(len(v) == 20 and {x >= 100 for x in v} == {q >= 100} for q, v in got.items())


def test_the_query_finds_all_neighbours_of_the_given_table(spark):
    """Recall over all queries of the whole table, against brute force: the query is exact."""
    d = "/root/testdata/sf0.1"
    given = [r for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect() if r["embedding"] and any(r["embedding"])]
    x, ids = np.array([r["embedding"] for r in given], np.float32), np.array([r["vec_id"] for r in given])
    got = {}
    for r in ann.op3_additive_quantisation(spark, d).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    asked = np.flatnonzero(ids % 20 == 0)
    assert set(got) == set(ids[asked].tolist())
    for q in asked:
        own = sorted(got[ids[q]])
        want = brute(x, ids, q, "inner")
        assert [k for k, *_ in own] == list(range(1, 21)) and np.allclose([s for *_, s in own], [s for _, s in want], rtol=1e-12)
        assert len({v for _, v, _ in own} & {v for v, _ in want}) >= 18  # ties to the last digit may fall either way


def test_no_vectors_and_no_queries(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.index(none) is None
    none.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert ann.op3_additive_quantisation(spark, str(tmp_path)).count() == 0
    assert ann.nearest(ann.index(table(spark, clustered(30))), F.col("vec_id") < 0).count() == 0


def test_large_groups_of_copies_and_near_copies_are_exact(spark):
    r = np.random.default_rng(7)
    x = clustered(3000)
    x[r.permutation(3000)[:700]] = x[0]  # more than a shortlist, equal
    near = r.permutation(3000)[:700]
    x[near] = x[1] + (1e-4 * r.normal(size=(700, x.shape[1]))).astype(np.float32)  # and closer than the codes tell
    ids = r.permutation(3000)
    asked = np.flatnonzero(ids % 20 == 0)
    found = ann.index(table(spark, x, ids), sample=500)
    for measure in ("inner", "l2"):
        got = {}
        for row in ann.nearest(found, F.col("vec_id") % 20 == 0, measure=measure).collect():
            got.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"]))
        for q in asked:
            # scores as sums in the same order, so that ties are ties
            y = x.astype(np.float64)
            s = (y * y[q]).sum(axis=1) if measure == "inner" else -((y - y[q]) ** 2).sum(axis=1)
            s[q] = -np.inf
            assert [v for _, v in sorted(got[ids[q]])] == ids[np.lexsort((ids, -s))[:20]].tolist()
