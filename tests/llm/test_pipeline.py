import importlib.util
import re

import pytest

import __spark_entry__
import corpus_pipeline
from tessera.llm import binary, langid, pieces, secrets, simhash

from .test_decontaminate import by_hand
from .test_similar import by_hand as similar_by_hand


def rows_by_hand(docs, items):
    """The pipeline's rows by plain loops: each stage over what the one before kept."""
    docs = [(d, t) for d, t in docs if t and any(c.isalpha() for c in t) and not re.search("[ก-๛]{9}", t)]
    first = set(similar_by_hand(docs))
    docs = [(d, t) for d, t in docs if d in first]
    hit = {d for d, n, h, _ in by_hand(docs, items) if h}
    return sorted((d, secrets.redact(t)) for d, t in docs if d not in hit)


def test_pipeline_matches_brute_force(spark, docs, tmp_path):
    item = " ".join(f"Benchmark{k}" for k in range(15))
    base = [(i, f"Document number {i} has words like alpha{i} beta{i} gamma{i} and others too.", "en") for i in range(30)]
    long = " ".join(f"long{k}" for k in range(200))
    odd = [(90, long, "en"), (91, long.replace("long77 ", "other "), None), (107, "ภาษาไทย ครับ สวัสดีครับ", None), (108, "² ½ ①", "en"), (100, base[3][1], "en"), (101, None, "en"), (102, "", None), (103, "12 34 !!", "en"), (104, f"before {item} after", "de"), (105, "my password: hunter2secret stays out", "en"), (106, item + " filler" * 400, "en")]
    docs(base + odd).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    L = pieces.Lattice(pieces.model_path())
    want = rows_by_hand([(d, t) for d, t, _ in base + odd], [(1, item), (2, None)])
    assert sorted((r["doc_id"], L.decode(__import__("numpy").array(r["ids"]))) for r in got) == want
    assert all(r["lossless"] for r in got) and {91, 100, 101, 102, 103, 104, 106, 107, 108} & {r["doc_id"] for r in got} == set()


def test_stages_keep_the_columns(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontamination", "secrets", "pieces"]


def test_every_query_is_registered():
    names = __spark_entry__.queries()
    assert {re.match(r"op(\d+)_", n)[1] for n in names if n.startswith("op")} == {str(n) for n in range(1, 11)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


@pytest.mark.parametrize("module", [binary, langid, pieces, secrets, simhash])
def test_imports_are_not_guarded(module):
    assert "ImportError" not in open(importlib.util.find_spec(module.__name__).origin).read()
