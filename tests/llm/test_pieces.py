from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from tessera.llm import pieces

L = pieces.Lattice(pieces.model_path())
LIBRARY = SentencePieceProcessor(model_file=pieces.model_path())


@given(st.lists(st.text(max_size=50) | st.sampled_from([" a  b ", "\n\n x\n", "a▁b", "漢字" * 40, "é" * 90, "\t🙂", "x" * 500]), max_size=6))
@settings(max_examples=200, deadline=None)
def test_decoding_is_lossless(texts):
    ids = L.encode(texts, [str(i) for i in range(len(texts))])
    assert [L.decode(x) for x in ids] == texts
    for t, x in zip(texts, ids, strict=True):
        if t and "▁" not in t:
            assert LIBRARY.decode(x.tolist()) == t
        assert L.encode([t], [str(texts.index(t))])[0].tolist() == L.encode([t], [str(texts.index(t))])[0].tolist()


def by_hand(text):
    """The chance of every segmentation, by walking all of them."""
    text = (" " + text).encode()

    def paths(b):
        if b == 0:
            yield (), 1.0
        for a in range(b):
            if text[a:b] in L.of:
                i, w = L.of[text[a:b]]
                for p, q in paths(a):
                    yield (*p, i), q * w

    chances = Counter()
    for p, q in paths(len(text)):
        chances[p] += q
    total = sum(chances.values())
    return {p: q / total for p, q in chances.items()}


def test_draws_follow_the_lattice():
    n = 20_000
    for text in ("tionhand", "in the"):
        want = by_hand(text)
        if " " in text:  # pieces don't cross the space, so its sides are independent
            assert not any(" " in L.surface[i].decode()[1:] for p in want for i in p)
        got = Counter(tuple(x.tolist()) for x in L.encode([text] * n, [str(k) for k in range(n)]))
        assert set(got) <= set(want) and max(abs(got[p] / n - q) for p, q in want.items()) < 0.02


def test_long_stretches_follow_the_lattice(monkeypatch):
    n, text = 4000, "tionhand"
    draws = Counter(tuple(L.long(b" " + text.encode(), k)) for k in range(n))
    want = by_hand(text)
    assert max(abs(draws[p] / n - q) for p, q in want.items()) < 0.03


def test_row_key_alone_decides():
    texts = ["the same words again and again"] * 40
    keys = [str(k) for k in range(40)]
    once = [x.tolist() for x in L.encode(texts, keys)]
    assert once == [L.encode([t], [k])[0].tolist() for t, k in zip(texts, keys, strict=True)]
    assert len({tuple(x) for x in once}) > 1
    assert [x.tolist() for x in L.encode(texts, keys, seed=1)] != once


def test_tables(spark, docs):
    df = docs([(1, "two words"), (1, "two words"), (2, None), (3, ""), (None, "x " * 30_000)]).withColumn("ids", F.lit(0))
    out = pieces.encoded(df)
    assert sorted(out.columns) == sorted(df.columns)
    back = pieces.decoded(out.withColumnRenamed("text", "was")).collect()
    assert len(back) == 5 and all(r["was"] == r["text"] for r in back)
    assert {r["doc_id"]: r["ids"] for r in back}[2] is None and {r["doc_id"]: r["ids"] for r in back}[3] == []
    twice = [r["ids"] for r in back if r["doc_id"] == 1]
    assert twice[0] == twice[1] and np.array(twice[0]).size
    digest = pieces.digested(df).collect()
    assert all(r["lossless"] for r in digest) and pieces.digested(df.limit(0)).count() == 0


def test_length_of_a_stretch_changes_nothing(monkeypatch):
    texts = ["the same words again, andwordswithoutanyspace " * 3, "漢字かな交じり文" * 3, "x" * 31, "é🙂 " * 9]
    keys = [str(k) for k in range(len(texts))]
    together = [x.tolist() for x in L.encode(texts, keys)]
    monkeypatch.setattr(pieces, "SHORT", 0)
    assert [x.tolist() for x in L.encode(texts, keys)] == together


def test_digest_takes_any_names(docs):
    df = docs([(1, "a b"), (1, "a b"), (None, None)]).toDF("k", "t", "doc_id", "text", "ids")
    rows = pieces.digested(df, key_col="k", text_col="t").collect()
    assert sorted((str(r["doc_id"]), r["n_pieces"], r["lossless"]) for r in rows)[0] == ("1", rows[0]["n_pieces"], True) and len(rows) == 3
