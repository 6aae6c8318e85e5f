import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import similar


def by_hand(rows):
    """Least ids of the components of texts with five-word similarity 0.8, by comparing all."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])) and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return sorted(min(d for (d, _), h in zip(rows, group, strict=True) if h == g) for g in set(group))


def cases():
    r = random.Random(3)
    words = [f"w{i}" for i in range(2000)]
    rows = [(1000, "a b"), (1001, "A  b"), (1002, None), (1003, ""), (1004, "a b c d e"), (1005, "a b c d e f")]
    for d in range(12):
        text = r.choices(words, k=150)
        rows.append((d * 20, " ".join(text)))
        for k in range(1, 9):  # from near to far, with many at about the limit
            other = list(text)
            for at in r.sample(range(150), k):
                other[at] = r.choice(words)
            rows.append((d * 20 + k, " ".join(other)))
    line = " ".join(r.choices(words, k=40))
    return rows + [(2000 + i, line + " " + " ".join(r.choices(words, k=30))) for i in range(20)]


@pytest.mark.parametrize(("dense", "few"), [(4, 1 << 13), (0, 0)])
def test_stage_takes_all_near_copies(spark, docs, monkeypatch, dense, few):
    monkeypatch.setattr(similar, "DENSE", dense)
    monkeypatch.setattr(similar, "FEW", few)
    monkeypatch.setattr(similar, "BUCKET", 2000)
    rows = cases()
    want = by_hand(rows)
    got = corpus_pipeline.near_dedup(spark, docs(rows), "")
    assert sorted(r["doc_id"] for r in got.collect()) == want and 20 < len(want) < len(rows) - 20


def test_large_groups_and_odd_tables(spark, docs):
    r = random.Random(4)
    text = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        other = list(text)
        other[r.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(other)))
    assert [r["doc_id"] for r in similar.deduplicated(docs(rows)).collect()] == [0]
    assert similar.deduplicated(docs([(None, "a b c"), (None, "a b c"), (None, "x"), (3, "x")])).count() == 2
    assert similar.deduplicated(docs([])).count() == 0
    df = docs([(1, "a b"), (2, "A b"), (3, "c")]).withColumn("_row", F.lit(1)).withColumn("c1", F.lit(2))
    kept = similar.deduplicated(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


@given(st.integers(0, 300), st.integers(0, 300), st.integers(0, 60))
@settings(deadline=None)
def test_parities_never_tell_more_than_the_difference(common, own, other):
    r = np.random.default_rng(common)
    a, b, c = (r.integers(-(1 << 62), 1 << 62, n) for n in (common, own, other))
    x, y = similar.parities(np.unique(np.concatenate((a, b)))), similar.parities(np.unique(np.concatenate((a, c))))
    while len(x) != len(y):
        x, y = [[u ^ v for u, v in zip(p[: len(p) // 2], p[len(p) // 2 :], strict=True)] if len(p) == max(len(x), len(y)) else p for p in (x, y)]
    assert sum((u ^ v).bit_count() if u ^ v >= 0 else ((u ^ v) % (1 << 64)).bit_count() for u, v in zip(x, y, strict=True)) <= own + other


def test_texts_just_beyond_the_limit_of_a_large_group_make_few_pairs(spark, docs, monkeypatch):
    """Changed in too many places to link, they share tokens with all of the group; they mustn't be paired with each."""
    r, text = random.Random(5), [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):
        other = list(text)
        for at in r.sample(range(5, 145), 1 + 3 * (i % 2)):
            other[at] = f"x{i}_{at}"
        rows.append((i, " ".join(other)))
    given, real = [], similar._similar

    def counted(pairs, *rest):
        pairs.collect()
        given.append(joined(pairs._jdf.queryExecution().executedPlan()))
        return real(pairs, *rest)

    monkeypatch.setattr(similar, "_similar", counted)
    assert sorted(x["doc_id"] for x in similar.deduplicated(docs(rows)).collect()) == by_hand(rows)
    assert max(given) < 20 * len(rows)


def joined(plan):
    """The most rows that a join of a plan that has run made."""
    name, kids = plan.nodeName(), plan.children()
    inner = [plan.executedPlan()] if name.startswith("AdaptiveSparkPlan") else [plan.plan()] if name.endswith("QueryStage") else [kids.apply(i) for i in range(kids.size())]
    own = plan.metrics().apply("numOutputRows").value() if "Join" in name else 0
    return max([own, *map(joined, inner)])


@pytest.mark.parametrize("rare", [1, 1 << 20])
def test_rare_and_frequent_tokens_give_the_same(spark, docs, monkeypatch, rare):
    monkeypatch.setattr(similar, "RARE", rare)
    monkeypatch.setattr(similar, "OFTEN", 1 << 20)  # no token is known to be frequent
    rows = cases()
    assert sorted(x["doc_id"] for x in similar.deduplicated(docs(rows)).collect()) == by_hand(rows)


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 40), st.integers(1, 60)), max_size=30), st.integers(1, 12))
@settings(deadline=None)
def test_postings_that_can_meet_are_kept(found, rare):
    found = [(t, n, min(p, s - 1), s) for n, (t, p, s) in enumerate(sorted(found))]
    pairs, kept = similar._met(*np.array(found, np.int64).reshape(-1, 4).T, rare)
    may = [(a, b) for a in range(len(found)) for b in range(a) if found[a][0] == found[b][0] and 4 * (found[a][3] + found[b][3]) <= 9 * min(found[i][3] - found[i][2] for i in (a, b))]
    pairs = set(map(tuple, pairs.tolist()))
    assert pairs <= {(b, a) for a, b in may} and len(pairs) <= similar.PAIRS * len(found)
    assert all((b, a) in pairs or kept[a] and kept[b] for a, b in may)
