import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate
from tessera.llm.decontaminate import decontaminated, matches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def by_hand(docs, items, n=13):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for win, of in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found |= of
        out.append((d, len(w), len(hit), ",".join(sorted(found))))
    return sorted(out, key=repr)


def cases():
    r = random.Random(3)
    vocabulary = ["the", "of", "Élan", "x1", "and", "rare", "zz", "日本"] + [f"w{i}" for i in range(30)]
    say = lambda n: " ".join(r.choices(vocabulary, k=n))
    items = [(i, say(r.choice([1, 2, 5, 12, 13, 14, 40]))) for i in range(25)] + [(90, None), (91, ""), (92, "-!-")]
    items += [items[3], (77, items[4][1])]
    docs = []
    for d in range(60):
        parts = [say(r.randint(0, 60)) for _ in range(3)]
        if d % 3 == 0:
            parts.insert(1, items[d % 25][1].upper().replace(" ", " -- "))
        docs.append((d, ". ".join(parts)))
    return docs + [(100, None), (101, ""), (102, "?!"), docs[0]], items


def rows(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in df.collect()), key=repr)


def test_matches_brute_force(spark, docs):
    d, i = cases()
    items = spark.createDataFrame(i, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    assert rows(matches(docs(d), items)) == by_hand(d, i)


@pytest.mark.parametrize("vocabulary", [4 << 20, 3])
def test_several_passes_agree_over_an_index_of_some_or_all_words(spark, docs, monkeypatch, vocabulary):
    monkeypatch.setattr(decontaminate, "TEST_BYTES", 600)
    monkeypatch.setattr(decontaminate, "VOCABULARY", vocabulary)
    d, i = cases()
    items = spark.createDataFrame(i, "item_id long, text string")
    several = {(r["doc_id"], r["n_hit"]): r for r in matches(docs(d), items).collect()}
    monkeypatch.undo()
    for r in matches(docs(d), items).collect():
        assert several[r["doc_id"], r["n_hit"]] == r
    monkeypatch.setattr(decontaminate, "TEST_BYTES", 600)
    assert rows(matches(docs(d), spark.createDataFrame(i, "item_id long, text string"))) == by_hand(d, i)


def test_proximity(spark, docs):
    item = " ".join(f"t{k}" for k in range(13))
    moved = item.replace("t5 t6", "t6 t5").replace("t9", "filler t9")
    got = {r["doc_id"]: r for r in matches(docs([(1, moved), (2, item), (3, item.replace("t5", "other"))]), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert [got[k]["n_hit"] for k in (1, 2, 3)] == [0, 13, 0]
    assert [got[k]["near"] for k in (1, 2, 3)] == [["7"], ["7"], []]


def test_long_text_in_one_row(spark, docs):
    item = " ".join(f"q{k}" for k in range(20))
    text = "pad " * 400_000 + item + " pad" * 400_000
    r = matches(docs([(1, text)]), spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert (r["n_words"], r["n_hit"], [tuple(s) for s in r["spans"]]) == (800_020, 20, [(400_000, 400_020)])


def test_empty_sides(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows(matches(docs([(1, "a b")]), none)) == [(1, 2, 0, "")]
    assert matches(docs([]), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_filter_keeps_clean_documents(spark, docs):
    item = " ".join(f"q{k}" for k in range(20))
    df = docs([(1, item), (2, "clean words here"), (3, "w " * 5000 + item + " w" * 5000), (None, "other"), (4, None), (5, "the " * 3), (6, "words " * 50 + "the end"), (7, item[:-10] + " w" * 5000)])
    df = df.withColumn("_hit", F.lit(1)).withColumn("row", F.lit(2))
    items = spark.createDataFrame([(1, item), (2, "the")], "item_id long, text string")
    kept = decontaminated(df, items)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "4", "6", "None"]
    assert decontaminated(df, items.limit(0)).count() == 8 and decontaminated(df.limit(0), items).count() == 0


def test_window_and_slop_have_a_limit(spark, docs):
    with pytest.raises(ValueError):
        matches(docs([]), docs([]), window=50)
