import hashlib
import random
import re

from pyspark.sql import functions as F

from tessera.llm import pii

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, text):
    d = re.sub("[^0-9]", "", text)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in text.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def by_hand(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def cases():
    r = random.Random(1)
    parts = ["a.b@c.de", "x@y.z%q@w.v", "@", "a@b", "a@b.c..d@e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "00001.2.3.255", "4111 1111 1111 1111", "4111111111111112", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "4111  1111",
             "+1 (988) 555-2485", "+1 2", "++33.123.456.78", "+123456789012345678", "é", "日本", "😀", " ", "\n", "12", "-", ".", "+", "word", "token", "99999999999999999999999"]
    rows = [(i, "".join(r.choice(parts) + r.choice(["", " ", " "]) for _ in range(r.randint(0, 14)))) for i in range(300)]
    return rows + [(900, None), (901, ""), (5, rows[5][1])]


def digest(spark, tmp_path, docs, rows):
    docs(rows).withColumn("row", F.lit(1)).withColumn("kind", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    return pii.op6_weak_supervision_pii(spark, str(tmp_path)).collect()


def test_base_spans_are_those_of_the_plain_patterns(spark, docs, tmp_path):
    rows = cases()
    got = digest(spark, tmp_path, docs, rows)
    assert len(got) == len(rows)
    want = {d: by_hand(t) for d, t in rows}
    for r in got:
        own = want[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(own).encode()).hexdigest(), (r, own)
        assert [r[f"n_{k}"] for k in BASE] == [sum(x.startswith(k) for x in own) for k in BASE]
        assert [x for x in r["spans"].split(",") if x in own] == own


def test_long_runs_neither_recurse_nor_hang(spark, docs, tmp_path):
    n = 60_000
    rows = [(1, "7" * n), (2, "a" * n + "@"), (3, "x@" + "a." * n + "b"), (4, "1." * n), (5, "+" * n), (6, "+1" + " " * n), (7, "4 " * n)]
    got = {r["doc_id"]: r for r in digest(spark, tmp_path, docs, rows)}
    assert got[3]["n_email"] == 1 and got[2]["n_email"] == got[1]["n_card"] == 0 and got[4]["n_ip"] == n // 4


def test_weak_spans_are_judged_by_their_votes(spark, docs):
    rows = [(i, f"Please call my phone ({300 + i}) 555-{2000 + i} today") for i in range(40)]
    rows += [(100 + i, f"invoice order part no {300 + i} 555 {2000 + i}/7") for i in range(40)]
    rows += [(200 + i, f"write e-mail to jane{i} (at) example (dot) com now") for i in range(20)] + [(300, "4111111111111112 card visa")]
    got = {r["doc_id"]: r["spans"] for r in pii.personal(docs(rows)).collect()}
    assert all([s["kind"] for s in got[i]] == ["phone"] for i in range(40))
    assert not any(got[100 + i] for i in range(40)) and not got[300]
    assert all([s["kind"] for s in got[200 + i]] == ["email"] for i in range(20))


def test_masking_keeps_all_else(spark, docs):
    rows = [(1, "é mail a@b.cd or +1 (988) 555-2485."), (2, None), (3, "clean"), (3, "clean"), (None, "1.2.3.4")]
    df = docs(rows)
    out = pii.masked(df)
    assert out.columns == df.columns
    assert sorted(map(str, [r["text"] for r in out.collect()])) == sorted(["é mail <email> or <phone>.", "None", "clean", "clean", "<ip>"])


def test_reliabilities_find_the_labeler_that_is_right():
    votes = dict.fromkeys(pii.LABELERS, 0)
    counts = [{"kind": "phone", **votes, "by_list": a, "by_context": a, "by_edge": e, "size": 1, "n": n} for a, e, n in ((1, 1, 450), (1, -1, 50), (-1, 1, 250), (-1, -1, 250))]
    prior, tables = pii.reliabilities(counts)["phone"]
    gap = lambda name: tables[pii.LABELERS.index(name)][1][1] - tables[pii.LABELERS.index(name)][1][0]
    assert 0.3 < prior < 0.7 and gap("by_list") > 0.8 > gap("by_edge")


def test_empty_table(docs):
    assert pii.personal(docs([])).count() == 0


def test_plan_has_no_python(spark, docs, tmp_path):
    docs(cases()).write.parquet(f"{tmp_path}/documents.parquet")
    plan = pii.op6_weak_supervision_pii(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapIn", plan)


def test_masking_keeps_columns_of_any_name(docs):
    df = docs([(1, "mail a.b@example.org now"), (1, "mail a.b@example.org now"), (None, None), (3, "")]).withColumn("_row", F.lit(7)).withColumn("spans", F.lit("x")).withColumn("_key", F.lit(1))
    out = pii.masked(df)
    assert out.columns == df.columns and sorted(str(r["text"]) for r in out.collect()) == ["", "None", "mail <email> now", "mail <email> now"] and {r["spans"] for r in out.collect()} == {"x"}
    assert pii.masked(df.limit(0)).count() == 0
