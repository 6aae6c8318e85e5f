import random

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessera.llm import simhash


def by_hand(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", "  \n", "One", "a B", "a b c", "Été é è " * 9, "x y " * 500, "a b c d", "w" * 50_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % (1 << 64) == by_hand(text)


def test_native_hash_agrees(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % (1 << 64) == xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("bits", [1, 3, 5])
def test_links_lose_and_invent_nothing(spark, bits):
    r = random.Random(bits)
    fps = {0, 1, (1 << 64) - 1}
    for _ in range(60):
        x = r.getrandbits(64)
        fps |= {x} | {x ^ sum(1 << b for b in r.sample(range(64), k)) for k in (1, 2, 3, 3, 4, 5, 6)}
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = {(r["x"], r["y"]) for r in simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), bits).collect()}
    want = {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= bits}
    assert got == want and want


def components_by_hand(rows):
    fps = [by_hand(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min(d for (d, _), h in zip(rows, group, strict=True) if h == g) for g in group}
    return sorted((d, format(f, "016x"), least[g]) for (d, _), f, g in zip(rows, fps, group, strict=True))


def cases():
    r = random.Random(5)
    rows = []
    for d in range(40):
        text = " ".join(r.choices([f"w{i}" for i in range(40)], k=300))
        rows += [(d * 10, text), (d * 10 + 1, text), (d * 10 + 2, text + " tail")]
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "One  TWO"), (0, rows[0][1])]


def test_components(spark, docs):
    rows = cases()
    got = simhash.near_duplicates(docs(rows)).collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == components_by_hand(rows)


def test_one_of_each_component_stays(spark, docs):
    rows = cases()
    df = docs(rows).withColumn("_row", F.lit(1)).withColumn("c0", F.lit(2)).withColumn("_key", F.lit(3))
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for *_, c in components_by_hand(rows)})
    assert simhash.deduplicated(docs([(None, "a b c"), (None, "a b c"), (None, "x")])).count() == 2
    assert simhash.near_duplicates(docs([])).count() == 0
