import hashlib
import heapq
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import shards


@given(st.lists(st.integers(1, 1000), max_size=60), st.integers(1, 9))
@settings(deadline=None)
def test_schedule_is_longest_first_to_the_least_loaded(sizes, n):
    placed = shards.schedule(list(enumerate(sizes)), n)
    loads = [0] * n
    for unit, size in sorted(enumerate(sizes), key=lambda x: (-x[1], x[0])):
        least = loads.index(min(loads))
        assert placed[unit] == least
        loads[least] += size


def check(rows, placed):
    texts = {}
    for r in placed:
        texts.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in texts.values())
    for s in {r["shard"] for r in placed}:
        own = sorted((r["slot"], r["doc_id"]) for r in placed if r["shard"] == s)
        assert [k for k, _ in own] == list(range(len(own))) and [d for _, d in own] == sorted(d for _, d in own)
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in placed) == want


def test_groups_stay_together_and_sizes_are_near_equal(docs):
    rows = [(i, f"text {i} " * (i % 17)) for i in range(400)] + [(1000 + i, "copied é") for i in range(50)] + [(2000, None), (2001, ""), (3, "repeated"), (3, "repeated")]
    placed = shards.assign(docs(rows).withColumn("shard", F.lit(99)).withColumn("slot", F.lit("x"))).collect()
    check(rows, placed)
    loads = Counter()
    for r in placed:
        loads[r["shard"]] += r["size"]
    assert len(loads) == 8 and max(loads.values()) - min(loads.values()) <= 500
    again = shards.assign(docs(rows)).collect()
    assert {(r["doc_id"], r["shard"]) for r in again} == {(r["doc_id"], r["shard"]) for r in placed}


@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 40)), max_size=12, unique_by=lambda x: x[0]), st.integers(1, 9))
@settings(deadline=None)
def test_runs_of_equal_sizes_are_single_steps(classes, n):
    classes = sorted(classes, reverse=True)
    want = shards.schedule([(k, size) for k, size in enumerate(size for size, many in classes for _ in range(many))], n)
    heap, got = [(0, shard) for shard in range(n)], []
    for size, many in classes:
        of = shards.runs(size, many, heap)
        assert len(of) <= n
        got += [turn[i % len(turn)] for long, turn in of for i in range(long)]
    assert got == [want[k] for k in range(len(want))]


def by_hand(rows, n=8):
    """The whole query by plain loops: groups by text, a heap step for each, slots by counting."""
    groups = {}
    for d, t in rows:
        groups.setdefault((t or "").encode(), []).append(d)
    total = {t: (len(t) + 1) * len(of) for t, of in groups.items()}
    shard_of, heap = {}, [(0, k) for k in range(n)]
    for t in sorted(groups, key=lambda t: (-total[t], hashlib.sha256(t).digest())):
        load, k = heapq.heappop(heap)
        shard_of[t] = k
        heapq.heappush(heap, (load + total[t], k))
    out, slots = [], Counter()
    for d, t in sorted(((d, t) for t, of in groups.items() for d in of), key=lambda x: (x[0] is not None, x[0] or 0, zlib.crc32(x[1]))):
        k = shard_of[t]
        out.append((d, len(t) + 1, zlib.crc32(t), "bytes", k, slots[k], None))
        slots[k] += 1
    return Counter(out)


def test_the_query_is_that_of_plain_loops(spark, docs, tmp_path):
    long = "long " * 300_000
    rows = [(i, f"text {i}" * (i % 7)) for i in range(300)] + [(900 + i, "one hot text") for i in range(200)] + [(2, "again"), (2, "again"), (None, "no id"), (2000, None), (2001, ""), (2002, long), (2003, "é")]
    docs(rows).withColumn("_group", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(map(tuple, shards.op9_sharding(spark, str(tmp_path)).collect())) == by_hand(rows)
    d = "/root/testdata/sf0.01"
    every = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, shards.op9_sharding(spark, d).collect())) == by_hand(every)


def test_fewer_groups_than_shards_and_none(docs):
    assert {r["shard"] for r in shards.assign(docs([(1, "a"), (2, "a")])).collect()} == {0}
    assert shards.assign(docs([])).count() == 0


def test_written_shards(spark, docs, tmp_path):
    df = docs([(i, f"text {i}") for i in range(40)])
    shards.write(df, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 40 and {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
