"""Shards: groups together, slots gapless, loads as a plain heap gives them."""

import heapq
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.llm import queries, sharding
from tests.llm import odd


def size_of(text):
    return len((text or "").encode()) + 16


def loads_by_hand(docs, shards):
    """Loads of the longest-processing-time rule, group by group."""
    groups = Counter()
    for _, t in docs:
        groups[t or ""] += size_of(t)
    heap = [(0, s) for s in range(shards)]
    for size in sorted(groups.values(), reverse=True):
        load, s = heap[0]
        heapq.heapreplace(heap, (load + size, s))
    return sorted(load for load, _ in heap)


def check(rows, docs, shards):
    assert Counter((r[0], r.size, r.text_crc32) for r in rows) == Counter((i, size_of(t), zlib.crc32((t or "").encode())) for i, t in docs)
    slots, kept, loads = defaultdict(list), defaultdict(set), Counter({s: 0 for s in range(shards)})
    texts = {(i, size_of(t), zlib.crc32((t or "").encode())): t or "" for i, t in docs}
    for r in rows:
        slots[r.shard].append(r.slot)
        kept[texts[r[0], r.size, r.text_crc32]].add(r.shard)
        loads[r.shard] += r.size
    assert set(loads) == set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in kept.values())
    return sorted(loads.values())


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_whole(spark, shards):
    docs = odd.documents(spark)
    rows = sharding.shard_by_bytes(docs.repartition(3), shards).collect()
    assert check(rows, odd.pairs(docs), shards) == loads_by_hand(odd.pairs(docs), shards)


@pytest.mark.parametrize("large", [1, 10, 100, 20_000])
def test_many_groups_and_a_hot_one(spark, monkeypatch, large):
    """A third of the rows say the same; the others have all sizes."""
    monkeypatch.setattr(sharding, "LARGE", large)
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.col("id").cast("string"), F.repeat(F.lit("é"), (F.col("id") * 7919 % 400).cast("int")))).alias("text"),
    )
    pairs = odd.pairs(docs)
    got, want = check(sharding.shard_by_bytes(docs.repartition(5), 8).collect(), pairs, 8), loads_by_hand(pairs, 8)
    assert got[-1] <= want[-1] + 50 and got[0] >= want[0] - 50


def test_wide_classes_stay_balanced(spark, monkeypatch):
    """Classes that hold very different sizes: sorted places keep the shards level."""
    monkeypatch.setattr(sharding, "STEPS", 2)
    docs = spark.range(4000).select("id", F.col("id").alias("doc_id"), F.concat(F.col("id"), F.repeat(F.lit("x"), (F.col("id") * 7919 % 3000).cast("int"))).alias("text"))
    loads = check(sharding.shard_by_bytes(docs, 7).collect(), odd.pairs(docs), 7)
    assert loads[-1] - loads[0] < 3000 + 32


def test_runs_equal_a_plain_heap():
    rng = np.random.default_rng(5)
    for shards in (1, 2, 7, 40):
        heap = [(float(x), s) for s, x in enumerate(rng.integers(0, 100_000, shards))]
        heapq.heapify(heap)
        plain = list(heap)
        for size, count in ((5000, 3), (900, 700), (17, 20_000), (16, 1)):
            got = sharding.place_run(heap, size, count)
            want = np.zeros(shards, np.int64)
            for _ in range(count):
                load, s = plain[0]
                heapq.heapreplace(plain, (load + size, s))
                want[s] += 1
            assert (got == want).all() and sorted(heap) == sorted(plain)


def test_places_are_dealt_as_planned():
    for got in ([3, 0, 5, 5], [0, 0, 0], [7], [2, 2, 2], [1000, 1, 0, 999]):
        stretches = sharding.spread(np.array(got))
        dealt = sharding.shard_at(stretches, np.arange(sum(got)))
        assert np.bincount(dealt, minlength=len(got)).tolist() == got


def test_size_classes(spark):
    sizes = spark.createDataFrame([(i,) for i in [16, 17, 2047, 2048, 2049, 2050, 4095, 4096, 4100, 10**6, 10**6 + 100, 10**9, 10**14]], "size bigint")
    kinds = [r[0] for r in sizes.select(sharding.size_class(F.col("size"))).collect()]
    assert kinds == sorted(kinds) and kinds[:3] == [16, 17, 2047] and kinds[3] == kinds[4] != kinds[5] and kinds[9] == kinds[10]


def test_empty_table(spark):
    assert sharding.shard_by_bytes(odd.nothing(spark)).count() == 0


def test_query(spark, write_tables):
    docs = odd.documents(spark, extra=("digest", "shard", "slot", "place", "size"))
    out = queries.op13_lpt_shards(spark, write_tables(documents=docs))
    assert dict(out.dtypes)["grown_shard"] == "int" and out.where("law != 'bytes' OR grown_shard IS NOT NULL").isEmpty()
    check(out.select("doc_id", "size", "text_crc32", "shard", "slot").collect(), odd.pairs(docs), 40)
