"""SimHash near duplicates against all pairs."""

from collections import Counter

import numpy as np
import pytest
import xxhash

from opinara.llm import queries, simhash
from opinara.llm.shared import components, with_least
from tests.llm import odd


def fingerprint_by_hand(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    out = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles)
        out |= (2 * ones > len(shingles)) << bit
    return out


def components_by_hand(rows, radius=4):
    fps = sorted({f for _, f in rows})
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    of = dict(zip(fps, label))
    least = {}
    for i, f in rows:
        if i is not None:
            least[of[f]] = min(least.get(of[f], i), i)
    return Counter((i, f, least.get(of[f])) for i, f in rows)


def found(df):
    return Counter((r.id, r.fp % 2**64, r.component_id) for r in df.collect())


def test_against_all_pairs(spark):
    docs = odd.documents(spark)
    rows = [(i, fingerprint_by_hand(t)) for i, t in odd.pairs(docs)]
    assert found(simhash.near_duplicates(docs)) == components_by_hand(rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(odd.nothing(spark)).count() == 0


def test_sixty_four_shingles_with_the_same_bit():
    assert simhash.fingerprint(b"A b c d " * 70, 4) == fingerprint_by_hand("a b c d " * 70)


@pytest.mark.parametrize(("hot", "blocks"), [(4, None), (64, None), (16, 7), (16, 8)])
def test_links_of_a_crowded_neighbourhood(spark, monkeypatch, hot, blocks):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**62))
    fps = {base}
    for _ in range(300):
        fps.add(base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 9), replace=False)))
    fps |= {int(x) for x in rng.integers(0, 2**63, 200)} | {0, 1, 2**64 - 1}
    signed = [simhash._signed(f) for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    roots = {r.node: r.root for r in components(simhash.links(nodes, blocks=blocks)).collect()}
    rows = [(i, f) for i, f in enumerate(signed)]
    want = components_by_hand([(i, f % 2**64) for i, f in rows])
    least = {}
    for i, f in rows:
        r = roots.get(f, f)
        least[r] = min(least.get(r, i), i)
    assert Counter((i, f % 2**64, least[roots.get(f, f)]) for i, f in rows) == want


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 180)] + [(200, 200), (201, 202), (202, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{x: 100 for x in range(100, 180)}, 201: 201, 202: 201}


def test_blocks_follow_the_fingerprints():
    found = [simhash.blocks_for(10**e, 4) for e in range(12)]
    assert found[:8] == [6] * 8 and found == sorted(found) and found[-1] > 7
    assert simhash.comb(found[-1], 4) * 10**11 / 2 ** (64 * (found[-1] - 4) // found[-1]) <= simhash.PARTNERS


def test_edges_of_a_hub_are_split(spark):
    """A node with a third of all edges: its join is dealt anew, and the components are right."""
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "32",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    edges = spark.range(1, 30_001).selectExpr("id * 7 AS u", "0L AS v").unionAll(spark.range(60_000).selectExpr("10000000 + id AS u", "20000000 + id AS v"))
    edges = edges.unionAll(edges.selectExpr("v AS u", "u AS v")).repartition(8)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        least = with_least(edges)
        assert least.collect() and "skew=true" in least._jdf.queryExecution().executedPlan().toString()
        assert least.where("m != least(u, v)").count() == 0 and least.count() == 180_000
        roots = components(edges)
        assert roots.where("root = 0").count() == 30_001 and roots.count() == 150_001
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_query(spark, write_tables):
    docs = odd.documents(spark)
    out = queries.op7_simhash(spark, write_tables(documents=docs)).collect()
    rows = [(i, fingerprint_by_hand(t)) for i, t in odd.pairs(docs)]
    assert Counter((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in out) == components_by_hand(rows)
    assert all(len(r.fingerprint) == 16 for r in out)
