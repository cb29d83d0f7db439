"""Ranks and tiles against brute force, with one group holding most of the rows."""

import random

from pyspark.sql import functions as F

from opinara.operators import ranking


def skewed(n=3000, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        group = "hot" if rng.random() < 0.6 else f"g{rng.randrange(40)}"
        value = 5.0 if rng.random() < 0.4 else rng.randrange(100, 500) / rng.choice([100, 99, 97])
        rows.append((i, group, value))
    return rows


def test_rank_within(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "i int, g string, v double")
    got = {r["i"]: r["rank"] for r in ranking.rank_within(df, "g", "v", "rank").collect()}
    by_group = {}
    for _, g, v in rows:
        by_group.setdefault(g, []).append(v)
    assert got == {i: 1 + sum(w > v for w in by_group[g]) for i, g, v in rows}


def test_dense_rank(spark):
    rows = [(i, round(v, 2)) for i, _, v in skewed(500)]
    df = spark.createDataFrame(rows, "i int, v double")
    levels = sorted({v for _, v in rows}, reverse=True)
    got = {r["i"]: r["rank"] for r in ranking.dense_rank_of_levels(df, "v", "rank").collect()}
    assert got == {i: levels.index(v) + 1 for i, v in rows}


def test_tiles(spark):
    """As ntile gives them; with many names at one value, and names that share their first letters."""
    for n in (1, 3, 4, 5, 10, 103):
        for descending in (False, True):
            df = spark.createDataFrame([(f"{'same' * (i % 2)}{i * 31 % 101:03d}", (i * 7) % 5 if i % 3 else 0) for i in range(n)], "name string, v int")
            got = {r["name"]: r["t"] for r in ranking.tiles(df, 4, "v", "name", "t", descending).collect()}
            want = df.selectExpr("name", f"ntile(4) over (order by v {'desc' if descending else 'asc'}, name) as t").collect()
            assert got == {r["name"]: r["t"] for r in want} and len(got) == n


def test_tiles_of_nothing(spark):
    assert ranking.tiles(spark.createDataFrame([], "name string, v int"), 4, "v", "name", "t").collect() == []


def test_top_k(spark):
    """Whole levels above the cut, the first names by the alphabet at the cut, other groups untouched."""
    rows = [("g", f"t{i:03d}", total) for i, total in enumerate([9] * 3 + [5] * 40 + [2] * 400)] + [("h", "only", 2), ("h", "éa", 2), ("h", "", 7)]
    df = spark.createDataFrame(rows, "grp string, term string, total long").repartition(5)
    for k in (1, 2, 3, 4, 43, 50, 442, 443, 1000):
        got = sorted((r.grp, r.term) for r in ranking.top_k(df, "grp", "total", "term", k).collect())
        best = [sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))[:k] for g in "gh"]
        assert got == sorted((r[0], r[1]) for part in best for r in part)
