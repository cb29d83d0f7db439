"""Benchmark decontamination against a direct search."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from opinara.llm import decontamination, queries
from tests.llm import odd

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, n):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if owners := windows.get(tuple(w[i : i + k])):
                    found |= owners
                    hit |= set(range(i, i + k))
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def near_by_hand(docs, items, n, span):
    """Items of which a window has all its words within ``span`` of a place of its rarest word."""
    corpus = [w for _, t in docs for w in words(t)]
    out = []
    for doc, text in docs:
        w, found = words(text), set()
        for item, t in items:
            own = words(t)
            for i in range(max(1, len(own) - n + 1) if own else 0):
                window = own[i : i + n]
                counts = [corpus.count(x) for x in window]
                rarest = window[counts.index(min(counts))]
                if any(set(window) <= set(w[max(0, p - span) : p + span + 1]) for p, x in enumerate(w) if x == rarest):
                    found.add(item)
        out.append((doc, sorted(found)))
    return sorted(out, key=str)


ITEMS = [(1, "alpha beta gamma delta"), (2, "one two three, four five six"), (3, "The end"), (4, None), (5, "..."), (6, "alpha beta gamma delta"), (7, "a a a a a a"), (8, "l'été à Zürich 2024 ok"), (None, "zeta"), (1, "zeta eta theta iota kappa")]
DOCS = [(1, "x ALPHA beta; gamma\ndelta alpha beta gamma delta y"), (2, "a a a a a a a b a a a a"), (3, "one two three four five. two three four five six"), (4, "L'été à Zürich 2024 ok the-END"), (5, None), (6, ""), (7, "delta gamma x beta alpha"), (None, "the end"), (7, "delta gamma x beta alpha"), (8, "alpha beta"), (9, "gamma delta"), (10, "zeta eta theta iota")]


def frames(spark, docs=DOCS):
    d = spark.createDataFrame([(i, t, "clash", "clash") for i, t in docs], "doc_id long, text string, key string, n_hit string")
    return d, spark.createDataFrame([(i, t, "clash") for i, t in ITEMS], "item_id long, text string, items string")


@pytest.mark.parametrize("n", [4, 10])
def test_against_direct_search(spark, monkeypatch, n):
    monkeypatch.setattr(decontamination, "PLACES", 3)
    docs, items = frames(spark)
    got = [(r.id, r.n_words, r.n_hit, sorted(r["items"])) for r in decontamination.decontaminate(docs.repartition(2), items, n=n).collect()]
    assert sorted(got, key=str) == by_hand(DOCS, [i for i in ITEMS if i[0] is not None], n)


def test_proximity(spark):
    docs, items = frames(spark)
    rows = decontamination.decontaminate(docs, items, n=4, span=3).collect()
    assert sorted([(r.id, sorted(r.near_items)) for r in rows], key=str) == near_by_hand(DOCS, [i for i in ITEMS if i[0] is not None], 4, 3)


def test_benchmark_in_parts(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PART_WORDS", 8)
    docs, items = frames(spark)
    got = [(r.id, r.n_words, r.n_hit, sorted(r["items"])) for r in decontamination.decontaminate(docs, items, n=4).collect()]
    assert sorted(got, key=str) == by_hand(DOCS, [i for i in ITEMS if i[0] is not None], 4)


def test_nothing(spark):
    docs, items = frames(spark)
    assert decontamination.decontaminate(odd.nothing(spark), items).count() == 0
    rows = decontamination.decontaminate(docs, items.limit(0), n=4).select("n_hit", F.size("items").alias("n")).distinct().collect()
    assert [tuple(r) for r in rows] == [(0, 0)]


def test_query(spark, write_tables):
    docs = odd.documents(spark)
    items = [(3, odd.LONG[:3000]), (20, " ".join(odd.pairs(docs)[10][1].split()[:30])), (5, "qué"), (11, "nowhere to be found")]
    folder = write_tables(documents=docs, benchmark=spark.createDataFrame(items, "item_id long, text string"))
    want = by_hand(odd.pairs(docs), items, 10)
    got = queries.op6_benchmark_index(spark, folder).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got), key=str) == sorted(((d, w, h, len(i)) for d, w, h, i in want), key=str)
    digests = {(d, hashlib.sha256(",".join(sorted(map(str, i))).encode()).hexdigest()) for d, _, _, i in want}
    assert {(r.doc_id, r.items_sha256) for r in got} == digests and all(r.contaminated == (r.n_hit > 0) for r in got)
