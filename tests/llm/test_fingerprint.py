"""Document fingerprints against sets of paragraphs."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from opinara.llm import fingerprint, queries
from tests.llm import odd

ENDS = re.compile(r"[.!?][ \t\n\x0b\f\r]+|\n")


def paragraphs(text):
    return {p for p in ENDS.split(text or "") if p}


def alike(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(text, after):
    n = len(text)
    return text[: n - n // 4] + after[: n // 4]


def by_hand(docs, spark_hash):
    rows = sorted(((i is not None, i or 0, spark_hash[t or ""], t or "") for i, t in docs))
    out = []
    for k, (has, i, _, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][3]
        new = edited(text, after)
        out.append((i if has else None, len(text), hashlib.sha256(new.encode()).hexdigest(), round(alike(text, new), 9), round(alike(text, after), 9)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()), key=str)


@pytest.fixture
def hashes(spark):
    def run(docs):
        texts = sorted({t or "" for _, t in docs})
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()
        return {r.t: r.h for r in rows}

    return run


@pytest.mark.parametrize("bytes_in_range", [2 << 20, 30_000])
def test_against_sets(spark, hashes, monkeypatch, bytes_in_range):
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", bytes_in_range)
    docs = odd.documents(spark, extra=["bucket", "guest", "cells", "a"])
    docs = docs.withColumn("text", F.regexp_replace("text", " (th|on)", ". $1"))
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    pairs = odd.pairs(docs)
    assert found(fingerprint.fingerprints(docs)) == by_hand(pairs, hashes(pairs))


def test_one_document_is_its_own_next(spark):
    docs = spark.createDataFrame([(1, "a. b. c. d.")], odd.DOCS_SCHEMA.split(", lang")[0])
    row = fingerprint.fingerprints(docs).first()
    assert row.near_next == 1.0 and row.n_chars == 11


def test_empty_table(spark):
    assert fingerprint.fingerprints(odd.nothing(spark)).count() == 0


def test_peeling_recovers_what_differs(spark):
    a, b = list(range(100, 160)), list(range(104, 165))
    df = spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>")
    df = df.select(*[F.transform(c, lambda x: F.xxhash64(x)).alias(c) for c in "ab"])
    row = df.select("a", "b", fingerprint.peel(fingerprint.subtract(fingerprint.sketch(F.col("a")), fingerprint.sketch(F.col("b")))).alias("p")).first()
    assert {(f.key, f.n) for f in row.p.found} == {(x, 1) for x in row.a[:4]} | {(x, -1) for x in row.b[-5:]}
    assert all((c.n, c.key, c.check) == (0, 0, 0) for c in row.p.cells)


@pytest.mark.parametrize("n", [0, 3, 9, 40, 200])
def test_retries_until_whole(spark, n):
    df = spark.createDataFrame([(list(range(n)), list(range(n // 2, 2 * n)))], "a array<bigint>, b array<bigint>")
    df = df.select(*[F.transform(c, lambda x: F.xxhash64(x)).alias(c) for c in "ab"])
    assert df.select(fingerprint.retried(F.col("a"), F.col("b"))).first()[0] == n // 2 + n


@pytest.mark.parametrize("room", [16, 1])
def test_larger_sketches_of_pairs(spark, monkeypatch, room):
    monkeypatch.setattr(fingerprint, "ROOM", room)
    rows = [(0, u, "next", list(range(u)), list(range(u // 2, u + 7))) for u in range(0, 120, 3)]
    pair = spark.createDataFrame(rows, "bucket int, uid bigint, of string, a array<bigint>, b array<bigint>")
    pair = pair.select("bucket", "uid", "of", *[F.transform(c, lambda x: F.xxhash64(x)).alias(c) for c in "ab"])
    got = fingerprint._wide_sketches(pair).collect()
    assert len(got) == len(rows) and all(r.differ == r.uid // 2 + 7 for r in got if r.whole)
    assert sum(r.whole for r in got) > 30 if room == 16 else not all(r.whole for r in got)
    assert {r.uid: r.differ for r in fingerprint._sharded_sketches(pair).collect()} == {u: u // 2 + 7 for _, u, *_ in rows}


def test_query(spark, write_tables):
    docs = odd.documents(spark)
    out = queries.op1_paragraph_iblt(spark, write_tables(documents=docs)).collect()
    texts = {}
    for i, t in odd.pairs(docs):
        texts.setdefault(i, t or "")
    by_text = {}
    for r in out:
        if r.doc_id is not None:
            by_text.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
    assert len(out) == docs.count() and all(len(x) == 1 for x in by_text.values())
    assert len({next(iter(x)) for x in by_text.values()}) == len({frozenset(paragraphs(t)) for t in by_text})
