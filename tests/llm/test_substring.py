"""Substring dedup against a direct search."""

import hashlib
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from opinara.llm import queries, substring
from tests.llm import odd


def by_hand(docs, size):
    least = {}
    split = [(i, (t or "").encode().split()) for i, t in docs]
    for i, w in split:
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            least[key] = min(least.get(key, substring.NO_ID), substring.NO_ID if i is None else i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - size + 1):
            if least[tuple(w[k : k + size])] < (substring.NO_ID if i is None else i):
                gone |= set(range(k, k + size))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return Counter(out)


def found(df):
    return Counter((r.row.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect())


@pytest.mark.parametrize("bytes_in_block", [1, 2000, 1 << 24])
def test_against_direct_search(spark, monkeypatch, bytes_in_block):
    monkeypatch.setattr(substring, "BLOCK_BYTES", bytes_in_block)
    docs = odd.documents(spark, extra=["row", "n_words", "kept"]).repartition(3)
    assert found(substring.remove_copies(docs, size=5)) == by_hand(odd.pairs(docs), 5)


def test_overlaps_order_and_copies_inside_one_document(spark):
    docs = [(2, "a b c d e f g h"), (1, "x b c d e y"), (3, "b c d e b c d e"), (1, "x b c d e y"), (5, "  a b\tc d  e "), (0, "a b")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(substring.remove_copies(df, size=3)) == by_hand(docs, 3)


def test_empty_table(spark):
    assert substring.remove_copies(odd.nothing(spark)).count() == 0


def test_numbers_survive_encoding():
    rng = np.random.default_rng(0)
    for top in (1, 200, 60_000, 2**30, 2**63):
        cells = np.sort(rng.integers(0, top, 500).astype(np.uint64))
        assert (substring.decode(substring.encode(cells)) == cells).all()
    assert len(substring.decode(substring.encode(np.zeros(0, np.uint64)))) == 0


def test_windows_with_equal_digests_have_equal_words():
    rng = np.random.default_rng(1)
    text = " ".join(rng.choice(["a", "b", "c"], 5000)).encode()
    block = substring.Block([text], 6, substring.WordHashes())
    words = text.split()
    by_digest = {}
    for i, key in enumerate(zip(*[d.tolist() for d in block.digests], strict=True)):
        by_digest.setdefault(key, set()).add(tuple(words[i : i + 6]))
    assert all(len(x) == 1 for x in by_digest.values()) and len(by_digest) == len(set.union(*by_digest.values()))


def test_query(spark, write_tables):
    docs = odd.documents(spark)
    got = queries.op10_substring_dedup(spark, write_tables(documents=docs)).collect()
    want = Counter((i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in by_hand(odd.pairs(docs), 13).elements())
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want


def test_a_hot_passage_is_sent_twice_by_a_block(spark):
    """A passage that a third of the rows repeat reaches its slice twice from each block, not once for each window."""
    hot = " ".join(f"w{i}" for i in range(13))
    texts = [hot if i % 3 == 0 else " ".join(f"v{i}x{j}" for j in range(13)) for i in range(3000)]
    blocks = spark.createDataFrame([(0, (t,)) for t in texts], "block bigint, row struct<text:string>").coalesce(1)
    cells = [substring.decode(r.cells) for r in substring._sketch(blocks, "text", 13, 40, 2).collect()]
    counts = [np.unique(c, return_counts=True)[1] for c in cells]
    assert max(c.max() for c in counts) == 2 and sum(len(c) for c in cells) == substring.DEPTH * (2000 + 2)


def test_slices_grow_with_the_counters():
    assert [substring.slice_bits_of(b) for b in (10, 24, 30, 38, 42, 47, 60)] == [2, 2, 8, 16, 16, 21, 34]


def test_a_block_holds_the_words_of_one_document_at_a_time():
    """Peak and rest per word of a block of different words: its arrays of numbers, but no objects."""
    texts = [" ".join(f"w{i}x{j}" for j in range(1000)).encode() for i in range(200)]
    tracemalloc.start()
    block = substring.Block(texts, 13, substring.WordHashes())
    left, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(block.digests[0]) == 200 * 988 and left < 40 * 200_000 and peak < 120 * 200_000
