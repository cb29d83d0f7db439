"""Packing: every id in exactly one piece, sequences gapless and full."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from opinara.llm import packing, queries
from tests.llm import odd

NAME = "byte_bpe_50k"


def ids_by_hand(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(f"{NAME}.json"))
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("text", ["", " ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b\n\n c", "l'été ß 𝄞 \u00a0\u3000x", "A1 b2\t\tc" * 50, odd.LONG])
def test_ids(text):
    assert [*packing.token_ids(text).tolist(), 0] == ids_by_hand(text)


def test_long_texts_are_cut_where_tokens_end(monkeypatch):
    monkeypatch.setattr(packing, "SPLIT_CHARS", 50)
    text = "some words, l'été 12 34 <|endoftext|> and  blanks " * 30
    assert [*packing.token_ids(text).tolist(), 0] == ids_by_hand(text)


def check(pieces, docs, window):
    """All that must hold of a packing."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id if hasattr(p, "doc_id") else p.id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    want = Counter()
    for i, t in docs:
        want[i, len(ids_by_hand(t))] += 1
    got = Counter((next(iter(d)), n) for d, n in ((({i}), p.doc_tokens) for i, x in by_doc.items() for p in x if p.start == 0))
    assert got == want
    for i, x in by_doc.items():
        assert sum(p.length for p in x) == sum(len(ids_by_hand(t)) for j, t in docs if j == i)
        texts = [t for j, t in docs if j == i]
        if len(texts) == 1:
            ids, at = ids_by_hand(texts[0]), 0
            for p in sorted(x, key=lambda p: p.start):
                assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
                at += p.length
            assert at == len(ids)
    short = 0
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window
        short += at < window
    assert short <= 1


@pytest.mark.parametrize("window", [16, 64, 1024])
def test_whole(spark, window):
    docs = odd.documents(spark)
    check(packing.pack(docs.repartition(3), window=window).collect(), odd.pairs(docs), window)


def test_one_length_for_most(spark):
    docs = spark.createDataFrame([(i, "a b c d e f g h i j") for i in range(50)] + [(99, "x")], "doc_id long, text string").repartition(4)
    check(packing.pack(docs, window=16).collect(), odd.pairs(docs), 16)


def test_empty_table(spark):
    assert packing.pack(odd.nothing(spark)).count() == 0


def test_counts_reproduce_a_histogram():
    window = 64
    combos = packing.combinations_filling(window)
    assert (combos.sum(1) == window).all() and len({tuple(c) for c in combos}) == len(combos)
    x = np.zeros(len(combos))
    x[::7] = 10
    histogram = sum(np.bincount(combos[:, j], x, window + 1) for j in range(3))
    histogram[0] = 0
    solved = packing.solve_counts(combos, histogram, rounds=4000)
    made = sum(np.bincount(combos[:, j], solved, window + 1) for j in range(3))
    assert (solved >= 0).all() and np.abs(made - histogram)[1:].sum() < 0.01 * histogram.sum()


def test_query(spark, write_tables):
    docs = odd.documents(spark)
    out = queries.op8_nnls_packing(spark, write_tables(documents=docs))
    assert set(out.columns) >= {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    check(out.collect(), odd.pairs(docs), 1024)
