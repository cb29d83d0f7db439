"""LM scores against counts by hand, and the model's probabilities."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from opinara.llm import language_model as lm
from opinara.llm import queries
from tests.llm import odd


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


def out_of_training(i):
    return zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2


def base_by_hand(docs):
    counts = Counter(t for i, text in docs if not out_of_training(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, text in docs:
        own = tokens(text)
        score = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own)
        out.append((i, out_of_training(i), len(own), sum(counts[t] > 0 for t in own), n, round(score, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("frequent", [1 << 18, 3, 0])
def test_counts_and_base(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    docs = odd.documents(spark, extra=["uid", "gain", "score", "n"]).repartition(3)
    rows = lm.score_documents(docs).collect()
    got = [(r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows]
    assert sorted(got, key=str) == base_by_hand(odd.pairs(docs))
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(50) if out_of_training(i))
    row = lm.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
    assert lm.score_documents(odd.nothing(spark)).count() == 0


def test_all_tokens_share_one(spark):
    """Over every word of the vocabulary, the unseen words of each tail and the end, the model's probabilities sum to one."""
    train = [i for i in range(60) if not out_of_training(i)]
    text = "the cat sat on the mat the dog ate a bone of the cat"
    docs = spark.createDataFrame([(i, text + f" w{i}") for i in train], "doc_id long, text string")
    counts = lm.word_counts(docs.select("text"))
    vocab = lm.vocabulary(counts)
    rows = counts.collect()
    model = lm.fit(lm.class_triples(docs.select("text"), vocab), vocab.n_classes)
    p = 10 ** model.log_probabilities(np.array([1]), np.array([2]))[0]
    total = p[: 1 + vocab.singles].sum()
    for tail in range(lm.TAILS):
        words = [r.n + 1 for r in rows if r.word and vocab.classes[vocab.words[r.word.encode()]] == 1 + vocab.singles + tail]
        total += p[1 + vocab.singles + tail] * (sum(words) + 1) / vocab.tail_mass[tail]
    assert abs(total - 1) < 1e-9


def test_training_finds_the_order_of_classes():
    n = 6
    codes, counts = [], []
    for v in range(n):
        for u in range(n):
            codes.append((v * n + u) * n + (u + 1) % n)  # each class is followed by the next
            counts.append(10)
    model = lm.LogBilinear(np.full(n, 60.0))
    model.train(np.array(codes), np.array(counts), 400, 0.15, 0)
    u = np.arange(n)
    best = model.log_probabilities(u, u).argmax(1)
    assert (best == (u + 1) % n).all()
    assert np.allclose((10 ** model.log_probabilities(u, u)).sum(1), 1)


def test_query_beats_its_base_on_text_it_has_not_seen(spark, write_tables):
    rng = np.random.default_rng(0)
    words = {"x": ["the", "red", "cat", "runs"], "y": ["le", "chat", "rouge", "court"]}
    docs = [(i, " ".join(words["xy"[i % 2]][k % 4] for k in range(rng.integers(20, 60)))) for i in range(200)]
    folder = write_tables(documents=spark.createDataFrame(docs, "doc_id long, text string"))
    rows = [r for r in queries.op3_lbl_scores(spark, folder).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > 0.8 * sum(r.base_score for r in rows)
