"""Token alignment against a plain double loop over both tokenizers' offsets."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from opinara.llm import alignment, queries
from tests.llm import odd

#: Byte-level vocabularies write these bytes as themselves and the others, in order, as code points from 256 on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]


def spans_a(text, cache={}):
    if not cache:
        cache["t"] = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        cache["t"].encode_special_tokens = True
        others = [b for b in range(256) if b not in PRINTED]
        cache["b"] = {chr(b): b for b in PRINTED} | {chr(256 + i): b for i, b in enumerate(others)}
    ids = cache["t"].encode(" " + text, add_special_tokens=False).ids
    return ids, [bytes(cache["b"][c] for c in cache["t"].id_to_token(i)) for i in ids]


def spans_b(text, cache={}):
    if not cache:
        cache["t"] = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    model = cache["t"]
    ids = model.encode(text)
    pieces = [model.id_to_piece(i) for i in ids]
    return ids, [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in pieces]


def by_hand(texts):
    rows, pairs = [], []
    for text in texts:
        a, bytes_a = spans_a(text) if text else ([], [])
        b, bytes_b = spans_b(text) if text else ([], [])
        if not text or b"".join(bytes_a) != b" " + text.encode() or b"".join(bytes_b) != b" " + text.encode():
            rows.append((0, 0, 0, ""))
            pairs.append([])
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        starts_a, starts_b = [0, *ends_a[:-1]], [0, *ends_b[:-1]]
        near = range(40)  # tokens at most so far apart in number can overlap in these texts
        at_b, links = 0, []
        for i in range(len(a)):
            while ends_b[at_b] <= starts_a[i]:
                at_b += 1
            links += [(a[i], b[at_b + k]) for k in near if at_b + k < len(b) and starts_b[at_b + k] < ends_a[i]]
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = []
        for lo, hi in zip([0, *cuts], cuts):
            groups.append([[str(i) for i, s, e in zip(ids, starts, ends) if lo <= s and e <= hi] for ids, starts, ends in ((a, starts_a, ends_a), (b, starts_b, ends_b))] if len(a) < 3000 else None)
        said = ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in groups) if None not in groups else None
        rows.append((len(a), len(b), len(cuts), said and hashlib.sha256(said.encode()).hexdigest()))
        pairs.append(links)
    count = Counter(p for links in pairs for p in links)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return [(*row[:3], len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), row[3]) for row, links in zip(rows, pairs)]


def check(found, docs):
    wanted = Counter()
    for (row_id, _), row in zip(docs, by_hand([t for _, t in docs]), strict=True):
        wanted[row_id, *row] += 1
    got = Counter()
    open_digests = {(k[0], *k[1:-1]) for k in wanted if k[-1] is None}
    for r in found:
        key = (r[0], r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum)
        got[(*key, None if key in open_digests else r.groups_sha256)] += 1
    assert got == wanted


EXTRA = ["<|endoftext|> <s> </s> <unk>", "a▁b", "  two  blanks\n\n\ttabs", "l'été 𝄞 ﬁ 　x  ", "日本語のテキスト", "\x00\x01", "don't WON'T 12345 ...!?"]


@pytest.mark.parametrize("frequent", [1 << 18, 50, 0])
def test_whole(spark, frequent):
    docs = odd.documents(spark)
    docs = docs.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(EXTRA)], "doc_id long, text string"), allowMissingColumns=True)
    check(alignment.align(docs.repartition(3), frequent=frequent).collect(), odd.pairs(docs))


def test_small_lanes_parts_and_batches(spark, monkeypatch):
    texts = [" ".join(f"a word {i} l'été, and so {i * j}" for i in range(60)) for j in range(4)]
    parts = []
    for t in texts:
        parts += alignment.parts_of(t)
    assert parts == texts
    monkeypatch.setattr(alignment, "PART", 100)
    monkeypatch.setattr(alignment, "BATCH_BYTES", 300)
    assert all(" ".join(alignment.parts_of(t)) == t and len(list(alignment.parts_of(t))) > 3 for t in texts)
    documents = [alignment._Document() for _ in texts]
    for document, t in zip(documents, texts, strict=True):
        alignment.align_parts([(document, p) for p in alignment.parts_of(t)], "byte_bpe_50k", "piece_bpe_32k")
    for document, want in zip(documents, by_hand(texts), strict=True):
        row = document.row()
        assert row[:4] == want[:4] and row[4] == want[6] and row[6].sum() == want[3]


@pytest.mark.parametrize("size", [1, 2, 7, 512])
def test_lanes_give_the_same_links(size):
    rng = np.random.default_rng(3)
    ends_a, ends_b = (np.unique(np.append(rng.integers(1, 2000, n), 2000)) for n in (700, 500))
    one = alignment.lockstep(ends_a, ends_b, np.array([0]), np.array([0]))
    many = alignment.lockstep(ends_a, ends_b, *alignment.lanes(ends_a, ends_b, np.array([0]), size))
    assert set(zip(*one[:2])) == set(zip(*many[:2])) and len(one[0]) == len(many[0])
    assert (one[2] == many[2]).all() and (one[3] == many[3]).all() and set(ends_a[one[2]]) == set(ends_a) & set(ends_b)


def test_empty_table(spark):
    assert alignment.align(odd.nothing(spark)).count() == 0


def test_only_texts_without_tokens(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "▁"), (None, "")], "doc_id long, text string")
    check(alignment.align(docs).collect(), odd.pairs(docs))


def test_query(spark, write_tables):
    docs = odd.documents(spark)
    out = queries.op11_lockstep_alignment(spark, write_tables(documents=docs))
    assert set(out.columns) >= {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"}
    check(out.select("doc_id", *[c for c in out.columns if c != "doc_id"]).collect(), odd.pairs(docs))
