"""Spelling groups against edit distances of all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from opinara.llm import queries, spelling
from tests.llm import odd


def words_by_hand(docs):
    counts = Counter()
    for row_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if row_id is None else row_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 5
    return {w: n for w, n in counts.items() if n >= 3}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def groups_by_hand(counts):
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and distance(w, v) == 1] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    found = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        found.add((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return found


def rows_of(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def vocabulary(n=600, letters="abé", lengths=(1, 9), seed=1):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randrange(*lengths))): rng.choice([3, 5, 9, 20, 50, 100, 400]) for _ in range(n)}


@pytest.mark.parametrize("hot, tile", [(1024, 128), (8, 128), (5, 3), (1024, 2)])
def test_all_single_edits(spark, monkeypatch, hot, tile):
    monkeypatch.setattr(spelling, "HOT", hot)
    monkeypatch.setattr(spelling, "TILE", tile)
    counts = vocabulary(250)
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    pairs = [tuple(r) for r in spelling.near_pairs(words).select("word", "near", "n", "near_n").collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(v, w, counts[v], counts[w]) for v in counts for w in counts if distance(v, w) == 1}


def test_groups(spark):
    counts = vocabulary(500, "abcdé", (5, 8))
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows_of(spelling.group_variants(words)) == groups_by_hand(counts)


def test_one_prefix_for_all(spark, monkeypatch):
    """A key that holds every word, in more blocks than one."""
    monkeypatch.setattr(spelling, "HOT", 16)
    counts = {f"samesamesame{a}{b}{c}": 3 + (a == b) * 30 for a in "pqrst" for b in "pqrst" for c in "pqr"}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    assert rows_of(spelling.group_variants(words)) == groups_by_hand(counts)


def test_long_chain_of_forms(spark):
    """Each word is a single edit from one twice as frequent."""
    counts = {"x" * i + "y" * (12 - i) + "zz": 3 * 2**i for i in range(13)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = rows_of(spelling.group_variants(words))
    assert got == groups_by_hand(counts) and {r[2] for r in got} == {"x" * 12 + "zz"}


def test_very_long_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CELLS", 4000)
    rng = random.Random(2)
    base = "".join(rng.choice("abcdef") for _ in range(3000))
    counts = {base: 100, base[:1500] + base[1501:]: 4, base[:10] + "z" + base[11:]: 5, base[:-1]: 6, base + "a": 7, base[::-1]: 8}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = rows_of(spelling.group_variants(words))
    assert {(r[3], r[5]) for r in got} == {(100, None), (4, 100), (5, 100), (6, 100), (7, 100), (8, None)}


def test_parts_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PART", 7)
    monkeypatch.setattr(spelling, "HELD", 3)
    docs = spark.createDataFrame([(i, "Several wörds, SEVERAL words of ÀÉ letters; x " * 3) for i in range(4)], "doc_id long, text string")
    assert dict(spelling.word_counts(docs).collect()) == words_by_hand(odd.pairs(docs))


def test_empty_tables(spark):
    assert spelling.group_variants(spelling.word_counts(odd.nothing(spark))).count() == 0
    assert spelling.group_variants(spark.createDataFrame([("alone", 3)], "word string, n long")).collect()[0][:3] == ("alone", None, "alone")


def test_query(spark, write_tables):
    rng = random.Random(4)
    vocabulary_of = ["letter", "lettre", "letters", "Kitten", "sitten", "kittens", "mötion", "motion", "notion", "nation", "nations", "x", "the"]
    extra = [(200 + i, " ".join(rng.choice(vocabulary_of[: 3 + i % 11]) for _ in range(50))) for i in range(120)]
    docs = odd.documents(spark, extra=("n", "form", "root")).unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    out = queries.op12_spelling_tiles(spark, write_tables(documents=docs))
    assert rows_of(out) == groups_by_hand(words_by_hand(odd.pairs(docs)))
