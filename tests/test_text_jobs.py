import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from opinara import settings
from opinara.functions.words import any_phrase, stretch_rows, word_stretches
from opinara.operators import complaints, lookup, sentiment, terms


def frame(spark, rows):
    return spark.createDataFrame(rows, "review_id int, review_text string, sentiment_label string, business string")


# --- complaints ---------------------------------------------------------------------------------------------


def test_complaint_tags(spark):
    texts = [
        "çok yavaş.", "hizmetçi", "Slow SERVICE", "", None, "HİZMET", "uzun süre bekledik, pahalı", "parking lot far away",
        "güler yüzlü personel", "temizlik!", "No parking", "tat", "tatlı",
    ]
    df = frame(spark, [(i, t, "Negative", "b") for i, t in enumerate(texts)])
    got = {r["review_id"]: r["complaint_categories"] for r in complaints.tag(df).collect()}
    wanted = [['Waiting Time'], [], ['Waiting Time', 'Service'], [], [], [], ['Waiting Time', 'Price / Value'], ['Parking', 'Location / Access'], ['Service'], ['Cleanliness'], ['Parking'], ['Food Quality'], []]
    assert got == dict(enumerate(wanted))


def test_complaint_frequency_and_profile(spark):
    rows = [
        (1, "slow service", "Negative", "A"), (2, "slow", "Negative", "A"), (3, "dirty", "Positive", "A"),
        (4, "dirty", "Negative", "B"), (5, None, "Negative", "C"), (6, "nothing", "Negative", "D"),
    ]
    df = frame(spark, rows)
    got = [tuple(r) for r in complaints.frequency(df).collect()]
    assert got == [("Waiting Time", 2, 50.0), ("Cleanliness", 1, 25.0), ("Service", 1, 25.0)]
    everything = {r["category"]: r["count"] for r in complaints.frequency(df, label_column=None).collect()}
    assert everything["Cleanliness"] == 2
    assert {r["category"]: r["count"] for r in complaints.frequency(df.drop("sentiment_label")).collect()} == everything
    profile = {tuple(r) for r in complaints.business_profile(df, "review_text", "business", top_n=2).collect()}
    assert profile == {("A", "Waiting Time", 2), ("A", "Service", 1), ("B", "Cleanliness", 1)}
    keywords = complaints.keyword_rows(df).collect()
    assert sorted((r["review_id"], r["keyword"]) for r in keywords) == [
        ("1", "Service"), ("1", "Waiting Time"), ("2", "Waiting Time"), ("4", "Cleanliness"),
    ]
    assert len({r["keyword_id"] for r in keywords}) == 4
    assert complaints.frequency(df.where("false")).collect() == []


def test_tags_equal_a_search_for_every_phrase(spark):
    """Overlaps, repeats, other spaces between the words, marks at a phrase's edge, letters outside ASCII."""
    rng = random.Random(8)
    letters = ["a", "b", "ab", "ba", "é", "c++", "x_1", "7", "B"]
    texts = ["".join(rng.choice(letters) + rng.choice([" ", " ", "  ", "-", ", "]) for _ in range(rng.randrange(0, 25))) for _ in range(150)]
    names = {f"n{i}": [" ".join(rng.choice(letters) for _ in range(rng.randrange(1, 4))) for _ in range(3)] for i in range(9)}
    df = frame(spark, [(i, t, None, "b") for i, t in enumerate(texts)])
    got = {r.review_id: r.complaint_categories for r in complaints.tag(df, complaints=names).collect()}
    found = df.select("review_id", *[F.lower("review_text").rlike(any_phrase([p.lower() for p in ps])).alias(n) for n, ps in names.items()])
    assert got == {r.review_id: [n for n in names if r[n]] for r in found.collect()} and any(got.values())


def test_a_thousand_phrases(spark):
    texts = [" ".join(f"w{(i * j) % 997}" for j in range(1, 60)) for i in range(1, 40)]
    names = {f"c{i % 20}": [f"w{k} w{(k + i) % 997}" for k in range(i, 997, 20)] for i in range(20)}
    df = frame(spark, [(i, t, None, "b") for i, t in enumerate(texts)])
    got = {r.review_id: r.complaint_categories for r in complaints.tag(df, complaints=names).collect()}
    assert got == {i: [n for n, ps in names.items() if any(f" {p} " in f" {t} " for p in ps)] for i, t in enumerate(texts)}


@pytest.mark.parametrize("frequent", [10_000, 2, 1])
def test_phrase_table(spark, monkeypatch, frequent):
    monkeypatch.setattr(lookup, "FREQUENT", frequent)
    names = {"A": ["of the", "Soup"], "B": ["the", "x y z"], "C": ["of the", "x  y"], "none": ["absent"]}
    texts = ["the end of the SOUP", "of  the", "x y z", "x  y z", "", None, "other"] + ["the the the"] * 10
    df = frame(spark, [(i, t, None, "b") for i, t in enumerate(texts)]).repartition(3)
    phrases = spark.createDataFrame([(n, p) for n, ps in names.items() for p in ps] + [("A", "soup"), ("A", None), (None, "the")], "category string, phrase string")
    got = sorted(tuple(r) for r in complaints.mentions_by_table(df, phrases).collect())
    tagged = complaints.tag(df, complaints=names).collect()
    assert got == sorted((r.review_id, n) for r in tagged for n in r.complaint_categories)


# --- word counts and tf-idf ------------------------------------------------------------------------------------


def test_word_frequency(spark):
    df = frame(spark, [(1, "Food food GOOD the", "Positive", "b"), (2, "good bad don't", "Negative", "b"), (3, None, "Positive", "b")])
    assert [tuple(r) for r in terms.word_frequency(df).collect()] == [("food", 2), ("good", 2), ("bad", 1)]
    assert [tuple(r) for r in terms.word_frequency(df, max_words=1).collect()] == [("food", 2)]
    labelled = {tuple(r) for r in terms.word_frequency_by_label(df, max_words=1).collect()}
    assert labelled == {("Positive", "food", 2), ("Negative", "bad", 1)}


def test_theme_counts(spark):
    df = frame(spark, [(1, "good good slow", None, "b"), (2, "good", None, "b"), (3, None, None, "b")])
    got = {tuple(r) for r in terms.theme_counts(df).collect()}
    assert got == {("positive", "good", 3, 2), ("negative", "slow", 1, 1)}


def tfidf_by_hand(texts, top_n, max_features=5000, low=1, high=2):
    stops = set(settings.STOP_WORDS)
    docs = []
    for t in texts:
        tokens = [w for w in re.findall(r"\b\w\w+\b", t.lower()) if w not in stops]
        docs.append(Counter(" ".join(tokens[i : i + n]) for n in range(low, high + 1) for i in range(len(tokens) - n + 1)))
    df, total = Counter(), Counter()
    for d in docs:
        df.update(d.keys())
        total.update(d)
    vocabulary = sorted((t for t in df if df[t] >= 2), key=lambda t: (-total[t], t))[:max_features]
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in vocabulary}
    mean = Counter()
    for d in docs:
        w = {t: c * idf[t] for t, c in d.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        for t, x in w.items():
            mean[t] += x / norm / len(docs)
    best = sorted(mean, key=lambda t: (-round(mean[t], 12), t))[:top_n]
    return {t: round(mean[t], 6) for t in best}


@pytest.mark.parametrize("max_features", [5000, 12])
def test_tfidf(spark, max_features):
    rng = random.Random(5)
    vocabulary = ["soup", "bread", "çorba", "tea", "the", "warm", "cold", "rice_2", "x", "staff"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 15))) for _ in range(60)]
    df = frame(spark, [(i, t, "Positive" if i % 3 else "Negative", "b") for i, t in enumerate(texts)])
    got = terms.tfidf_keywords(df, top_n=15, max_features=max_features).collect()
    want = tfidf_by_hand(texts, 15, max_features)
    assert {r["keyword"]: r["tfidf_score"] for r in got} == pytest.approx(want, abs=2e-6)
    themes = terms.themes_by_label(df, top_n=5, max_features=max_features).collect()
    for label, keep in (("Positive", lambda i: i % 3), ("Negative", lambda i: not i % 3)):
        want = tfidf_by_hand([t for i, t in enumerate(texts) if keep(i)], 5, max_features)
        got = {r["keyword"]: r["tfidf_score"] for r in themes if r["sentiment"] == label}
        assert got == pytest.approx(want, abs=2e-6)


def test_tfidf_shuffles_texts_once(spark):
    """Terms are counted and vectors measured where their text is: no exchange by text and term."""
    rows = [(i, f"soup bread tea w{i % 3}", "Positive", "b") for i in range(20)]
    found = terms.tfidf_keywords(frame(spark, rows))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" in plan and not re.search(r"hashpartitioning\([^)]*id#[^)]*term", plan)


def test_tfidf_needs_two_texts(spark):
    df = frame(spark, [(1, "soup soup bread", "Positive", "b"), (2, None, "Positive", "b")])
    assert terms.tfidf_keywords(df).collect() == []
    assert terms.tfidf_keywords(df.where("false")).collect() == []


# --- sentiment ------------------------------------------------------------------------------------------------------


def score(spark, text, **dictionaries):
    row = sentiment.score_reviews(frame(spark, [(1, text, None, "b")]).drop("sentiment_label"), **dictionaries).first()
    return tuple(row[f"sentiment_{c}"] for c in ("compound", "positive", "neutral", "negative", "label"))


def compound(*valences):
    s = sum(valences)
    return round(s / math.sqrt(s * s + 15), 4)


def test_blank_texts_are_neutral(spark):
    for text in ("", "  ", " ", None, "..."):
        assert score(spark, text) == (0.0, 0.0, 1.0, 0.0, "Neutral")


def test_plain_and_mixed(spark):
    assert score(spark, "good") == (compound(2), 1.0, 0.0, 0.0, "Positive")
    assert score(spark, "Good soup, BAD tea") == (0.0, round(3 / 8, 4), round(2 / 8, 4), round(3 / 8, 4), "Neutral")


def test_boosters_and_negations(spark):
    assert score(spark, "very good")[0] == compound(2 + 0.293)
    assert score(spark, "very bad")[0] == compound(-2 - 0.293)
    assert score(spark, "slightly good")[0] == compound(2 - 0.293)
    assert score(spark, "very much so good")[0] == compound(2 + 0.293 + 0.293 * 0.9)
    assert score(spark, "not good")[0] == compound(2 * -0.74)
    assert score(spark, "not very good")[0] == compound((2 + 0.293) * -0.74)
    assert score(spark, "not a b c good")[0] == compound(2)
    assert score(spark, "didn't like good food")[4] == "Negative"


def test_own_dictionaries(spark):
    got = score(spark, "leziz değil ama hoş", lexicon={"leziz": 3.0, "hoş": 1.0}, negations=["değil"], boosters={})
    assert got[0] == compound(3.0, 1.0 * -0.74)


def test_as_written(spark):
    rules = sentiment.Rules()
    assert score(spark, "GOOD soup", rules=rules)[0] == compound(2.733)
    assert score(spark, "GOOD SOUP", rules=rules)[0] == compound(2)  # nothing stands out
    assert score(spark, "BAD soup", rules=rules)[0] == compound(-2.733)
    assert score(spark, "VERY good", rules=rules)[0] == compound(2 + 0.293 + 0.733)
    assert score(spark, "good!!", rules=rules)[0] == compound(2 + 2 * 0.292)
    assert score(spark, "bad!!!!!!", rules=rules)[0] == compound(-2 - 4 * 0.292)
    assert score(spark, "good?", rules=rules)[0] == compound(2)
    assert score(spark, "bad???", rules=rules)[0] == compound(-2 - 3 * 0.18)
    assert score(spark, "bad????", rules=rules)[0] == compound(-2 - 0.96)
    assert score(spark, "good but bad", rules=rules)[0] == compound(2 * 0.5, -2 * 1.5)
    assert score(spark, "Not good here today, BUT clean but slow", rules=rules)[0] == compound(-0.74 * 2 * 0.5, 2 * 1.5, -2 * 1.5)
    assert score(spark, "good soup!", rules=rules)[1:4] == (round((3 + 0.292) / (4 + 0.292), 4), round(1 / (4 + 0.292), 4), 0.0)
    assert score(spark, "GOOD soup!", rules=sentiment.PLAIN)[0] == compound(2)


WRITTEN = [
    "", None, "...", "good", "GOOD soup but BAD tea!!", "VERY good, NOT so bad???", "never truly slow!", "Fresh çorba AMA cold", "but", "a b c d e f",
    "good good good good", "the the the good the bad",
]


@pytest.mark.parametrize("frequent", [10_000, 3, 1])
@pytest.mark.parametrize("rules", [sentiment.Rules(), sentiment.PLAIN])
def test_lexicon_table_gives_the_same_as_the_dictionary(spark, monkeypatch, frequent, rules):
    """Whichever words count as frequent: all, some, hardly any; one word holds a third of all tokens."""
    monkeypatch.setattr(lookup, "FREQUENT", frequent)
    texts = [*WRITTEN, *["good " + "the " * 30] * 5]
    df = frame(spark, [(i, t, None, "b") for i, t in enumerate(texts)]).select("review_id", "review_text").repartition(3)
    lexicon = spark.createDataFrame(list(settings.LEXICON.items()), "token string, valence double")
    got = {tuple(r) for r in sentiment.score_with_lexicon(df, lexicon, rules=rules).collect()}
    want = {tuple(r) for r in sentiment.score_reviews(df, rules=rules).drop("review_text").collect()}
    assert got == want and len(got) == len(texts)


def test_lexicon_tables_of_any_kind(spark):
    df = frame(spark, [(1, "Good but odd", None, "b"), (2, "very", None, "b")]).select("review_id", "review_text")
    lexicon = spark.createDataFrame([("good", 1.0), ("GOOD", 3.0), ("odd", None), ("very", 9.0), ("unseen", 1.0)], "token string, valence double")
    got = {r.review_id: r.sentiment_compound for r in sentiment.score_with_lexicon(df, lexicon).collect()}
    assert got == {1: compound(2 * 0.5), 2: 0.0}  # several valences: their mean; a booster has none
    empty = {r.review_id: tuple(r)[1:] for r in sentiment.score_with_lexicon(df, lexicon.where("false")).collect()}
    assert empty == {1: (0.0, 0.0, 1.0, 0.0, "Neutral"), 2: (0.0, 0.0, 1.0, 0.0, "Neutral")}
    assert sentiment.score_with_lexicon(df.where("false"), lexicon).collect() == []


def test_learnt_lexicon(spark):
    rows = [(i, "Tasty soup soup", "Positive", "b") for i in range(6)] + [(9, "soup cold", "Negative", "b"), (10, "soup", "Neutral", "b")]
    found = {tuple(r) for r in sentiment.lexicon_from_labels(frame(spark, rows)).collect()}
    assert found == {("tasty", 4.0), ("soup", round(4 * 5 / 7, 3))}


def test_lexicon_job_moves_no_text(spark):
    """Tokens of frequent words meet the lexicon by broadcast; what is shuffled are tokens with their neighbours, and sums."""
    df = frame(spark, [(1, "good", None, "b")]).select("review_id", "review_text")
    lexicon = spark.range(10).selectExpr("concat('w', id) AS token", "1D AS valence")
    plan = sentiment.score_with_lexicon(df, lexicon)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan and "TakeOrderedAndProject" in plan
    assert "partial_sum" in plan and "PythonUDF" not in plan


def test_label_shares(spark):
    df = frame(spark, [(1, "", "Positive", ""), (2, "", "Negative", ""), (3, "", "Negative", "")])
    assert tuple(sentiment.label_shares(df).first()) == (33.3, 0.0, 66.7)
    assert tuple(sentiment.label_shares(df.where("false")).first()) == (None, None, None)


def test_attached_scores(spark):
    df = frame(spark, [(1, "good", "Negative", "b"), (2, "bad", "Negative", "b")])
    scored = sentiment.score_reviews(df.where("review_id = 1"))
    got = {r["review_id"]: r["sentiment_label"] for r in sentiment.attach_scores(df, scored).collect()}
    assert got == {1: "Positive", 2: None}


# --- many words -----------------------------------------------------------------------------------------------------


def test_theme_counts_make_a_row_per_word_and_text(spark):
    """Not one per occurrence, each with all the others: a text of n theme words was n rows of n words."""
    found = terms.theme_counts(frame(spark, [(1, "good slow good " * 7_000, None, "b"), (2, "good", None, "b")]))
    assert "posexplode" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {("positive", "good", 14_001, 2), ("negative", "slow", 7_000, 1)}


@pytest.mark.parametrize("max_features", [3, 20, 45])
def test_tfidf_counts_terms_of_frequent_words_only(spark, max_features):
    rng = random.Random(8)
    texts = [" ".join(f"w{min(int(rng.paretovariate(0.6)), 60)}" for _ in range(rng.randrange(0, 25))) for _ in range(40)]
    df = frame(spark, [(i, t, "Positive", "b") for i, t in enumerate(texts)])
    got = terms.tfidf_keywords(df, top_n=15, max_features=max_features)
    assert {r["keyword"]: r["tfidf_score"] for r in got.collect()} == pytest.approx(tfidf_by_hand(texts, 15, max_features), abs=2e-6)
    total, seen = Counter(w for t in texts for w in t.split()), Counter(w for t in texts for w in set(t.split()))
    counts = sorted((total[w] for w in seen if seen[w] > 1), reverse=True)
    starts = terms._starts(df.select(F.lit("all").alias("grp"), F.col("review_id").alias("id"), F.col("review_text").alias("body")), 2)
    held = {r["word"] for r in terms._candidates(starts, max_features).collect()}
    least = counts[max_features - 1] if len(counts) >= max_features else 0
    assert held == {w for w in seen if seen[w] > 1 and total[w] >= least} and (max_features > 20 or len(held) < len(counts))


@pytest.mark.parametrize("frequent", [0, 2, 100])
def test_look_up_leaves_other_words_out_before_the_shuffle(spark, monkeypatch, frequent):
    monkeypatch.setattr(lookup, "FREQUENT", frequent)
    rows = spark.createDataFrame([(i, f"w{i % 7}", "long") for i in range(50)] + [(99, None, "head"), (98, "none", "long")], "i int, word string, more string")
    entries = spark.createDataFrame([("w1", 1.0), ("w3", 3.0), ("w9", 9.0)], "word string, v double")
    found = lookup.look_up(rows, entries, "word", always=F.col("word").isNull(), slim=["i", F.length("more").alias("n")])
    assert found.columns == ["word", "i", "n", "v"]  # nothing else is shuffled
    want = {(f"w{i % 7}", i, 4, float(i % 7)) for i in range(50) if i % 7 in (1, 3)} | {(None, 99, 4, None)}
    assert {tuple(r) for r in found.collect()} == want
    assert lookup._possible(rows, entries.select(lookup._slot("word")), "word").count() == len(want) - 1


def test_stretches_as_rows(spark):
    texts = ["one two, three", "", "  a--b ", "x", None, "été 2_3!"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for longest in (1, 2, 3):
        want = df.select("i", F.explode(word_stretches(F.col("t"), longest)).alias("s"))
        assert {tuple(r) for r in stretch_rows(df, F.col("t"), longest, "i").collect()} == {tuple(r) for r in want.collect()}
