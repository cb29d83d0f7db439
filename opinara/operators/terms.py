"""Word counts and weighted terms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara import settings
from opinara.functions.text import bind
from opinara.functions.words import plain_words, words
from opinara.operators.ranking import top_k

def word_frequency(
    df: DataFrame, text_column: str = "review_text", max_words: int = settings.WORD_LIST_SIZE,
    stop_words: Sequence[str] | None = None,
) -> DataFrame:
    """The most frequent words of all texts; equal counts go by the alphabet."""
    stops = settings.STOP_WORDS if stop_words is None else stop_words
    found = df.select(F.explode(plain_words(F.col(text_column), stops)).alias("word"))
    return found.groupBy("word").agg(F.count("*").alias("freq")).orderBy(F.desc("freq"), "word").limit(max_words)


def word_frequency_by_label(
    df: DataFrame, text_column: str = "review_text", label_column: str = "sentiment_label",
    max_words: int = settings.WORD_LIST_SIZE, stop_words: Sequence[str] | None = None,
    labels: Sequence[str] = (settings.POSITIVE, settings.NEGATIVE),
) -> DataFrame:
    """The same per label."""
    stops = settings.STOP_WORDS if stop_words is None else stop_words
    label = F.col(label_column).alias("sentiment")
    found = df.where(F.col(label_column).isin(list(labels))).select(
        label, F.explode(plain_words(F.col(text_column), stops)).alias("word")
    )
    counts = found.groupBy("sentiment", "word").agg(F.count("*").alias("freq"))
    return top_k(counts, "sentiment", "freq", "word", max_words)


def theme_counts(
    df: DataFrame, text_column: str = "review_text", positive: Sequence[str] | None = None,
    negative: Sequence[str] | None = None,
) -> DataFrame:
    """How often each theme word occurs, and in how many reviews."""
    themes = {"positive": positive or settings.POSITIVE_THEMES, "negative": negative or settings.NEGATIVE_THEMES}
    wanted = sorted({w for ws in themes.values() for w in ws})
    hits = F.filter(words(F.col(text_column)), lambda w: w.isin(wanted))

    def counted(found: Column) -> Column:
        """(term, n) per theme word of a text: a pass over the hits for each, and a row for each, however long the text."""
        return F.transform(
            F.array_distinct(found), lambda w: F.struct(w.alias("term"), (F.size(found) - F.size(F.array_remove(found, w))).alias("n"))
        )

    rows = df.select(F.explode(bind(hits, counted)).alias("hit")).select("hit.*")
    found = rows.groupBy("term").agg(F.sum("n").alias("total"), F.count("*").alias("df"))
    sides = [F.when(F.col("term").isin(list(ws)), F.lit(name)) for name, ws in themes.items()]
    return found.select(
        F.explode(F.array_compact(F.array(*sides))).alias("theme"), F.col("term").alias("word"),
        F.col("total").alias("mentions"), F.col("df").alias("reviews"),
    )


#: Parts of a group that are ranked on their own; the group's ranking sees ``max_features`` terms of each.
PARTS = 64


def _starts(texts: DataFrame, high: int) -> DataFrame:
    """A row per word of ``texts`` (grp, id, body), the words joined by a space: (grp, id, w0, w1, ...), null behind the last word."""
    listed = texts.where("body != ''").select("grp", "id", F.split("body", " ").alias("ws"))
    later = [F.slice("ws", F.lit(1 + n), F.greatest(F.size("ws") - n, F.lit(0))) for n in range(high)]
    found = listed.select("grp", "id", F.explode(F.arrays_zip(*later)).alias("w"))
    return found.select("grp", "id", *[F.col("w").getField(str(n)).alias(f"w{n}") for n in range(high)])


def _candidates(starts: DataFrame, max_features: int) -> DataFrame:
    """(grp, word) that terms of the vocabulary are made of: ``max_features`` words of two or more texts are as frequent as these
    or more so, hence so is the vocabulary, and no term is more frequent than its words. All words of two or more texts if
    there are fewer."""
    text = F.xxhash64("id")
    words_seen = starts.groupBy("grp", "w0").agg(F.count("*").alias("total"), F.min(text).alias("least"), F.max(text).alias("most"))
    frequent = words_seen.where("least != most")
    above = F.sum("words").over(Window.partitionBy("grp").orderBy(F.desc("total")))
    levels = frequent.groupBy("grp", "total").agg(F.count("*").alias("words")).withColumn("above", above)
    floors = levels.where(F.col("above") >= max_features).groupBy("grp").agg(F.max("total").alias("floor"))
    held = frequent.join(F.broadcast(floors), "grp", "left").where(F.col("total") >= F.coalesce("floor", F.lit(0)))
    return held.select("grp", F.col("w0").alias("word"))


def _weighted(
    docs: DataFrame, id_column: str, text_column: str, group: Column, top_n: int, max_features: int,
    sizes: tuple[int, int], stop_words: Sequence[str],
) -> DataFrame:
    """Mean normalised tf-idf per term and group: smooth idf, terms in two or more texts, the ``max_features``
    most frequent of them, unit vectors, mean over all texts of the group.

    The texts' words are shuffled once, by id, and read three times: for the words' counts, which leave about ``max_features``
    candidates per group (broadcast); for the terms made of candidates, which are counted per text; and for the weights of the
    vocabulary (broadcast). What else is shuffled are partial sums per word and per term of candidates.
    """
    low, high = sizes
    tokens = F.filter(words(F.col(text_column), shortest=2), lambda w: ~w.isin(list(stop_words)))
    texts = docs.where(F.col(text_column).isNotNull()).select(
        group.alias("grp"), F.col(id_column).alias("id"), F.array_join(tokens, " ").alias("body")
    )
    texts = texts.repartition("id")
    rows = starts = _starts(texts, high)
    places = [f"w{n}" for n in range(high)]
    whole = [F.col(p).isNotNull() for p in places]
    if low == 1:
        held = F.broadcast(_candidates(starts, max_features))
        for n, place in enumerate(places):
            rows = rows.join(held.select("grp", F.col("word").alias(place), F.lit(True).alias(f"held{n}")), ["grp", place], "left" if n else "inner")
        whole = [F.col(f"held{n}").isNotNull() for n in range(high)]
    grams = [F.when(reduce(Column.__and__, whole[:n]), F.concat_ws(" ", *places[:n])) for n in range(low, high + 1)]
    terms = rows.select("grp", "id", F.explode(F.array(*grams)).alias("term")).where("term IS NOT NULL")
    counts = terms.groupBy("grp", "id", "term").agg(F.count("*").alias("tf"))
    seen = counts.groupBy("grp", "term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).where("df >= 2")
    best_first = (F.desc("total"), "term")
    part = Window.partitionBy("grp", F.pmod(F.xxhash64("term"), F.lit(PARTS))).orderBy(*best_first)
    for window in (part, Window.partitionBy("grp").orderBy(*best_first)):
        seen = seen.withColumn("place", F.row_number().over(window)).where(F.col("place") <= max_features)
    size = F.broadcast(texts.groupBy("grp").agg(F.count("*").alias("n")).where("n >= 2"))  # one row per group
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    vocabulary = seen.join(size, "grp").select("grp", "term", "n", idf.alias("idf"))
    weights = terms.join(F.broadcast(vocabulary), ["grp", "term"]).groupBy("grp", "id", "term").agg(
        (F.count("*") * F.max("idf")).alias("w"), F.max("n").alias("n")
    )
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    scores = (
        weights.select("grp", "term", "n", (F.col("w") / norm).alias("w"))
        .groupBy("grp", "term")
        .agg((F.sum("w") / F.max("n")).alias("score"))
        .withColumn("score", F.round("score", 12))
    )
    order = Window.partitionBy("grp").orderBy(F.desc("score"), "term")  # of a vocabulary, max_features rows
    best = scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_n)
    return best.select("grp", F.col("term").alias("keyword"), F.round("score", 6).alias("tfidf_score"))


def tfidf_keywords(
    df: DataFrame, id_column: str = "review_id", text_column: str = "review_text", top_n: int = 20,
    max_features: int = 5000, ngram_range: tuple[int, int] = (1, 2), stop_words: Sequence[str] | None = None,
) -> DataFrame:
    """The terms with the highest mean weight over all texts; none when there are fewer than two texts."""
    stops = settings.STOP_WORDS if stop_words is None else stop_words
    everything = F.left(F.concat(F.lit("all"), F.col(text_column)), F.lit(3))  # one group, which joins by group can hash
    found = _weighted(df, id_column, text_column, everything, top_n, max_features, ngram_range, stops)
    return found.select("keyword", "tfidf_score").orderBy(F.desc("tfidf_score"), "keyword")


def themes_by_label(
    df: DataFrame, id_column: str = "review_id", text_column: str = "review_text",
    label_column: str = "sentiment_label", top_n: int = 20, max_features: int = 5000,
    ngram_range: tuple[int, int] = (1, 2), stop_words: Sequence[str] | None = None,
    labels: Sequence[str] = (settings.POSITIVE, settings.NEGATIVE),
) -> DataFrame:
    """The same per label, every statistic being taken within the label."""
    stops = settings.STOP_WORDS if stop_words is None else stop_words
    chosen = df.where(F.col(label_column).isin(list(labels)))
    found = _weighted(chosen, id_column, text_column, F.col(label_column), top_n, max_features, ngram_range, stops)
    return found.select("keyword", "tfidf_score", F.col("grp").alias("sentiment"))
