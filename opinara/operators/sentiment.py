"""Dictionary sentiment after a published method (Hutto & Gilbert, 2014), with dictionaries supplied by the caller.

A token's valence is taken from the dictionary; a booster among the three tokens before it moves the valence
away from zero (or towards it), less the further away it stands; a negation among them turns and damps it. The
compound score squeezes the sum S into (-1, 1) as S / sqrt(S^2 + 15), and the three shares weigh positive,
negative and neutral tokens. ``Rules`` adds what needs the text as written: capitals, marks, and words like "but".

:func:`score_reviews` has small dictionaries in the plan and computes everything inside the row: scoring is a projection.
:func:`score_with_lexicon` takes a lexicon table of any size: token positions are joined with it.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara import settings
from opinara.functions.numbers import flag, percent, sentiment_label
from opinara.functions.text import WORD_CHAR, bind
from opinara.functions.words import dictionary, words
from opinara.operators.lookup import look_up

#: Sums of the table job are whole numbers of this part of a point: they don't depend on the order of adding.
UNIT = 1e-9


@dataclass(frozen=True)
class Rules:
    """What the written form of a text adds; zero or empty switches a rule off.

    ``capitals``: a word in capitals, in a text that also has others, gains so much; so does a booster. ``exclamation``
    and ``question``: exclamation marks, four at most, move the sum away from zero, and so do two or three question
    marks; more count as ``questions``. ``pivots``: what stands before the first of these words weighs ``before``, what
    follows it ``after``.
    """

    capitals: float = 0.733
    exclamation: float = 0.292
    question: float = 0.18
    questions: float = 0.96
    pivots: Sequence[str] = ("but",)
    before: float = 0.5
    after: float = 1.5


PLAIN = Rules(capitals=0.0, exclamation=0.0, question=0.0, questions=0.0, pivots=())


def _shouted(word: Column) -> Column:
    return (word == F.upper(word)) & (word != F.lower(word))


def _is_mixed(tokens: Column, rules: Rules) -> Column:
    """Whether some words are in capitals and others aren't."""
    if not rules.capitals:
        return F.lit(False)
    return F.exists(tokens, _shouted) & F.exists(tokens, lambda w: ~_shouted(w))


def _pivot(tokens: Column, rules: Rules) -> Column:
    """Place of the first pivot, null if there is none."""
    if not rules.pivots:
        return F.lit(None).cast("int")
    places = F.transform(tokens, lambda w, at: F.when(F.lower(w).isin(list(rules.pivots)), at))
    return F.array_min(places)


def _marks(text: Column, rules: Rules) -> Column:
    """How far exclamation and question marks move the sum from zero."""
    if not (rules.exclamation or rules.question or rules.questions):
        return F.lit(0.0)
    exclamations, asked = F.regexp_count(text, F.lit("!")), F.regexp_count(text, F.lit(r"\?"))
    question = F.when(asked < 2, 0.0).when(asked <= 3, asked * rules.question).otherwise(rules.questions)
    return F.least(exclamations, F.lit(4)) * F.lit(rules.exclamation) + question


def _context(
    word: Column, earlier: Sequence[Column], mixed: Column, at: Column, pivot: Column, boost_of, turned: list[str], rules: Rules
) -> tuple[Column, Column]:
    """By how much the words around a word move its valence from zero, and the factor; ``earlier`` are the words before it, nearest first."""
    zero, lowered = F.lit(0.0), [F.lower(w) if rules.capitals else w for w in earlier]

    def loud(w: Column) -> Column:
        return F.when(mixed & _shouted(w), rules.capitals).otherwise(0.0) if rules.capitals else zero

    moved = loud(word)
    is_negated = F.lit(False)
    for w, low, decay in zip(earlier, lowered, settings.BOOST_DECAY, strict=True):
        moved = moved + F.coalesce((boost_of(low) + loud(w)) * decay, zero)
        is_negated = is_negated | F.coalesce(low.isin(turned), F.lit(False))
    factor = F.when(is_negated, settings.NEGATION_FACTOR).otherwise(1.0)
    if rules.pivots:
        factor = factor * F.when(at < pivot, rules.before).when(at > pivot, rules.after).otherwise(1.0)
    return moved, factor


def _adjusted(valence: Column, moved: Column, factor: Column) -> Column:
    """Valence of a word of the lexicon among its neighbours."""
    return bind(valence, lambda v: v + F.signum(v) * moved) * factor


def _shares(sums: Column, empty: Column) -> Column:
    """``struct<compound, positive, neutral, negative>`` out of ``struct<up, down, whole, neutral, marks>`` of a text."""

    def moved(x: Column) -> Column:
        return F.struct(
            (x["whole"] + F.signum(x["whole"]) * x["marks"]).alias("total"), x["neutral"].alias("neutral"),
            (x["up"] + F.when(x["up"] > x["down"], x["marks"]).otherwise(0.0)).alias("up"),
            (x["down"] + F.when(x["down"] > x["up"], x["marks"]).otherwise(0.0)).alias("down"),
        )

    def of(x: Column) -> Column:
        weight = x["up"] + x["down"] + x["neutral"]
        return F.struct(
            F.when(empty, 0.0).otherwise(F.round(x["total"] / F.sqrt(x["total"] * x["total"] + settings.COMPOUND_ALPHA), 4)).alias("compound"),
            F.when(empty, 0.0).otherwise(F.round(F.try_divide(x["up"], weight), 4)).alias("positive"),
            F.when(empty, 1.0).otherwise(F.round(F.try_divide(x["neutral"], weight), 4)).alias("neutral"),
            F.when(empty, 0.0).otherwise(F.round(F.try_divide(x["down"], weight), 4)).alias("negative"),
        )

    return bind(bind(sums, moved), of)


def _tokens(text: Column, rules: Rules) -> Column:
    """Words as written where capitals count, else in lower case."""
    if rules.capitals:
        return F.regexp_extract_all(text, F.lit(f"[{WORD_CHAR}']+"), F.lit(0))
    return words(text, extra="'")


def scores(
    text: Column,
    lexicon: Mapping[str, float] | None = None,
    boosters: Mapping[str, float] | None = None,
    negations: Collection[str] | None = None,
    rules: Rules = PLAIN,
) -> Column:
    """``struct<compound, positive, neutral, negative>`` of a text, each with four decimals.

    Only tokens of the lexicon are looked at with their neighbours.
    """
    boosters = settings.BOOSTERS if boosters is None else boosters
    entries = {w: v for w, v in (settings.LEXICON if lexicon is None else lexicon).items() if w not in boosters and v}
    valence_of, boost_of = dictionary(entries), dictionary(boosters)
    turned = list(settings.NEGATIONS if negations is None else negations)
    text = F.coalesce(text, F.lit(""))

    def lowered(word: Column) -> Column:
        return F.lower(word) if rules.capitals else word

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)

    def of_tokens(found: Column) -> Column:
        tokens, mixed, pivot = found["tokens"], found["mixed"], found["pivot"]
        places = F.filter(F.transform(tokens, lambda w, at: F.when(lowered(w).isin(list(entries)), at)), lambda at: at.isNotNull())

        def value(at: Column) -> Column:
            word = F.get(tokens, at)
            earlier = [F.get(tokens, at - back) for back in range(1, len(settings.BOOST_DECAY) + 1)]
            return _adjusted(valence_of(lowered(word)), *_context(word, earlier, mixed, at, pivot, boost_of, turned, rules))

        def of_values(values: Column) -> Column:
            sums = F.struct(
                total(F.transform(F.filter(values, lambda v: v > 0), lambda v: v + 1)).alias("up"),
                total(F.transform(F.filter(values, lambda v: v < 0), lambda v: 1 - v)).alias("down"),
                total(values).alias("whole"), (F.size(tokens) - F.size(F.filter(values, lambda v: v != 0))).alias("neutral"),
                _marks(text, rules).alias("marks"),
            )
            return _shares(sums, F.size(tokens) <= 0)

        return bind(F.transform(places, value), of_values)

    def with_facts(tokens: Column) -> Column:
        return F.struct(tokens.alias("tokens"), _is_mixed(tokens, rules).alias("mixed"), _pivot(tokens, rules).alias("pivot"))

    return bind(bind(_tokens(text, rules), with_facts), of_tokens)


def _with_scores(df: DataFrame, found: Column) -> DataFrame:
    """Adds the four scores and the label."""
    scored = df.withColumn("_scores", found)
    compound = F.col("_scores.compound")
    return scored.withColumns(
        {
            "sentiment_compound": compound,
            "sentiment_positive": F.col("_scores.positive"),
            "sentiment_neutral": F.col("_scores.neutral"),
            "sentiment_negative": F.col("_scores.negative"),
            "sentiment_label": sentiment_label(compound),
        }
    ).drop("_scores")


def score_reviews(df: DataFrame, text_column: str = "review_text", **options) -> DataFrame:
    """Adds the four scores and the label; ``options`` as for :func:`scores`."""
    return _with_scores(df, scores(F.col(text_column), **options))


def _positions(df: DataFrame, key: str, text_column: str, rules: Rules) -> DataFrame:
    """One row per token with the three before it, and one per text (``at`` -1) with its number of tokens and its marks."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    back = [f"w{i}" for i in range(1, len(settings.BOOST_DECAY) + 1)]
    facts = bind(
        _tokens(text, rules),
        lambda tokens: F.struct(
            F.size(tokens).alias("n"), _is_mixed(tokens, rules).alias("mixed"), _pivot(tokens, rules).alias("pivot"), tokens.alias("tokens")
        ),
    )
    whole = df.select(F.col(key), _marks(text, rules).alias("marks"), facts.alias("facts")).select(key, "marks", "facts.*")
    # each list begins one place later, so the zipped ones have a place behind the last token: it stands for the text
    none = F.lit(None).cast("string")
    shifted = [F.concat(F.array(*[none] * i), F.col("tokens")) for i in range(1, len(back) + 1)]
    rows = whole.select(key, "marks", "n", "mixed", "pivot", F.posexplode(F.arrays_zip("tokens", *shifted)).alias("at", "place"))
    names = zip(["tokens", *map(str, range(1, len(back) + 1))], ["word", *back], strict=True)
    rows = rows.where("at <= n").select(key, "marks", "n", "mixed", "pivot", F.when(F.col("at") < F.col("n"), F.col("at")).otherwise(-1).alias("at"), *[F.col("place").getField(f).alias(n) for f, n in names])
    return rows.withColumn("token", F.lower("word"))


def score_with_lexicon(
    df: DataFrame, lexicon: DataFrame, key: str = "review_id", text_column: str = "review_text",
    boosters: Mapping[str, float] | None = None, negations: Collection[str] | None = None, rules: Rules = Rules(),
) -> DataFrame:
    """(key, four scores, label) per text, by a ``lexicon`` table (token, valence) of any size.

    ``key`` tells the texts apart. A token that the lexicon has several times has its mean valence. Tokens
    meet the lexicon by :func:`look_up`, so the words of every text don't gather in a few tasks; what neighbours do to a token
    is two numbers before anything is shuffled. Sums are of whole units, per text on the map side first.
    """
    boosters = settings.BOOSTERS if boosters is None else boosters
    turned = list(settings.NEGATIONS if negations is None else negations)
    entries = lexicon.select(F.lower("token").alias("token"), F.col("valence").cast("double").alias("valence")).where("valence IS NOT NULL")
    entries = entries.groupBy("token").agg(F.avg("valence").alias("valence"))
    if boosters:
        entries = entries.where(~F.col("token").isin(list(boosters)))
    positions = _positions(df, key, text_column, rules)
    counted = df.select(F.explode(_tokens(F.col(text_column), rules)).alias("token")).select(F.lower("token").alias("token"))
    earlier = [F.col(f"w{i}") for i in range(1, len(settings.BOOST_DECAY) + 1)]
    moved, factor = _context(F.col("word"), earlier, F.col("mixed"), F.col("at"), F.col("pivot"), dictionary(boosters), turned, rules)
    of_text = F.col("at") < 0
    slim = [key, moved.alias("moved"), factor.alias("factor"), *[F.when(of_text, F.col(c)).alias(c) for c in ("marks", "n")]]
    found = look_up(positions, entries, "token", counted, always=of_text, slim=slim)
    units = F.when(F.col("n").isNull(), F.round(_adjusted(F.col("valence"), F.col("moved"), F.col("factor")) / UNIT).cast("bigint"))
    found = found.select(key, "marks", "n", units.alias("v"))

    def summed(kept: Column, v: Column) -> Column:
        return F.coalesce(F.sum(F.when(kept, v)), F.lit(0)) * UNIT

    v, one = F.col("v"), round(1 / UNIT)
    sums = found.groupBy(key).agg(
        F.max("marks").alias("marks"), F.max("n").alias("n"), F.sum(flag(v != 0)).alias("hits"),
        summed(v > 0, v + one).alias("up"), summed(v < 0, one - v).alias("down"), summed(v != 0, v).alias("whole"),
    )
    parts = F.struct("up", "down", "whole", (F.col("n") - F.col("hits")).alias("neutral"), "marks")
    return _with_scores(sums, _shares(parts, F.col("n") <= 0)).select(key, *SCORE_COLUMNS)


def lexicon_from_labels(
    df: DataFrame, text_column: str = "review_text", label_column: str = "sentiment_label", min_texts: int = 5, scale: float = 4.0
) -> DataFrame:
    """A lexicon (token, valence) learnt from labelled texts: by how much a word's positive texts outnumber its negative
    ones, as a share of both, times ``scale``. Words of fewer than ``min_texts`` labelled texts, and even ones, are left out.
    """
    labelled = df.where(F.col(label_column).isin(settings.POSITIVE, settings.NEGATIVE))
    seen = labelled.select(F.col(label_column).alias("label"), F.explode(F.array_distinct(words(F.col(text_column), extra="'"))).alias("token"))
    counts = seen.groupBy("token").agg(
        F.sum(flag(F.col("label") == settings.POSITIVE)).alias("good"), F.sum(flag(F.col("label") == settings.NEGATIVE)).alias("bad")
    )
    valence = F.round(F.lit(scale) * (F.col("good") - F.col("bad")) / (F.col("good") + F.col("bad")), 3)
    return counts.where(F.col("good") + F.col("bad") >= min_texts).select("token", valence.alias("valence")).where("valence != 0")


SCORE_COLUMNS = [
    "sentiment_compound", "sentiment_positive", "sentiment_neutral", "sentiment_negative", "sentiment_label",
]


def attach_scores(reviews: DataFrame, scored: DataFrame, key: str = "review_id") -> DataFrame:
    """Reviews with scores computed elsewhere, matched by key; a review without a score gets none.

    For scores of :func:`score_reviews` this join is not needed: they are columns of the reviews already. Where both
    sides are tables of ``warehouse.write_keyed`` neither is shuffled.
    """
    plain = reviews.drop(*SCORE_COLUMNS)
    return plain.join(scored.select(key, *SCORE_COLUMNS), key, "left")


def label_shares(df: DataFrame, digits: int = 1) -> DataFrame:
    """Share of each label in percent of all rows, as one row."""
    labels = {"positive_pct": settings.POSITIVE, "neutral_pct": settings.NEUTRAL, "negative_pct": settings.NEGATIVE}
    return df.agg(
        *[
            percent(F.count(F.when(F.col("sentiment_label") == label, 1)), F.count("*"), digits).alias(name)
            for name, label in labels.items()
        ]
    )
