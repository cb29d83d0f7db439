import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from opinara import settings
from opinara.functions import dates, numbers, text, words

V = None  # the column under test; needs a running session


@pytest.fixture(autouse=True)
def _value_column(spark):
    global V
    V = F.col("v")


SAMPLES = [
    "a<br>b", "<p></p>", "‘x’ “y”", "été", "  two \t\n lines here now ", "\x1cfield\x1f", "", "a < b > c",
    "İSTANBUL'da", "straße <i>ß</i>", "x​y",
]


CLEANED = ['a b', '', '\'x\' "y"', 'été', 'two lines here now', 'field', '', 'a c', "İSTANBUL'da", 'straße ß', 'x\u200by']


def test_normalise(column):
    assert column(SAMPLES, text.normalise(V)) == CLEANED


def test_blank(column):
    values = ["", "  ", "\t\n", " ", " \x1c", None, ".", " a "]
    assert column(values, text.is_blank(V)) == [True, True, True, True, True, True, False, False]


def test_city(column):
    values = [
        "nyc", " Bombay ", "o'fallon st-john", "", None, "İstanbul", "IZMIR", "3rd ave", "ŞİŞLİ", "straße", "ßen", " la\t",
        "washington DC", "new  york", "中a b",
    ]
    wanted = ['New York City', 'Mumbai', "O'Fallon St-John", 'Unknown', 'Unknown', 'İstanbul', 'Izmir', '3Rd Ave', 'Şi̇şli̇', 'Straße', 'Ssen', 'Los Angeles', 'Washington D.C.', 'New  York', '中A B']
    assert column(values, text.standard_city(V)) == wanted


def test_ratings(column):
    values = ["4", "0.5", "6", "abc", None, "NaN", "5.0", "1"]
    assert column(values, numbers.is_valid_rating(V)) == [True, False, False, False, False, False, True, True]
    assert column(["4", "x", None], numbers.to_number(V)) == [4.0, None, None]


def test_label_limits(column):
    got = column([0.05, 0.0499, -0.05, -0.0499], numbers.sentiment_label(V), "double")
    assert got == ["Positive", "Neutral", "Negative", "Neutral"]


def test_rating_bands(column):
    got = column([0.0, 1.99, 2.0, 3.49, 3.5, 5.0, None, 5.1], numbers.rating_band(V), "double")
    assert got == ["low", "low", "medium", "medium", "high", "high", None, None]


def test_written_dates(column):
    day = dt.date(2024, 3, 5)
    values = [
        "2024-03-05", "2024-03-05 10:11:12", "2024-03-05T01:30:00+05:00", "2024/3/5", "03/05/2024", "25/12/2024",
        "5 Mar 2024", "5 March 2024", "March 5, 2024", "Mar 5, 2024", "20240305", "2 hafta önce", "", None, "2024-13-45",
        "03/05/2024 23:59",
    ]
    wanted = [day] * 5 + [dt.date(2024, 12, 25)] + [day] * 5 + [None] * 4 + [day]
    assert column(values, dates.parse_date(V)) == wanted


def test_epoch_dates(column):
    day, first = dt.date(2023, 11, 14), dt.date(1970, 1, 1)
    values = ["1700000000000", "1700000000", "1.7e9", "-5", "17", "20240305", "99999999", "1e19", "Infinity", "NaN", "1700000000d", None]
    assert column(values, dates.parse_date(V)) == [day, day, day, dt.date(1969, 12, 31), first, dt.date(2024, 3, 5), first] + [None] * 5
    assert column(["1700000000000", "1e30"], dates.parse_date(V, "ms")) == [day, None]
    assert column([1700000000, 17], dates.parse_date(V), "bigint") == [day, first]
    assert column(["12:30:00", "T12:30", "2024-03-05T12:30"], dates.parse_date(V)) == [None, None, dt.date(2024, 3, 5)]


def test_order_of_day_and_month(column):
    values = ["03/04/2024", "25/12/2024", "12-25-2024"]
    assert column(values, dates.parse_date(V)) == [dt.date(2024, 3, 4), dt.date(2024, 12, 25), dt.date(2024, 12, 25)]
    assert column(values, dates.parse_date(V, day_first=True)) == [dt.date(2024, 4, 3), dt.date(2024, 12, 25), dt.date(2024, 12, 25)]


def test_numbers_have_the_shape_of_numbers(column):
    values = ["5d", "4f", "0x1p1", "4L", " 4.50 ", ".5", "5.", "-1e-1", "+3", "1e", "e1", "4 5", "NaN", ""]
    assert column(values, numbers.to_number(V)) == [None] * 4 + [4.5, 0.5, 5.0, -0.1, 3.0] + [None] * 5


def test_words(column):
    values = ["yavaş güzel food Cafe2 good", "It's a_b 12 naïve", "", None]
    plain = column(values, words.plain_words(V, []))
    assert plain == [["food", "good"], [], [], None]
    assert column(values[:2], words.words(V)) == [re.findall(r"\w+", v.lower()) for v in values[:2]]


def test_ngrams(column):
    got = column(["a b a b", "x", ""], words.ngrams(words.words(V), 1, 2))
    assert got == [["a", "b", "a", "b", "a b", "b a", "a b"], ["x"], []]
    got = column(["a b c d"], words.ngrams(words.words(V), 2, 3))
    assert got == [["a b", "b c", "c d", "a b c", "b c d"]]


def test_dictionary_lookup(column):
    entries = {f"wörd{i}": float(i) for i in range(500)}
    got = column(["wörd0", "wörd499", "word1", None, ""], words.dictionary(entries)(V))
    assert got == [0.0, 499.0, None, None, None]
    assert column(["a"], words.dictionary({})(V)) == [None]


def test_phrases(column):
    texts = ["wait", "waiting", "a wait.", "hizmetçi", "hizmet!", "c++", "c++x", "a.b", "axb", "no parking here", "_wait"]
    phrases = ["wait", "hizmet", "a.b", "no parking"]
    wanted = [True, False, True, False, True, False, False, True, False, True, False]
    assert column(texts, V.rlike(words.any_phrase(phrases))) == wanted
    assert column(["c++x", "c++", "c++ "], V.rlike(words.any_phrase(["c++"]))) == [True, False, False]
