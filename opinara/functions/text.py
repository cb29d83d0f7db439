"""Text cleaning as column expressions.

White space is Unicode white space plus the four separator controls U+001C..U+001F, words are runs of
letters, digits and underscores of any script.
"""

from __future__ import annotations

import unicodedata
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara import settings

SPACE = r"[\s\x1c-\x1f]"
WORD_CHAR = r"\p{L}\p{N}_"
CASED = r"\p{Lu}\p{Ll}\p{Lt}"


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once per row, however often ``use`` mentions it."""
    return F.transform(F.array(value), use).getItem(0)


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(rf"(?U)[^\s\x1c-\x1f]")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", " ")


def straight_quotes(text: Column) -> Column:
    return F.translate(text, "‘’“”", "''\"\"")


@F.pandas_udf(T.StringType())
def _compose(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def compose(text: Column) -> Column:
    """Unicode NFC. Characters below U+0300 are in that form already, so only texts with others leave the
    JVM; the rest reach the Python worker as null."""
    candidate = F.when(text.rlike(r"[^\x{0}-\x{2FF}]"), text)
    return F.coalesce(_compose(candidate), text)


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"(?U){SPACE}+", " "))


def normalise(text: Column, unicode_form: bool = True) -> Column:
    """Tags out, quotes straightened, composed form, single spaces. May leave an empty text."""
    plain = straight_quotes(strip_html(text))
    return collapse_spaces(compose(plain) if unicode_form else plain)


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of cased letters, lower-case the others.

    A letter whose capital is written with two letters, like the German sharp s, keeps one of them small.
    """
    runs = F.split(text, f"(?<=[^{CASED}])|(?=[^{CASED}])")

    def titled(run: Column) -> Column:
        capital = F.upper(F.substring(run, 1, 1))
        return F.concat(
            F.substring(capital, 1, 1), F.lower(F.substring(capital, 2, 9)), F.lower(F.substring(run, 2, 1 << 30))
        )

    return F.array_join(F.transform(runs, titled), "")


def standard_city(city: Column, aliases: dict[str, str] | None = None) -> Column:
    """Known spelling, else title case; ``Unknown`` for a missing or blank name."""
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable((aliases or settings.CITY_ALIASES).items())])
    name = strip(city)
    return F.when(is_blank(city), settings.UNKNOWN).otherwise(
        F.coalesce(F.try_element_at(known, F.lower(name)), title_case(name))
    )
