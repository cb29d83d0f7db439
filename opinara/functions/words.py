"""Words, n-grams and dictionary lookups inside a row: nothing here shuffles."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions.text import WORD_CHAR, bind


def words(text: Column, extra: str = "", shortest: int = 1) -> Column:
    """Lower-case word runs of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD_CHAR}{extra}]{{{shortest},}}"), F.lit(0))


def plain_words(text: Column, stop_words: Sequence[str]) -> Column:
    """Word runs made of three or more ASCII letters, stop words left out."""
    run = rf"(?<![{WORD_CHAR}])[a-z]{{3,}}(?![{WORD_CHAR}])"
    found = F.regexp_extract_all(F.lower(text), F.lit(run), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(list(stop_words))) if stop_words else found


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """All runs of ``low``..``high`` neighbouring tokens, joined by a space."""

    def of_size(ts: Column, n: int) -> Column:
        if n == 1:
            return ts
        joined = ts
        for shift in range(1, n):
            joined = F.zip_with(
                joined,
                F.slice(ts, F.lit(shift + 1), F.greatest(F.size(ts) - shift, F.lit(0))),
                lambda left, right: F.concat(left, F.lit(" "), right),
            )
        return F.slice(joined, F.lit(1), F.greatest(F.size(ts) - (n - 1), F.lit(0)))

    return bind(tokens, lambda ts: F.concat(*[of_size(ts, n) for n in range(low, high + 1)]))


def dictionary(entries: Mapping[str, float]) -> Callable[[Column], Column]:
    """Lookup ``token -> value`` (null when absent) in a dictionary that travels with the plan.

    Spark scans a map literal from its start, so the entries are spread over as many small maps as there are
    entries, and the token's checksum picks the one to look in.
    """
    slots = 1 << max(len(entries), 1).bit_length()
    table: list[dict[str, float]] = [{} for _ in range(slots)]
    for word, value in entries.items():
        table[zlib.crc32(word.encode()) % slots][word] = float(value)
    literal = F.from_json(F.lit(json.dumps(table, ensure_ascii=False)), "array<map<string,double>>")
    return lambda token: F.try_element_at(F.get(literal, (F.crc32(token) % slots).cast("int")), token)


def any_phrase(phrases: Sequence[str]) -> str:
    """Pattern that finds any of the phrases, not preceded or followed by more of a word."""

    def quoted(phrase: str) -> str:
        return re.sub(r"([^\w\s])", r"\\\1", phrase)

    def edge(char: str, before: bool) -> str:
        same, other = ("?<!", "?<=") if before else ("?!", "?=")
        return f"({same if re.match(r'\w', char) else other}[{WORD_CHAR}])"

    plain = [p for p in phrases if is_run_bound(p)]
    odd = [p for p in phrases if not is_run_bound(p)]
    parts = [edge(p[0], True) + quoted(p) + edge(p[-1], False) for p in odd]
    if plain:
        body = "|".join(quoted(p) for p in plain)
        parts.insert(0, f"(?<![{WORD_CHAR}])(?:{body})(?![{WORD_CHAR}])")
    return "|".join(parts)


RUNS = f"[{WORD_CHAR}]+|[^{WORD_CHAR}]+"  # words, and what stands between them


def word_stretches(lowered: Column, longest: int) -> Column:
    """The distinct stretches of one to ``longest`` words of a text, as written there, with what stands between the words."""

    def of(runs: Column) -> Column:
        size = F.size(runs)
        starts = F.filter(F.transform(runs, lambda r, at: F.when(r.rlike(f"^[{WORD_CHAR}]"), at)), lambda at: at.isNotNull())

        def at_place(at: Column) -> Column:
            ends = [F.when(at + 2 * n < size, F.array_join(F.slice(runs, at + 1, 2 * n + 1), "")) for n in range(1, longest)]
            return F.array(F.get(runs, at), *ends)

        return F.array_distinct(F.array_compact(F.flatten(F.transform(starts, at_place))))

    return bind(F.regexp_extract_all(lowered, F.lit(RUNS), F.lit(0)), of)


def stretch_rows(df: DataFrame, lowered: Column, longest: int, *keep: str) -> DataFrame:
    """(``keep``, stretch): the same as rows, as often as they occur. Nothing but the stretches is made of a text."""
    runs = df.select(*keep, F.regexp_extract_all(lowered, F.lit(RUNS), F.lit(0)).alias("runs"))
    later = [F.slice("runs", F.lit(1 + n), F.greatest(F.size("runs") - n, F.lit(0))) for n in range(2 * longest - 1)]
    at = runs.select(*keep, F.explode(F.arrays_zip(*later)).alias("at")).where(F.col("at").getField("0").rlike(f"^[{WORD_CHAR}]"))
    parts = [F.col("at").getField(str(n)) for n in range(2 * longest - 1)]
    # null where the text ends before
    return at.select(*keep, F.explode(F.array(*[F.concat(*parts[: 2 * n + 1]) for n in range(longest)])).alias("stretch")).where("stretch IS NOT NULL")


def is_run_bound(phrase: str) -> bool:
    """Whether a phrase starts and ends with a word character, so that it covers whole words where it is found."""
    return bool(re.fullmatch(r"\w(.*\w)?", phrase, re.S))


def phrases_found(lowered: Column, phrases: Mapping[str, Sequence[int]]) -> Column:
    """Numbers of all the phrases found in a lower-case text, each once, in order: one pass, however many phrases there are.

    The text is cut in runs of words and runs of what stands between them. Where a run is the first word of a phrase, the
    stretches that are as many words long as some phrase starting like that are looked up in a dictionary of all phrases.
    Phrases have to be run-bound and in lower case.
    """
    codes = sorted({tuple(sorted(numbers)) for numbers in phrases.values()})
    code_of = {numbers: i for i, numbers in enumerate(codes)}
    lookup = dictionary({p: code_of[tuple(sorted(numbers))] for p, numbers in phrases.items()})
    numbers_of = F.from_json(F.lit(json.dumps(codes)), "array<array<int>>")
    firsts: dict[int, set[str]] = {}
    for phrase in phrases:
        runs = re.findall(r"\w+|\W+", phrase)
        firsts.setdefault(len(runs), set()).add(runs[0])
    every_first = sorted(set().union(*firsts.values())) if firsts else []

    def of(runs: Column) -> Column:
        starts = F.filter(F.transform(runs, lambda r, at: F.when(r.isin(every_first), at)), lambda at: at.isNotNull())

        def at_place(at: Column) -> Column:
            first = F.get(runs, at)
            stretches = [
                F.when(first.isin(sorted(begin)), first if length == 1 else F.array_join(F.slice(runs, at + 1, length), ""))
                for length, begin in sorted(firsts.items())
            ]
            return F.transform(F.array_compact(F.array(*stretches)), lambda s: lookup(s).cast("int"))

        hits = F.array_distinct(F.array_compact(F.flatten(F.transform(starts, at_place))))
        return F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda c: F.get(numbers_of, c)))))

    if not phrases:
        return F.array().cast("array<int>")
    return bind(F.regexp_extract_all(lowered, F.lit(RUNS), F.lit(0)), of)


def row_digest(columns: Sequence[str], *more: Column) -> Column:
    """256-bit digest of a row's values, nulls told apart from texts."""
    whole = F.to_json(F.struct(*more, *[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})
    return F.sha2(whole, 256)
