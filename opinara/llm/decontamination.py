"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document: a stored row holds, for a run of documents, the positions of every benchmark term,
sorted by term. Documents never move; a benchmark window is looked up in each row by intersecting offset-adjusted lists,
beginning with the term that is rarest in the whole corpus. Exact phrases need each term at its own place; proximity
matches need all terms within a span around the rarest.

The benchmark is the query set and is broadcast in parts of at most ``PART_WORDS`` words, so any number of items is
handled, one part after the other, with an index of the part's terms.

Defined cases: a null text has no words and gives 0 hits; an item without words occurs nowhere. A document is told apart
by its id and text together, so repeated rows get the same result, once per row; null ids are ids of their own. Other
columns are ignored. Without documents the result is empty, without items nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.shared import by_batch, stored, utf8

#: Benchmark words handled at once: bounds the broadcast to about 100 MB.
PART_WORDS = 1_000_000
#: Candidate places tested at once in a task.
PLACES = 1 << 21

_WORD_BYTES = bytes(
    b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits, A-Z lower-cased, and of everything beyond ASCII."""
    return text.translate(_WORD_BYTES).split()


@dataclass
class Part:
    """Windows of a part of the benchmark. Windows with equal words are one; ``items`` lists who has them."""

    terms: dict[bytes, int]
    windows: list[np.ndarray]  # by group of equal length: windows x length
    owners: list[tuple[np.ndarray, np.ndarray]]  # by group: offsets and item ids


def parts_of(benchmark: DataFrame, id_column: str, text_column: str, n: int) -> Iterator[Part]:
    rows, size = [], 0
    for item, text in benchmark.select(F.col(id_column).cast("bigint"), F.col(text_column).cast("string")).toLocalIterator():
        words = words_of((text or "").encode())
        if words:
            rows.append((item, words))
            size += len(words)
        if size >= PART_WORDS:
            yield _part(rows, n)
            rows, size = [], 0
    if rows:
        yield _part(rows, n)


def _part(rows: list[tuple[int, list[bytes]]], n: int) -> Part:
    terms: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[int]] = {}
    for item, words in rows:
        ids = [terms.setdefault(w, len(terms)) for w in words]
        for i in range(max(1, len(ids) - n + 1)):
            found.setdefault(tuple(ids[i : i + n]), set()).add(item)
    groups: dict[int, list[tuple[int, ...]]] = {}
    for window in found:
        groups.setdefault(len(window), []).append(window)
    owners = []
    for windows in groups.values():
        lists = [sorted(found[w]) for w in windows]
        owners.append((np.concatenate(([0], np.cumsum([len(x) for x in lists]))), [i for x in lists for i in x]))
    return Part(terms, [np.array(w, np.int64) for w in groups.values()], owners)


def build_index(docs: DataFrame, terms: dict[bytes, int], id_column: str, text_column: str) -> DataFrame:
    """Rows (keys, ids, n_words, terms, counts, steps): documents of a run, how often each term occurs in it, and the terms'
    positions in the run as differences."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    kind = "binary" if docs.schema[id_column].dataType.typeName() == "binary" else "bigint"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        get = shared.value.get
        parts, sizes, keys = [], [], []
        ids = batch.column(0).to_pylist()
        for doc, text in zip(ids, utf8(batch.column(1)), strict=True):
            words = words_of(text)
            sizes.append(len(words))
            parts.append(np.fromiter(map(get, words, repeat(-1)), np.int64, len(words)))
            name = b"" if doc is None else doc if isinstance(doc, bytes) else b"%d" % doc
            keys.append(xxhash.xxh3_128_digest(name + b":" + text))
        if not ids:
            return None
        term = np.concatenate(parts)
        at = np.flatnonzero(term >= 0)
        posting = np.sort(term[at] << 32 | at)
        which, counts = np.unique(posting >> 32, return_counts=True)
        place = (posting & 0xFFFFFFFF).astype(np.int32)
        steps = np.diff(place, prepend=np.int32(0))
        row = [keys, ids, sizes, which.astype(np.int32).tolist(), counts.tolist(), steps.astype("<i4").tobytes()]
        return pa.record_batch([pa.array([x], t) for x, t in zip(row, (pa.list_(pa.binary()), pa.list_(pa.binary() if kind == "binary" else pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()), strict=True)], names=["keys", "ids", "n_words", "terms", "counts", "steps"])

    rows = docs.select(F.col(id_column).cast(kind).alias("id"), F.col(text_column).cast("string").alias("text"))
    return stored(rows.mapInArrow(by_batch(run), f"keys array<binary>, ids array<{kind}>, n_words array<bigint>, terms array<int>, counts array<bigint>, steps binary"), "postings")


def term_counts(index: DataFrame, n_terms: int) -> np.ndarray:
    """How often each term of the part occurs in the corpus; one row per term comes back."""
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("p")).groupBy("p.terms").agg(F.sum("p.counts").alias("n"))
    counts = np.zeros(n_terms, np.int64)
    found = pairs.toArrow()
    counts[found["terms"].to_numpy()] = found["n"].to_numpy()
    return counts


def _places(posting: np.ndarray, starts: np.ndarray, term: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, place) for every place of each window's ``term``, some windows at a time."""
    size = starts[term + 1] - starts[term]
    ends = np.cumsum(size)
    first = 0
    while first < len(term):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + PLACES, "right")))
        n = size[first:last]
        window = np.repeat(np.arange(first, last), n)
        within = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
        yield window, posting[starts[term[window]] + within] & 0xFFFFFFFF
        first = last


def _intersect(posting, starts, doc_ends, windows, counts, span) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, first word's place) of the phrases found; with ``span``, (window, place of its rarest term) of the proximity matches."""
    length = windows.shape[1]
    order = np.argsort(counts[windows], axis=1, kind="stable")
    rarest = windows[np.arange(len(windows)), order[:, 0]]
    for window, place in _places(posting, starts, rarest):
        doc = np.searchsorted(doc_ends, place, "right")
        low, high = np.where(doc > 0, doc_ends[doc - 1], 0), doc_ends[doc]
        if span is None:
            place = place - order[window, 0]
            keep = (place >= low) & (place + length <= high)
        else:
            low, high = np.maximum(low, place - span), np.minimum(high, place + span + 1)
            keep = np.ones(len(place), bool)
        window, place, low, high = window[keep], place[keep], low[keep], high[keep]
        for r in range(1, length):
            if not len(window):
                break
            term = windows[window, order[window, r]]
            probe = term << 32 | (place + order[window, r] if span is None else low)
            at = np.searchsorted(posting, probe)
            at_most = probe if span is None else (term << 32 | (high - 1))
            keep = posting[np.minimum(at, len(posting) - 1)] <= at_most
            keep &= at < len(posting)
            window, place, low, high = window[keep], place[keep], low[keep], high[keep]
        if len(window):
            yield window, place


def matches(index: DataFrame, part: Part, counts: np.ndarray, span: int | None = None) -> DataFrame:
    """Rows (key, item_id, first, end): the words of a document inside occurrences of an item's windows, as runs that don't
    touch for one item; with ``span``, the places around which all words of a window are found within ``span`` words."""
    # a window with a term that the corpus lacks can't occur
    groups = []
    for windows, (offsets, items) in zip(part.windows, part.owners, strict=True):
        alive = (counts[windows] > 0).all(1)
        lists = [items[offsets[i] : offsets[i + 1]] for i in np.flatnonzero(alive)]
        if lists:
            groups.append((windows[alive], np.concatenate(([0], np.cumsum([len(x) for x in lists]))), [i for x in lists for i in x]))
    shared = index.sparkSession.sparkContext.broadcast((groups, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, counts = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                yield from look_up(row, groups, counts)

    def look_up(row: dict, groups: list, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.zeros(len(counts), np.int64)
        sizes[row["terms"]] = row["counts"]
        starts = np.concatenate(([0], np.cumsum(sizes)))
        place = np.cumsum(np.frombuffer(row["steps"], "<i4").astype(np.int64))
        posting = np.repeat(np.arange(len(sizes)), sizes) << 32 | place
        doc_ends = np.cumsum(row["n_words"])
        if not len(posting):
            return
        for windows, offsets, items in groups:
            length = windows.shape[1]
            for window, at in _intersect(posting, starts, doc_ends, windows, counts, span):
                n = offsets[window + 1] - offsets[window]
                owner = np.repeat(offsets[window], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(at, n)
                doc = np.searchsorted(doc_ends, at, "right")
                name, item = np.unique(np.array(items, np.int64)[owner], return_inverse=True)
                by = np.lexsort((at, item, doc))
                doc, item, at = doc[by], item[by], at[by]
                reach = 1 if span is not None else length
                new = np.ones(len(at), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] > at[:-1] + reach)
                begin = np.flatnonzero(new)
                last = np.append(begin[1:], len(at)) - 1
                base = np.concatenate(([0], doc_ends))[doc[begin]]
                yield pa.record_batch(
                    [pa.array([row["keys"][d] for d in doc[begin]], pa.binary()), pa.array(name[item[begin]]), pa.array(at[begin] - base), pa.array(at[last] + reach - base)],
                    names=["key", "item_id", "first", "end"],
                )

    return index.mapInArrow(run, "key binary, item_id bigint, first bigint, end bigint")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", n: int = 10, span: int | None = None,
) -> DataFrame:
    """Per row of ``docs``: (id, key, n_words, n_hit, items, near_items).

    ``items`` are the benchmark items of which a window of ``n`` words (all words, if it has fewer) occurs in the document,
    ``n_hit`` counts the document's words inside such occurrences. ``near_items`` are the items of which all words of a
    window lie within ``span`` words of its rarest one, in any order; null without ``span``. Items without an id are left out.
    Ids of ``docs`` are bigint, or binary if the column is.
    """
    slim, exact, near = None, None, None
    parts = parts_of(benchmark.where(F.col(item_column).isNotNull()), item_column, item_text_column, n)
    for part in chain([next(parts, Part({}, [], []))], parts):
        index = build_index(docs, part.terms, id_column, text_column)
        counts = term_counts(index, len(part.terms))
        if slim is None:
            slim = index.select(F.explode(F.arrays_zip("keys", "ids", "n_words")).alias("d")).select(F.col("d.keys").alias("key"), F.col("d.ids").alias("id"), F.col("d.n_words").alias("n_words"))
        found = stored(matches(index, part, counts), "matches")
        exact = found if exact is None else exact.unionAll(found)
        if span is not None:
            found = stored(matches(index, part, counts, span).select("key", "item_id").distinct(), "near")
            near = found if near is None else near.unionAll(found)
    covered = F.aggregate(
        F.sort_array(F.collect_set(F.struct("first", "end"))),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("till")),
        lambda s, r: F.struct(
            (s["n"] + F.greatest(F.lit(0).cast("bigint"), r["end"] - F.greatest(r["first"], s["till"]))).alias("n"), F.greatest(s["till"], r["end"]).alias("till")
        ),
        lambda s: s["n"],
    )
    hits = exact.groupBy("key").agg(covered.alias("n_hit"), F.collect_set("item_id").alias("items")).withColumnRenamed("key", "k")
    out = slim.join(hits, F.col("key") == F.col("k"), "left")
    none = F.array().cast("array<bigint>")
    if span is None:
        near_items = F.lit(None).cast("array<bigint>")
    else:
        grouped = near.groupBy("key").agg(F.collect_set("item_id").alias("near")).withColumnRenamed("key", "k2")
        out = out.join(grouped, F.col("key") == F.col("k2"), "left")
        near_items = F.coalesce("near", none)
    return out.select("id", "key", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("items", none).alias("items"), near_items.alias("near_items"))
