"""Spelling variants: words one edit apart, grouped under their most frequent spelling.

Words are compared in dense tiles: two blocks of words become matrices of code points, padded on the right for the common
prefix and on the left for the common suffix, and every pair of the two blocks is measured at once. With ``longer`` the
length of the longer word, a pair is a single edit if prefix and suffix together reach ``longer - 1``.

So one of the two reaches ``longer // 2`` code points. A word is therefore filed under its first and its last
``longer // 2`` code points, once as the longer word of a pair and once as the shorter one, and only words filed under the
same key share a tile: the number of tiles follows the vocabulary, not its square. A key with more than ``HOT`` words is cut
in blocks by hash, and each pair of blocks is a tile group of its own. Only near pairs leave a task. A pair that agrees in
both halves is reported from the prefix side alone.

Defined cases: a null or empty text has no words; texts are read in parts of ``PART`` characters, cut between words. Rows may
repeat, each counts. A null id is the empty string in the digest that picks the runs to change. Words may be of any length;
tiles get smaller as words get longer. Ties between spellings go to the smallest word in code-point order. Other columns are
ignored whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.shared import slices, stored

LETTERS = r"[A-Za-zÀ-ÿ]+"
#: Words under one key in one block, rows of a tile's side, and cells of a side's matrix.
HOT, TILE, CELLS = 1024, 128, 1 << 22
#: Characters of a text read at once, and distinct words a task holds before it hands their counts on.
PART, HELD = 1 << 20, 1 << 18


def _parts(text: str, letters: re.Pattern) -> Iterator[str]:
    """A text in parts that no run crosses."""
    at = 0
    while len(text) - at > PART:
        end = at + PART
        while end < len(text) and letters.match(text, end):
            end = letters.match(text, end).end()
        yield text[at:end]
        at = end
    yield text[at:]


def word_counts(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", drop_every: int | None = 97, min_length: int = 5, min_count: int = 3,
    pattern: str = LETTERS,
) -> DataFrame:
    """(word, n): how often each word occurs over all texts, A-Z lower-cased.

    With ``drop_every``, a run whose CRC-32 with its document's id is a multiple of it loses one code point, which plants
    spelling errors at known places.
    """
    letters = re.compile(pattern)

    def flushed(counts: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches, 200):
            for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{'' if row_id is None else row_id}:".encode())
                for part in _parts(text or "", letters):
                    # lower-casing bytes touches A-Z alone
                    for word, n in Counter(letters.findall(part.encode().lower().decode())).items():
                        if drop_every and (h := zlib.crc32(word.encode(), start)) % drop_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        if len(word) >= min_length:
                            counts[word] += n
                if len(counts) >= HELD:
                    yield flushed(counts)
                    counts = Counter()
        yield flushed(counts)

    rows = docs.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).cast("string").alias("text"))
    found = rows.mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _matrices(words: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, one row each: padded with zeros on the right, and on the left."""
    left = np.array(words, "U")
    width = left.dtype.itemsize // 4
    left = left.view(np.uint32).reshape(len(words), width)
    from_end = np.arange(width) - (width - lengths)[:, None]
    return left, np.where(from_end >= 0, np.take_along_axis(left, np.maximum(from_end, 0), 1), 0)


def _agreeing(a: np.ndarray, b: np.ndarray, columns: range) -> np.ndarray:
    """For each row of a and each of b: how many columns agree, from the first one on, padding apart."""
    going = np.ones((len(a), len(b)), bool)
    found = np.zeros((len(a), len(b)), np.int32)
    for c in columns:
        going &= (a[:, c, None] == b[None, :, c]) & (a[:, c, None] != 0)
        if not going.any():
            break
        found += going
    return found


def single_edits(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of two blocks of words: the common prefix, the common suffix, and the longer length."""
    lengths_a, lengths_b = (np.fromiter(map(len, w), np.int64, len(w)) for w in (a, b))
    both, from_end = _matrices([*a, *b], np.concatenate((lengths_a, lengths_b)))
    n, width = len(a), both.shape[1]
    prefix = _agreeing(both[:n], both[n:], range(width))
    suffix = _agreeing(from_end[:n], from_end[n:], range(width - 1, -1, -1))
    return prefix, suffix, np.maximum(lengths_a[:, None], lengths_b[None, :])


def _near_in(words: list[str], group: np.ndarray, longer: np.ndarray, own: np.ndarray, crossing: np.ndarray, by_suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the near pairs among rows sorted by group, each pair once.

    In a crossing group words of the same block don't meet: they meet in the block's own group.
    """
    edges = [0]
    while edges[-1] < len(words):
        at = edges[-1]
        rows = max(1, min(TILE, CELLS // max(1, int(longer[at]))))
        end = min(len(words), at + rows)
        change = np.flatnonzero(longer[at:end] != longer[at])  # a block holds one length, and the next shorter one
        edges.append(at + int(change[0]) if len(change) else end)
    blocks = list(zip(edges, edges[1:], strict=False))
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x, (a0, a1) in enumerate(blocks):
        for b0, b1 in blocks[x:]:
            if group[b0] > group[a1 - 1]:
                break
            # rows of groups that the two blocks share
            lo, hi = (a0, b1) if b0 == a0 else (int(np.searchsorted(group, group[b0])), int(np.searchsorted(group, group[a1 - 1], "right")))
            a, b = np.arange(max(lo, a0), a1), np.arange(b0, min(hi, b1))
            wanted = (group[a, None] == group[None, b]) & (a[:, None] < b[None, :]) & ~(crossing[a, None] & (own[a, None] == own[None, b]))
            if not wanted.any():
                continue
            prefix, suffix, length = single_edits([words[i] for i in a], [words[i] for i in b])
            top = longer[a, None]
            wanted &= (length == top) & (prefix + suffix >= top - 1) & (~by_suffix[a, None] | (prefix < top // 2))
            i, j = np.nonzero(wanted)
            found_i.append(a[i])
            found_j.append(b[j])
    return np.concatenate(found_i), np.concatenate(found_j)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n), both ways, of all pairs of distinct ``words`` (word, n) that are a single edit apart."""
    length = F.length("word")
    ways = [
        F.struct(m.alias("longer"), F.lit(by_suffix).alias("by_suffix"), part(F.col("word"), F.floor(m / 2).cast("int")).alias("key"))
        for m in (length, length + 1)
        for by_suffix, part in ((False, F.left), (True, F.right))
    ]
    filed = words.select("word", "n", F.explode(F.array(*ways)).alias("way")).select("word", "n", "way.*")
    place = ["longer", "by_suffix", "key"]
    hot = filed.groupBy(*place).agg(F.ceil(F.count("*") / HOT).cast("int").alias("blocks")).where("blocks > 1")
    tiles = filed.join(hot, place, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    tiles = tiles.withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select(*place, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "word", "n")
    place += ["low", "high"]

    def pairs_of(rows: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        alone = np.bincount(group)[group] == 1
        rows, group = rows.filter(pa.array(~alone)), group[~alone]
        if not rows.num_rows:
            return
        column = {c: rows[c].to_numpy() for c in ("longer", "by_suffix", "own", "low", "high", "n")}
        words = rows["word"].to_pylist()
        i, j = _near_in(words, group, column["longer"], column["own"], column["low"] != column["high"], column["by_suffix"].astype(bool))
        one, two = np.concatenate((i, j)), np.concatenate((j, i))
        for at in range(0, len(one), 1 << 16):
            a, b = one[at : at + (1 << 16)], two[at : at + (1 << 16)]
            yield pa.record_batch(
                [pa.array([words[k] for k in a], pa.string()), pa.array(column["n"][a]), pa.array([words[k] for k in b], pa.string()), pa.array(column["n"][b])],
                names=["word", "n", "near", "near_n"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in _with_end(batches):
            if batch is not None:
                held.append(batch)
                if sum(b.num_rows for b in held) < 4 * HOT:
                    continue
            if not held:
                return
            rows = pa.Table.from_batches(held).combine_chunks()
            group = _groups(rows, place)
            whole = rows.num_rows if batch is None else int(np.searchsorted(group, group[-1]))
            if whole:
                yield from pairs_of(rows.slice(0, whole), group[:whole])
            held = rows.slice(whole).to_batches()

    dealt = tiles.repartition(*place).sortWithinPartitions(*place)
    return dealt.mapInArrow(run, "word string, n bigint, near string, near_n bigint")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _groups(rows: pa.Table, place: list[str]) -> np.ndarray:
    """Number of the group of each row; rows of a group follow each other."""
    new = np.zeros(rows.num_rows, bool)
    for c in place:
        values = rows[c].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.cumsum(new)


def roots(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word that the forms lead to. Forms must not lead in circles.

    Each round doubles the steps taken and is stored, so a chain of k words takes about log2(k) rounds.
    """
    current = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = current.select(F.col("word").alias("at"), F.col("root").alias("further"))
        moved = stored(current.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        current = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return current


def group_variants(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of ``words`` (word, n), whose words are distinct.

    A word's form is its most frequent near word if that one occurs at least ``times`` as often.
    """
    words = stored(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    fits = -F.col("best.less") >= times * F.col("n")
    forms = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"),
    )
    forms = stored(forms, "forms")
    found = forms.join(roots(forms.where("form IS NOT NULL")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
