"""Packing token sequences by non-negative least squares.

A document's ids are cut at multiples of the window; full pieces fill a sequence each. What is left over, at most one
piece per document, is counted by length. All ways to fill a window with up to three such lengths are enumerated, the
repeat counts that reproduce the histogram best are solved for by non-negative least squares, rounded down to what the
histogram holds, and laid out. The pieces still left are packed greedily, longest first: each sequence is filled to the
brim and the piece that crosses its end is cut there, so one sequence at most is not full.

The driver holds the histogram (one count per length) and the plan made from it, whose sizes depend on the window alone.
A piece finds its place from its length and its rank among the pieces of that length; ranks are counted per stored file
part and offset by the parts before, so no length is gathered in one task. Documents are tokenized once.

Defined cases: a null text is an empty one and gives the end id alone. Rows may repeat and ids may be null; each row is a
document of its own. Other columns are ignored. An empty table gives no piece.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from opinara.llm.shared import slices, stored

END = 0
SPLIT_CHARS = 1 << 20


@lru_cache(maxsize=2)
def _coder(name: str):
    """(encode one text, special strings with their ids).

    The vocabulary's rank file gives the same ids as the tokenizer file several times faster; the special strings, which
    the tokenizer takes out of the text first, come from the tokenizer file.
    """
    tokenizer = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as ranks:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks)}
    coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return coder.encode_ordinary, special


def _parts(text: str) -> Iterator[str]:
    """A long text in parts that are tokenized alike alone: cut before a blank between two letters."""
    while len(text) > SPLIT_CHARS:
        at = SPLIT_CHARS
        while 0 < at and not (text[at] == " " and text[at - 1].isalpha() and text[at + 1 : at + 2].isalpha()):
            at -= 1
        if not at:
            break
        yield text[:at]
        text = text[at:]
    yield text


def token_ids(text: str, name: str = "byte_bpe_50k") -> np.ndarray:
    """Ids of a text without special tokens around it."""
    encode, special = _coder(name)
    ids: list[int] = []
    rest = text
    while True:
        found = min(((at, s) for s in special if (at := rest.find(s)) >= 0), default=None)
        for part in _parts(rest if found is None else rest[: found[0]]):
            ids += encode(part)
        if found is None:
            return np.array(ids, "<u4")
        ids.append(special[found[1]])
        rest = rest[found[0] + len(found[1]) :]


def solve_counts(combos: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative x with sum of x over combos, each counted at its lengths, closest to ``histogram``.

    ``combos`` has a row of lengths per combination, 0 for none. Accelerated projected gradient; each length's misfit
    weighs as its share of a window.
    """
    n = len(histogram)
    weight = np.arange(n) / (n - 1)
    weight[0] = 0

    def made(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(combos[:, j], x, n) for j in range(combos.shape[1]))

    def gradient(x: np.ndarray) -> np.ndarray:
        misfit = weight * (made(x) - histogram)
        return sum(misfit[combos[:, j]] for j in range(combos.shape[1]))

    probe = np.ones(len(combos))
    for _ in range(20):
        back = weight * made(probe)
        probe = sum(back[combos[:, j]] for j in range(combos.shape[1]))
        size = np.linalg.norm(probe)
        probe /= size
    x = look = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, look - gradient(look) / (1.05 * size))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def combinations_filling(window: int) -> np.ndarray:
    """All pairs and triples of lengths that fill a window exactly, longest first, 0 for no third."""
    a, b = np.meshgrid(np.arange(1, window), np.arange(0, window), indexing="ij")
    c = window - a - b
    keep = (a >= c) & (c >= b) & (c > 0)
    return np.stack([a[keep], c[keep], b[keep]], 1)


def plan(histogram: np.ndarray) -> tuple[np.ndarray, int]:
    """Where the pieces of each length go: rows (length, first rank, end rank, first sequence, offset), and the number of
    sequences. ``histogram[k]`` counts the pieces of length k; the last length is the window itself."""
    window = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    rows = [(window, 0, left[window], 0, 0)]
    sequences = int(left[window])
    left[window] = 0
    combos = combinations_filling(window)
    combos = combos[(left[combos] > 0)[:, :2].all(1) & ((left[combos[:, 2]] > 0) | (combos[:, 2] == 0))]
    if len(combos):
        counts = solve_counts(combos, left.astype(float))
        used = np.zeros(window + 1, np.int64)
        for i in np.argsort(-counts, kind="stable"):
            n = int(np.rint(counts[i]))
            if not n:
                break
            lengths = [int(k) for k in combos[i] if k]
            n = min(n, *(int(left[k]) // lengths.count(k) for k in lengths))
            if n:
                offset = 0
                for k in lengths:
                    rows.append((k, used[k], used[k] + n, sequences, offset))
                    used[k] += n
                    left[k] -= n
                    offset += k
                sequences += n
    return np.array(rows, np.int64).reshape(-1, 5), sequences


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenized(docs: DataFrame, id_column: str, text_column: str, window: int, tokenizer: str) -> DataFrame:
    """One row per document: (part, id, doc_tokens, full_crcs, tail, and where it ranks in its part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = np.zeros(window + 1, np.int64)
        for batch in slices(batches):
            ids_out, rows = batch.column(1), []
            for text in batch.column(2).to_pylist():
                ids = np.append(token_ids(text or "", tokenizer), np.uint32(END)).astype("<u4")
                full = len(ids) // window
                tail = ids[full * window :]
                crcs = [crc32(ids[i * window : (i + 1) * window]) for i in range(full)]
                rows.append((len(ids), crcs, tail.astype("<u2" if len(ids) == 0 or ids.max() < 1 << 16 else "<u4").tobytes(), len(tail), crc32(tail), ranks[len(tail)], ranks[window]))
                ranks[len(tail)] += 1
                ranks[window] += full
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(7)]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([batch.column(0), ids_out, *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], names=["part", "id", "doc_tokens", "full_crcs", "tail", "tail_length", "tail_crc", "tail_rank", "full_rank"])

    rows = docs.select(F.spark_partition_id().alias("part"), F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "part int, id bigint, doc_tokens bigint, full_crcs array<bigint>, tail binary, tail_length int, tail_crc bigint, tail_rank bigint, full_rank bigint")


def pack(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 1024, tokenizer: str = "byte_bpe_50k"
) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A sequence is padded to ``window`` unless its pieces' length is a power of two.
    """
    spark = docs.sparkSession
    rows = stored(tokenized(docs, id_column, text_column, window, tokenizer), "tokens")
    # pieces of each length in each part: at most parts x window rows, whatever the number of documents
    tails = rows.where("tail_length > 0").groupBy("part", F.col("tail_length").alias("length")).agg(F.count("*").alias("n"))
    fulls = rows.groupBy("part").agg(F.sum(F.size("full_crcs")).cast("bigint").alias("n")).select("part", F.lit(window).alias("length"), "n").where("n > 0")
    counts = stored(tails.unionAll(fulls), "lengths")
    histogram = np.zeros(window + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most one row per length
        histogram[length] = n
    placed, sequences = plan(histogram)
    # the rest of each length, longest first, as one stream that is cut at every window
    taken = np.zeros(window + 1, np.int64)
    np.maximum.at(taken, placed[:, 0], placed[:, 2])
    rest = (histogram - taken) * np.arange(window + 1)
    stream = np.concatenate((np.cumsum(rest[::-1])[::-1][1:], [0]))  # tokens of the longer lengths
    by_length = [placed[placed[:, 0] == k] for k in range(window + 1)]
    by_length = [p[np.argsort(p[:, 1])] for p in by_length]
    shared = spark.sparkContext.broadcast((by_length, taken, stream, sequences))

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint"))
    tail_base = offsets.where(F.col("length") < window).select(F.col("part").alias("p1"), F.col("length").alias("l1"), F.col("base").alias("tail_base"))
    full_base = offsets.where(F.col("length") == window).select(F.col("part").alias("p2"), F.col("base").alias("full_base"))
    slim = rows.select("part", "id", "doc_tokens", "full_crcs", "tail_length", "tail_crc", "tail_rank", "full_rank", "tail")
    ranked = slim.join(full_base, F.col("part") == F.col("p2"), "left").join(
        tail_base, (F.col("part") == F.col("p1")) & (F.col("tail_length") == F.col("l1")), "left"
    )
    ranked = ranked.select(
        "id", "doc_tokens", "full_crcs", (F.col("full_rank") + F.coalesce("full_base", F.lit(0))).alias("full_rank"),
        "tail_length", "tail_crc", (F.col("tail_rank") + F.coalesce("tail_base", F.lit(0))).alias("tail_rank"), "tail",
    )

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        by_length, taken, stream, sequences = shared.value
        out: list[tuple] = []
        for row_id, tokens, crcs, full, length, crc, rank, tail in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            for i, c in enumerate(crcs):
                out.append((row_id, i * window, window, c, tokens, full + i, 0))
            if not length:
                continue
            start = len(crcs) * window
            if rank < taken[length]:
                spans = by_length[length]
                s = spans[np.searchsorted(spans[:, 1], rank, "right") - 1]
                out.append((row_id, start, length, crc, tokens, int(s[3] + rank - s[1]), int(s[4])))
                continue
            ids = np.frombuffer(tail, "<u2" if len(tail) == 2 * length else "<u4")
            at = int(stream[length] + (rank - taken[length]) * length)
            done = 0
            while done < length:
                n = min(length - done, window - at % window)
                out.append((row_id, start + done, n, crc32(ids[done : done + n]), tokens, sequences + at // window, at % window))
                done, at = done + n, at + n
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
        return pa.record_batch([pa.array(list(c), pa.int64()) for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield place(batch)

    return ranked.mapInArrow(run, "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
