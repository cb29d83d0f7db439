"""Token alignment of two tokenizers over the same text, by lockstep merging.

Both tokenizers cut the same bytes. Per batch of texts the end offsets of all A tokens lie in one array and those of all B
tokens in another. One state vector holds a pair of pointers per lane, a lane being a text or, for a long one, a stretch of
it that starts where tokens of both end. Every step links the two tokens that all lanes point to, notes a cut where both end
at the same byte, moves on whichever ends first, and drops the lanes that are through. Texts of any length are read in parts
of ``PART`` characters, cut before a blank between letters, where tokens of both kinds end.

How often a pair of ids is linked in the whole corpus is summed per task before the shuffle. Documents keep their own pairs
with counts in the stored table. The ``FREQUENT`` most frequent pairs reach every task as one table of that size at most;
the other pairs, none of which has more than one link in ``FREQUENT``, are looked up by a join.

Defined cases: a null or empty text, and one that either tokenizer does not give back byte for byte, has no tokens: zeros and
an empty ``groups_sha256``. Strings that look like special tokens are text. Rows may repeat and ids may be null; each row is a
document of its own and counts. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.shared import slices, stored

#: Characters of a text tokenized at once, bytes of text aligned at once, A tokens of a lane.
PART, BATCH_BYTES, LANE = 1 << 20, 1 << 21, 512
#: Id pairs that every task holds.
FREQUENT = 1 << 18
#: Distinct pairs a task sums up before it hands them on.
HELD = 1 << 20


@lru_cache(maxsize=2)
def _coder_a(name: str):
    """(encode texts, bytes of each id) of a byte-level vocabulary given by ranks."""
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as ranks:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks)}
    coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    entries = [b""] * (max(table.values()) + 1)
    for entry, i in table.items():
        entries[i] = entry
    return coder.encode_ordinary, entries


@lru_cache(maxsize=2)
def _coder_b(name: str):
    """(encode texts, bytes of each id) of a piece vocabulary."""
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{name}.model"))
    entries = []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        entries.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return lambda texts: model.encode(texts, num_threads=1), entries


def parts_of(text: str) -> Iterator[str]:
    """A text in parts to be tokenized alone, each with a blank before it; the blank between two parts is left out."""
    start = 0
    while len(text) - start > PART:
        at = start + PART
        while at > start and not (text[at] == " " and text[at - 1].isalpha() and text[at + 1 : at + 2].isalpha()):
            at -= 1
        if at == start:
            break
        yield text[start:at]
        start = at + 1
    yield text[start:]


def lanes(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, size: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Where lanes start, in A and in B: at each text's first token, and about every ``size`` tokens where both end."""
    size = size or LANE
    tries = np.arange(size - 1, len(ends_a) - 1, size)
    found = [np.maximum(first_a, 0)]
    for _ in range(16):
        if not len(tries):
            break
        at = np.searchsorted(ends_b, ends_a[tries])
        both = ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a[tries]
        found.append(tries[both] + 1)
        tries = tries[~both] + 1
        tries = tries[tries < len(ends_a) - 1]
    start_a = np.unique(np.concatenate(found))
    before = np.where(start_a > 0, ends_a[np.maximum(start_a - 1, 0)], 0)
    return start_a, np.searchsorted(ends_b, before, "right")


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, start_a: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All links (a, b) between overlapping tokens, and the last tokens (a, b) of each group, as positions.

    ``ends_*`` are the tokens' end offsets over all texts laid end to end; lanes start at ``start_*``.
    """
    a, b = start_a.copy(), start_b.copy()
    stop = np.append(start_a[1:], len(ends_a))
    links, cuts = [], []
    while len(a):
        links.append((a.copy(), b.copy()))
        end_a, end_b = ends_a[a], ends_b[b]
        both = end_a == end_b
        if both.any():
            cuts.append((a[both], b[both]))
        a += end_a <= end_b
        b += end_b <= end_a
        going = a < stop
        if not going.all():
            a, b, stop = a[going], b[going], stop[going]
    none = np.zeros(0, np.int64)
    both = [np.concatenate(x) if x else none for x in (*map(list, zip(*links, strict=True)), *map(list, zip(*cuts, strict=True)))] if links else [none] * 4
    return both[0], both[1], *(np.sort(x) for x in both[2:])


@dataclass
class _Document:
    """What is known of one document after some of its parts."""

    good: bool = True
    counts: list[int] = field(default_factory=lambda: [0, 0, 0, 0])
    groups: object = None
    keys: list[np.ndarray] = field(default_factory=list)
    links: list[np.ndarray] = field(default_factory=list)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) == 1:
            return self.keys[0], self.links[0]
        keys, where = np.unique(np.concatenate(self.keys), return_inverse=True)
        return keys, np.bincount(where, np.concatenate(self.links), len(keys)).astype(np.int64)

    def row(self) -> tuple:
        if not self.good or self.groups is None:
            return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        return *self.counts, self.groups.hexdigest(), *self.pairs()


def align_parts(parts: list[tuple[_Document, str]], a_name: str, b_name: str) -> None:
    """Tokenizes and aligns the parts, and adds what they give to their documents."""
    encode_a, bytes_a = _coder_a(a_name)
    encode_b, bytes_b = _coder_b(b_name)
    ids_b = encode_b([text for _, text in parts])
    kept = []
    for (document, text), b in zip(parts, ids_b, strict=True):
        whole = b" " + text.encode()
        a = encode_a(" " + text)
        document.good = document.good and b"".join([bytes_a[i] for i in a]) == whole and b"".join([bytes_b[i] for i in b]) == whole
        if document.good:
            kept.append((document, a, b))
    if not kept:
        return
    sizes_a, sizes_b = (np.fromiter(map(len, table), np.int64, len(table)) for table in (bytes_a, bytes_b))
    a, b = (np.concatenate([np.array(row[i], np.int64) for row in kept]) for i in (1, 2))
    last_a, last_b = (np.cumsum([len(row[i]) for row in kept]) for i in (1, 2))
    ends_a, ends_b = np.cumsum(sizes_a[a]), np.cumsum(sizes_b[b])  # a part has as many bytes in A as in B
    starts = lanes(ends_a, ends_b, np.append(0, last_a[:-1]))
    link_a, link_b, cut_a, cut_b = lockstep(ends_a, ends_b, *starts)
    part = np.searchsorted(last_a, link_a, "right")
    width = len(bytes_a) * len(bytes_b)
    keys, n = np.unique(part * width + a[link_a] * len(bytes_b) + b[link_b], return_counts=True)
    split = np.searchsorted(keys, np.arange(1, len(kept)) * width)
    per_part = np.bincount(part, minlength=len(kept))
    group_end = np.searchsorted(cut_a, last_a)  # cuts before each part's end
    done_a = done_b = done = 0
    for i, (keys_of, n_of) in enumerate(zip(np.split(keys, split), np.split(n, split), strict=True)):
        document, ids_a, ids_b = kept[i]
        text_a, text_b = list(map(str, ids_a)), list(map(str, ids_b))
        to_a, to_b = (cut_a[done : group_end[i]] + 1 - done_a).tolist(), (cut_b[done : group_end[i]] + 1 - done_b).tolist()
        groups = ";".join(
            [f"{','.join(text_a[i0:i1])}|{','.join(text_b[j0:j1])}" for i0, i1, j0, j1 in zip([0, *to_a], to_a, [0, *to_b], to_b, strict=False)]
        )
        if document.groups is None:
            document.groups = hashlib.sha256(groups.encode())
        else:
            document.groups.update(b";" + groups.encode())
        for k, more in enumerate((len(ids_a), len(ids_b), len(to_a), int(per_part[i]))):
            document.counts[k] += more
        document.keys.append(keys_of - i * width)
        document.links.append(n_of)
        done_a, done_b, done = int(last_a[i]), int(last_b[i]), int(group_end[i])


def aligned(docs: DataFrame, a_name: str, b_name: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: (row, id, n_a, n_b, n_groups, n_links, groups_sha256, keys, links).

    ``keys`` are its distinct linked pairs, id of A times the size of B's vocabulary plus id of B, ``links`` how often each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            texts, ids, parts_ids = batch.column(2), batch.column(1), batch.column(0)
            at = 0
            while at < batch.num_rows:
                documents, waiting, size = [], [], 0
                while at + len(documents) < batch.num_rows and size < BATCH_BYTES:
                    document, text = _Document(), texts[at + len(documents)].as_py()
                    documents.append(document)
                    for part in parts_of(text) if text else ():
                        waiting.append((document, part))
                        size += len(part.encode())
                        if size >= 2 * BATCH_BYTES:
                            align_parts(waiting, a_name, b_name)
                            waiting, size = [], BATCH_BYTES
                align_parts(waiting, a_name, b_name)
                columns = list(zip(*[d.row() for d in documents], strict=True))
                row = (parts_ids[at].as_py() << 40) + number + np.arange(len(documents))
                kinds = [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.int64()), pa.list_(pa.int32())]
                out = [pa.array(row), ids.slice(at, len(documents)), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]]
                yield pa.record_batch(out, names=["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "links"])
                number += len(documents)
                at += len(documents)

    rows = docs.select(F.spark_partition_id().cast("bigint").alias("part"), F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "row bigint, id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, keys array<bigint>, links array<int>")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of the document, key, links) of all pairs of a batch with columns keys and links."""
    keys, links = batch.column("keys"), batch.column("links")
    sizes = np.diff(keys.offsets.to_numpy())
    return np.repeat(np.arange(batch.num_rows), sizes), keys.flatten().to_numpy(), links.flatten().to_numpy().astype(np.int64)


def pair_counts(documents: DataFrame) -> DataFrame:
    """(key, n): links of each id pair over all ``documents``."""

    def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(where, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in _with_end(slices(batches, 1000)):
            if batch is not None:
                held.append(_flat(batch)[1:])
                if sum(len(k) for k, _ in held) < 4 * HELD:
                    continue
            if held:
                held = [summed(held)]
                if batch is None or len(held[0][0]) > HELD:
                    for at in range(0, len(held[0][0]), 1 << 16):
                        yield pa.record_batch([pa.array(c[at : at + (1 << 16)]) for c in held[0]], names=["key", "n"])
                    held = []

    return documents.select("keys", "links").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def vocabulary_size(b_name: str) -> int:
    return len(_coder_b(b_name)[1])


def align(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", a_name: str = "byte_bpe_50k", b_name: str = "piece_bpe_32k",
    frequent: int = FREQUENT,
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per document.

    ``count_sum`` adds up each link's corpus-wide count; ``n_best`` counts the links whose count is the highest of their B id.
    """
    documents = stored(aligned(docs, a_name, b_name, id_column, text_column), "aligned")
    counts = stored(pair_counts(documents), "pairs")
    b_id = F.pmod(F.col("key"), F.lit(vocabulary_size(b_name)))
    best = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))  # at most the size of B's vocabulary
    pairs = stored(counts.withColumn("b", b_id).join(best, "b").select("key", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    top = pairs.orderBy(F.desc("n"), "key").limit(frequent).toArrow()  # ``frequent`` rows
    order = np.argsort(top["key"].to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(tuple(top[c].to_numpy()[order] for c in ("key", "n", "best")))

    def look_up(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = shared.value[0]
        at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
        return (known[at] == key if len(known) else np.zeros(len(key), bool)), at

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            document, key, links = _flat(batch)
            hit, at = look_up(key)
            document, links, at = document[hit], links[hit], at[hit]
            out = [batch.column(i) for i in range(7)]
            for weight in (links * shared.value[2][at], links * shared.value[1][at]):
                total = np.zeros(batch.num_rows, np.int64)
                np.add.at(total, document, weight)
                out.append(pa.array(total))
            yield pa.record_batch(out, names=[*batch.schema.names[:7], "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            document, key, links = _flat(batch)
            rest = ~look_up(key)[0]
            if rest.any():
                row = batch.column("row").to_numpy()[document[rest]]
                yield pa.record_batch([pa.array(x) for x in (row, key[rest], links[rest])], names=["row", "key", "links"])

    schema = "row bigint, id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    rare = documents.select("row", "keys", "links").mapInArrow(others, "row bigint, key bigint, links bigint").join(pairs, "key")
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more_sum")
    )
    found = documents.mapInArrow(sums, schema).join(rare, "row", "left")
    return found.select(
        "id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
