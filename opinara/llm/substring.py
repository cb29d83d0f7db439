"""Substring dedup: exact repeated windows of words, with a count-min sketch before the exact grouping.

Documents are stored in blocks of bounded bytes, bucketed by block, so that later passes meet their block's answers
without moving the texts again.

1. Each block adds its windows to ``DEPTH`` rows of counters and sends the counters it touched, as sorted differences,
   to the slice of the sketch that they lie in. A slice merges what all blocks sent and answers each block which of its
   counters reached two. Counters overestimate, so no repeated window is lost; the sketch is split over tasks and grows
   with the corpus, and nothing of it is broadcast.
2. Only windows whose counters all reached two are grouped exactly, by 128-bit digests of their words: a block sends each
   once with the smallest and largest document id that has it, and is answered with the smallest id of all blocks. Both
   travel as sorted lists, a slice of digests at a time.
3. A window is a copy if that id is smaller than its document's; the words that copies cover are removed.

A window that a third of all documents share is one row per block by then.

Defined cases: a null text has no words, and its kept text is empty; texts shorter than the window stay whole. A null id
counts as larger than every other: such a document never makes others lose words. Rows with equal ids don't remove each
other's words; each has its own result. All columns of the input are carried along in one struct, so their names don't
matter. Without documents the result is empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.shared import shared_folder, slices, utf8

#: Text bytes in a block; a longer document is a block of its own.
BLOCK_BYTES = 8 << 20
#: Text bytes in a bucket, up to 50,000 buckets.
BUCKET_BYTES = 32 << 20
#: Rows of counters; each has about six counters to a window.
DEPTH = 2
#: Counters of a slice, as a power of two, while there are up to 65,536 slices, and at most.
SLICE_BITS, SLICE_BITS_MOST = 22, 26
NO_ID = 2**63 - 1
HALF = np.uint64(0xFFFFFFFF)
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIXES = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


class WordHashes:
    """64-bit hash of each word. None is remembered: a look-up takes longer than hashing, and the words of a block much memory."""

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _mixed(x: np.ndarray, factor: int) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(factor)
    return x ^ (x >> np.uint64(29))


def window_digests(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each run of ``size`` word hashes."""
    out = []
    n = len(hashes) - size + 1
    for factor, mix in zip(_FACTORS, _MIXES, strict=True):
        x = _mixed(hashes, mix)
        d = np.zeros(n, np.uint64)
        for j in range(size):
            d = d * np.uint64(factor) + x[j : j + n]
        out.append(_mixed(d, factor))
    return out[0], out[1]


class Block:
    """The windows of some documents: the digests, the document of each, and each document's first window.

    Words are held for one document at a time: as objects they take several times the space of their text.
    """

    def __init__(self, texts: list[bytes], size: int, hashed: WordHashes):
        by_text = [hashed(t.split()) for t in texts]
        n_words = np.array([len(h) for h in by_text], np.int64)
        self.n_windows = np.maximum(n_words - size + 1, 0)
        self.first = np.concatenate(([0], np.cumsum(self.n_windows)))
        self.doc = np.repeat(np.arange(len(texts)), self.n_windows)
        hashes = np.concatenate([np.zeros(0, np.uint64), *by_text])
        if len(hashes) < size:
            self.digests = (np.zeros(0, np.uint64),) * 2
            return
        start = np.cumsum(n_words) - n_words  # windows that run over a document's end go
        keep = np.repeat(start - self.first[:-1], self.n_windows) + np.arange(self.first[-1])
        a, b = window_digests(hashes, size)
        self.digests = a[keep], b[keep]


def encode(cells: np.ndarray) -> bytes:
    """Sorted numbers, repeats allowed, as compressed differences."""
    steps = np.diff(cells, prepend=np.uint64(0))
    width = next(w for w in (1, 2, 4, 8) if w == 8 or steps.max(initial=0) < 1 << 8 * w)
    return bytes([width]) + zstandard.compress(steps.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes(), 1)


def decode(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(width, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.uint64), dtype=np.uint64)


def pack(values: np.ndarray) -> bytes:
    """Numbers in any order, byte plane by byte plane."""
    return zstandard.compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _in_sorted(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.searchsorted(among, values)
    return among[np.minimum(at, len(among) - 1)] == values


def _store_blocks(docs: DataFrame, text_column: str) -> tuple[DataFrame, int]:
    """Rows (row, block) bucketed by block, and the texts' bytes."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.spark_partition_id().alias("part"), F.octet_length(F.col(text_column).cast("string")).alias("size"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chunk = 0, 0
        for batch in batches:
            blocks = np.zeros(batch.num_rows, np.int64)
            for i, (part, size) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                held += (size or 0) + 8
                if held > BLOCK_BYTES:
                    chunk, held = chunk + 1, (size or 0) + 8
                blocks[i] = part << 32 | chunk
            yield pa.record_batch([batch.column(0), pa.array(blocks)], names=["row", "block"])

    schema = rows.select("row").schema.add("block", "long")
    total = docs.agg(F.sum(F.octet_length(F.col(text_column).cast("string")))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(50_000, total // BUCKET_BYTES + 1))
    name = f"substring_blocks_{uuid.uuid4().hex}"
    writer = rows.mapInArrow(assign, schema).write.format("parquet").option("path", f"{shared_folder(spark)}/{name}")
    writer.bucketBy(buckets, "block").sortBy("block").saveAsTable(name)
    return spark.table(name), total


def slice_bits_of(bits: int) -> int:
    """How many slices, as a power of two, ``2 ** bits`` counters are cut in: as many as keep a slice in a task's memory at any size."""
    return max(2, min(16, bits - SLICE_BITS), bits - SLICE_BITS_MOST)


def _sketch(blocks: DataFrame, text_column: str, size: int, bits: int, slice_bits: int) -> DataFrame:
    """Rows (slice, block, cells): the counters a block touched, each once or, for several windows, twice.

    Twice is all that the estimate needs, so a passage that a block's documents repeat a thousand times weighs no more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, texts = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            digests = Block(texts, size, WordHashes()).digests
            found, cells = [], []
            for depth in range(DEPTH):
                cell = np.sort(digests[depth] >> np.uint64(64 - bits))
                cell = np.concatenate((cell[:2], cell[2:][cell[2:] != cell[:-2]]))
                which = (cell >> np.uint64(bits - slice_bits)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(which)) + 1
                for part in np.split(cell, cuts) if len(cell) else []:
                    found.append(depth << slice_bits | int(part[0] >> np.uint64(bits - slice_bits)))
                    cells.append(encode(part))
            yield pa.record_batch([pa.array(found, pa.int64()), pa.array([current] * len(found), pa.int64()), pa.array(cells, pa.binary())], names=["slice", "block", "cells"])

        for batch in slices(batches, 500):
            ids = batch.column(0).to_numpy()
            all_texts = utf8(batch.column(1))
            begin = 0
            for end in [*(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]:
                if begin < end:
                    if current is not None and ids[begin] != current:
                        yield from flush()
                        texts = []
                    current = int(ids[begin])
                    texts += all_texts[begin:end]
                begin = end
        if texts:
            yield from flush()

    rows = blocks.select("block", F.col("row").getField(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "slice bigint, block bigint, cells binary")


def _merge(group: pa.Table) -> pa.Table:
    """For one slice: the cells of each block that reached two over all blocks."""
    lists = [decode(c) for c in group["cells"].to_pylist()]
    whole = np.sort(np.concatenate(lists))
    twice = np.unique(whole[1:][whole[1:] == whole[:-1]])
    out = [(b, encode(mine)) for b, cells in zip(group["block"].to_pylist(), lists, strict=True) if len(mine := twice[_in_sorted(twice, cells)])]
    depth = group["slice"][0].as_py()
    return pa.table({"block": pa.array([b for b, _ in out], pa.int64()), "slice": pa.array([depth] * len(out), pa.int64()), "cells": pa.array([c for _, c in out], pa.binary())})


def _least_ids(group: pa.Table) -> pa.Table:
    """For one slice of digests: what each block sent that has a smaller id somewhere, with the smallest id of all."""
    lists = [decode(x) for x in group["a"].to_pylist()]
    a = np.concatenate(lists)
    b, low, more = (np.concatenate([unpack(x) for x in group[c].to_pylist()]) for c in ("b", "low", "more"))
    low = low.view(np.int64)
    high = low + more.view(np.int64)
    order = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    least = np.empty(len(a), np.int64)
    least[order] = np.minimum.reduceat(low[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    out, end = [], 0
    for block, own in zip(group["block"].to_pylist(), lists, strict=True):
        begin, end = end, end + len(own)
        hit = begin + np.flatnonzero(high[begin:end] > least[begin:end])
        if len(hit):
            out.append((block, encode(a[hit]), pack(b[hit] & HALF), pack(least[hit].view(np.uint64))))
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
    return pa.table({n: pa.array(list(c), k) for n, c, k in zip(("block", "a", "b", "least"), columns, kinds, strict=True)})


def _plain(table: pa.Table, column: str) -> pa.Array:
    found = table["row"].combine_chunks()
    found = found.chunk(0) if isinstance(found, pa.ChunkedArray) else found
    return found.field(found.type.get_field_index(column))


def _ids(table: pa.Table, column: str) -> np.ndarray:
    return np.array([NO_ID if i is None else i for i in _plain(table, column).to_pylist()], np.int64)


def remove_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 13) -> DataFrame:
    """(row, n_words, n_removed, kept): each input row as a struct, and its words that are left, joined by one space.

    Words are runs without ASCII white space. A word goes if a window of ``size`` words covers it that also starts in a
    document with a smaller id; windows are judged on the input.
    """
    blocks, total = _store_blocks(docs, text_column)
    bits = max(10, total.bit_length())
    slice_bits = slice_bits_of(bits)
    flags = _sketch(blocks, text_column, size, bits, slice_bits).groupBy("slice").applyInArrow(_merge, "block bigint, slice bigint, cells binary")

    nothing = pa.table({n: pa.array([], pa.int64() if n in ("slice", "block") else pa.binary()) for n in ("slice", "block", "a", "b", "low", "more")})

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return nothing
        block = Block(utf8(_plain(left, text_column)), size, WordHashes())
        keep = np.ones(len(block.doc), bool)
        which = right["slice"].to_numpy() >> slice_bits
        cells = right["cells"].to_pylist()
        for depth in range(DEPTH):
            mine = [decode(cells[i]) for i in np.flatnonzero(which == depth)]
            twice = np.sort(np.concatenate(mine)) if mine else np.zeros(0, np.uint64)
            keep &= _in_sorted(block.digests[depth] >> np.uint64(64 - bits), twice)
        at = np.flatnonzero(keep)
        a, b, doc = block.digests[0][at], block.digests[1][at], _ids(left, id_column)[block.doc[at]]
        order = np.lexsort((doc, b, a))
        a, b, doc = a[order], b[order], doc[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(a)) - 1 if len(first) else first
        a, b, low, high = a[first], b[first], doc[first].view(np.uint64), doc[last].view(np.uint64)
        own = (a >> np.uint64(64 - slice_bits)).astype(np.int64)
        parts = np.split(np.arange(len(a)), np.flatnonzero(np.diff(own)) + 1) if len(a) else []
        return pa.table(
            {
                "slice": pa.array([int(own[p[0]]) for p in parts], pa.int64()), "block": pa.array([left["block"][0].as_py()] * len(parts), pa.int64()),
                "a": pa.array([encode(a[p]) for p in parts], pa.binary()), "b": pa.array([pack(b[p]) for p in parts], pa.binary()),
                "low": pa.array([pack(low[p]) for p in parts], pa.binary()), "more": pa.array([pack(high[p] - low[p]) for p in parts], pa.binary()),
            }
        )

    sent = "slice bigint, block bigint, a binary, b binary, low binary, more binary"
    repeated = blocks.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(candidates, sent)
    answers = repeated.groupBy("slice").applyInArrow(_least_ids, "block bigint, a binary, b binary, least binary")

    kept_type = f"row {blocks.schema['row'].dataType.simpleString()}, n_words bigint, n_removed bigint, kept string"

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = utf8(_plain(left, text_column))
        block = Block(texts, size, WordHashes())
        copies = np.zeros(len(block.doc), bool)
        if right.num_rows and len(copies):
            a = np.concatenate([decode(x) for x in right["a"].to_pylist()])
            b = np.concatenate([unpack(x) for x in right["b"].to_pylist()])
            low = np.concatenate([unpack(x) for x in right["least"].to_pylist()]).view(np.int64)
            order = np.argsort(a, kind="stable")
            a, b, low = a[order], b[order], low[order]
            doc = _ids(left, id_column)[block.doc]
            at = np.searchsorted(a, block.digests[0])
            left_over = np.arange(len(at))
            while len(left_over := left_over[at[left_over] < len(a)]):
                left_over = left_over[a[at[left_over]] == block.digests[0][left_over]]
                same = b[at[left_over]] == block.digests[1][left_over] & HALF
                hit = left_over[same]
                copies[hit] = low[at[hit]] < doc[hit]
                left_over = left_over[~same]
                at[left_over] += 1
        n_words, n_removed, kept = [], [], []
        marks = np.concatenate(([0], np.cumsum(copies)))
        for i, words in enumerate(map(bytes.split, texts)):
            n_words.append(len(words))
            first, end = block.first[i], block.first[i + 1]
            if marks[end] == marks[first]:
                n_removed.append(0)
                kept.append(b" ".join(words))
                continue
            cover = np.zeros(len(words) + 1, np.int64)
            starts = np.flatnonzero(copies[first:end])
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + size, -1)
            stays = np.cumsum(cover[:-1]) == 0
            n_removed.append(int(len(words) - stays.sum()))
            kept.append(b" ".join([words[k] for k in np.flatnonzero(stays)]))
        return pa.table({"row": left["row"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(remove, kept_type)
