"""Sharding by longest processing time: equal texts stay together, larger groups are placed first, each in the shard that has
least so far, which a heap gives.

Spark groups equal texts by digest and sorts the groups by size over range partitions, so a group's place in the order is its
partition's offset plus its place there. The driver never sees the groups: it plans the run of each size class. Sizes below
``2 * STEPS`` are a class each, larger ones share a class if they differ by less than one part in ``STEPS``; however many
documents there are, that is about ``STEPS`` classes for each power of two. Groups of a class count as equally large: while a
class has many left, whole rounds over the least loaded shards are placed at once, and the heap places the rest one by one. A
class hands each shard evenly spread places of its sorted groups, so what the sizes within classes add to the difference of
two shards telescopes to about one group of the largest class.

Groups with more than one part in ``LARGE`` of all bytes or of all documents, at most ``2 * LARGE`` of them, are placed one by
one by their own sizes. Their documents get their shard by a broadcast of that many digests; the other documents by a join
in which no key has more than one row in ``LARGE``. Slots are counted per stored part and offset by the parts before.

Defined cases: a null text is an empty one. Rows may repeat and ids may be null; each row has a slot. Other columns are
ignored. An empty table gives an empty result. There may be fewer groups than shards; the others stay empty.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm.shared import stored

#: Size classes for each power of two, and what share of all bytes or rows makes a group be placed by itself.
STEPS, LARGE = 1024, 20_000
#: Bytes that each document has besides its text.
OVERHEAD = 16


def size_class(size: Column) -> Column:
    """Number of the size class, growing with the size: a size without its low bits, as many as exceed those of 2 * STEPS."""
    left_out = F.greatest(F.lit(0), F.length(F.bin(size)) - F.lit(STEPS.bit_length()))
    return (left_out * STEPS + F.call_function("shiftright", size, left_out)).cast("bigint")


def place_run(heap: list[tuple[int, int]], size: float, count: int) -> np.ndarray:
    """Places ``count`` groups of one size, each in the least loaded shard; returns how many each shard gets.

    ``heap`` holds (load, shard) and is changed. Equal loads go to the smaller shard.
    """
    shards = len(heap)
    got = np.zeros(shards, np.int64)
    if count > 4 * shards:
        loads = np.zeros(shards)
        for load, shard in heap:
            loads[shard] = load
        # the highest level that all shards below it can be filled up to, a whole number of groups each
        low, high = loads.min(), loads.min() + size * count
        while high - low > size / 2:
            level = (low + high) / 2
            if np.floor(np.maximum(level - loads, 0) / size).sum() <= count:
                low = level
            else:
                high = level
        got = np.floor(np.maximum(low - loads, 0) / size).astype(np.int64)
        loads += got * size
        heap[:] = [(float(load), shard) for shard, load in enumerate(loads)]
        heapq.heapify(heap)
        count -= int(got.sum())
    for _ in range(count):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        got[shard] += 1
    return got


def spread(got: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How a class's sorted groups go to shards that get ``got``: (first place, shards in turn, order of shards) per stretch.

    The shard that gets most starts alone, the next joins it, and so on, each stretch in turn among those that take part.
    """
    order = np.argsort(-got, kind="stable")
    ordered = got[order]
    steps = ordered - np.append(ordered[1:], 0)  # rounds in which exactly the first k take part
    width = np.flatnonzero(steps) + 1
    return np.cumsum(np.append(0, steps[width - 1] * width))[:-1], width, order.astype(np.int16)


def shard_at(stretches: tuple[np.ndarray, np.ndarray, np.ndarray], place: np.ndarray) -> np.ndarray:
    """The shards at these places of a class."""
    first, width, order = stretches
    k = np.searchsorted(first, place, "right") - 1
    return order[(place - first[k]) % width[k]]


def plan(large: list[tuple[bytes, int]], classes: list[tuple[int, int, int]], shards: int) -> tuple[dict[bytes, int], dict[int, tuple]]:
    """Shards of the large groups (digest, size), and the stretches of each class (class, groups, bytes), placed by falling size."""
    heap: list[tuple[float, int]] = [(0.0, s) for s in range(shards)]
    alone: dict[bytes, int] = {}
    runs: dict[int, tuple] = {}
    waiting = [(-size, 0, digest, 1) for digest, size in large] + [(-total / n, 1, kind, n) for kind, n, total in classes]
    for size, many, key, n in sorted(waiting, key=lambda x: x[:2] + (x[2] if isinstance(x[2], bytes) else b"",)):
        got = place_run(heap, -size, n)
        if many:
            runs[key] = spread(got)
        else:
            alone[key] = int(got.argmax())
    return alone, runs


def sized(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, size, text_crc32, digest) per row."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(text, 256), 1, 32))
    return docs.select(
        F.col(id_column).cast("bigint").alias("id"), (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"), digest.alias("digest"),
    )


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each group's place among those of its class in this partition, whose rows are sorted by class."""
    last, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kind = batch.column(batch.schema.names.index("kind")).to_numpy()
        starts = np.append(0, np.flatnonzero(kind[1:] != kind[:-1]) + 1)
        lengths = np.diff(np.append(starts, len(kind)))
        place = np.arange(len(kind)) - np.repeat(starts, lengths)
        if kind[0] == last:
            place[: lengths[0]] += seen
        last, seen = kind[-1], int(place[-1]) + 1
        yield pa.record_batch([*batch.columns, pa.array(place)], names=[*batch.schema.names, "place"])


def _slots(shards: int):
    """Adds each row's place among those of its shard in this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(shards, np.int64)
        for batch in batches:
            shard = batch.column(batch.schema.names.index("shard")).to_numpy()
            order = np.argsort(shard, kind="stable")
            counts = np.bincount(shard, minlength=shards)
            place = np.empty(len(shard), np.int64)
            place[order] = np.arange(len(shard)) - np.repeat(np.cumsum(counts) - counts - seen, counts)
            seen += counts
            yield pa.record_batch([*batch.columns, pa.array(place)], names=[*batch.schema.names, "place"])

    return run


def group_shards(groups: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """(digest, shard) of the large groups, at most ``2 * LARGE`` rows, and of all others, from (digest, bytes, n)."""
    spark = groups.sparkSession
    totals = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    is_large = (F.col("bytes") > totals.bytes / LARGE) | (F.col("n") > totals.n / LARGE)
    large = [(bytes(r.digest), r.bytes) for r in groups.where(is_large).select("digest", "bytes").collect()]
    by_size = groups.where(~is_large).select("digest", "bytes", size_class(F.col("bytes")).alias("kind"))
    # sorted over range partitions: a class of many groups spans several, and (kind, part) has a row per class and partition at most
    by_size = by_size.repartitionByRange(F.desc("bytes"), F.asc("digest")).sortWithinPartitions(F.desc("bytes"), "digest")
    by_size = by_size.withColumn("part", F.spark_partition_id())
    placed = stored(by_size.mapInArrow(_places, "digest binary, bytes bigint, kind bigint, part int, place bigint"), "groups")
    counts = placed.groupBy("kind", "part").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).orderBy("kind", "part").toArrow()
    kind, part, n, size = (counts[c].to_numpy() for c in ("kind", "part", "n", "bytes"))
    starts = np.append(0, np.flatnonzero(kind[1:] != kind[:-1]) + 1) if len(kind) else np.zeros(0, np.int64)
    before = np.cumsum(n) - n
    base = before - np.repeat(before[starts], np.diff(np.append(starts, len(kind))))  # places taken in earlier partitions
    classes = list(zip(kind[starts].tolist(), np.add.reduceat(n, starts).tolist() if len(kind) else [], np.add.reduceat(size, starts).tolist() if len(kind) else [], strict=True))
    alone, runs = plan(large, classes, shards)
    shared = spark.sparkContext.broadcast((kind * (1 << 32) + part, base, runs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, base, runs = shared.value
        for batch in batches:
            kind, part, place = (batch.column(batch.schema.names.index(c)).to_numpy() for c in ("kind", "part", "place"))
            place = place + base[np.searchsorted(known, kind * (1 << 32) + part)]
            shard = np.empty(len(kind), np.int32)
            order = np.argsort(kind, kind="stable")
            for of in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1):
                if len(of):
                    shard[of] = shard_at(runs[int(kind[of[0]])], place[of])
            yield pa.record_batch([batch.column(batch.schema.names.index("digest")), pa.array(shard)], names=["digest", "shard"])

    return spark.createDataFrame(list(alone.items()), "digest binary, shard int"), placed.mapInArrow(run, "digest binary, shard int")


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) per row of ``docs``: equal texts in one shard, the shards near equal in bytes."""
    rows = stored(sized(docs, id_column, text_column), "sized")
    groups = stored(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    large, small = group_shards(groups, shards)
    large = F.broadcast(large)
    dealt = rows.join(large, "digest").unionByName(rows.join(large, "digest", "left_anti").join(small, "digest"))
    dealt = dealt.select("id", "size", "text_crc32", "shard", F.spark_partition_id().alias("part"))
    placed = stored(dealt.mapInArrow(_slots(shards), "id bigint, size bigint, text_crc32 bigint, shard int, part int, place bigint"), "placed")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return placed.join(offsets, ["shard", "part"]).select("id", "size", "text_crc32", "shard", (F.col("place") + F.col("base")).alias("slot"))
