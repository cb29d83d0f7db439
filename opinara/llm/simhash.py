"""Near duplicates by SimHash, found with pivot distance tables.

Equal fingerprints are one node. Two fingerprints that differ in at most ``radius`` bits agree in at least
``blocks - radius`` of ``blocks`` blocks of bits, so every pair to be linked meets under one of the keys made of that many
blocks. Under a key, a table holds the Hamming distance of each fingerprint to many reference fingerprints; by the
triangle inequality a pair whose distances to any reference differ by more than ``radius`` can't be a link and is
discarded, the survivors are verified bit by bit. (Pivot tables alone would have to compare all pairs.)

The number of blocks follows from the number of fingerprints (``blocks_for``): more blocks are more keys of more bits, so a
fingerprint shares its keys with a bounded number of unrelated ones however many there are. The links are the same.

A key with many fingerprints is cut into blocks of ``HOT`` rows and each pair of blocks is a group of its own. From a
group only a spanning forest of its links leaves the task, never its pairs.

Defined cases: a null text has no words, like an empty one; no words give fingerprint zero, linked like any other. Rows
may repeat and ids may be null: a null id never becomes a component's id unless all its ids are null. Other columns are
ignored whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.shared import by_batch, components, stored, utf8

BITS = 64
SEED = 42
#: Reference fingerprints; drawn once, the same everywhere.
PIVOTS = np.random.default_rng(7).integers(0, 2**63, 24, dtype=np.uint64) * np.uint64(2) + np.arange(24, dtype=np.uint64) % np.uint64(2)
#: Fingerprints under one key in one group.
HOT = 2048
CHUNK = 1 << 16
#: Unrelated fingerprints that one may share its keys with, about, before there are more blocks.
PARTNERS = 1 << 10


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of one text: a bit is set if it is in over half the shingles' XXH64."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), CHUNK):
        part = list(zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True))
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in part), np.uint64, len(part))
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts)).view(">u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp) per row of ``docs``; fp is the fingerprint as a signed 64-bit number."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.fromiter((fingerprint(t, shingle) for t in utf8(batch.column(1))), np.uint64, batch.num_rows)
        return pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(by_batch(run), "id bigint, fp bigint")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def blocks_for(n: int, radius: int, least: int = 2) -> int:
    """Blocks so that ``n`` evenly spread fingerprints have about ``PARTNERS`` partners each under all keys, or fewer.

    A key has all blocks but ``radius``, about 64 (blocks - radius) / blocks bits; ``least`` of them at any size.
    """
    blocks = radius + least
    while blocks < BITS and comb(blocks, radius) * n > PARTNERS << (BITS * (blocks - radius) // blocks):
        blocks += 1
    return blocks


def block_masks(radius: int, blocks: int) -> list[int]:
    """One mask for each choice of blocks - radius blocks."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(masks, blocks - radius)]


def _signed(number: int) -> int:
    return number - 2**64 if number >= 2**63 else number


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, least node) of the components of a local graph."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, label[a], label[b])
        np.minimum.at(label, label[b], label[a])
        label = label[label]
        if (label == before).all():
            break
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _links(group: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of the same group; rows come sorted by group."""
    table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    us, vs, held = [], [], 0
    left = np.arange(len(fp))
    step = 0
    while True:
        step += 1
        left = left[left + step < len(fp)]
        left = left[group[left] == group[left + step]]
        if not len(left):
            break
        near = left
        for p in range(table.shape[1]):
            near = near[np.abs(table[near, p] - table[near + step, p]) <= radius]
        near = near[np.bitwise_count(fp[near] ^ fp[near + step]) <= radius]
        if len(near):
            us.append(fp[near]), vs.append(fp[near + step])
            held += len(near)
            if held > 1 << 20:
                u, v = _forest(np.concatenate(us), np.concatenate(vs))
                us, vs, held = [u], [v], len(u)
    if not us:
        return fp[:0], fp[:0]
    return _forest(np.concatenate(us), np.concatenate(vs))


def _link_groups(radius: int):
    """mapInArrow over rows sorted by group: whole groups are compared, the last of a batch waits for the next."""

    def compare(group: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        u, v = _links(group, fp.view(np.uint64), radius)
        if len(u):
            yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            group = np.concatenate((group, batch.column(0).to_numpy()))
            fp = np.concatenate((fp, batch.column(1).to_numpy()))
            if not len(group):
                continue
            cut = np.searchsorted(group == group[-1], True)
            if cut:
                yield from compare(group[:cut], fp[:cut])
                group, fp = group[cut:], fp[cut:]
        if len(group):
            yield from compare(group, fp)

    return run


def links(nodes: DataFrame, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """A spanning set of the links between the distinct fingerprints ``nodes`` (fp): (u, v)."""
    if blocks is None:
        blocks = blocks_for(nodes.count(), radius)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(block_masks(radius, blocks))])
    keyed = nodes.select("fp", F.explode(keys).alias("key"))
    shared_keys = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("key", "k")
    rows = keyed.join(shared_keys, F.col("key") == F.col("k")).withColumn("parts", F.ceil(F.col("n") / HOT))
    own = F.pmod(F.xxhash64(F.lit("part"), "fp"), F.col("parts"))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    group = F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    grouped = rows.select(group.alias("g"), "fp").repartition("g").sortWithinPartitions("g")
    return grouped.mapInArrow(_link_groups(radius), "u bigint, v bigint").select(
        F.col("u"), F.col("v")
    )


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4, radius: int = 4, blocks: int | None = None
) -> DataFrame:
    """(id, fp, component_id) per row of ``docs``: component_id is the smallest id reachable over links, its own included."""
    rows = stored(fingerprints(docs, id_column, text_column, shingle), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), radius, blocks))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    named = rooted.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    return rows.join(named, F.col("fp") == F.col("f")).select("id", "fp", "component_id")
