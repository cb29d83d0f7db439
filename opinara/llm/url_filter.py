"""URL filters: allow and block rules, and a Bloom filter cascade for the listed keys.

The cascade is built over the corpus's complete key universe: level 1 holds the listed keys, level 2 the other keys that
level 1 lets through by mistake, level 3 the listed keys that level 2 lets through, and so on until nothing is let through
by mistake. For every key of the universe the number of levels it passes tells exactly whether it is listed, without a
join: each task probes the filters, which are broadcast behind a check of their size.

Defined cases: a null URL, or one without '://', has an empty host and path, hence no keys and the verdict 'allow'.
Repeated rows each get their row; a null page id stays null; other columns are ignored; an empty list allows everything.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.shared import ascii_lower, by_batch, stored

#: Bytes of a filter that one group of a task combines.
SEGMENT = 1 << 16


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and all its subdomains where the URL's path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Position of the longest rule that fits in ``rules``; null if none does. Equal lengths: the longer host, then block."""
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].text), -len(rules[i].host), rules[i].verdict != "block"))
    if not order:
        return F.lit(None).cast("int")
    fits = [
        F.when(((host == rules[i].host) | host.endswith("." + rules[i].host)) & path.startswith(rules[i].path), F.lit(i)) for i in order
    ]
    return F.coalesce(*fits)


def keys_of(host: Column, path: Column) -> Column:
    """What a list may name of a URL: its host, each parent domain, and the host with the path."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.concat(suffixes, F.when(F.startswith(path, F.lit("/")), F.array(F.concat(host, path))).otherwise(F.array().cast("array<string>"))))
    )


class Cascade:
    """Alternating Bloom filters. ``member`` is exact for every key of the universe it was built over."""

    def __init__(self, levels: list[tuple[np.ndarray, int, int]]):
        self.levels = levels

    @staticmethod
    def positions(keys: Sequence[bytes], level: int, bits: int, hashes: int) -> np.ndarray:
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k, seed=level) for k in keys), np.uint64).reshape(-1, 2)
        steps = np.arange(hashes, dtype=np.uint64)
        return (digests[:, :1] + steps[None, :] * (digests[:, 1:] | np.uint64(1))) % np.uint64(bits)

    def passes(self, keys: Sequence[bytes], level: int) -> np.ndarray:
        filled, bits, hashes = self.levels[level]
        at = self.positions(keys, level, bits, hashes)
        return ((filled[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    def member(self, keys: Sequence[bytes]) -> np.ndarray:
        passed = np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        for level in range(len(self.levels)):
            if not len(left):
                break
            left = left[self.passes([keys[i] for i in left], level)]
            passed[left] += 1
        return passed % 2 == 1


def _filter_of(keys: DataFrame, level: int, n: int, rate: float) -> tuple[np.ndarray, int, int]:
    """A Bloom filter of ``keys`` (key): tasks find the bytes that they set, others combine them to segments, which travel whole."""
    bits = max(64, 8 * math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 8))
    hashes = max(1, round(bits / n * math.log(2)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = Cascade.positions([k.encode() for k in batch.column(0).to_pylist()], level, bits, hashes).ravel()
        place, inverse = np.unique(at >> np.uint64(3), return_inverse=True)
        value = np.zeros(len(place), np.uint8)
        np.bitwise_or.at(value, inverse, np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        return pa.record_batch([pa.array(place.view(np.int64)), pa.array(value.astype(np.int32))], names=["place", "value"])

    def combine(group: pa.Table) -> pa.Table:
        segment = group["segment"][0].as_py()
        filled = np.zeros(SEGMENT, np.uint8)
        np.bitwise_or.at(filled, group["place"].to_numpy() - segment * SEGMENT, group["value"].to_numpy().astype(np.uint8))
        return pa.table({"segment": pa.array([segment], pa.int64()), "filled": pa.array([filled.tobytes()], pa.binary())})

    rows = keys.select("key").mapInArrow(by_batch(run), "place bigint, value int").withColumn("segment", F.floor(F.col("place") / SEGMENT))
    filled = np.zeros((bits // 8 // SEGMENT + 1) * SEGMENT, np.uint8)
    for r in rows.groupBy("segment").applyInArrow(combine, "segment bigint, filled binary").toLocalIterator():
        filled[r.segment * SEGMENT : (r.segment + 1) * SEGMENT] = np.frombuffer(r.filled, np.uint8)
    return filled[: bits // 8 + 1], bits, hashes


def build_cascade(universe: DataFrame, max_megabytes: int = 64, first_rate: float = 0.1, rate: float = 0.5) -> Cascade:
    """Cascade over ``universe`` (key string, listed boolean), each key once.

    All levels together must fit ``max_megabytes``, since they are broadcast; :func:`judge` gives a larger universe in parts.
    """
    cascade = Cascade([])
    spark = universe.sparkSession
    inside, outside = universe.where("listed").select("key"), universe.where("NOT listed").select("key")
    while n := inside.count():
        level = len(cascade.levels)
        chance = first_rate if level == 0 else rate
        total = sum(len(filled) for filled, _, _ in cascade.levels) + n * -math.log(chance) / math.log(2) ** 2 / 8
        if total > max_megabytes * 2**20:
            raise ValueError(f"the listed keys need over {max_megabytes} MB of filters; give them in parts")
        if level >= 128:
            raise ValueError("the universe repeats a key both as listed and as not listed")
        cascade.levels.append(_filter_of(inside, level, n, chance))
        shared = spark.sparkContext.broadcast(cascade)

        def let_through(batch: pa.RecordBatch, shared=shared, level=level) -> pa.RecordBatch:
            keep = shared.value.passes([k.encode() for k in batch.column(0).to_pylist()], level) if batch.num_rows else []
            return batch.filter(pa.array(keep, pa.bool_()))

        mistaken = stored(outside.mapInArrow(by_batch(let_through), "key string"), "cascade")
        inside, outside = mistaken, inside
    return cascade


def judge(
    pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, id_column: str = "page_id", url_column: str = "url", max_megabytes: int = 64
) -> DataFrame:
    """(id, host, path, rule, verdict) per row of ``pages``: the longest fitting rule's verdict, else 'block' if the URL's
    host, one of its parent domains or the host with the path is among ``listed`` (key), else 'allow'."""
    url = F.coalesce(F.col(url_column).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_column).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("keys", keys_of(F.col("host"), F.col("path")))
    corpus = rows.select(F.explode("keys").alias("key"), F.lit(False).alias("listed"))
    named = listed.where("key IS NOT NULL").select(F.col("key").cast("string").alias("key"), F.lit(True).alias("listed"))
    universe = stored(corpus.unionAll(named).groupBy("key").agg(F.max("listed").alias("listed")), "universe")
    numbers = dict(universe.groupBy("listed").count().collect())
    # bits of all levels: each halves the one before the last, the first lets a tenth of the other keys through
    bits = 6.3 * numbers.get(True, 0) + 0.3 * numbers.get(False, 0)
    parts = math.ceil(1.3 * bits / (8 * 2**20 * max_megabytes)) or 1

    def probe(cascade: Broadcast):
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys = batch.column(3)
            flat = [k.encode() for k in keys.flatten().to_pylist()]
            member = cascade.value.member(flat) if flat else np.zeros(0, bool)
            ends = np.concatenate(([0], np.cumsum(member)))
            offsets = keys.offsets.to_numpy() - keys.offsets[0].as_py()
            hit = (ends[offsets[1:]] > ends[offsets[:-1]]) | batch.column(5).to_numpy(zero_copy_only=False)
            return pa.record_batch([*batch.columns[:3], batch.column(4), pa.array(hit)], names=["id", "host", "path", "keys", "hit"])

        return run

    judged = rows.withColumn("hit", F.lit(False))
    of_part = F.pmod(F.xxhash64("key"), F.lit(parts))
    for part in range(parts):  # one part is the rule; the verdicts so far are stored before the next part's filters are sent
        shared = pages.sparkSession.sparkContext.broadcast(build_cascade(universe.where(of_part == part), max_megabytes))
        own = F.filter("keys", lambda k: F.pmod(F.xxhash64(k), F.lit(parts)) == part) if parts > 1 else F.col("keys")
        judged = judged.select("id", "host", "path", own.alias("own"), "keys", "hit").mapInArrow(by_batch(probe(shared)), judged.schema)
        if part < parts - 1:
            judged = stored(judged, "url-verdicts")
            shared.destroy()
    which = fitting_rule(F.col("host"), F.col("path"), rules)
    texts = F.array(*[F.lit(r.text) for r in rules]) if rules else F.array().cast("array<string>")
    verdicts = F.array(*[F.lit(r.verdict) for r in rules]) if rules else F.array().cast("array<string>")
    return judged.withColumn("which", which).select(
        "id", "host", "path",
        F.when(F.col("which").isNotNull(), F.get(texts, F.col("which"))).alias("rule"),
        F.coalesce(F.get(verdicts, F.col("which")), F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"),
    )
