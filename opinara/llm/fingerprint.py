"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame functions only.

A text's paragraphs (here its lines and sentences) are hashed to 64-bit digests, each once. A sketch has three rows of
cells; a digest goes into one cell of each row, which keeps the number, the XOR of the digests and the XOR of their
checks. Sketches of two versions subtract cell by cell; peeling takes out digests that stand alone in a cell until nothing
is left, which recovers exactly the digests that differ.

A sketch of ``WIDTH`` cells a row is a document's fingerprint. If the difference of two is too large to peel, the pair is
retried with a larger sketch that has room for all its digests; should that fail too, the digests are dealt to shards by
hash, about ``SHARD`` to each, every shard has a sketch of its own, and a shard that fails is retried with wider rows and
other hashes (after the last of them its few digests are compared directly).

The next document is met in key ranges that are found from quantiles of the ids; the first document of each range is a
guest in the range before. The texts are shuffled once; what follows stays in the same bucketed ranges.

Defined cases: a null text is empty; an empty text has no paragraph, and two empty ones are alike (1.0). Null ids come
before all others, equal ids in the order of their texts' hashes; a single row is its own next. Repeated rows each get a
row. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm.shared import shared_folder

PARAGRAPH_ENDS = r"[.!?]\s+|\n"
ROWS = 3
WIDTH = 10
SHARD = 5
ROOM = 16
RETRIES = ((1, 6), (2, 16), (3, 50))
RANGE_BYTES = 2 << 20
SIDE = 128  # ranges: at most SIDE * SIDE

def digests(text: Column, ends: str = PARAGRAPH_ENDS) -> Column:
    """The distinct digests of a text's paragraphs."""
    return F.array_distinct(F.transform(F.filter(F.split(text, ends), lambda p: p != ""), lambda p: F.xxhash64(p)))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _placed(values: Column, width: int, seed: int, n: Callable[[Column], Column], key: Callable[[Column], Column]) -> Column:
    """Each digest with its number, its check and its cell in each row."""

    def one(value: Column) -> Column:
        spread = F.xxhash64(key(value), F.lit(seed)) if seed else key(value)
        places = [F.pmod(F.shiftright(spread, 16 * row), F.lit(width)).cast("int").alias(f"p{row}") for row in range(ROWS)]
        return F.struct(n(value).alias("n"), key(value).alias("key"), F.hash(key(value), F.lit(17)).alias("check"), *places)

    return F.transform(values, one)


def _add(cell: Column, other: Column, n: Column) -> Column:
    return F.struct(n.alias("n"), cell["key"].bitwiseXOR(other["key"]).alias("key"), cell["check"].bitwiseXOR(other["check"]).alias("check"))


def sketch(values: Column, width: int = WIDTH, seed: int = 0) -> Column:
    """Cells of all rows, one row after the other: array<struct<n, key, check>>."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("key"), F.lit(0).alias("check"))

    def filled(placed: Column) -> Column:
        def cells(row: int) -> Column:
            def cell(i: Column) -> Column:
                return F.aggregate(F.filter(placed, lambda x: x[f"p{row}"] == i), empty, lambda c, x: _add(c, x, c["n"] + 1))

            return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), cell)

        return F.concat(*[cells(row) for row in range(ROWS)])

    return _bound(_placed(values, width, seed, lambda x: F.lit(1), lambda x: x), filled)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _add(x, y, x["n"] - y["n"]))


def peel(cells: Column, width: int = WIDTH, seed: int = 0, rounds: int = 12) -> Column:
    """struct<cells, found, live>: the digests recovered with their side (1 or -1), and what is left of the cells."""

    def alone(cells: Column) -> Column:
        pure = F.filter(cells, lambda c: (F.abs(c["n"]) == 1) & (c["check"] == F.hash(c["key"], F.lit(17))))
        once = F.array_distinct(F.transform(pure, lambda c: F.struct(c["key"].alias("key"), c["n"].alias("n"))))
        return _placed(once, width, seed, lambda c: c["n"], lambda c: c["key"])

    def without(cells: Column, pure: Column) -> Column:
        def part(row: int) -> Column:
            def cell(c: Column, i: Column) -> Column:
                return F.aggregate(F.filter(pure, lambda p: p[f"p{row}"] == i), c, lambda left, p: _add(left, p, left["n"] - p["n"]))

            return F.transform(F.slice(cells, row * width + 1, width), cell)

        return F.concat(*[part(row) for row in range(ROWS)])

    def one_round(state: Column) -> Column:
        def taken(pure: Column) -> Column:
            found = F.transform(pure, lambda p: F.struct(p["key"].alias("key"), p["n"].alias("n")))
            return F.when(
                F.size(pure) > 0, F.struct(without(state["cells"], pure).alias("cells"), F.concat(state["found"], found).alias("found"), F.lit(True).alias("live"))
            ).otherwise(F.struct(state["cells"].alias("cells"), state["found"].alias("found"), F.lit(False).alias("live")))

        return F.when(state["live"], _bound(alone(state["cells"]), taken)).otherwise(state)

    nothing = F.array().cast("array<struct<key:bigint,n:int>>")
    start = F.struct(cells.alias("cells"), nothing.alias("found"), F.lit(True).alias("live"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda s, _: one_round(s))


def is_empty(cells: Column) -> Column:
    return F.forall(cells, lambda c: (c["n"] == 0) & (c["key"] == 0) & (c["check"] == 0))


def recovered(peeled: Column) -> Column:
    """How many digests differ; null if peeling failed."""
    return _bound(peeled, lambda p: F.when(is_empty(p["cells"]), F.size(p["found"])))


def retried(a: Column, b: Column) -> Column:
    """How many of a shard's digests differ, by sketches that grow until one can be peeled."""
    tries = [recovered(peel(subtract(sketch(a, w, s), sketch(b, w, s)), w, s)) for s, w in RETRIES]
    return F.coalesce(*tries, F.size(F.array_except(a, b)) + F.size(F.array_except(b, a)))


def likeness(a: Column, b: Column, differ: Column) -> Column:
    """Jaccard similarity of sets of sizes a and b that differ in so many elements."""
    return F.when(a + b + differ == 0, 1.0).otherwise((a + b - differ) / (a + b + differ))


def as_text(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda c: F.lower(F.concat(F.hex(c["n"]), F.lit("."), F.hex(c["key"]), F.lit("."), F.hex(c["check"])))), "-")


def _ranges(docs: DataFrame) -> DataFrame:
    """``docs`` (id, text) with the range of its id and the texts' order in it; the first of each range also as a guest of
    the range before."""
    size, rows = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    n = max(1, min(SIDE * SIDE, (size or 0) // RANGE_BYTES + 1))
    points = docs.agg(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    points = sorted(set(points))[: n - 1] if n > 1 else []
    inner = [points[i : i + SIDE] for i in range(0, len(points), SIDE)]
    if points:
        blocks = F.array(*[F.array(*[F.lit(p).cast("bigint") for p in block]) for block in inner])
        outer = F.array(*[F.lit(block[-1]).cast("bigint") for block in inner])
        smaller = lambda array: F.size(F.filter(array, lambda p: p < F.col("id")))
        block = F.least(smaller(outer), F.lit(len(inner) - 1))
        place = F.when(F.col("id").isNull(), 0).otherwise(block * SIDE + smaller(F.get(blocks, block)))
    else:
        place = F.lit(0)
    order = docs.withColumn("h", F.xxhash64("text")).withColumn("bucket", place.cast("int"))
    first = F.min(F.struct(F.col("id").isNotNull().alias("has_id"), "id", "h")).alias("first")
    firsts = sorted(order.groupBy("bucket").agg(first).select("bucket", "first.id", "first.h").collect())  # one row per range
    guests = None
    if firsts:
        before = [firsts[i - 1].bucket for i in range(len(firsts))]
        names = order.sparkSession.createDataFrame([(f.id, f.h, b) for f, b in zip(firsts, before, strict=True)], "first_id bigint, first_h bigint, host int")
        asked = F.col("id").isin([f.id for f in firsts if f.id is not None])
        asked = asked | F.col("id").isNull() if any(f.id is None for f in firsts) else asked
        guests = order.where(asked).join(F.broadcast(names), F.col("id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h")))
        guests = guests.dropDuplicates(["host"]).select("id", "text", "h", F.col("host").alias("bucket"), F.lit(True).alias("guest"))
    order = order.select("id", "text", "h", "bucket", F.lit(False).alias("guest"))
    return order.unionAll(guests) if guests is not None else order


def _single(pair: DataFrame, size: Column) -> DataFrame:
    """A row for each digest of the pairs: its side (1 or -1) and the size of its pair's sketch."""
    sided = lambda side, n: F.transform(side, lambda x: F.struct(x.alias("x"), F.lit(n).alias("side")))
    rows = pair.select("bucket", "uid", "of", size.cast("bigint").alias("size"), F.explode(F.concat(sided("a", 1), sided("b", -1))).alias("d"))
    return rows.select("bucket", "uid", "of", "size", "d.x", "d.side")


def _wide_sketches(pair: DataFrame) -> DataFrame:
    """First retry, (bucket, uid, of, differ, whole): a sketch with ``ROOM`` cells a row for each digest of the pair, kept as
    rows of the cells in use. With that room one round of peeling nearly always recovers all; ``whole`` tells."""
    key = ["bucket", "uid", "of"]
    rows = _single(pair, ROOM * (F.size("a") + F.size("b"))).withColumn("row", F.explode(F.array(*[F.lit(r) for r in range(ROWS)])))
    check = lambda x: F.hash(x, F.lit(17)).cast("bigint")
    cell = F.pmod(F.xxhash64("x", F.col("row") + 101), F.col("size"))
    cells = rows.groupBy(*key, "row", cell.alias("cell")).agg(F.sum("side").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor(check(F.col("x"))).alias("check"))
    alone = F.when((F.abs("n") == 1) & (F.col("check") == check(F.col("x"))), F.col("x"))
    first = F.col("row") == 0  # every digest is in one cell of the first row
    found = cells.groupBy(*key, alone.alias("alone")).agg(F.max("n").alias("side"), F.bit_xor(F.when(first, F.col("x"))).alias("all"), F.sum(F.when(first, F.col("n"))).alias("sides"))
    is_found = F.col("alone").isNotNull()
    none = F.lit(0).cast("bigint")
    return found.groupBy(*key).agg(
        F.count("alone").cast("bigint").alias("differ"),
        ((F.coalesce(F.bit_xor("alone"), none) == F.coalesce(F.bit_xor("all"), none)) & (F.coalesce(F.sum(F.when(is_found, F.col("side"))), none) == F.sum("sides"))).alias("whole"),
    )


def _sharded_sketches(pair: DataFrame) -> DataFrame:
    """Further retries, (bucket, uid, of, differ): sketches of about ``SHARD`` digests each, retried until they peel."""
    rows = _single(pair, F.ceil((F.size("a") + F.size("b")) / SHARD)).withColumn("shard", F.pmod(F.xxhash64("x", F.lit(0)), F.col("size")))
    sides = [F.collect_list(F.when(F.col("side") == n, F.col("x"))).alias(name) for name, n in (("a", 1), ("b", -1))]
    differ = rows.groupBy("bucket", "uid", "of", "shard").agg(*sides).withColumn("differ", retried(F.col("a"), F.col("b")))
    return differ.groupBy("bucket", "uid", "of").agg(F.sum("differ").cast("bigint").alias("differ"))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of ``docs``: (id, n_chars, edited_sha256, cells, edited_cells, near_edited, near_next).

    The edited text has the last quarter of its characters replaced by as many of the next document's first ones.
    ``cells`` are the sketches of the text and the edited text; the likenesses compare the text with its edited text and
    with the next document's.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("bucket").orderBy("guest", F.asc_nulls_first("id"), "h")
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    met = _ranges(rows).withColumn("after", F.lead("text").over(order))
    met = met.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - quarter), F.substring(F.coalesce("after", F.lit("")), F.lit(1), quarter)))
    met = met.select("bucket", "guest", "id", "h", n.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("a"), digests(F.col("edited")).alias("e"))
    met = met.withColumn("cells", sketch(F.col("a"))).withColumn("edited_cells", sketch(F.col("e")))
    met = met.withColumn("b", F.lead("a").over(order)).withColumn("next_cells", F.lead("cells").over(order)).where("NOT guest")
    met = met.withColumn("differ_edited", recovered(peel(subtract(F.col("cells"), F.col("edited_cells")))))
    met = met.withColumn("differ_next", recovered(peel(subtract(F.col("cells"), F.col("next_cells")))))
    kind = "array<struct<of:string,a:array<bigint>,b:array<bigint>>>"
    again = lambda name, b: F.when(
        F.col(f"differ_{name}").isNull(), F.array(F.struct(F.lit(name).alias("of"), F.col("a").alias("a"), F.col(b).alias("b")))
    ).otherwise(F.array().cast(kind))
    met = met.select(
        "bucket", F.monotonically_increasing_id().alias("uid"), "id", "n_chars", "edited_sha256", "cells", "edited_cells", "differ_edited", "differ_next",
        F.size("a").alias("n_a"), F.size("e").alias("n_e"), F.size("b").alias("n_b"), F.concat(again("edited", "e"), again("next", "b")).alias("again"),
    )
    name = f"fingerprints_{uuid.uuid4().hex}"
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met.write.format("parquet").option("path", f"{shared_folder(spark)}/{name}").bucketBy(buckets, "bucket").saveAsTable(name)
    found = spark.table(name)

    pair = found.select("bucket", "uid", F.explode("again").alias("p")).select("bucket", "uid", "p.of", "p.a", "p.b")
    once = _wide_sketches(pair)
    stuck = once.where("NOT whole").select(F.col("bucket").alias("k"), F.col("uid").alias("u"), F.col("of").alias("o"))
    left = pair.join(stuck, (F.col("bucket") == F.col("k")) & (F.col("uid") == F.col("u")) & (F.col("of") == F.col("o")), "left_semi")
    differ = once.where("whole").select("bucket", "uid", "of", "differ").unionByName(_sharded_sketches(left))
    more = differ.groupBy(F.col("bucket").alias("k"), F.col("uid").alias("u")).agg(
        F.sum(F.when(F.col("of") == "edited", F.col("differ"))).alias("more_edited"), F.sum(F.when(F.col("of") == "next", F.col("differ"))).alias("more_next")
    )
    joined = found.join(more, (F.col("bucket") == F.col("k")) & (F.col("uid") == F.col("u")), "left")
    return joined.select(
        "id", "n_chars", "edited_sha256", "cells", "edited_cells",
        likeness(F.col("n_a"), F.col("n_e"), F.coalesce("differ_edited", "more_edited", F.lit(0))).alias("near_edited"),
        likeness(F.col("n_a"), F.col("n_b"), F.coalesce("differ_next", "more_next", F.lit(0))).alias("near_next"),
    )
