"""Helpers of the operators: input tables, shared intermediate tables, Arrow plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z only; every other letter stays."""
    return F.translate(text, UPPER, UPPER.lower())


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach: spark.checkpoint.dir, or one of its own for a local session that has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="llm-shared-"))
    return context.getCheckpointDir().rstrip("/")


def stored_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there and every reader sees the same rows."""
    path = stored_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, which bounds what a task unpacks at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def by_batch(function: Callable[[pa.RecordBatch], pa.Table | pa.RecordBatch | None]):
    """A mapInArrow function that treats each part of a batch on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = function(batch)
            if out is not None:
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return run


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as bytes, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m) per edge (u, v): m is the least of u and the nodes that u has edges to.

    The second, redundant key has both sides dealt right before the join. Else the minima stay where the grouping left them,
    and AQE only splits the edges of a node that has very many if both sides come straight from a shuffle.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    return edges.join(least, (F.col("u") == F.col("c")) & (F.xxhash64("u") == F.xxhash64("c"))).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large and small stars: (node, root), root the smallest node reachable.

    ``edges`` has two bigint columns (u, v); loops and repeats are allowed. Nodes without an edge are left out. Each
    round shuffles the edges a few times and is stored, so lost executors repeat one round at most. No adjacency list
    is ever gathered: a node with many neighbours only meets their minimum, which is combined before the shuffle, and its
    edges are spread over tasks (``with_least``).
    """
    current = stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = with_least(large).select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").where("u != v").distinct()
        current = stored(small, "edges")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
                current.select(F.col("v").alias("node"), F.col("v").alias("root"))
            ).distinct()
        seen = state
