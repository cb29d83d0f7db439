"""Review files in, tables and reports out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from opinara import settings
from opinara.functions.numbers import to_number

ORDER = "_order"
#: A kept review's city as the file spells it.
SPELLING = "_city_spelling"


def find_csv(spark: SparkSession, folder: str, preferred: str | None = None) -> list[str]:
    """Paths of all CSV files of a folder by name, or of the preferred one alone if it is there."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path")
        paths = [row["path"] for row in files.orderBy("path").collect()]
    except AnalysisException:
        paths = []
    if not paths:
        raise FileNotFoundError(f"no CSV file in {folder}")
    return [p for p in paths if preferred and p.endswith("/" + preferred)] or paths


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    multi_line: bool = False,
    null_texts: Sequence[str] = tuple(settings.NULL_TEXTS),
) -> DataFrame:
    """A UTF-8 CSV file (or folder, or several) with header, every column as text.

    Files are split over tasks. Quoted line breaks need ``multi_line``, which reads one file per task. All files must
    have the same header; another one is an error. Raises ValueError when there are no rows.
    """
    raw = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("encoding", "UTF-8")
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("enforceSchema", False)
        .csv(path if isinstance(path, str) else list(path))
    )
    if raw.isEmpty():
        raise ValueError(f"CSV is empty: {path}")
    blanked = [
        F.when(F.col(f"`{c}`").isin(list(null_texts)), None).otherwise(F.col(f"`{c}`")).alias(c) for c in raw.columns
    ]
    return raw.select(*blanked)


def with_order(df: DataFrame) -> DataFrame:
    """Adds the reading order. It follows the scan's splits, so apply it directly to a read."""
    return df.withColumn(ORDER, F.monotonically_increasing_id())


def numeric_columns(df: DataFrame) -> list[str]:
    """Text columns in which every present value is a number, found in one pass."""
    texts = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    if not texts:
        return []
    tests = [
        (F.count(F.col(f"`{c}`")) == F.count(to_number(F.col(f"`{c}`")))).alias(c) for c in texts
    ]
    row = df.agg(*tests).first()
    return [c for c in texts if row[c]]


def with_numbers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Casts numeric text columns to double; which ones is found out when not given."""
    names = numeric_columns(df) if columns is None else [c for c in columns if c in df.columns]
    return df.withColumns({c: to_number(F.col(f"`{c}`")) for c in names}) if names else df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option(
        "encoding", "UTF-8"
    ).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
