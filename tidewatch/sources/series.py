"""Reading and writing series as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.scratch import save
from tidewatch.operators.index import broadcast_if_small


def series_schema(width: int) -> T.StructType:
    """``width`` numeric columns, then the label."""
    features = [T.StructField(f"f{i}", T.DoubleType()) for i in range(width)]
    return T.StructType([*features, T.StructField("label", T.StringType())])


def read_series(spark: SparkSession, path: str, schema: T.StructType | str, source: str = "csv") -> DataFrame:
    """A headerless CSV table (or Parquet) with ``idx``, the position in file order.

    Splits of a file are numbered by their place in the file, rows by their place in the
    split; one count per split turns that into a dense position without any shuffle of rows.
    The numbered rows are written once, so that both uses see the same splits.
    """
    reader = spark.read.schema(schema)
    raw = reader.csv(path, header=False) if source == "csv" else reader.format(source).load(path)
    numbered = save(
        raw.select(
            *raw.columns,
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "series",
    )
    splits = numbered.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    # one row per file split
    earlier = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")
    placed = numbered.join(
        broadcast_if_small(save(splits.select("_file", "_block", shift), "splits")), ["_file", "_block"]
    )
    return placed.select((F.col("_row") + F.col("_shift")).alias("idx"), *raw.columns)


def parse_column_kinds(lines: DataFrame, line: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """``name: kind`` entries separated by dots -> (ord, name, kind), per line."""
    entries = lines.select(*keep, F.posexplode(F.split(F.col(line), "[.]")).alias("ord", "entry"))
    parts = F.split("entry", ": ")
    return entries.filter(F.size(parts) > 1).select(
        *keep, F.col("ord").cast("long").alias("ord"), F.trim(parts[0]).alias("name"), parts[1].alias("kind")
    )


def read_column_kinds(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(name, kind) per column from a one-line description (a row per column of the table)."""
    rows = parse_column_kinds(spark.read.text(path)).orderBy("ord").collect()
    return [(r["name"], r["kind"]) for r in rows]


def write_series(df: DataFrame, path: str, columns: Sequence[str] | None = None, mode: str = "errorifexists") -> None:
    """Headerless CSV files whose name order is the row order.  ``x`` is written as one column per feature."""
    columns = columns or [c for c in df.columns if c != "idx"]
    ordered = df.repartitionByRange("idx").sortWithinPartitions("idx")
    ordered.select(*columns).write.mode(mode).csv(path, header=False)


def spread_vector(df: DataFrame, width: int, vector: str = "x") -> DataFrame:
    """One column per feature, as the CSV form needs."""
    rest = [c for c in df.columns if c != vector]
    lead = [c for c in rest if c == "idx"]
    return df.select(*lead, *[F.col(vector)[i].alias(f"f{i}") for i in range(width)], *[c for c in rest if c != "idx"])
