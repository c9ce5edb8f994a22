"""The given tables seen as indexed series, and the steps that many queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.models.base import Model, reconstruction_errors, score
from tidewatch.models.profile import Profile
from tidewatch.operators.errors import error_rows, fit_error_model
from tidewatch.operators.index import index_and_count, ordered_union
from tidewatch.operators.labels import minority_as_anomaly
from tidewatch.operators.project import filter_eq
from tidewatch.operators.split import Split, fit_split
from tidewatch.plans.initialize import init_windows
from tidewatch.plans.params import Params

LENGTH, PER_BATCH = 10, 8
# points over the threshold that flag a window, as for the published datasets with windows of ten rows
HARD = 4
WIDTH = {"U": 1, "M": 4, "E": 64, "D": 1}
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vector(*columns: str):
    return F.array(*[F.col(c).cast("double") for c in columns]).alias("x")


def raw_stream(spark: SparkSession, sf: str, stream: str) -> tuple[DataFrame, list[str]]:
    """Rows of a stream without positions, and the columns that order them."""
    if stream in ("U", "D"):
        events = table(spark, sf, "events")
        rows = events.select("event_id", "ts", "user_id", "event_type", vector("value"), (F.col("value") > 200).alias("is_anomaly"))
        return rows, ["ts", "event_id"]
    if stream == "M":
        rule = (F.col("l_quantity") >= 49) & (F.col("l_discount") >= 0.09)
        return table(spark, sf, "lineitem").select(*LINE_ORDER, vector(*MEASURES), rule.alias("is_anomaly")), LINE_ORDER
    if stream == "E":
        marked = minority_as_anomaly(table(spark, sf, "embeddings").withColumn("label", F.col("label").cast("string")))
        rows = marked.select(
            "vec_id", F.col("embedding").cast("array<double>").alias("x"), (F.col("label") == "anomaly.").alias("is_anomaly")
        )
        return rows, ["vec_id"]
    raise ValueError(stream)


def series(
    spark: SparkSession, sf: str, stream: str, keep: tuple[str, ...] = ("x", "is_anomaly")
) -> tuple[DataFrame, int]:
    """The stream with ``idx``, and its number of rows."""
    rows, order = raw_stream(spark, sf, stream)
    if stream == "D":
        return drifting(rows, order, keep)
    return index_and_count(rows, order, keep=keep)


def drifting(rows: DataFrame, order: list[str], keep: tuple[str, ...]) -> tuple[DataFrame, int]:
    """Views, then clicks at twice the value; labels still follow the plain value."""
    views, n = index_and_count(filter_eq(rows, "event_type", "view"), order, keep=keep)
    clicks, m = index_and_count(filter_eq(rows, "event_type", "click"), order, keep=keep)
    doubled = clicks.withColumn("x", F.transform("x", lambda v: v * 2))
    return ordered_union(views, doubled, sizes=[n, m]), n + m


def whole(stream: str, n: int, **changes) -> Params:
    """Initialization over the whole stream."""
    return Params(LENGTH, PER_BATCH, 8, WIDTH[stream], n, 1, 4, kind="profile", **changes)


def windows_of(spark: SparkSession, sf: str, stream: str) -> tuple[DataFrame, Split]:
    s, n = series(spark, sf, stream)
    windows = init_windows(s, whole(stream, n), n)
    return windows, fit_split(windows)


def fitted(spark: SparkSession, sf: str, stream: str) -> tuple[DataFrame, Split, Model]:
    """Windows, subsets, and a profile model with its error distribution (no threshold)."""
    windows, split = windows_of(spark, sf, stream)
    profile = Profile.fit(windows.filter(split.where("sn")), (LENGTH, WIDTH[stream]))
    vn1 = reconstruction_errors(windows.filter(split.where("vn1")), profile)
    return windows, split, Model(profile, fit_error_model(error_rows(vn1), WIDTH[stream]))


def scored(spark: SparkSession, sf: str, stream: str) -> tuple[DataFrame, Split, Model]:
    windows, split, model = fitted(spark, sf, stream)
    return score(windows, model), split, model


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, fractions rounded to six places without negative zero."""
    columns = []
    for field in df.schema:
        c = F.col(field.name)
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
            c = F.when(c == 0, F.lit(0.0)).otherwise(c)
        columns.append(c.alias(field.name))
    return df.select(*columns)
