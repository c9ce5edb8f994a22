"""Exact duplicates through a persistent digest index (operator 8)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.scratch import save, scratch_path

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Digests per bucket that the number of buckets is chosen for when an index is made.
PER_BUCKET = 4_000_000
COLUMNS = "digest BINARY, keep_id {kind}, group_size BIGINT, batch INT"


def normal_text(text: str = "text") -> Column:
    """Only A-Z lower-cased; null counts as empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)


class DigestIndex:
    """A table of digests, bucketed and sorted by digest, that outlives a session in its folder.

    One row per digest: ``digest`` (32 bytes), ``keep_id`` (the row that stays), ``group_size``
    (equal rows in the batch that brought the digest), ``batch`` (its number).  The folder also holds a
    description (``about``): the number of buckets and the type of the ids, which hold for all its sessions.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, buckets: int | None = None, kind: str | None = None):
        """``kind`` is the type of the ids.  Of an index that is there, both may be left out; others than its own are refused."""
        self.spark, self.path, self.name = spark, path, name
        self.data, self.about = f"{path}/digests", f"{path}/about"
        held = self._described()
        if held is None:
            self.buckets, self.kind, self.batches = buckets, kind or "bigint", 0
            if buckets:
                self._create()
            return
        self.buckets, self.kind = held["buckets"], held["kind"]
        if buckets not in (None, self.buckets) or kind not in (None, self.kind):
            raise ValueError(f"the index in {path} has {self.buckets} buckets and ids of type {self.kind}")
        self._register()
        self.batches = (spark.table(name).agg(F.max("batch")).first()[0] or 0) + 1

    @property
    def columns(self) -> str:
        return COLUMNS.format(kind=self.kind)

    def _described(self) -> Row | None:
        try:
            return self.spark.read.schema("buckets int, kind string").json(self.about).first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _create(self) -> None:
        described = self.spark.createDataFrame([(self.buckets, self.kind)], "buckets int, kind string")
        described.coalesce(1).write.mode("overwrite").json(self.about)
        self._register()

    def _register(self) -> None:
        self.drop_entry()
        self.spark.sql(
            f"CREATE TABLE {self.name} ({self.columns}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.data}'"
        )

    def add(self, rows: DataFrame, batch: int | None = None) -> DataFrame:
        """Take in ``digest, doc_id``; returns the digests that were new, one row each.

        Equal rows of the batch are counted before the shuffle; the row with the largest id stays.
        What the index has already is left out by a sort-merge anti-join on the buckets, and the
        rest is appended.  A batch that is taken in again under its number, after a failure or not, appends only what
        is missing, and the answer is all that the batch brought.
        """
        batch = self.batches if batch is None else batch
        grouped = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        if self.buckets is None:
            grouped = save(grouped, "grouped")
            self.buckets = max(8, -(-grouped.count() // PER_BUCKET))
            self._create()
        known = self.spark.table(self.name)
        again = batch < self.batches
        earlier = save(known.filter(F.col("batch") == batch), "earlier_digests") if again else None
        new = grouped.join(known.select("digest").hint("merge"), "digest", "left_anti")
        new = save(new.withColumn("batch", F.lit(batch)), "new_digests")
        dealt = new.repartition(self.buckets, "digest").sortWithinPartitions("digest")
        dealt.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.data).saveAsTable(self.name)
        self.batches = max(self.batches, batch + 1)
        return earlier.unionByName(new) if again else new

    def drop_entry(self) -> None:
        """Forget the table's name; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """For every row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty.  Of equal
    rows of a batch the one with the largest id stays; if ``index`` had the digest before, its
    row stays and none of the batch.  A row with a null id never stays unless all ids of its
    group are null (``keep_id`` is null then, and ``kept`` false).  Ids may be of any type that has an order.  Rows that share the id that
    stays are all marked as kept.  An empty table gives no rows; other columns are not read.
    """
    spark, kind = docs.sparkSession, docs.schema[id_column].dataType
    kind = "bigint" if isinstance(kind, T.NumericType) else kind.simpleString()
    digests = docs.select(F.col(id_column).cast(kind).alias("doc_id"), F.unhex(F.sha2(normal_text(text), 256)).alias("digest"))
    digests = save(digests, "digests")
    own = index is None
    if own:
        path = scratch_path(spark, "digest_index")
        index = DigestIndex(spark, path, "digest_index_" + path[-32:], kind=kind)
    index.add(digests)
    if own:
        index.drop_entry()
    # Read by path and not by bucket, so that both sides are shuffled and a hot digest can be split.
    known = spark.read.schema(index.columns).parquet(index.data).select("digest", "keep_id", "group_size")
    return digests.join(known, "digest").select(
        F.col("doc_id").alias(id_column),
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
