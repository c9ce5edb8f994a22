"""A corpus from raw documents to packed token windows, in stages that each call one operator."""

from __future__ import annotations

import os
import sys

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewatch.functions.scratch import save  # noqa: E402
from tidewatch.llm.exact import exact_groups  # noqa: E402
from tidewatch.llm.language import UNKNOWN, Languages, identify  # noqa: E402
from tidewatch.llm.packing import pack_documents  # noqa: E402
from tidewatch.llm.simhash import simhash_groups  # noqa: E402
from tidewatch.llm.toxicity import Toxicity, score_texts  # noqa: E402

#: Share of its text that a document's main language must have.
LEAST_SHARE = 0.3
#: Words of a shingle, and differing bits at which fingerprints link.
NEAR_WORDS, NEAR_BITS = 4, 4


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that are toxic more likely than not; learned from the labels of all documents given.

    Null ids and null texts are scored like others (null counts as empty, which is not toxic);
    rows that share an id are scored each by its own text.  No documents: none left.
    """
    model = Toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _opened(score_texts(_wrapped(docs), model).filter("predicted = 0"), docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents without a language: no text, no letters, or no language with ``LEAST_SHARE`` of the text.

    Ids are not looked at; null texts go.  No documents: none left.
    """
    known = identify(_wrapped(docs), Languages.fit(docs))
    return _opened(known.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SHARE)), docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of those with equal text: that with the largest id.

    Rows are told apart by their place in the files and not by id, so a text that stands once
    stays whatever other rows share its id.  Of rows that share the largest id, or if all ids of
    a text are null, the last by place stays.  Null and empty texts are equal.  No documents: none left.
    """
    rows = _placed(docs, F.col("doc_id").isNotNull())
    return _without(rows, exact_groups(rows, "place").filter("NOT kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of those connected by fingerprints: that with the smallest id, of equal ids the first by place.

    Fingerprints are those of ``NEAR_WORDS``-word shingles and link at ``NEAR_BITS`` or fewer
    differing bits.  Rows with a null id are linked too and stay only if all ids of their group
    are null (the first by place does).  Null texts and texts without words link with each other.
    """
    rows = _placed(docs, F.col("doc_id").isNull())
    return _without(rows, simhash_groups(rows, "place", words=NEAR_WORDS, limit=NEAR_BITS).filter("place != component_id"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of all documents left; a null text is empty and gives its end token, a null id stays null."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def _wrapped(docs: DataFrame) -> DataFrame:
    """The text, and all other columns as one, so that none clashes with what an operator adds."""
    return docs.select("text", F.struct(F.lit(0).alias("_"), *[docs[c] for c in docs.columns if c != "text"]).alias("row"))


def _opened(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def _placed(docs: DataFrame, first: Column) -> DataFrame:
    """The rows of ``docs`` as ``row``, ``text``, and ``place``: what orders them, ending with the row's place in its file.

    Places come with the scan of the files; rows that are not read from files are written first.
    """
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = save(docs, "rows")
    place = F.struct(
        first.alias("first"),
        F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("id"),
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("at"),
    )
    return docs.select(F.struct(*docs.columns).alias("row"), "text", place.alias("place"))


def _without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``_placed`` whose place is not among those dropped; few are, so texts need not be shuffled if their places fit a broadcast."""
    keys = dropped.select(F.col("place.file").alias("file"), F.col("place.at").alias("at"))
    found = rows.select("row", F.col("place.file").alias("file"), F.col("place.at").alias("at"))
    return found.join(keys, ["file", "at"], "left_anti").select("row.*")


STAGES = [
    ("toxicity", toxicity),
    ("language", language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

#: The stages learn from the data and compare fingerprints, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    return docs
