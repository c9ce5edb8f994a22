import os
import random
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.01"
#: Columns that operators use names of for themselves.
CLASHES = ["score", "fingerprint", "node", "label", "shard", "keep_id", "digest", "id", "body", "part", "predicted", "lang_pred", "row", "start"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())]
    + [T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHES]
)
WORDS = "the of and river stone house walks green idle cloud maker paper light never often seven brown large wide".split()


def odd_texts() -> list[tuple[int | None, str | None, str | None]]:
    """Ids, texts, and languages with nulls, empty and very long texts, ties, repeated rows, and odd characters."""
    draw = random.Random(5)
    line = lambda n: " ".join(draw.choice(WORDS) for _ in range(n))
    long = line(60_000)
    same, near = line(300), line(300)
    rows = [(1, None, None), (2, "", "en"), (3, None, "en"), (4, " \n\t ", None), (5, "!!! 123", "fr"), (6, "a", "en"), (7, "A", "en")]
    rows += [(8, long, "en"), (9, long.upper(), "en"), (None, same, "en"), (10, same, "en"), (10, same, "en"), (11, same.title(), "en"), (None, None, None)]
    rows += [(20 + i, near + f" {WORDS[i]}", "en") for i in range(8)]
    rows += [(40, "x" * 50_000, "en"), (41, "ab" * 20_000, "en"), (42, "café Été 中文 \U0001f600   İ é", "fr")]
    rows += [(43, "end<|endoftext|> of <|startoftext|>it  <|endoftext|>", "en"), (44, "Licensed under CC BY-NC 4.0. the MIT  License; mit license", "en")]
    rows += [(45, "GNU General Public\nLicense, version 3 gnu general public license", "en"), (46, "l 0 s e r", "en"), (47, line(4000), None)]
    rows += [(60 + i, line(20 + i), "en") for i in range(20)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(i, t, g, "s", 1, *["x"] * len(CLASHES)) for i, t, g in odd_texts()], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
