"""Licence passages found by voting on diagonals (operator 4)."""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.scratch import save
from tidewatch.llm.text import LOWER, WORD_BYTES, gram_hashes, span_hashes, text_slices, word_bounds

#: Words per gram.
GRAM = 2
#: Diagonals this close are merged; the share of a template's words a span must hold, and the words of a template
#: up to which it must hold all.
REACH, LEAST_SHARE, SHORT = 3, 0.8, 10
#: Votes that a diagonal of a template with more than two grams needs to count at all (within a part of the template).
LEAST_VOTES = 2
#: Places of a template whose votes are the bits of one number; longer templates have several such parts.
BITS = 62


@dataclass(frozen=True)
class Template:
    """A passage that stands for a label; ``base`` ones only count where all words stand consecutively."""

    label: str
    words: str
    base: bool = False


#: The phrases that make base labels.
BASE = [
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
]
#: Passages of well-known licences and notices, and whole short licences.
PASSAGES = [
    Template("gpl-2.0", "gnu general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
        " public license as published by the free software foundation",
    ),
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction",
    ),
    Template("mit", "released under the mit license"),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that"
        " the following conditions are met",
    ),
    Template("cc-by-4.0", "cc by 4 0"),
    Template("cc-by-nc-4.0", "cc by nc 4 0"),
    Template("cc-by-sa-4.0", "cc by sa 4 0"),
    Template("cc-by-nc", "creative commons attribution noncommercial"),
    Template("cc-by-sa", "creative commons attribution sharealike"),
    Template("cc0", "has dedicated the work to the public domain by waiving all of his or her rights"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction including without limitation the"
        " rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit"
        " persons to whom the software is furnished to do so subject to the following conditions the above copyright notice"
        " and this permission notice shall be included in all copies or substantial portions of the software the software is"
        " provided as is without warranty of any kind express or implied including but not limited to the warranties of"
        " merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright"
        " holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise"
        " arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
        " provided that the above copyright notice and this permission notice appear in all copies the software is provided"
        " as is and the author disclaims all warranties with regard to this software including all implied warranties of"
        " merchantability and fitness in no event shall the author be liable for any special direct indirect or"
        " consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of"
        " contract negligence or other tortious action arising out of or in connection with the use or performance of this"
        " software",
    ),
]


def word_hashes(text: str) -> np.ndarray:
    data = LOWER[np.frombuffer(text.encode(), dtype=np.uint8)]
    return span_hashes(data, *word_bounds(data, np.array([0, len(data)]), WORD_BYTES)[:2])


def template_grams(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """``gram``, ``template``, ``place`` of every gram: as many rows as the templates have words."""
    rows = []
    for n, template in enumerate(templates):
        words = word_hashes(template.words)
        if len(words) < GRAM or template.base and len(words) > BITS:
            raise ValueError(f"a template needs {GRAM} words, and a base one at most {BITS}: {template.words}")
        rows += [(int(h), n, place) for place, h in enumerate(gram_hashes(words, GRAM).view(np.int64))]
    return spark.createDataFrame(rows, "gram long, template int, place int")


def _grams(batches):
    for batch in batches:
        held = []
        for _, _, data, offsets in text_slices(batch.column(2)):
            data = LOWER[data]
            starts, ends, first = word_bounds(data, offsets, WORD_BYTES)
            words = span_hashes(data, starts, ends)
            held += [gram_hashes(words[a:b], GRAM).view(np.int64) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        sizes = np.array([0, *map(len, held)], dtype=np.int32)
        flat = np.concatenate(held) if held else np.zeros(0, np.int64)
        grams = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), grams], names=["id", "body", "grams"])


def _counts(batches):
    for batch in batches:
        counts = [np.zeros(0, np.int64)]
        for _, _, data, offsets in text_slices(batch.column(2)):
            counts.append(np.diff(word_bounds(LOWER[data], offsets, WORD_BYTES)[2]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(counts), pa.int64())], names=["id", "body", "n_words"])


def ordered_spans(starts: list[int], parts: list[int], places: list[int], words: int) -> list[tuple[int, int, int]]:
    """Stretches of a text whose words follow a template: first word, end, and how many words of the template they hold in order.

    Matched grams are chained while both their place in the text and that in the template grow and the diagonal moves by
    no more than ``REACH``.  Of chains that overlap in the text the one with most words counts, of equal ones the first.
    """
    found = [(s + p * BITS + b, p * BITS + b) for s, p, bits in zip(starts, parts, places, strict=True) for b in range(BITS) if bits >> b & 1]
    at, place = np.array(sorted(found), dtype=np.int64).T
    start = at - place
    held, first, low, high = np.full(len(at), GRAM), at.copy(), start.copy(), start.copy()
    since = np.searchsorted(at, at - words - REACH)
    for i in range(len(at)):
        j = slice(since[i], i)
        step = np.minimum(at[i] - at[j], place[i] - place[j])
        gain = np.where((step > 0) & (np.abs(start[i] - start[j]) <= REACH), held[j] + np.minimum(GRAM, step), 0)
        if gain.size and gain.max() > GRAM:
            best = since[i] + int(gain.argmax())
            held[i], first[i] = gain[best - since[i]], first[best]
            low[i], high[i] = min(low[best], start[i]), max(high[best], start[i])
    taken: list[tuple[int, int]] = []
    spans = []
    needed = words * (1 if words <= SHORT else LEAST_SHARE)
    for i in np.lexsort((at, -held)).tolist():
        if held[i] < needed:
            break
        mine = (int(first[i]), int(at[i]) + GRAM)
        k = bisect.bisect(taken, mine)
        if (k == 0 or taken[k - 1][1] <= mine[0]) and (k == len(taken) or taken[k][0] >= mine[1]):
            taken.insert(k, mine)
            spans.append((int(low[i]), int(high[i]) + words, int(held[i])))
    return sorted(spans)


def _verified(batches):
    for batch in batches:
        rows = [
            (i, *span)
            for i, (words, votes) in enumerate(zip(batch.column("words").to_pylist(), batch.column("votes").to_pylist(), strict=True))
            for span in ordered_spans([v["start"] for v in votes], [v["part"] for v in votes], [v["places"] for v in votes], words)
        ]
        taken = batch.take(pa.array([r[0] for r in rows], pa.int64()))
        kept = [taken.column(c) for c in ("id", "body", "template", "label", "base")]
        share = np.array([r[3] for r in rows]) / taken.column("words").to_numpy()
        columns = [*kept, pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array(share, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "body", "template", "label", "base", "start", "end", "share"])


def license_spans(docs: DataFrame, templates: list[Template], id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Verified spans: ``id``, ``body`` (hash of the text), ``template``, ``label``, ``base``, ``start``, ``end``, ``share``.

    All grams of all texts are joined with the grams of the templates.  A match votes for its
    diagonal, the word that the template would start at; a diagonal's votes are one bit per place in
    the template (a row for every ``BITS`` places), so repeated rows vote once.  Diagonals of a text and template no more
    than ``REACH`` apart are merged, which takes in left-out and added words.  Merged diagonals that could hold enough
    words are verified: a span is kept if the words that it holds in the template's order are ``LEAST_SHARE`` of the
    template's, or all of a short one's; base templates need all of them on one diagonal.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType
    keyed = docs.select(F.col(id_column).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("body"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("id", kind), T.StructField("body", T.LongType()), T.StructField("grams", T.ArrayType(T.LongType()))])
    grams = keyed.mapInArrow(_grams, schema).select("id", "body", F.posexplode("grams").alias("at", "gram"))
    hits = grams.join(F.broadcast(template_grams(spark, templates)), "gram")
    facts = spark.createDataFrame([(n, t.label, t.base, len(t.words.split())) for n, t in enumerate(templates)], "template int, label string, base boolean, words int")
    place = F.col("place") % BITS
    votes = hits.groupBy("id", "body", "template", (F.col("at") - F.col("place")).alias("start"), F.expr(f"cast(place div {BITS} AS int)").alias("part")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place)).alias("places")
    )
    votes = save(votes, "votes").join(F.broadcast(facts), "template").withColumn("n", F.bit_count("places"))
    whole = F.col("n") == F.col("words") - 1
    exact = votes.filter(F.col("base") & whole)
    exact = exact.select("id", "body", "template", "label", "base", "start", (F.col("start") + F.col("words")).alias("end"), F.lit(1.0).alias("share"))
    loose = votes.filter(~F.col("base") & (whole | (F.col("n") >= LEAST_VOTES)))
    of_text = Window.partitionBy("id", "body", "template").orderBy("start")
    apart = F.coalesce(F.col("start") - F.lag("start").over(of_text) > REACH, F.lit(True))
    loose = loose.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(of_text))
    # A gram at a place holds the words at this place and the next.
    held = F.bit_count(F.col("places").bitwiseOR(F.shiftleft("places", 1)))
    merged = loose.groupBy("id", "body", "template", "label", "base", "words", "run").agg(
        F.sum(held).alias("held"), F.collect_list(F.struct("start", "part", "places")).alias("votes")
    )
    merged = merged.filter(F.col("held") >= F.col("words") * F.when(F.col("words") <= SHORT, F.lit(1.0)).otherwise(F.lit(LEAST_SHARE)))
    verified = T.StructType().add("id", kind).add("body", "long").add("template", "integer").add("label", "string").add("base", "boolean")
    verified = verified.add("start", "integer").add("end", "integer").add("share", "double")
    return exact.unionByName(merged.mapInArrow(_verified, verified))


def scan_licenses(docs: DataFrame, passages: list[Template] | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of digits, letters, and bytes above ASCII, with A-Z lower-cased.  ``n_base`` counts all
    places of base phrases, ``first_word`` and ``last_word`` are the smallest and largest start (null without any).
    ``labels`` adds those of ``passages``; both lists are distinct, sorted, and joined by commas, empty without any.  ``score``
    is the largest share of a template that was found, 0 without any.  Null counts as empty; null and repeated ids
    are treated like others; other columns are not read; an empty table gives no rows.
    """
    templates = [*BASE, *(PASSAGES if passages is None else passages)]
    kind = docs.schema[id_column].dataType
    keyed = docs.select(F.col(id_column).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("body"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("id", kind), T.StructField("body", T.LongType()), T.StructField("n_words", T.LongType())])
    sized = save(keyed.mapInArrow(_counts, schema), "sized")
    spans = license_spans(docs, templates, id_column, text)
    start = F.when(F.col("base"), F.col("start").cast("long"))
    found = spans.groupBy("id", "body").agg(
        F.count(start).alias("n_base"),
        F.min(start).alias("first_word"),
        F.max(start).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    found = save(found, "found").select(F.col("id").alias("_id"), F.col("body").alias("_body"), *found.columns[2:])
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("body") == F.col("_body"))
    return sized.join(found, same, "left").select(
        F.col("id").alias(id_column),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
