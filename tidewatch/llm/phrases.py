"""Benchmark decontamination through a positional inverted index (operator 12), in DataFrame operations only.

The index holds, for every word that any test item uses, its places in the training documents: rows
``term, key, pos``, written by each task in order of term, so that every file is an index
of its own and a list is read from the files' row groups that hold it.  Queries intersect lists whose
positions are shifted by the word's place in the item, the rarest words first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.scratch import save
from tidewatch.llm.exact import normal_text

#: Consecutive words of an item that make a match.
LENGTH = 10
#: Words are runs of ASCII digits and letters and of everything above ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of a table that may be broadcast, and rows that may be whatever their width.
BROADCAST_BYTES, BROADCAST_ROW = 16 << 20, 32
#: Term of the row that stands for a document's end: its position is the number of words.
END = -1


def words_of(text: str = "text") -> Column:
    """Words of a text with A-Z lower-cased; null has none."""
    return F.array_remove(F.split(normal_text(text), SEPARATORS), "")


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its rows, with all their strings, were counted to take at most ``BROADCAST_BYTES``."""
    strings = [F.octet_length(F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.StringType)]
    width = sum(strings, F.lit(BROADCAST_ROW))
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES else df


@dataclass(frozen=True)
class Items:
    """Test items as written tables.

    ``terms``: item, q (place in the item, from 0), term, size (words of the item); one item for each
    distinct sequence of words.  ``ids``: item, id.  ``words``: term, word.
    """

    terms: DataFrame
    ids: DataFrame
    words: DataFrame

    @classmethod
    def of(cls, items: DataFrame, id_column: str = "item_id", text: str = "text") -> Items:
        """Items without words are left out; rows with equal words are one item with several ids; a null id is no id."""
        rows = save(items.select(F.col(id_column).alias("id"), words_of(text).alias("held")).filter(F.size("held") > 0), "items")
        texts = save(rows.select("held").distinct().select(F.monotonically_increasing_id().alias("item"), "held"), "item_texts")
        ids = save(rows.filter("id IS NOT NULL").join(texts, "held").select("item", "id").distinct(), "item_ids")
        placed = texts.select("item", F.size("held").alias("size"), F.posexplode("held").alias("q", "word"))
        words = save(placed.select("word").distinct().select(F.monotonically_increasing_id().alias("term"), "word"), "item_words")
        terms = save(placed.join(words, "word").select("item", "q", "term", "size"), "item_terms")
        return cls(terms, ids, words)


def positional_index(docs: DataFrame, words: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Written postings ``term, key, pos`` of these words (``term, word``) in all documents.

    ``key`` numbers the rows of ``docs``.  A last posting of each row, of term ``END``, has its number of
    words as ``pos`` and its ``id``.  Texts are read and cut once, and no row is shuffled unless ``words``
    is too large to be broadcast.
    """
    marked = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_column).alias("id"), F.concat(words_of(text), F.array(F.lit(""))).alias("held"))
    end = docs.sparkSession.range(1).select(F.lit(END).cast("long").alias("term"), F.lit("").alias("word"))
    known = words.select("term", "word").unionByName(end)
    found = marked.select("key", "id", F.posexplode("held").alias("pos", "word")).join(small(known), "word")
    rows = found.select("term", "key", "pos", F.when(F.col("term") == END, F.col("id")).alias("id"))
    return save(rows.sortWithinPartitions("term", "key", "pos"), "postings")


def document_rows(postings: DataFrame) -> DataFrame:
    """``key, id, n_words`` of every document of an index."""
    return postings.filter(F.col("term") == END).select("key", "id", F.col("pos").cast("long").alias("n_words"))


def _anchors(postings: DataFrame, terms: DataFrame, length: int) -> DataFrame:
    """The places of the two rarest words of every window: item, q1, term1, q2, term2 (null if the window has one word).

    Windows with a word that no document has are left out.
    """
    counts = postings.filter(F.col("term") != END).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    held = terms.join(save(counts, "term_counts"), "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = F.greatest(F.lit(0), F.col("q") - length + 1)
    last = F.greatest(F.lit(0), F.least(F.col("q"), F.col("size") - length))
    held = held.select("item", F.explode(F.sequence(first, last)).alias("s"), F.struct("n", "q", "term").alias("word"))
    # A window has ``length`` words at most.
    windows = held.groupBy("item", "s").agg(F.sort_array(F.collect_list("word")).alias("words")).filter("words[0].n > 0")
    two = F.get("words", F.lit(1))
    one = windows.select("item", F.expr("words[0].q").alias("q1"), F.expr("words[0].term").alias("term1"), two["q"].alias("q2"), two["term"].alias("term2"))
    return save(one.distinct(), "anchors")


def phrase_matches(postings: DataFrame, items: Items, length: int = LENGTH) -> DataFrame:
    """Places where ``length`` or more consecutive words of an item stand: key, item, start, item_start, n_words.

    ``start`` and ``item_start`` are the first word in the document and in the item, ``n_words`` how many
    match from there on; every match is as long as it can be.  An item of fewer words matches as a whole.
    Repeated places in one document are all found.

    The list of the rarest word of each window, shifted by the word's place, gives the diagonals (document, item,
    shift) to look at; those stay on which the second rarest word stands too; what is left
    is intersected with the lists of all words of the item, and runs of consecutive places are matches.
    """
    anchors = _anchors(postings, items.terms, length)
    lists = postings.filter(F.col("term") != END).select("term", "key", "pos")
    tried = lists.join(small(anchors), F.col("term") == F.col("term1"))
    tried = tried.select("key", "item", (F.col("pos") - F.col("q1")).alias("shift"), "q2", F.col("term2").alias("term"))
    alone = tried.filter("term IS NULL").select("key", "item", "shift")
    second = lists.join(small(anchors.select(F.col("term2").alias("term")).distinct()), "term", "left_semi")
    both = tried.withColumn("pos", F.col("shift") + F.col("q2")).join(second, ["key", "pos", "term"], "left_semi").select("key", "item", "shift")
    left = save(both.unionByName(alone).distinct(), "diagonals")
    expected = left.join(small(items.terms), "item").withColumn("pos", F.col("shift") + F.col("q"))
    near = lists.join(left.select("key").distinct(), "key", "left_semi")
    met = expected.join(near, ["key", "pos", "term"], "left_semi").select("key", "item", "shift", "q", "size")
    run = F.col("q") - F.row_number().over(Window.partitionBy("key", "item", "shift").orderBy("q"))
    runs = met.withColumn("run", run).groupBy("key", "item", "shift", "run")
    runs = runs.agg(F.count(F.lit(1)).alias("n_words"), F.min("q").alias("item_start"), F.min("size").alias("size"))
    whole = runs.filter(F.col("n_words") >= F.least(F.lit(length), F.col("size")))
    return save(whole.select("key", "item", (F.col("shift") + F.col("item_start")).alias("start"), "item_start", "n_words"), "phrases")


def proximity_matches(postings: DataFrame, items: Items, span: int, length: int = LENGTH) -> DataFrame:
    """Stretches of ``span`` words that hold all the words of a window of an item, in any order: key, item, item_start, start.

    A word that the window has twice must stand there twice.  ``item_start`` is the window's first word in the item,
    ``start`` any place of a word of the window from which on ``span`` words hold all of them (fewer at the end of the text).
    Items of fewer words are one window.

    Places of the rarest word are intersected with those of the second rarest less than ``span`` away (they fall in the
    same block of ``span`` words or the next ones), and what is left with all the words of the window.
    """
    terms = items.terms
    first = F.greatest(F.lit(0), F.col("q") - length + 1)
    last = F.greatest(F.lit(0), F.least(F.col("q"), F.col("size") - length))
    held = terms.select("item", F.explode(F.sequence(first, last)).alias("s"), "term").groupBy("item", "s", "term").agg(F.count(F.lit(1)).alias("times"))
    counts = postings.filter(F.col("term") != END).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    needed = save(held.join(save(counts, "term_counts"), "term", "left").withColumn("n", F.coalesce("n", F.lit(0))), "needed")
    windows = needed.groupBy("item", "s").agg(F.sort_array(F.collect_list(F.struct("n", "term"))).alias("words")).filter("words[0].n > 0")
    windows = windows.select("item", "s", F.expr("words[0].term").alias("term1"), F.get("words", F.lit(1))["term"].alias("term2"), F.size("words").alias("kinds"))
    windows = save(windows, "near_windows")
    lists = postings.filter(F.col("term") != END).select("term", "key", "pos")
    tried = lists.join(small(windows), F.col("term") == F.col("term1")).select("key", "item", "s", "term2", "kinds", F.col("pos").alias("at"))
    alone = tried.filter("term2 IS NULL").select("key", "item", "s", "kinds", "at")
    block = F.expr(f"pos div {span}")
    second = lists.join(small(windows.select(F.col("term2").alias("term")).distinct()), "term", "left_semi").withColumn("block", block)
    reach = tried.filter("term2 IS NOT NULL").withColumn("block", F.explode(F.expr(f"sequence(at div {span} - 1, at div {span} + 1)")))
    close = reach.join(second, (reach.key == second.key) & (reach.term2 == second.term) & (reach.block == second.block) & (F.abs(second.pos - reach["at"]) < span), "left_semi")
    places = save(close.select("key", "item", "s", "kinds", "at").unionByName(alone).distinct(), "near_places")
    reach = places.withColumn("block", F.explode(F.expr(f"sequence(at div {span} - 1, at div {span} + 1)")))
    wanted = reach.join(small(needed.select("item", "s", "term", "times")), ["item", "s"])
    near = lists.join(places.select("key").distinct(), "key", "left_semi").withColumn("block", block)
    met = wanted.join(near, ["key", "term", "block"]).filter(F.abs(F.col("pos") - F.col("at")) < span)
    met = met.select("key", "item", "s", "kinds", "term", "times", "pos").distinct()
    # From each place of a word of the window: do the ``span`` words from there on hold enough of every word?
    starts = met.select("key", "item", "s", F.col("pos").alias("start"), F.explode(F.expr(f"sequence(pos div {span}, pos div {span} + 1)")).alias("block")).distinct()
    held = starts.join(met.withColumn("block", block), ["key", "item", "s", "block"]).filter(f"pos >= start AND pos < start + {span}")
    enough = held.groupBy("key", "item", "s", "kinds", "start", "term", "times").agg(F.count(F.lit(1)).alias("n")).filter("n >= times")
    found = enough.groupBy("key", "item", "s", "kinds", "start").agg(F.count(F.lit(1)).alias("n")).filter("n = kinds")
    return save(found.select("key", "item", F.col("s").alias("item_start"), "start"), "proximity")


def contamination(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", length: int = LENGTH) -> DataFrame:
    """Of every document: ``id_column, n_words, n_hit, n_items, items_sha256, contaminated``.

    ``n_hit`` counts the words inside any match of ``phrase_matches``, each once; ``items_sha256`` is of the ids of the items
    that match, sorted as strings and comma-joined (the hash of the empty string if there are none).  Null and empty
    texts have no words; items without words match nothing; an item with a null id hits words
    but is not listed.  Rows that repeat an id are documents of their own; an id that several items share is listed once.  No documents: no rows;
    no items: nothing is hit.  Other columns of both tables, whatever their names, are not read.
    """
    held = Items.of(items, item_id, item_text)
    postings = positional_index(docs, held.words, id_column, text)
    found = phrase_matches(postings, held, length)
    spans = found.select("key", "start", (F.col("start") + F.col("n_words")).alias("end")).distinct()
    before = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.coalesce(F.max("end").over(before), F.col("start")), F.col("start")))
    hits = spans.select("key", fresh.cast("long").alias("fresh")).groupBy("key").agg(F.sum("fresh").alias("hit"))
    listed = found.select("key", "item").distinct().join(small(held.ids), "item").select("key", F.col("id").cast("string").alias("id")).distinct()
    # The ids of the items in one document.
    listed = listed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("id"))), 256).alias("sha"))
    rows = document_rows(postings).join(hits, "key", "left").join(listed, "key", "left")
    hit = F.coalesce("hit", F.lit(0)).cast("long")
    return rows.select(
        F.col("id").alias(id_column),
        "n_words",
        hit.alias("n_hit"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
