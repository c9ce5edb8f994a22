"""Packing documents into token windows by multiway differencing (operator 9)."""

from __future__ import annotations

import heapq
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.scratch import save
from tidewatch.llm.bpe import _ODD, CLASSES, Merges, Pieces
from tidewatch.llm.text import LOWER, NOT_SPACE, ragged, span_hashes, text_slices, word_bounds

CAPACITY, END = 4096, 2
#: Windows and pieces that one task fills at a time.
WINDOWS, PIECES = 256, 1 << 17
#: Bit that the sequences of whole windows have.
WHOLE = 1 << 62
#: Fixed value: the split pattern of the vocabulary file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
_WHITE = regex.compile(r"\p{White_Space}+")


class LowerPieces(Pieces):
    """Pieces between white space for a lower-cased vocabulary with word ends."""

    single_digits = True
    classes = CLASSES.copy()
    classes[[0xC4, 0xC5]] = _ODD

    def parts(self, piece: str) -> list[bytes]:
        text = _WHITE.sub(" ", unicodedata.normalize("NFC", piece))
        return [p.encode() for p in self.pattern.findall("".join([c.lower() for c in text]))]

    def prepare(self, flat: np.ndarray) -> np.ndarray:
        low = LOWER[flat]
        capital = (flat[:-1] == 0xC3) & (flat[1:] >= 0x80) & (flat[1:] <= 0x9E)
        low[1:][capital] += 0x20
        return low


@lru_cache(maxsize=2)
def _pieces(path: str) -> LowerPieces:
    return LowerPieces(Merges(path), SPLIT)


def token_slices(column: pa.Array, pieces: LowerPieces):
    """Slices of rows: ids one after the other, and where each row's start (one more than rows)."""
    special = pieces.merges.special
    marks = [s.encode() for s in special]
    cut = regex.compile("(" + "|".join(regex.escape(s) for s in special) + ")") if special else None
    for lo, hi, data, offsets in text_slices(column):
        starts, ends, first = word_bounds(data, offsets, NOT_SPACE)
        hashes, seen, number = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        ids, at, lengths = pieces.look_up(hashes, data, starts[seen], ends[seen])
        lengths = lengths[number]
        tokens = ids[ragged(at[number], lengths)]
        bounds = np.concatenate([[0], np.cumsum(lengths)])[first]
        held = data.tobytes()
        if any(m in held for m in marks):
            rows = []
            for i in range(hi - lo):
                row = held[offsets[i] : offsets[i + 1]]
                if any(m in row for m in marks):
                    rows.append(_marked(row.decode(), cut, pieces))
                else:
                    rows.append(tokens[bounds[i] : bounds[i + 1]])
            tokens, bounds = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        yield tokens, bounds


def _marked(text: str, cut, pieces: LowerPieces) -> np.ndarray:
    """Ids of a text that holds strings of special tokens."""
    special = pieces.merges.special
    out = [np.zeros(0, np.int32)]
    for part in cut.split(text):
        out += [np.array([special[part]], np.int32)] if part in special else pieces._merge([pieces.parts(part)])
    return np.concatenate(out)


def cut_documents(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids: id, start, length, ids_crc32, doc_tokens; every document ends with ``END``."""
    kind = docs.schema[id_column].dataType

    def run(batches):
        pieces = _pieces(tokenizer)
        for batch in batches:
            row, start, length, check, total = [], [], [], [], []
            at = 0
            for tokens, bounds in token_slices(batch.column(1), pieces):
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    ids = np.append(tokens[a:b], END).astype("<u4")
                    for lo in range(0, len(ids), capacity):
                        part = ids[lo : lo + capacity]
                        row.append(at)
                        start.append(lo)
                        length.append(len(part))
                        check.append(zlib.crc32(part.tobytes()))
                        total.append(len(ids))
                    at += 1
            columns = [batch.column(0).take(pa.array(row, pa.int64()))]
            columns += [pa.array(x, pa.int64()) for x in (start, length, check, total)]
            yield pa.RecordBatch.from_arrays(columns, names=[id_column, "start", "length", "ids_crc32", "doc_tokens"])

    schema = T.StructType([T.StructField(id_column, kind), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")]])
    return docs.select(id_column, text).mapInArrow(run, schema)


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Items dealt to ``windows`` lists with nearly equal sums (Karmarkar and Karp, many ways).

    Every item starts as a partition of its own, with the other windows empty.  The two
    partitions with the largest spread are merged, the fullest window of one with the emptiest
    of the other, until one is left.  Only windows that hold something are kept, and a window is
    a tree of the two it was made from, so memory grows with the items alone.
    """
    if not sizes:
        return []
    heap = [(-size, n) for n, size in enumerate(sizes)]
    heapq.heapify(heap)
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # sums, falling, and windows of merged partitions
    joined: list[tuple[int, int]] = []
    node = len(sizes)

    def take(n: int) -> tuple[np.ndarray, np.ndarray]:
        return held.pop(n) if n >= len(sizes) else (np.array([sizes[n]]), np.array([n]))

    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        (sums, of), (other_sums, other) = take(a), take(heap[0][1])
        other_sums, other = other_sums[::-1], other[::-1]
        both = max(0, len(sums) + len(other_sums) - windows)
        alone = len(sums) - both
        new = np.arange(len(joined), len(joined) + both) + len(sizes)
        joined += zip(of[alone:].tolist(), other[:both].tolist(), strict=True)
        sums = np.concatenate([sums[:alone], sums[alone:] + other_sums[:both], other_sums[both:]])
        order = np.argsort(-sums, kind="stable")
        held[node] = sums[order], np.concatenate([of[:alone], new, other[both:]])[order]
        least = int(held[node][0][-1]) if len(sums) == windows else 0
        heapq.heapreplace(heap, (least - int(held[node][0][0]), node))
        node += 1
    dealt: list[list[int]] = [[] for _ in range(windows)]
    for place, top in enumerate(take(heap[0][1])[1].tolist()):
        left = [top]
        while left:
            n = left.pop()
            if n < len(sizes):
                dealt[place].append(n)
            else:
                left += joined[n - len(sizes)]
        dealt[place].sort()
    return dealt


def fill(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most ``capacity``: as few as the sum allows at first, and more whenever one overflows.

    The count rises by what would make up for the overflow if the spread stayed as it is, one at
    least and a fiftieth at most.
    """
    total = sum(sizes)
    count = -(-total // capacity)
    while True:
        windows = differencing(sizes, count)
        over = max((sum(sizes[i] for i in w) for w in windows), default=0) - capacity
        if over <= 0:
            return [w for w in windows if w]
        spread = over + capacity - total / count
        wanted = int(total / (capacity - spread)) if spread < capacity else count + 1
        count = min(max(count + 1, wanted), count + max(1, count // 50))


def pack_documents(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``: every sequence holds at most ``capacity`` ids without gaps.

    Whole windows of a long document are sequences of their own; what is left of every document
    is dealt by the hash of a row number to groups of about ``WINDOWS`` windows and ``PIECES`` pieces at most, and each group is
    filled on its own, so no task holds more than that, whatever rows are equal.  ``sequence_id`` is unique, but not dense.  Null and
    empty texts are one piece with the end id alone; ids may be null or repeat; other columns
    are not read; an empty table gives no rows.
    """
    columns = [id_column, "start", "length", "ids_crc32", "doc_tokens"]
    # The number is written, so that a task that runs again deals the same.
    pieces = cut_documents(docs, tokenizer, id_column, text, capacity).toDF("id", *columns[1:])
    pieces = save(pieces.withColumn("number", F.monotonically_increasing_id()), "pieces")
    left = pieces.filter(F.col("length") < capacity)
    rest, many = left.agg(F.sum("length"), F.count(F.lit(1))).first()
    groups = max(1, round((rest or 0) / (WINDOWS * capacity)), -(-many // PIECES))
    dealt = left.withColumn("part", F.pmod(F.xxhash64("number"), F.lit(groups)))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("start", "ascending")])
        lengths = table["length"].to_numpy()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for n, window in enumerate(fill(lengths.tolist(), capacity)):
            sequence[window] = n
            offset[window] = np.cumsum(lengths[window]) - lengths[window]
        sequence += table["part"][0].as_py() << 32
        return table.select(["id", *columns[1:]]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = T.StructType([*pieces.schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    whole = pieces.filter(F.col("length") == capacity)
    whole = whole.withColumn("sequence_id", F.col("number").bitwiseOR(F.lit(WHOLE))).withColumn("offset", F.lit(0).cast("long")).drop("number")
    return dealt.groupBy("part").applyInArrow(pack, schema).union(whole).toDF(*columns, "sequence_id", "offset")
