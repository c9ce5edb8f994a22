"""SimHash near-duplicates through a Gray-order hierarchical index (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.scratch import save
from tidewatch.llm.components import components, smallest_member
from tidewatch.llm.text import connect, text_slices

WORDS, LIMIT, SEED = 4, 4, 42
#: Fingerprints of a lowest node, and children of an upper node.
LEAF, FAN = 32, 8
_PAIRS_AT_ONCE = 1 << 16
#: Rows under one tree: as many whole cells as come to this.
TREE = 1 << 16
#: Fingerprints of a cell that are not cut into parts.
HOME = 1 << 14


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Fingerprint of one text: a bit is 1 if set in over half the shingle hashes; no words: zero.

    Shingles are runs of ``words`` words of the text with A-Z lower-cased (the whole sequence,
    if it has fewer), repeats included; hashes are XXH64 with seed 42.
    """
    held = text.lower().split()
    if not held:
        return 0
    line = b" ".join(held)
    if len(held) <= words:
        return xxhash.xxh64_intdigest(line, SEED)
    lengths = np.fromiter(map(len, held), dtype=np.int64, count=len(held)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(held) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in pairs), dtype=np.uint64, count=len(held) - words + 1)
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo : lo + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``id_column`` and ``fingerprint`` (its 64 bits as a signed long) of every row; null counts as empty."""
    kind = docs.schema[id_column].dataType

    def run(batches):
        for batch in batches:
            found = np.zeros(batch.num_rows, dtype=np.uint64)
            for lo, _, data, offsets in text_slices(batch.column(1)):
                held = data.tobytes()
                for i in range(len(offsets) - 1):
                    found[lo + i] = fingerprint(held[offsets[i] : offsets[i + 1]], words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[id_column, "fingerprint"])

    schema = T.StructType([T.StructField(id_column, kind), T.StructField("fingerprint", T.LongType())])
    return docs.select(id_column, text).mapInArrow(run, schema)


def gray_rank(code: Column) -> Column:
    """Position of a 64-bit code in the Gray sequence; neighbours in it differ in few bits."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def cells(fingerprint: Column, limit: int = LIMIT) -> Column:
    """Keys of the cells a fingerprint belongs to: any two at ``limit`` or fewer differing bits share one.

    The 64 bits are cut into ``limit + 2`` blocks; such two agree in two blocks at least, and
    every pair of blocks with its bits is a cell.
    """
    blocks = limit + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]

    def bits(i: int) -> Column:
        return F.shiftrightunsigned(fingerprint, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))

    wide = max(b - a for a, b in zip(edges, edges[1:], strict=False))
    keys = []
    for n, (i, j) in enumerate(combinations(range(blocks), 2)):
        key = F.shiftleft(F.lit(n).cast("long"), 2 * wide).bitwiseOR(F.shiftleft(bits(i), wide)).bitwiseOR(bits(j))
        keys.append(key)
    return F.array(*keys)


def _shared(value: np.ndarray, mask: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The bits that all of every ``width`` neighbours know and agree in, and which bits those are."""
    starts = np.arange(0, len(value), width)
    first = value[starts]
    differ = np.bitwise_or.reduceat(value ^ np.repeat(first, np.diff(np.append(starts, len(value)))), starts)
    mask = np.bitwise_and.reduceat(mask, starts) & ~differ
    return first & mask, mask


class GrayIndex:
    """Fingerprints in Gray order under a tree whose nodes hold the bits all members share.

    Level 0 are runs of ``LEAF`` fingerprints, every further level runs of ``FAN`` nodes.  With
    ``keys`` (the cell of each; rows in the Gray order of cells, then of codes), only pairs of one
    cell must be found, so nodes whose shared bits of the cell differ at all are apart.

    ``pruned`` and ``compared`` count the pairs of nodes that went as a whole and the pairs of
    lowest nodes whose members were compared.
    """

    def __init__(self, codes: np.ndarray, keys: np.ndarray | None = None):
        self.codes = codes
        self.pruned = self.compared = 0
        known = np.full(len(codes), ~np.uint64(0))
        cell = np.zeros(len(codes), np.uint64) if keys is None else keys
        width = LEAF
        self.levels = [(*_shared(codes, known, width), *_shared(cell, known, width))]
        while len(self.levels[-1][0]) > FAN:
            value, mask, cell, known = self.levels[-1]
            self.levels.append((*_shared(value, mask, FAN), *_shared(cell, known, FAN)))

    def classes(self, limit: int) -> np.ndarray:
        """Smallest position connected with each fingerprint by links of ``limit`` or fewer bits.

        Pairs of nodes are followed downwards; what the bits shared on both sides differ in adds
        up on the way, and a pair of groups goes as a whole once that passes the limit, or once
        all its members are connected already.
        """
        label = np.arange(len(self.codes))
        leaves = np.arange(len(self.levels[0][0]))
        label = self._compare(label, leaves, leaves, limit)
        top = len(self.levels[-1][0])
        a, b = np.triu_indices(top)
        stack = [(len(self.levels) - 1, a, b, np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64))]
        while stack:
            level, a, b, apart, seen = stack.pop()
            if len(a) > _PAIRS_AT_ONCE:
                for lo in range(0, len(a), _PAIRS_AT_ONCE):
                    part = slice(lo, lo + _PAIRS_AT_ONCE)
                    stack.append((level, a[part], b[part], apart[part], seen[part]))
                continue
            value, mask, cell, known = self.levels[level]
            shared = mask[a] & mask[b]
            apart = apart + np.bitwise_count((value[a] ^ value[b]) & shared & ~seen)
            low, high = self._spread(label, level)
            joined = (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])
            keep = (apart <= limit) & ((cell[a] ^ cell[b]) & known[a] & known[b] == 0) & ~joined
            self.pruned += int(len(a) - keep.sum())
            a, b, apart, shared = a[keep], b[keep], apart[keep], shared[keep]
            if not len(a):
                continue
            if level == 0:
                other = a != b
                label = self._compare(label, a[other], b[other], limit)
                continue
            below = len(self.levels[level - 1][0])
            i, j = (x.ravel() for x in np.meshgrid(np.arange(FAN), np.arange(FAN), indexing="ij"))
            down_a, down_b = (a[:, None] * FAN + i).ravel(), (b[:, None] * FAN + j).ravel()
            keep = (down_a < below) & (down_b < below) & (down_a <= down_b)
            stack.append((level - 1, down_a[keep], down_b[keep], np.repeat(apart, FAN * FAN)[keep], np.repeat(shared, FAN * FAN)[keep]))
        return label

    def _spread(self, label: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest class in each node."""
        starts = np.arange(0, len(label), LEAF * FAN**level)
        return np.minimum.reduceat(label, starts), np.maximum.reduceat(label, starts)

    def _compare(self, label: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        step = np.arange(LEAF)
        last = len(self.codes) - 1
        for lo in range(0, len(a), 256):
            left = np.minimum(a[lo : lo + 256, None] * LEAF + step, last)
            right = np.minimum(b[lo : lo + 256, None] * LEAF + step, last)
            open_ = label[left].min(1) != label[left].max(1)
            open_ |= label[right].min(1) != label[right].max(1)
            open_ |= label[left[:, 0]] != label[right[:, 0]]
            left, right = left[open_], right[open_]
            self.compared += len(left)
            near = np.bitwise_count(self.codes[left][:, :, None] ^ self.codes[right][:, None, :]) <= limit
            n, i, j = np.nonzero(near)
            label = connect(label, left[n, i], right[n, j])
        return label


def _links(limit: int):
    """Links in rows of cell, fingerprint, and node, in Gray order; thinned to one for each row at most."""

    def edges(rows: np.ndarray) -> pa.RecordBatch:
        bits = [np.ascontiguousarray(rows[:, i]).view(np.uint64) for i in (0, 1)]
        label = GrayIndex(bits[1], bits[0]).classes(limit)
        linked = np.flatnonzero(rows[label, 2] != rows[:, 2])
        return pa.RecordBatch.from_arrays([pa.array(rows[label[linked], 2]), pa.array(rows[linked, 2])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1))
            if sum(map(len, held)) < TREE:
                continue
            rows = np.concatenate(held)
            ends = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1
            cut = int(ends[-1]) if len(ends) else 0  # the last cell may go on
            if cut:
                yield edges(rows[:cut])
            held = [rows[cut:]]
        if held:
            yield edges(np.concatenate(held))

    return run


def dealt(distinct: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``cell``, ``code`` and ``node`` of every cell a fingerprint (column ``node``) belongs to; partitions hold whole cells in Gray order.

    A cell of more than ``HOME`` members is cut into parts by hash, and every two parts are a cell of their own.
    """
    code = F.col("node")
    rows = distinct.select(F.explode(cells(code, limit)).alias("cell"), code.alias("code"), "node")
    full = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOME)
    # Few rows: cells that hold more than HOME fingerprints.
    full = save(full.select("cell", F.ceil(F.col("n") / HOME).cast("int").alias("parts")), "full_cells")
    own = F.pmod(F.xxhash64("code"), F.col("parts")).cast("int")
    rows = rows.join(F.broadcast(full), "cell", "left").withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    # Equal hashes of two cells only let more fingerprints meet.
    cut = F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))
    rows = rows.select(F.when(F.col("parts").isNull(), F.col("cell")).otherwise(cut).alias("cell"), "code", "node")
    return rows.repartition("cell").sortWithinPartitions(gray_rank(F.col("cell")), gray_rank(F.col("code")))


def links(distinct: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``node``) that connect all within ``limit`` bits.

    Fingerprints are dealt to cells that agree in two blocks of bits.  A task puts its cells in Gray
    order under trees of about ``TREE`` rows, cells of any size alike, and joins each tree with itself.
    Links are thinned to a forest, so a tree gives fewer links than it has members, and none between classes is lost.
    """
    return dealt(distinct, limit).mapInArrow(_links(limit), "a long, b long")


def simhash_groups(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = WORDS, limit: int = LIMIT
) -> DataFrame:
    """``id_column``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    ``component_id`` is the smallest id reachable by links of ``limit`` or fewer differing bits,
    the row's own included.  Null and empty texts have fingerprint zero and link like others.
    Rows with a null id keep a null id and take the smallest id of their component, if any.
    Other columns, whatever their names, are not read.  An empty table gives no rows.
    """
    marked = save(fingerprints(docs, id_column, text, words), "fingerprints")
    distinct = marked.groupBy(F.col("fingerprint").alias("node")).agg(F.min(id_column).alias("first"))
    distinct = save(distinct, "distinct")
    found = save(smallest_member(distinct, links(distinct, limit)), "components")
    found = found.select(F.col("node").alias("fingerprint"), F.col("first").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return marked.join(found, "fingerprint").select(id_column, hexed, "component_id")
