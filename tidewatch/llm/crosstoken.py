"""Cross-tokenizer alignment: fragments of byte ranges that can be joined in any grouping (operator 13).

Two tokenizers cut the same bytes; where tokens of both end, a group ends.  A fragment is what a range of bytes
knows of that: an open prefix up to the first common end, closed groups, and an open suffix after the last
one; or, without a common end, only open tokens.  Joining two neighbours closes at most one group,
the suffix of the left with the prefix of the right, and joining is associative, so the ranges of a very long document
are handled by many tasks and joined as a tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.scratch import save, scratch_path
from tidewatch.llm.bpe import SPLIT, Merges, Pieces, Spelling, encode_column
from tidewatch.llm.text import ragged, span_hashes, text_slices

#: Bytes of a range; longer texts are cut into ranges.
RANGE = 1 << 16
#: Fragments joined by a task in one round.
FAN = 16
#: Tokens worked on at a time, and pairs of ids (with counts) that workers get at a time: 16 bytes each.
TOKENS, PAIRS = 1 << 17, 1 << 22
#: The blank as the piece file writes it.
BLANK = "▁"


class PieceUnits(Pieces):
    """Ids by a sentencepiece model of runs that start with a blank, remembered by hash; no piece holds a blank behind other characters."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(BLANK in n.lstrip(BLANK) for n in names):
            raise ValueError(f"{path} has pieces with a blank behind other characters: texts can't be cut before blanks")
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace(BLANK, " ").encode() for i, n in enumerate(names)]
        self.clear()

    def encode(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [data[a + 1 : a + n].tobytes().decode() for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
        ids = self.model.encode(texts, num_threads=1)
        counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.array([i for held in ids for i in held], dtype=np.int64), counts

    def of_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each of which starts with a blank, and where each row's start (one more than rows)."""
        blank = data == 32
        cut = np.zeros(len(data), dtype=bool)
        cut[1:-1] = blank[1:-1] & ~blank[:-2] & ~blank[2:]
        cut[offsets[1:] - 1] = False  # what ends a text stays with what is before it
        cut[offsets[:-1]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        hashes, seen, number = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        ids, at, lengths = self.look_up(hashes, data, starts[seen], ends[seen])
        lengths = lengths[number]
        return ids[ragged(at[number], lengths)], np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(starts, offsets)]


@dataclass
class Pair:
    """Two tokenizers: a byte-level BPE file (A) and a sentencepiece model (B), whose texts get a blank in front."""

    a: Pieces
    b: PieceUnits

    def __post_init__(self):
        self.spell_a, self.spell_b = Spelling(self.a.merges.bytes), Spelling(self.b.bytes)
        self.size_a, self.size_b = len(self.spell_a.lengths), len(self.spell_b.lengths)
        self.kind = np.dtype("<u2" if max(self.size_a, self.size_b) <= 1 << 16 else "<u4")
        # A token as it is written in a list of groups: A inside and at the end of its part, then B.
        self.written = Spelling([form % i for form, n in ((b"%d,", self.size_a), (b"%d|", self.size_a), (b"%d,", self.size_b), (b"%d;", self.size_b)) for i in range(n)])

    def forget(self) -> Pair:
        """Without the remembered pieces, for tasks that only spell."""
        self.a.clear()
        self.b.clear()
        return self

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For slices of rows (texts with a blank in front): ids and bounds of A and of B, and which rows both spell as they are."""
        for (_, _, data, offsets), (a, a_at) in zip(text_slices(column), encode_column(column, self.a), strict=True):
            b, b_at = self.b.of_slice(data, offsets)
            good = _spells(self.spell_a, a, a_at, data, offsets) & _spells(self.spell_b, b, b_at, data, offsets)
            yield a, a_at, b, b_at, good


def _spells(spelling: Spelling, ids: np.ndarray, bounds: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which rows' ids spell their bytes."""
    total = np.concatenate([[0], np.cumsum(spelling.lengths[ids])])[bounds]
    good = np.diff(total) == np.diff(offsets)
    joined, _ = spelling.of(ids, bounds)
    joined = np.frombuffer(joined, dtype=np.uint8)
    if good.all():
        wrong = np.flatnonzero(joined != data)
        good[np.searchsorted(offsets, wrong, "right") - 1] = False
        return good
    for i in np.flatnonzero(good).tolist():
        good[i] = np.array_equal(joined[total[i] : total[i + 1]], data[offsets[i] : offsets[i + 1]])
    return good


@lru_cache(maxsize=1)
def _pair(byte_file: str, piece_file: str) -> Pair:
    merges = Merges(byte_file)
    merges.special = {}  # their strings are plain text
    return Pair(Pieces(merges, SPLIT), PieceUnits(piece_file))


def _safe(data: bytes, at: int) -> bool:
    """Whether tokens of both end before the blank at this place: single blanks between characters that are no white space."""
    before, after = data[max(0, at - 4) : at].decode(errors="ignore")[-1:], data[at + 1 : at + 5].decode(errors="ignore")[:1]
    return bool(before and after) and not before.isspace() and not after.isspace() and before != BLANK


def _safe_after(data: bytes, at: int) -> int:
    while (at := data.find(b" ", at)) >= 0:
        if _safe(data, at):
            return at
        at += 1
    return len(data)


def _safe_before(data: bytes, at: int) -> int:
    while (at := data.rfind(b" ", 0, at + 1)) > 0:
        if _safe(data, at):
            return at
        at -= 1
    return 0


def byte_ranges(data: bytes, size: int) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of about ``size`` bytes, each with the bytes around it that its tokens depend on: lo, hi, begin, end.

    Ranges end at multiples of ``size``, wherever that is in a token; ``begin`` and ``end`` are
    the nearest blanks at which no token reaches over.  Where there is none for long, a range takes in all up to the next.
    """
    lo = 0
    while lo < len(data):
        hi = min(lo + size, len(data))
        end = _safe_after(data, hi) if hi < len(data) else hi
        hi = len(data) if end == len(data) else max(hi, end // size * size)
        yield lo, hi, _safe_before(data, lo), end
        lo = hi


def _binary(ids: np.ndarray, bounds: np.ndarray, kind: np.dtype) -> pa.Array:
    """Ids of each row as bytes."""
    held = ids.astype(kind)
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * kind.itemsize).astype(np.int64)), pa.py_buffer(held)]).cast(pa.binary())


def _ids(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows as one view of the column's bytes, and where each row's start; null counts as none."""
    column = pc.fill_null(column, b"").cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, kind), np.zeros(1, np.int64)
    _, where, held = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    n = int(offsets[-1] - offsets[0])
    flat = np.frombuffer(held, dtype=kind, count=n // kind.itemsize, offset=int(offsets[0])) if n else np.zeros(0, kind)
    return flat, (offsets - offsets[0]) // kind.itemsize


_OPEN = ["prefix_a", "prefix_b", "suffix_a", "suffix_b"]


def _fragment(pair: Pair, a: np.ndarray, b: np.ndarray, skip: int, take: int, first: bool) -> tuple[bool, list[np.ndarray]]:
    """Whether a range has a common end, and its tokens: prefix, closed groups and suffix of A and B.

    ``a`` and ``b`` are ids of the range's surroundings, ``skip`` and ``take`` the range in them; a token belongs to the range
    in which it ends.  The start of a text (``first``) is a common end.
    """
    ends = [np.cumsum(s.lengths[ids]) for s, ids in ((pair.spell_a, a), (pair.spell_b, b))]
    cuts = [np.searchsorted(e, [skip, take], "right") for e in ends]
    (a, b), (ea, eb) = [ids[lo:hi] for ids, (lo, hi) in zip((a, b), cuts, strict=True)], [e[lo:hi] for e, (lo, hi) in zip(ends, cuts, strict=True)]
    common = np.intersect1d(ea, eb, assume_unique=True)
    if first:
        common = np.concatenate([[0], common])
    if not len(common):
        return False, [a, b, a[:0], b[:0], a[:0], b[:0]]
    out = []
    for start, stop in ((None, common[0]), (common[0], common[-1]), (common[-1], None)):
        for ids, e in ((a, ea), (b, eb)):
            lo = 0 if start is None else int(np.searchsorted(e, start, "right"))
            hi = len(e) if stop is None else int(np.searchsorted(e, stop, "right"))
            out.append(ids[lo:hi])
    return True, out


def _fragments(byte_file: str, piece_file: str, size: int):
    """Rows of key, id, text: fragments of short texts, which are closed, and ranges of long ones as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(byte_file, piece_file)
        names = ["key", "id", "chunk", "last", "good", "cut", "closed_a", "closed_b", *_OPEN, "body", "skip", "take"]

        def out(keys, ids, columns):
            return pa.RecordBatch.from_arrays([keys, ids, *columns], names=names)

        none = lambda n: [pa.nulls(n, pa.binary())] * 4 + [pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
        fixed = lambda n, v: pa.array(np.full(n, v))
        for batch in batches:
            text = pc.fill_null(batch.column(2), "").cast(pa.large_string())
            length = pc.binary_length(text).to_numpy()
            empty = np.flatnonzero(length == 0)
            if len(empty):
                n, at = len(empty), pa.array(empty)
                yield out(batch.column(0).take(at), batch.column(1).take(at), [fixed(n, 0), fixed(n, True), fixed(n, False), fixed(n, True), *[pa.nulls(n, pa.binary())] * 2, *none(n)])
            short = np.flatnonzero((length > 0) & (length < size))
            if len(short):
                rows = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), text.take(pa.array(short)), pa.scalar(" ", pa.large_string()))
                lo = 0
                for a, a_at, b, b_at, good in pair.encode(rows):
                    n = len(good)
                    at = pa.array(short[lo : lo + n])
                    lo += n
                    if not good.all():
                        a, b = a[np.repeat(good, np.diff(a_at))], b[np.repeat(good, np.diff(b_at))]
                        a_at, b_at = (np.concatenate([[0], np.cumsum(np.diff(x) * good)]) for x in (a_at, b_at))
                    closed = [_binary(a, a_at, pair.kind), _binary(b, b_at, pair.kind)]
                    yield out(batch.column(0).take(at), batch.column(1).take(at), [fixed(n, 0), fixed(n, True), pa.array(good), fixed(n, True), *closed, *none(n)])
            for i in np.flatnonzero(length >= size).tolist():
                data = b" " + text[i].as_py().encode()
                for chunk, (lo, hi, begin, end) in enumerate(byte_ranges(data, size)):
                    body = pa.array([data[begin:end]], pa.binary())
                    held = [fixed(1, chunk), fixed(1, hi == len(data)), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.bool_()), *none(1)[:2]]
                    yield out(batch.column(0)[i : i + 1], batch.column(1)[i : i + 1], [*held, *none(1)[:4], body, fixed(1, lo - begin), fixed(1, hi - begin)])

    return run


def _range_fragments(byte_file: str, piece_file: str):
    """Rows of key, id, chunk, last, body, skip, take: the fragments of ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(byte_file, piece_file)
        for whole in batches:
            for n in range(whole.num_rows):
                batch = whole.slice(n, 1)
                rows = batch.column(4).cast(pa.large_string())
                a, _, b, _, good = next(pair.encode(rows))
                cut, parts = False, [a[:0]] * 6
                if good[0]:
                    cut, parts = _fragment(pair, a, b, batch.column(5)[0].as_py(), batch.column(6)[0].as_py(), batch.column(2)[0].as_py() == 0)
                prefix, closed, suffix = parts[:2], parts[2:4], parts[4:]
                held = [pa.array([x.astype(pair.kind).tobytes()], pa.binary()) for x in (*closed, *prefix, *suffix)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([bool(good[0])]), pa.array([cut]), *held], names=["key", "id", "chunk", "last", "good", "cut", "closed_a", "closed_b", *_OPEN])

    return run


def compose(left: tuple, right: tuple) -> tuple[tuple, tuple | None]:
    """Two neighbouring fragments as one, and the group that closes between them (place, A, B), if one does.

    A fragment is (whether it has a common end, the range of its first one, prefix A, prefix B, suffix A, suffix B);
    without a common end all its tokens are prefix.
    """
    cut, place, *prefix, suffix_a, suffix_b = left
    if not cut:
        joined = [x + y for x, y in zip(prefix, right[2:4], strict=True)]
        return (right[0], right[1], *joined, *right[4:]), None
    if not right[0]:
        return (True, place, *prefix, suffix_a + right[2], suffix_b + right[3]), None
    return (True, place, *prefix, *right[4:]), (right[1], suffix_a + right[2], suffix_b + right[3])


_NODES = "key long, node long, kind int, cut boolean, place long, prefix_a binary, prefix_b binary, suffix_a binary, suffix_b binary"


def _joined(table: pa.Table) -> pa.Table:
    """The fragments of one node of the tree as one fragment, and the groups closed between them (kind 1, as prefix)."""
    rows = sorted(table.to_pylist(), key=lambda r: r["node"])
    held, groups = None, []
    for r in rows:
        mine = (r["cut"], r["place"], *[r[c] or b"" for c in _OPEN])
        if held is None:
            held = mine
            continue
        held, group = compose(held, mine)
        if group and (group[1] or group[2]):
            groups.append(group)
    out = [{"key": rows[0]["key"], "node": rows[0]["node"] // FAN, "kind": 0, "cut": held[0], "place": held[1], **dict(zip(_OPEN, held[2:], strict=True))}]
    out += [{"key": rows[0]["key"], "node": -1, "kind": 1, "cut": True, "place": p, "prefix_a": a, "prefix_b": b, "suffix_a": b"", "suffix_b": b""} for p, a, b in groups]
    return pa.Table.from_pylist(out, schema=_SCHEMA)


_SCHEMA = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("kind", pa.int32()), ("cut", pa.bool_()), ("place", pa.int64()), *[(c, pa.binary()) for c in _OPEN]])


def seams(fragments: DataFrame) -> DataFrame:
    """Groups that close between ranges (key, at, a, b), from fragments of long texts, joined as a tree of ``FAN`` branches.

    Every round joins up to ``FAN`` neighbours of each text and writes what is left, so no task ever holds more than
    ``FAN`` fragments, which carry their open ends only.
    """
    level = fragments.select("key", F.col("chunk").alias("node"), F.lit(0).alias("kind"), "cut", F.col("chunk").alias("place"), *_OPEN)
    closed = []
    while True:
        parents = level.withColumn("parent", F.expr(f"node div {FAN}"))
        done = save(parents.groupBy("key", "parent").applyInArrow(_joined, _NODES), "joined_fragments")
        closed.append(done.filter("kind = 1").select("key", F.col("place").alias("at"), F.col("prefix_a").alias("a"), F.col("prefix_b").alias("b")))
        level = done.filter("kind = 0")
        if level.filter("node > 0").isEmpty():
            break
    found = closed[0]
    for more in closed[1:]:
        found = found.unionByName(more)
    return found


def _slices(columns: list[pa.Array], kind: np.dtype) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows lo to hi with ids and bounds of A and B, about ``TOKENS`` at a time."""
    (a, a_at), (b, b_at) = (_ids(c, kind) for c in columns)
    both, lo = a_at + b_at, 0
    while lo < len(both) - 1:
        hi = max(lo + 1, int(np.searchsorted(both, both[lo] + TOKENS, "right")) - 1)
        mine = [(ids[at[lo] : at[hi]].astype(np.int64), at[lo : hi + 1] - at[lo]) for ids, at in ((a, a_at), (b, b_at))]
        yield lo, hi, *mine[0], *mine[1]
        lo = hi


def links(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two cuts of the same bytes into tokens of these lengths: end, place in A and place in B of every link, and whether a group ends with it.

    Tokens that overlap do so in one stretch between two neighbouring ends, and each such stretch is a link.
    """
    ends_a, ends_b = np.cumsum(a_lengths), np.cumsum(b_lengths)
    mark = np.zeros(int(ends_a[-1]) + 1 if len(ends_a) else 1, dtype=np.uint8)
    mark[ends_a] = 1
    mark[ends_b] += 2
    at = np.flatnonzero(mark)
    ends = mark[at]
    is_a, is_b = (ends & 1).astype(np.int64), (ends >> 1).astype(np.int64)
    return at, np.cumsum(is_a) - is_a, np.cumsum(is_b) - is_b, ends == 3


def _counted(byte_file: str, piece_file: str):
    """How often each pair of ids is linked in batches of A and B: pair, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(byte_file, piece_file).forget()
        for batch in batches:
            found = []
            for _, _, a, _, b, _ in _slices(batch.columns, pair.kind):
                _, i, j, _ = links(pair.spell_a.lengths[a], pair.spell_b.lengths[b])
                held = pa.array(a[i] * pair.size_b + b[j]).dictionary_encode()
                n = np.bincount(held.indices.to_numpy(), minlength=len(held.dictionary))
                found.append(pa.RecordBatch.from_arrays([held.dictionary, pa.array(n)], names=["pair", "n"]))
            if len(found) == 1:
                yield found[0]
            elif found:
                summed = pa.Table.from_batches(found).group_by("pair", use_threads=False).aggregate([("n", "sum")])
                yield from summed.select(["pair", "n_sum"]).rename_columns(["pair", "n"]).to_batches()

    return run


def _measured(byte_file: str, piece_file: str, counts, lists: bool):
    """Rows of key, id, at, part, whole, a, b: their numbers of tokens, groups and links, and what the links' counts say.

    ``counts`` are sorted pairs with their counts (negative: the largest of their B id) as a broadcast.  With ``lists``, the groups of a
    whole text as a hash, and of a part as bytes that end with a semicolon.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(byte_file, piece_file).forget()
        known, often = counts.value
        for batch in batches:
            whole = batch.column(4).to_numpy(zero_copy_only=False)
            for lo, hi, a, a_at, b, b_at in _slices(batch.columns[5:], pair.kind):
                end, i, j, group = links(pair.spell_a.lengths[a], pair.spell_b.lengths[b])
                row = np.searchsorted(end, np.concatenate([[0], np.cumsum(pair.spell_a.lengths[a])])[a_at], "right")
                held = pa.array(a[i] * pair.size_b + b[j]).dictionary_encode()
                keys = held.dictionary.to_numpy()
                place = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
                n = np.where(known[place] == keys, often[place], 0) if len(known) else np.zeros(len(keys), np.int64)
                n = n[held.indices.to_numpy()]
                total = lambda x: pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[row]))  # noqa: E731, B023
                sums = [pa.array(np.diff(a_at)), pa.array(np.diff(b_at)), total(group.astype(np.int64)), pa.array(np.diff(row)), total((n < 0).astype(np.int64)), total(np.abs(n))]
                digests, bodies = [None] * (hi - lo), [None] * (hi - lo)
                if lists:
                    data, at = _lists(pair, a, b, a_at, b_at, i, j, group)
                    for r in range(hi - lo):
                        if whole[lo + r]:
                            digests[r] = hashlib.sha256(data[at[r] : at[r + 1] - 1]).hexdigest() if at[r + 1] > at[r] else ""
                        else:
                            bodies[r] = bytes(data[at[r] : at[r + 1]])
                kept = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*kept.columns[:5], *sums, pa.array(digests, pa.string()), pa.array(bodies, pa.binary())], names=["key", "id", "at", "part", "whole", *_SUMS, "digest", "body"])

    return run


_SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _lists(pair: Pair, a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray, i: np.ndarray, j: np.ndarray, group: np.ndarray) -> tuple[memoryview, list[int]]:
    """The groups as text, ``a1,a2|b1;a3|b2;``, and where each row's start."""
    of = np.cumsum(group) - group  # the group of each link
    last_a, last_b = np.ones(len(i), bool), np.ones(len(j), bool)
    last_a[:-1], last_b[:-1] = i[1:] != i[:-1], j[1:] != j[:-1]
    of_a, of_b = of[last_a], of[last_b]
    groups = int(of[-1]) + 1 if len(of) else 0
    n_a, n_b = np.bincount(of_a, minlength=groups), np.bincount(of_b, minlength=groups)
    before_b, upto_a = np.cumsum(n_b) - n_b, np.cumsum(n_a)
    end_a, end_b = np.ones(len(a), bool), np.ones(len(b), bool)
    end_a[:-1], end_b[:-1] = of_a[1:] != of_a[:-1], of_b[1:] != of_b[:-1]
    order = np.empty(len(a) + len(b), dtype=np.int64)
    order[np.arange(len(a)) + before_b[of_a]] = a + end_a * pair.size_a
    order[np.arange(len(b)) + upto_a[of_b]] = b + 2 * pair.size_a + end_b * pair.size_b
    return pair.written.of(order, a_at + b_at)


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts in order of text and place, as one row for each text; their lists are hashed as they come."""
    key, digest, sums, out = None, None, None, []

    def done():
        return (key[0], key[1], *sums, digest.hexdigest() if sums[0] else "")

    for batch in batches:
        for r in batch.to_pylist():
            if key is None or r["key"] != key[0]:
                if key is not None:
                    out.append(done())
                key, digest, sums, started = (r["key"], r["id"]), hashlib.sha256(), [0] * len(_SUMS), False
            if r["body"]:
                digest.update((b";" if started else b"") + r["body"][:-1])
                started = True
            sums = [x + r[c] for x, c in zip(sums, _SUMS, strict=True)]
        kind = batch.schema.field("id").type
        yield _rows(out, kind)
        out = []
    if key is not None:
        yield _rows([done()], kind)


def _rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in range(3 + len(_SUMS))]
    types = [pa.int64(), kind, *[pa.int64()] * len(_SUMS), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "id", *_SUMS, "digest"])


def _save_ids(df: DataFrame, name: str) -> DataFrame:
    """As ``save``, more tightly packed."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def aligned_pieces(docs: DataFrame, byte_file: str, piece_file: str, id_column: str = "doc_id", text: str = "text", size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """Written tables: pieces of aligned tokens (key, id, at, part, whole, a, b), and texts without tokens (key, id).

    ``a`` and ``b`` are ids as little-endian numbers of two or four bytes that spell the same bytes and end together.  A short text is one
    ``whole`` piece; a long one has, in the order of ``at`` and ``part``, a piece for the closed groups of each range (part 1) and one for each group
    between ranges (part 0).
    """
    kind = docs.schema[id_column].dataType
    blob, number, yes = T.BinaryType(), T.LongType(), T.BooleanType()
    fields = [("key", number), ("id", kind), ("chunk", number), ("last", yes), ("good", yes), ("cut", yes), ("closed_a", blob), ("closed_b", blob), *[(c, blob) for c in _OPEN]]
    schema = T.StructType([T.StructField(n, t) for n, t in [*fields, ("body", blob), ("skip", number), ("take", number)]])
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_column).alias("id"), F.col(text).alias("text"))
    first = _save_ids(keyed.mapInArrow(_fragments(byte_file, piece_file, size), schema), "fragments")
    # Only the ranges of long texts are dealt out anew.
    ranges = first.filter("body IS NOT NULL").select("key", "id", "chunk", "last", "body", "skip", "take").repartition("key", "chunk")
    long = _save_ids(ranges.mapInArrow(_range_fragments(byte_file, piece_file), T.StructType([T.StructField(n, t) for n, t in fields])), "long_fragments")
    bad = save(long.filter("NOT good").select("key").distinct(), "bad_texts")
    good = long.join(bad, "key", "left_anti")
    whole = first.filter("good").select("key", "id", F.lit(0).cast("long").alias("at"), F.lit(1).alias("part"), F.lit(True).alias("whole"), F.col("closed_a").alias("a"), F.col("closed_b").alias("b"))
    parts = good.select("key", "id", F.col("chunk").alias("at"), F.lit(1).alias("part"), F.lit(False).alias("whole"), F.col("closed_a").alias("a"), F.col("closed_b").alias("b"))
    between = seams(good).join(good.filter("chunk = 0").select("key", "id"), "key")
    between = between.select("key", "id", "at", F.lit(0).alias("part"), F.lit(False).alias("whole"), "a", "b")
    without = first.filter("NOT good").select("key", "id").unionByName(long.filter("chunk = 0").join(bad, "key", "left_semi").select("key", "id"))
    return whole.unionByName(parts).unionByName(between), without


def pair_counts(pieces: DataFrame, byte_file: str, piece_file: str) -> DataFrame:
    """Written ``pair, a_id, b_id, n, best`` of all pairs of ids that are linked anywhere: how often, and whether no pair of this B id is linked more often."""
    size = _pair(byte_file, piece_file).size_b
    counted = pieces.select("a", "b").mapInArrow(_counted(byte_file, piece_file), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = save(counted.select("pair", F.expr(f"pair div {size}").alias("a_id"), (F.col("pair") % size).alias("b_id"), "n"), "pair_counts")
    # A row for each id of B.
    most = save(counted.groupBy("b_id").agg(F.max("n").alias("most")), "most_linked")
    return save(counted.join(F.broadcast(most), "b_id").select("pair", "a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def align_tokenizers(docs: DataFrame, byte_file: str, piece_file: str, id_column: str = "doc_id", text: str = "text", size: int = RANGE) -> DataFrame:
    """Of every document: ``id_column, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A are the tokens of a blank and the text by ``byte_file``, B those of the text by ``piece_file`` (paths that every worker can open); strings
    of special tokens are plain text.  Texts that are null or empty, or that one of the tokenizers does not spell byte by byte, have no tokens:
    zeros, and '' in place of the hash.  Rows that repeat an id are documents of their own; null ids stay null.  No documents: no rows.  Other columns,
    whatever their names, are not read.

    Counts of pairs go to the workers in parts of ``PAIRS`` pairs, one after the other, whose sums are added.  A stretch of a text without
    a single blank between other characters is given to the tokenizers whole.
    """
    spark, kind = docs.sparkSession, docs.schema[id_column].dataType
    pieces, without = aligned_pieces(docs, byte_file, piece_file, id_column, text, size)
    counted = pair_counts(pieces, byte_file, piece_file)
    turns = max(1, -(-counted.count() // PAIRS))
    fields = [("key", T.LongType()), ("id", kind), ("at", T.LongType()), ("part", T.IntegerType()), ("whole", T.BooleanType()), *[(c, T.LongType()) for c in _SUMS], ("digest", T.StringType()), ("body", T.BinaryType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    rows, more = None, []
    for turn in range(turns):
        part = counted.filter(F.pmod(F.xxhash64("pair"), F.lit(turns)) == turn).select("pair", F.when(F.col("best"), -F.col("n")).otherwise(F.col("n")).alias("n")).toArrow()
        order = np.argsort(part["pair"].to_numpy())
        counts = spark.sparkContext.broadcast((part["pair"].to_numpy()[order], part["n"].to_numpy()[order]))
        measured = pieces.mapInArrow(_measured(byte_file, piece_file, counts, turn == 0), schema)
        if turn:
            more.append(save(measured.groupBy("key").agg(F.sum("n_best").alias("more_best"), F.sum("count_sum").alias("more_sum")), "measured"))
        else:
            rows = save(measured, "measured")
    schema = T.StructType([T.StructField(n, t) for n, t in [("key", T.LongType()), ("id", kind), *[(c, T.LongType()) for c in _SUMS], ("digest", T.StringType())]])
    parts = rows.filter("NOT whole").repartition("key").sortWithinPartitions("key", "at", "part").select("key", "id", *_SUMS, "body").mapInArrow(_stitched, schema)
    nothing = without.select("key", "id", *[F.lit(0).cast("long").alias(c) for c in _SUMS], F.lit("").alias("digest"))
    result = rows.filter("whole").select("key", "id", *_SUMS, "digest").unionByName(parts).unionByName(nothing)
    for extra in more:
        result = result.join(extra, "key", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
        result = result.drop("more_best", "more_sum")
    return result.select(F.col("id").alias(id_column), *_SUMS, F.col("digest").alias("groups_sha256"))
