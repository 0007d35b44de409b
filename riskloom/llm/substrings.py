"""Byte strings that occur again, by distributed prefix doubling.

A string of LENGTH bytes is known by its anchor: the position with the smallest
hash of eight bytes among its first SPAN. Equal strings have their anchors at
the same offset, so positions are compared by anchor, and there is one for some
sixty bytes of text. The anchor's first rank is the hash of the bytes that all
its strings share, LENGTH - SPAN + 1. A cell is a range of offsets: the strings
that start there share its core, and all together cover its context. Spark
sorts (rank, core, context, position) by range, and neighbours in that order are
compared: a core that occurs once ends the cell, a context that occurs again
settles all its strings, and any other cell is divided and ranked again by
pairs of its rank and the hash of a longer core, until cores are LENGTH long.

A sorted range is a bounded number of rows of any heat. It settles its own rows;
for its first and last row, one more look at the edges of all ranges decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import attach, id_array, ids_of, staged

LENGTH = 400
#: Offsets that an anchor answers for, a power of two below 256, and the cells that they are divided into.
SPAN = 128
STEPS = (SPAN, 16, 1)
#: Rows of a sorted range.
RANGE_ROWS = 500_000
#: Bytes of text whose anchors are sought at once.
CHUNK_BYTES = 2 << 20
_CELL = "name long, core long, ctx long, doc_id long, mark long, place long"
_DECIDED, _GOES_ON, _EDGE = 1, 2, 4


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, span: int) -> tuple[np.ndarray, ...]:
    """Anchors of the strings within each ``[start, end)`` of ``data``: positions, and the smallest and largest offset."""
    counts = np.maximum(ends - starts - length + 1, 0)
    total = int(counts.sum())
    if not total:
        return (np.zeros(0, dtype=np.int64),) * 3
    words = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))
    bits = len(data).bit_length()
    x = (words ^ (words >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    keys = ((x >> np.uint64(bits)) << np.uint64(bits)) | np.arange(len(x), dtype=np.uint64)
    window = 1
    while window < span:
        keys = np.minimum(keys[: len(keys) - window], keys[window:])
        window *= 2
    where = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(total)
    anchor = (keys[where] & np.uint64((1 << bits) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.append(first[1:], total) - 1
    at = anchor[first]
    return at, at - where[last], at - where[first]


def _hashes(text: memoryview, begin: np.ndarray, end: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    found = [digest(text[i:j], s) for i, j, s in zip(begin.tolist(), end.tolist(), seeds.tolist())]
    return np.array(found, dtype=np.uint64).view(np.int64)


def cells(text: memoryview, at: np.ndarray, low: np.ndarray, high: np.ndarray, step: int, length: int, span: int) -> tuple[np.ndarray, ...]:
    """Rank, core and context of each cell ``[low, high]`` of an anchor, none crossing a multiple of ``step``."""
    nothing = np.zeros(len(at), dtype=np.int64)
    name = _hashes(text, at, at + length - span + 1, nothing)
    base = low // step * step
    core = nothing if step == span else _hashes(text, at - base, at - base - step + 1 + length, nothing)
    ctx = core if step == 1 else _hashes(text, at - high, at - low + length, low << 8 | high)
    return name, core, ctx


def _pack(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return at << 16 | low << 8 | high


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 16, place >> 8 & 255, place & 255


def _table(name, core, ctx, doc_id, mark, place) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(name), pa.array(core), pa.array(ctx), id_array(doc_id), pa.array(mark), pa.array(place)],
        names=["name", "core", "ctx", "doc_id", "mark", "place"])


def first_cells(texts: DataFrame, length: int, span: int) -> DataFrame:
    """One cell for each anchor of ``texts(doc_id, mark, text)``."""

    def pieces(batch: pa.RecordBatch) -> Iterator[list[tuple[int, int, bytes]]]:
        """Row, offset and bytes, some CHUNK_BYTES at once; longer texts in parts that overlap by a string."""
        held, size = [], 0
        for row, text in enumerate(batch.column(2)):
            text = text.as_py()
            for offset in range(0, len(text) - length + 1, CHUNK_BYTES):
                held.append((row, offset, text[offset : offset + CHUNK_BYTES + length - 1]))
                size += len(held[-1][2])
                if size >= CHUNK_BYTES:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = ids_of(batch.column(0)), batch.column(1).to_numpy()
            for held in pieces(batch):
                rows, offsets = (np.array(x, dtype=np.int64) for x in list(zip(*held))[:2])
                ends = np.cumsum([len(p[2]) for p in held])
                starts = np.concatenate([[0], ends[:-1]])
                text = b"".join(p[2] for p in held)
                at, low, high = anchors(np.frombuffer(text, dtype=np.uint8), starts, ends, length, span)
                piece = np.searchsorted(ends, at, "right")
                keys = cells(memoryview(text), at, low, high, span, length, span)
                place = _pack(at - starts[piece] + offsets[piece], low, high)
                yield _table(*keys, ids[rows[piece]], marks[rows[piece]], place)

    return texts.mapInArrow(run, _CELL)


def divided_cells(texts: DataFrame, step: int, length: int, span: int) -> DataFrame:
    """The cells of ``texts(doc_id, mark, text, places)``, divided at multiples of ``step``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = ids_of(batch.column(0)), batch.column(1).to_numpy()
            for row, (text, places) in enumerate(zip(batch.column(2), batch.column(3))):
                at, low, high = _unpack(places.values.to_numpy())
                count = high // step - low // step + 1
                own = np.repeat(np.arange(len(at)), count)
                base = (low[own] // step + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)) * step
                at, low, high = at[own], np.maximum(low[own], base), np.minimum(high[own], base + step - 1)
                keys = cells(memoryview(text.as_buffer()), at, low, high, step, length, span)
                yield _table(*keys, np.full(len(at), ids[row]), np.full(len(at), marks[row]), _pack(at, low, high))

    return texts.mapInArrow(run, _CELL)


def verdicts(name: np.ndarray, core: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """What one sorted range of cells decides: flags of each row.

    Of several equal contexts one goes on for those that differ, if the core
    has others. The neighbours of the first and the last row are not known
    here: such a row goes on, and is an edge.
    """
    n = len(name)
    new_core = np.ones(n + 1, dtype=bool)
    new_core[1:-1] = (name[1:] != name[:-1]) | (core[1:] != core[:-1])
    new_ctx = new_core.copy()
    new_ctx[1:-1] |= ctx[1:] != ctx[:-1]
    new_core[[0, n]] = False
    start = np.flatnonzero(new_ctx[:-1])
    end = np.append(start[1:], n)
    others = ~new_core[start] | ~new_core[end]
    flags = np.where(np.repeat(end - start > 1, end - start), _DECIDED, 0)
    flags[start[others]] |= _GOES_ON
    flags[[0, n - 1]] |= _EDGE
    return flags


def settled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of staged cells: those whose context occurs again, and those to be divided; ``(doc_id, mark, place)``."""
    order = ["name", "core", "ctx", "doc_id", "mark", "place"]
    ranges = rows.repartitionByRange(max(1, -(-rows.count() // RANGE_ROWS)), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), rows_schema)  # a bounded number of rows
        if table.num_rows:
            table = table.combine_chunks()
            flags = verdicts(*(table.column(c).to_numpy() for c in ("name", "core", "ctx")))
            table = table.append_column("flags", pa.array(flags, type=pa.int32())).filter(pa.array(flags > 0))
            yield from table.to_batches()

    rows_schema = pa.schema([(c, pa.int64()) for c in order])
    out = staged(ranges.mapInArrow(run, f"{_CELL}, flags int"), "ranked")
    flag = lambda bit: F.col("flags").bitwiseAND(bit) > 0
    edges = out.filter(flag(_EDGE))
    again = staged(edges.groupBy("name", "core", "ctx").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "edges")
    open_rows = attach(edges.filter(~flag(_DECIDED)), again, ["name", "core", "ctx"], "left_semi")
    own = ["doc_id", "mark", "place"]
    return out.filter(flag(_DECIDED)).select(*own).unionAll(open_rows.select(*own)), out.filter(flag(_GOES_ON)).select(*own)


def merged_spans(places: DataFrame, length: int) -> DataFrame:
    """``(doc_id, mark, spans)`` of decided cells: the bytes covered, as starts and ends in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for row in batch.column(2):
                at, low, high = _unpack(np.sort(row.values.to_numpy()))
                order = np.argsort(at - high)
                begin, end = (at - high)[order], np.maximum.accumulate((at - low + length)[order])
                cut = np.flatnonzero(begin[1:] > end[:-1])
                lists.append(np.stack([begin[np.append(0, cut + 1)], end[np.append(cut, len(end) - 1)]], axis=1).ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lists, type=pa.list_(pa.int64()))], names=["doc_id", "mark", "spans"])

    grouped = places.groupBy("doc_id", "mark").agg(F.collect_list("place").alias("places"))
    return grouped.mapInArrow(run, "doc_id long, mark long, spans array<long>")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, mark, spans)`` of the texts with bytes to remove; ``mark`` is a hash of the text."""
    span, steps = SPAN, STEPS
    if length < 3 * span:
        raise ValueError(f"strings have at least {3 * span} bytes")
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), F.col("text").cast("binary"))
    texts = texts.filter(F.octet_length("text") >= length)
    found, rest = [], None
    for step in steps:
        if rest is None:
            rows = first_cells(texts, length, span)
        else:
            places = rest.groupBy("doc_id", "mark").agg(F.collect_set("place").alias("places"))
            rows = divided_cells(attach(texts, staged(places, "places"), ["doc_id", "mark"], "inner"), step, length, span)
        decided, rest = settled(staged(rows, "cells"))
        found.append(decided)
    return merged_spans(reduce(DataFrame.unionAll, found), length)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)`` for each row of ``docs(doc_id, text)``.

    A byte goes if a string of ``length`` bytes covers it that starts somewhere
    else as well, in any row, the same included. ``spans`` lists the maximal
    removed runs as ``(start, end)`` in bytes of UTF-8; ``kept`` holds the
    other bytes, and may end within a character.

    Null and empty texts have no bytes. Rows with a null or repeated id keep a
    row each and count as rows of their own: a repeated row repeats its text.
    Other columns are not read. Strings are equal if their 128-bit hashes are.
    """
    spans = staged(repeated_spans(docs, length), "spans")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, lists, sizes = [], [], []
            for text, cut in zip(batch.column(1), batch.column(2)):
                text, cut = text.as_py(), cut.as_py() or []
                bounds = [0, *cut, len(text)]
                kept.append(b"".join(text[i:j] for i, j in zip(bounds[::2], bounds[1::2])))
                lists.append([{"start": i, "end": j} for i, j in zip(cut[::2], cut[1::2])])
                sizes.append(len(text))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, type=pa.int64()), pa.array(lists, type=kind), pa.array(kept, type=pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"])

    joined = attach(rows, spans, ["doc_id", "mark"]).select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
