"""Lines that repeat across documents, found on range-partitioned line hashes.

Rows ``(hash, doc_id, position)`` are range-partitioned and sorted by hash,
document (largest first) and position, so each partition streams its keys once:
the first document of a key holds it, later ones lose the line. The ranges run
over all four columns, so a key of any heat is cut between documents; what a
partition cannot decide about its first and last key is settled by a summary of
at most two rows per partition. The result is one compressed keep bitmap per
document, never text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import attach, id_array, ids_of, staged

SPACES = b" \t\n\r\x0b\x0c"
MIN_CHARS = 20
MIN_DOCS = 3
_DROP, _PENDING, _SUMMARY = 0, 1, 2
_MARKS = "kind int, h1 long, h2 long, doc_id long, mark long, pos int, last_doc long, n long, part int"


def line_keys(text: bytes, min_chars: int) -> tuple[list[bytes], list[int]]:
    """128-bit hashes and positions of the lines whose key has ``min_chars`` code points."""
    digests, at = [], []
    for pos, line in enumerate(text.split(b"\n")):
        key = line.strip(SPACES).lower()
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars):
            digests.append(xxhash.xxh3_128_digest(key))
            at.append(pos)
    return digests, at


def line_rows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line long enough to count: hash, document, checksum of its text, position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, places, counts, checks = [], [], [], []
            for text in batch.column(1):
                text = text.as_py() or b""
                found, at = line_keys(text, min_chars)
                digests += found
                places += at
                counts.append(len(at))
                checks.append(zlib.crc32(text))
            hashes = np.frombuffer(b"".join(digests), dtype=">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[:, 0].copy()), pa.array(hashes[:, 1].copy()),
                 id_array(np.repeat(ids_of(batch.column(0)), counts)),
                 pa.array(np.repeat(np.array(checks, dtype=np.int64), counts)),
                 pa.array(np.array(places, dtype=np.int32))],
                names=["h1", "h2", "doc_id", "mark", "pos"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(
        run, "h1 long, h2 long, doc_id long, mark long, pos int")


def _marks(kind: int, rows: int, **columns) -> pa.RecordBatch:
    names = ["h1", "h2", "doc_id", "mark", "pos", "last_doc", "n", "part"]
    kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    arrays = [pa.array(np.full(rows, kind, dtype=np.int32))]
    for name, of in zip(names, kinds):
        value = columns.get(name)
        if value is None:
            arrays.append(pa.nulls(rows, of))
        elif name in ("doc_id", "last_doc"):
            arrays.append(id_array(value))
        else:
            arrays.append(pa.array(value, type=of))
    return pa.RecordBatch.from_arrays(arrays, names=["kind", *names])


def mark_lines(part: int, h1, h2, doc, mark, pos, min_docs: int) -> Iterator[pa.RecordBatch]:
    """What one sorted range of lines decides, and what it leaves to its neighbours.

    Rows of a key whose range starts and ends here are dropped or kept for
    good. All rows of the first key wait, as an earlier range may hold its
    first document; rows of the last key wait while too few documents are seen.
    """
    if not len(h1):
        return
    new_key = np.ones(len(h1), dtype=bool)
    new_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    new_doc = new_key.copy()
    new_doc[1:] |= doc[1:] != doc[:-1]
    run = np.cumsum(new_key) - 1
    starts = np.flatnonzero(new_key)
    ends = np.append(starts[1:], len(h1)) - 1
    steps = np.cumsum(new_doc)
    rank = steps - steps[starts][run]  # documents of the key before this row's
    docs = rank[ends] + 1
    settled = (run > 0) & (rank >= 1) & (docs[run] >= min_docs)
    waits = (run == 0) | ((run == run[-1]) & (rank >= 1) & ~settled)
    yield _marks(_DROP, int(settled.sum()), doc_id=doc[settled], mark=mark[settled], pos=pos[settled])
    yield _marks(_PENDING, int(waits.sum()), h1=h1[waits], h2=h2[waits], doc_id=doc[waits],
                 mark=mark[waits], pos=pos[waits])
    edges = np.unique([0, run[-1]])
    yield _marks(_SUMMARY, len(edges), h1=h1[starts[edges]], h2=h2[starts[edges]],
                 doc_id=doc[starts[edges]], last_doc=doc[ends[edges]], n=docs[edges],
                 part=np.full(len(edges), part, dtype=np.int32))


def dropped_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(doc_id, mark, pos)`` of the lines that go, from the staged rows of ``line_rows``."""
    order = ["h1", "h2", F.col("doc_id").desc_nulls_last(), "mark", "pos"]
    ranges = lines.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        columns = [table.column(c).combine_chunks() for c in ("h1", "h2", "doc_id", "mark", "pos")]
        arrays = [ids_of(c) if i == 2 else c.to_numpy(zero_copy_only=False) for i, c in enumerate(columns)]
        yield from mark_lines(TaskContext.get().partitionId(), *arrays, min_docs)

    marks = staged(ranges.mapInArrow(run, _MARKS), "marks")
    # At most two summaries per range, so this side is bounded by the number of ranges.
    edges = marks.filter(F.col("kind") == _SUMMARY).withColumn(
        "same", F.lag("last_doc").over(Window.partitionBy("h1", "h2").orderBy("part")).eqNullSafe(F.col("doc_id"))
        & F.lag("part").over(Window.partitionBy("h1", "h2").orderBy("part")).isNotNull())
    keys = edges.groupBy("h1", "h2").agg(
        F.sum(F.col("n") - F.coalesce(F.col("same").cast("long"), F.lit(0))).alias("docs"),
        F.min_by("doc_id", "part").alias("holder"))
    keys = F.broadcast(keys.filter(F.col("docs") >= min_docs))
    late = marks.filter(F.col("kind") == _PENDING).join(keys, ["h1", "h2"]).filter(
        ~F.col("doc_id").eqNullSafe(F.col("holder")))
    return marks.filter(F.col("kind") == _DROP).select("doc_id", "mark", "pos").unionAll(
        late.select("doc_id", "mark", "pos"))


def pack(positions: np.ndarray) -> bytes:
    """Compressed bitmap with 1 for every kept line; lines behind its end are kept."""
    keep = np.ones(int(positions.max()) + 1, dtype=np.uint8)
    keep[positions] = 0
    return len(keep).to_bytes(4, "big") + zlib.compress(np.packbits(keep).tobytes())


def unpack(bitmap: bytes) -> np.ndarray:
    n = int.from_bytes(bitmap[:4], "big")
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap[4:]), dtype=np.uint8), count=n)


def _packed(positions: pd.Series) -> pd.Series:
    return positions.map(lambda p: pack(np.asarray(p)))


def _kept(texts: pd.Series, bitmaps: pd.Series) -> pd.Series:
    out = []
    for text, bitmap in zip(texts, bitmaps):
        if bitmap is not None:
            lines, keep = text.split("\n"), unpack(bitmap)
            text = "\n".join(line for i, line in enumerate(lines) if i >= len(keep) or keep[i])
        out.append(text)
    return pd.Series(out, dtype=object)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(doc_id, mark, n_dropped, bitmap)`` for each document that loses lines.

    A line's key is the line without ASCII white space at its ends and with
    A-Z lower-cased. A key of at least ``min_chars`` code points found in at
    least ``min_docs`` documents stays only in the largest doc_id holding it,
    there with all its lines.

    Rows that share a doc_id count as one document; ``mark``, the CRC-32 of the
    text, tells them apart, and equal rows share a bitmap. A null id counts as
    one document below all others. A null text is one empty line. An empty
    table gives an empty table.
    """
    drops = dropped_lines(staged(line_rows(docs, min_chars), "lines"), min_docs)
    lists = drops.groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("at"))
    return lists.select("doc_id", "mark", F.size("at").cast("long").alias("n_dropped"),
                        F.pandas_udf(_packed, "binary")("at").alias("bitmap"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``text`` cut to the kept lines and the count ``n_dropped``; null texts turn empty.

    ``bitmaps`` is a staged table of ``keep_bitmaps``. All columns of ``docs``
    stay but for earlier ones named ``kept_text`` and ``n_dropped``.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.drop("kept_text", "n_dropped").withColumn("__mark", F.crc32(text.cast("binary")))
    side = bitmaps.withColumnsRenamed({"mark": "__mark", "bitmap": "__bitmap", "n_dropped": "__n_dropped"})
    out = attach(rows, side, ["doc_id", "__mark"])
    return out.withColumns({
        "kept_text": F.pandas_udf(_kept, "string")(text, "__bitmap"),
        "n_dropped": F.coalesce("__n_dropped", F.lit(0).cast("long"))}).drop("__mark", "__bitmap", "__n_dropped")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the columns ``kept_text`` and ``n_dropped``; see ``keep_bitmaps`` and ``apply_bitmaps``."""
    return apply_bitmaps(docs, staged(keep_bitmaps(docs, min_chars, min_docs), "bitmaps"))
