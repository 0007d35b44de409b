"""Periodic runs of words, found with multi-scale minimizers.

A run is a maximal stretch of words that repeats with a smallest period. Short
periods are found by direct lag scans. For the others, windows grow by doubling:
inside a run of period p every window of at most p words has the same minimum
one period later, so pairs of equal minimizers at a distance between one and two
windows seed the period, and each seed is extended word by word in both
directions. Documents are independent: Spark deals them, nothing is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 12
#: Words of a seed; a window of w seeds spans w + SEED_WORDS - 1 words.
SEED_WORDS = 4
#: Seeds in the smallest window; periods below FIRST_WINDOW + SEED_WORDS - 1 are scanned lag by lag.
FIRST_WINDOW = 16
#: A document with more pairs of equal minimizers than this times its minimizers is scanned lag by lag at that scale.
PAIRS_PER_SEED = 16
#: Bytes of text that are worked on at once, one document at least.
CHUNK_BYTES = 8 << 20
#: Maps the id of a document, as text, and its words to the words to be searched.
Edit = Callable[[str, list[bytes]], list[bytes]]
_RUN = "struct<start: long, length: long, period: long>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stretches(ids: np.ndarray, lag: int, least: int, offset: int = 0) -> list[tuple[int, int]]:
    """Maximal ``[start, end)`` of at least ``least`` words in which words ``lag`` apart are equal."""
    if len(ids) <= lag:
        return []
    equal = np.flatnonzero(ids[lag:] == ids[:-lag])
    if len(equal) < least - lag:
        return []
    cuts = np.flatnonzero(np.diff(equal) > 1)
    first = equal[np.concatenate([[0], cuts + 1])]
    last = equal[np.concatenate([cuts, [len(equal) - 1]])]
    long = last - first + 1 >= least - lag
    return [(int(s) + offset, int(e) + 1 + lag + offset) for s, e in zip(first[long], last[long])]


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix."""
    at, step, n = 0, 32, len(a)
    while at < n:
        differ = np.flatnonzero(a[at : at + step] != b[at : at + step])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, 2 * step
    return n


class RunFinder:
    """Runs of several documents at once: ``ids`` holds their words, each document closed by an id of its own."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, min_length: int):
        self.ids, self.starts, self.min_length = ids, starts, min_length
        self.runs: list[tuple[int, int, int]] = []
        self.seen: set[tuple[int, int]] = set()
        self.past = np.zeros(len(ids), dtype=np.int64)  # partners before this lie in the same run of a smaller period

    def add(self, start: int, end: int, period: int) -> None:
        # a stretch found with a smaller period has the same ends
        if end - start >= max(self.min_length, 2 * period) and (start, end) not in self.seen:
            self.seen.add((start, end))
            self.runs.append((start, end, period))
            self.past[start:end] = np.maximum(self.past[start:end], end - period + 1)

    def scan(self, lag: int, start: int = 0, end: int | None = None) -> None:
        for found in _stretches(self.ids[start:end], lag, max(self.min_length, 2 * lag), start):
            self.add(*found, lag)

    def extend(self, at: int, lag: int) -> int:
        """Add the stretch around a seed; the first position whose partner is not in it."""
        left, right = self.ids[:-lag], self.ids[lag:]
        end = at + _same(left[at:], right[at:])
        start = at - _same(left[:at][::-1], right[:at][::-1])  # backwards from the seed
        self.add(start, end + lag, lag)
        return end

    def probe(self, at: np.ndarray, lag: np.ndarray) -> np.ndarray:
        """Seeds that have at least FIRST_WINDOW equal words in a row around them; a run has more."""
        n = len(self.ids)
        count = np.zeros(len(at), dtype=np.int64)
        for step in (1, -1):
            x, alive = at if step == 1 else at - 1, np.ones(len(at), dtype=bool)
            for _ in range(FIRST_WINDOW):
                inside = (x >= 0) & (x + lag < n)
                alive = alive & inside & (self.ids[np.where(inside, x, 0)] == self.ids[np.where(inside, x + lag, 0)])
                count += alive
                x = x + step
        return count >= FIRST_WINDOW

    def scale(self, keys: np.ndarray, grams: np.ndarray, bits: int, window: int) -> None:
        """Periods from ``window + SEED_WORDS - 1`` to below twice the window plus that."""
        low, high, n = window + SEED_WORDS - 1, 2 * window + SEED_WORDS - 1, len(self.ids)
        where = (keys & np.uint64((1 << bits) - 1)).astype(np.int64)
        where = where[np.concatenate([[True], where[1:] != where[:-1]])]
        names, group = np.unique(grams[where], return_inverse=True)
        places = np.sort(group.astype(np.int64) * (2 * n) + where)
        group, at = places // (2 * n), places % (2 * n)
        first = np.searchsorted(places, group * (2 * n) + np.minimum(np.maximum(at + low, self.past[at]), n))
        counts = np.maximum(np.searchsorted(places, group * (2 * n) + np.minimum(at + high, n)) - first, 0)
        doc = np.searchsorted(self.starts, at, "right") - 1
        many = np.bincount(doc, counts, len(self.starts)) > PAIRS_PER_SEED * np.bincount(doc, minlength=len(self.starts)) + PAIRS_PER_SEED
        for d in np.flatnonzero(many):
            end = self.starts[d + 1] if d + 1 < len(self.starts) else n
            for lag in range(low, min(high, (end - self.starts[d]) // 2 + 1)):
                self.scan(lag, int(self.starts[d]), int(end))
        counts[many[doc]] = 0
        own = np.repeat(np.arange(len(at)), counts)
        partner = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
        seed, lag = at[own], at[partner] - at[own]
        true = self.probe(seed, lag)
        seed, lag = seed[true], lag[true]
        order = np.lexsort((seed, lag))
        known, done = 0, 0
        for x, p in zip(seed[order].tolist(), lag[order].tolist()):
            if p != known or x >= done:
                known, done = p, self.extend(x, p)

    def find(self) -> list[tuple[int, int, int]]:
        """All runs as ``(start, end, period)``."""
        n = len(self.ids)
        longest = int(np.diff(np.append(self.starts, n)).max(initial=0)) - 1
        for lag in range(1, min(FIRST_WINDOW + SEED_WORDS - 1, longest // 2 + 1)):
            self.scan(lag)
        if longest < 2 * (FIRST_WINDOW + SEED_WORDS - 1):
            return self.runs
        words = _mixed(self.ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        grams = np.zeros(n - SEED_WORDS + 1, dtype=np.uint64)
        for k in range(SEED_WORDS):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(grams)]
        grams = _mixed(grams)
        bits = n.bit_length()
        keys = ((grams >> np.uint64(bits)) << np.uint64(bits)) | np.arange(len(grams), dtype=np.uint64)
        window = 1
        while 2 * (window + SEED_WORDS - 1) <= longest and len(keys):
            if window >= FIRST_WINDOW:
                self.scale(keys, grams, bits, window)
            keys = np.minimum(keys[: len(keys) - window], keys[window:])  # the leftmost smallest gram of twice the window
            window *= 2
        return self.runs


def runs_of(split: list[list[bytes]], min_length: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """Runs ``(start, length, period)`` of each list of words, by start and period."""
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    starts = np.cumsum([0, *(len(w) + 1 for w in split)])
    ids = np.empty(starts[-1], dtype=np.int64)
    for k, words in enumerate(split):
        ids[starts[k] : starts[k + 1] - 1] = [known[w] for w in words]
        ids[starts[k + 1] - 1] = -1 - k  # no word, and no other document's end
    found: list[list[tuple[int, int, int]]] = [[] for _ in split]
    for start, end, period in RunFinder(ids, starts[:-1], min_length).find():
        k = int(np.searchsorted(starts, start, "right")) - 1
        found[k].append((start - int(starts[k]), end - start, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, edit: Edit | None = None) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed_text)`` for each row of ``docs(doc_id, text)``.

    ``runs`` lists every run ``(start, length, period)`` of at least
    ``min_length`` words and two periods, by start and period; ``start`` counts
    words from 0. ``collapsed_text`` joins by one space the words that no run
    holds after its first period. ``edit`` may replace the words of a document
    first.

    Null and empty texts have no words and no runs; their collapsed text is
    empty. Null and repeated ids keep a row each; other columns are not read.
    The cost is n log n for a text of n words, and n squared comparisons at
    worst for a text made of interleaved short periods.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy(zero_copy_only=False)
            part = (np.cumsum(sizes) - sizes) // CHUNK_BYTES
            for k in np.unique(part):
                rows = np.flatnonzero(part == k)
                piece = batch.slice(int(rows[0]), len(rows))
                words = [t.as_py().split() for t in piece.column(1)]
                if edit is not None:
                    words = [edit(i.as_py() or "", own) for i, own in zip(piece.column(3), words)]
                runs = runs_of(words, min_length)
                flat = np.array([r for own in runs for r in own], dtype=np.int64).reshape(-1, 3)
                offsets = np.cumsum([0, *map(len, runs)]).astype(np.int32)
                structs = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(map(len, words), type=pa.int64()),
                     pa.ListArray.from_arrays(offsets, structs),
                     pa.array([b" ".join(collapsed(*d)) for d in zip(words, runs)], type=pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed_text"])

    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("size"),
                       F.col("doc_id").cast("string").alias("name"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs array<{_RUN}>, collapsed_text string")
