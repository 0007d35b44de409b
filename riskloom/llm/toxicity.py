"""Toxicity by a gap-weighted subsequence kernel with Nystroem landmarks.

Strings are compared by their subsequences of three characters that span at
most ``SPAN`` characters, each skipped character costing a factor ``DECAY``;
characters inserted into an insult, or left out, only weaken the match. Words
are the strings: a sentence, and a document, is as toxic as its worst word. A
run of single letters counts as one word, and punctuation inside a word is
skipped, so spelled-out insults are words too.

Training is multiple-instance learning on a bounded sample of labelled
documents: each toxic document names its worst word as witness, each clean one
its worst words as counter-examples; a support vector machine is fitted to
their kernel values at landmark words and names new witnesses. Because the
kernel has explicit features, the machine folds into one weight per
three-character subsequence, and scoring is table look-ups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import staged

SPAN = 6
DECAY = 0.5
#: Labelled documents of each class that the model is fitted on; a bound.
TRAIN_DOCS = 2_000
LANDMARKS = 160
ROUNDS = 3
#: Words of clean texts that serve as examples besides the worst ones.
USUAL_WORDS = 8_000
#: Words above this length are cut into overlapping pieces of two thirds of it.
MAX_WORD = 24
#: Characters of text scored at once.
CHUNK_CHARS = 1_000_000
LOWEST, HIGHEST = -3.0, 3.0
_DROP, _SPACE = 255, 0
#: Digits and signs that stand in for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a"}


def _code_table() -> np.ndarray:
    table = np.full(1 << 16, _DROP, dtype=np.uint8)
    for cp in range(1 << 16):
        ch = LOOKALIKES.get(chr(cp), chr(cp))
        if "a" <= ch <= "z":
            table[cp] = ord(ch) - 96
        elif ch.isspace():
            table[cp] = _SPACE
        elif ch.isalnum():
            table[cp] = 27 + cp * 7 % 36
    return table


_CODES: list[np.ndarray] = []


def codes(text: str) -> np.ndarray:
    """Characters as numbers 1 to 62 with 0 between words, ending in 0."""
    if not _CODES:
        _CODES.append(_code_table())
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    out = _CODES[0][points & 0xFFFF]
    out = np.append(out[out != _DROP], np.uint8(_SPACE))
    gaps = np.flatnonzero(out == _SPACE)
    lengths = np.diff(gaps, prepend=-1) - 1
    filled = lengths > 0
    # Gaps between two single letters vanish: "i d i o t" is one word.
    spelled = (lengths[:-1] == 1) & (lengths[1:] == 1) if len(gaps) > 1 else np.zeros(0, dtype=bool)
    keep = np.ones(len(out), dtype=bool)
    keep[gaps[:-1][spelled]] = False
    keep[gaps[~filled]] = False
    return np.append(out[keep], np.uint8(_SPACE))


@dataclass
class Words:
    """Words of some texts in one array of codes."""

    chars: np.ndarray  # codes, 0 behind each word
    starts: np.ndarray
    lengths: np.ndarray
    doc: np.ndarray  # text of each word
    run: np.ndarray  # characters left in the word, this one included


def words_of(texts: list[str]) -> Words:
    parts = [codes(t) for t in texts]
    chars = np.concatenate([np.zeros(1, np.uint8), *parts]).astype(np.int32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(p) for p in parts])
    gaps = np.flatnonzero(chars == 0)
    starts = gaps[:-1] + 1
    lengths = np.diff(gaps) - 1
    run = np.append(np.repeat(gaps[1:], np.diff(gaps)) - np.arange(gaps[0], gaps[-1]), 0).astype(np.int32)
    run[gaps] = 0
    keep = lengths >= 3
    starts, lengths = starts[keep], lengths[keep]
    if (long := lengths > MAX_WORD).any():
        piece, step = 2 * MAX_WORD // 3, MAX_WORD // 3
        more = [np.arange(s, s + n - step, step) for s, n in zip(starts[long], lengths[long])]
        ends = np.repeat(starts[long] + lengths[long], [len(m) for m in more])
        more = np.concatenate(more)
        starts = np.concatenate((starts[~long], more))
        lengths = np.concatenate((lengths[~long], np.minimum(piece, ends - more)))
        order = np.argsort(starts, kind="stable")
        starts, lengths = starts[order], lengths[order]
    return Words(chars, starts, lengths, owner[starts - 1] if len(starts) else np.zeros(0, int), run)


def _norms() -> np.ndarray:
    """Length of the feature vector of a word without repeated subsequences, by its number of characters."""
    out = np.ones(MAX_WORD + 1)
    for n in range(3, MAX_WORD + 1):
        out[n] = math.sqrt(sum((n - b) * (b - 1) * DECAY ** (2 * (b - 2)) for b in range(2, min(SPAN, n))))
    return out


NORMS = _norms()


def fold(words: Words, weights: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """Sum over each word's subsequences of decay times ``weights``, divided by the word's norm.

    ``weights`` has a value per subsequence code, or ``rows`` gives the row of
    ``weights`` of each code.
    """
    shape = (len(words.chars),) + weights.shape[1:]
    total = np.zeros(shape, dtype=np.float64)
    first, middle = words.chars << 12, words.chars << 6
    for b in range(2, SPAN):
        at = np.flatnonzero(words.run > b)
        base = first[at] + words.chars[at + b]
        for a in range(1, b):
            code = base + middle[at + a]
            total[at] += DECAY ** (b - 2) * weights[code if rows is None else rows[code]]
    sums = np.concatenate((np.zeros((1,) + shape[1:]), np.cumsum(total, axis=0)))
    got = sums[words.starts + words.lengths] - sums[words.starts]
    norm = NORMS[words.lengths]
    return got / (norm if got.ndim == 1 else norm[:, None])


def feature_codes(words: Words, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position, code and weight of every subsequence."""
    ats, found, weights = [], [], []
    for b in range(2, span):
        at = np.flatnonzero(words.run > b)
        for a in range(1, b):
            ats.append(at)
            found.append((words.chars[at] << 12) + (words.chars[at + a] << 6) + words.chars[at + b])
            weights.append(np.full(len(at), DECAY ** (b - 2)))
    return np.concatenate(ats), np.concatenate(found), np.concatenate(weights)


def spelling(words: Words, i: int) -> bytes:
    s = words.starts[i]
    return words.chars[s : s + words.lengths[i]].astype(np.uint8).tobytes()


def from_spellings(items: list[bytes]) -> Words:
    chars = np.frombuffer(b"\x00" + b"".join(x + b"\x00" for x in items), dtype=np.uint8).astype(np.int32)
    gaps = np.flatnonzero(chars == 0)
    run = np.append(np.repeat(gaps[1:], np.diff(gaps)) - np.arange(gaps[0], gaps[-1]), 0)
    run[gaps] = 0
    return Words(chars, gaps[:-1] + 1, np.diff(gaps) - 1, np.arange(len(items)), run)


class Landmarks:
    """Nystroem features: kernel values at the landmarks, whitened by their own kernel matrix."""

    def __init__(self, items: list[bytes]):
        words = from_spellings(items)
        at, found, weight = feature_codes(words)
        owner = np.searchsorted(words.starts, at, side="right") - 1
        self.features, columns = np.unique(found, return_inverse=True)
        self.rows = np.zeros(1 << 18, dtype=np.int32)  # row 0 holds zeros
        self.rows[self.features] = np.arange(1, len(self.features) + 1)
        self.table = np.zeros((len(self.features) + 1, len(items)))
        np.add.at(self.table, (columns + 1, owner), weight)
        self.table /= NORMS[words.lengths]
        values, vectors = np.linalg.eigh((g := self.kernel(items)) + g.T)
        good = values > 1e-3
        self.whiten = vectors[:, good] / np.sqrt(values[good] / 2)

    def kernel(self, items: list[bytes]) -> np.ndarray:
        parts = [fold(from_spellings(items[i : i + 2_000]), self.table, self.rows) for i in range(0, len(items), 2_000)]
        return np.concatenate(parts) if parts else np.zeros((0, self.table.shape[1]))

    def map(self, items: list[bytes]) -> np.ndarray:
        return self.kernel(items) @ self.whiten

    def weights(self, normal: np.ndarray) -> np.ndarray:
        """One weight per subsequence code for a normal vector in the whitened space."""
        out = np.zeros(1 << 18)
        out[self.features] = self.table[1:] @ (self.whiten @ normal)
        return out


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Normal vector, then bias, of a linear machine with squared hinge loss, by Newton steps."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    cost = cost / cost.sum()
    for _ in range(25):
        active = y * (x @ w) < 1
        xa, ca = x[active], cost[active]
        new = np.linalg.solve(xa.T @ (xa * ca[:, None]) + np.diag(penalty), xa.T @ (ca * y[active]))
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def platt(scores: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of the labels over the scores."""
    x, w = np.stack((scores, np.ones_like(scores)), axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (cost * (y - p)) - 1e-3 * cost.sum() * w * [1, 0]
        step = np.linalg.solve(x.T @ (x * (cost * p * (1 - p))[:, None]) + np.diag([1e-3 * cost.sum(), 1e-9]), gradient)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


@dataclass
class Model:
    """Weights of the subsequences, bias, and the curve from decisions to probabilities."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def decisions(self, texts: list[str]) -> np.ndarray:
        """Decision of the worst word of each text; ``LOWEST`` without a word of three characters."""
        out = np.full(len(texts), LOWEST)
        words = words_of(texts)
        if len(words.starts):
            np.maximum.at(out, words.doc, np.clip(fold(words, self.weights) + self.bias, LOWEST, HIGHEST))
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 of each text, a long text piece by piece."""
        worst, chunk, owners, size = np.full(len(texts), LOWEST), [], [], 0

        def flush() -> None:
            if chunk:
                np.maximum.at(worst, owners, self.decisions(chunk))
                chunk.clear(), owners.clear()

        for i, text in enumerate(texts):
            for piece in pieces(text):
                chunk.append(piece)
                owners.append(i)
                size += len(piece)
                if size >= CHUNK_CHARS:
                    flush()
                    size = 0
        flush()
        return 1 / (1 + np.exp(-(self.slope * worst + self.offset)))


def pieces(text: str) -> Iterator[str]:
    """``text`` cut between words where it is very long; a cut inside a word repeats part of it."""
    at = 0
    while len(text) - at > CHUNK_CHARS:
        cut = text.rfind(" ", at + CHUNK_CHARS // 2, at + CHUNK_CHARS)
        end = cut if cut >= 0 else at + CHUNK_CHARS
        yield text[at:end]
        at = end if cut >= 0 else end - MAX_WORD
    yield text[at:]


def chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of some ``CHUNK_CHARS`` characters, with the number of the first."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= CHUNK_CHARS // 2:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def _first_weights(texts: list[str], toxic: np.ndarray) -> np.ndarray:
    """How much more often each subsequence occurs in toxic documents, in standard errors."""
    seen_in = np.zeros((2, 1 << 18))
    for start, part in chunks(texts):
        words = words_of(part)
        at, found, _ = feature_codes(words, 4)
        owner = words.doc[np.clip(np.searchsorted(words.starts, at, side="right") - 1, 0, None)]
        seen = np.unique(owner.astype(np.int64) << 18 | found)
        doc, code = seen >> 18, seen & (1 << 18) - 1
        for label in (0, 1):
            seen_in[label] += np.bincount(code[toxic[start + doc] == bool(label)], minlength=1 << 18)
    n1, n0 = max(toxic.sum(), 1), max((~toxic).sum(), 1)
    share = (seen_in.sum(axis=0) + 1) / (n1 + n0 + 2)
    return (seen_in[1] / n1 - seen_in[0] / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))


def _worst(words: Words, values: np.ndarray, docs: np.ndarray, n: int) -> list[list[bytes]]:
    """The ``n`` words of the highest value of each of ``docs``, different ones."""
    order = np.lexsort((-values, words.doc))
    starts = np.searchsorted(words.doc[order], docs)
    ends = np.searchsorted(words.doc[order], docs, side="right")
    out = []
    for s, e in zip(starts, ends):
        names: dict[bytes, None] = {}
        for i in order[s : min(e, s + 8 * n)]:
            names[spelling(words, i)] = None
            if len(names) == n:
                break
        out.append(list(names))
    return out


def _examples(texts: list[str], toxic: np.ndarray, weights: np.ndarray, rng: np.random.Generator) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """The worst word of each toxic text; the four worst of each clean one, and some of its others."""
    witnesses, hard, usual = [], [], []
    share = USUAL_WORDS / max(sum(map(len, texts)), 1)
    for start, part in chunks(texts):
        words = words_of(part)
        if not len(words.starts):
            continue
        values, labels = fold(words, weights), toxic[start : start + len(part)]
        witnesses += [w[0] for w in _worst(words, values, np.flatnonzero(labels), 1) if w]
        hard += [x for w in _worst(words, values, np.flatnonzero(~labels), 4) for x in w]
        clean = np.flatnonzero(~labels[words.doc])
        some = rng.choice(clean, min(len(clean), math.ceil(share * sum(map(len, part)))), replace=False)
        usual += [spelling(words, i) for i in some]
    return witnesses, hard, usual


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> Model | None:
    """A model of documents and labels; ``weight`` is the number of documents that each stands for.

    A quarter of the documents is kept for the curve of probabilities. None if
    one of the classes is missing. Texts are read in runs, so memory holds one
    run and the examples.
    """
    toxic = np.asarray(toxic, dtype=bool)
    if not toxic.any() or toxic.all():
        return None
    held = np.arange(len(texts)) % 4 == 3
    if not all((kind & part).any() for kind in (toxic, ~toxic) for part in (held, ~held)):
        held = np.zeros(len(texts), dtype=bool)
    train_on, labels = [t for t, h in zip(texts, held) if not h], toxic[~held]
    weights, model, rng = _first_weights(train_on, labels), None, np.random.default_rng(0)
    for _ in range(ROUNDS):
        witnesses, hard, usual = _examples(train_on, labels, weights, rng)
        if not witnesses or not hard:
            break
        counts: dict[bytes, list[int]] = {}
        for kind, words in ((0, witnesses), (1, hard), (1, usual)):
            for word in words:
                counts.setdefault(word, [0, 0])[kind] += 1
        items = list(counts)
        marks = sorted(set(witnesses), key=lambda k: (-counts[k][0], k))[: LANDMARKS // 2]
        landmarks = Landmarks(list(dict.fromkeys(marks + hard[: LANDMARKS // 4] + usual[: LANDMARKS // 4])))
        x = landmarks.map(items)
        n = np.array([counts[k] for k in items], dtype=float)
        cost = np.concatenate((n[:, 0] / n[:, 0].sum(), n[:, 1] / n[:, 1].sum()))
        used = cost > 0
        w = svm(np.vstack((x, x))[used], np.repeat([1.0, -1.0], len(items))[used], cost[used])
        weights = landmarks.weights(w[:-1])
        model = Model(weights, float(w[-1]), 1.0, 0.0)
    if model is None:
        return None
    curve = held if held.any() else np.ones(len(texts), dtype=bool)
    scores = np.concatenate([model.decisions(part) for _, part in chunks([t for t, h in zip(texts, curve) if h])])
    model.slope, model.offset = platt(scores, toxic[curve].astype(float), np.asarray(weight, float)[curve])
    return model


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the ids whose labels are never learned."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, n_docs: int = TRAIN_DOCS) -> Model | None:
    """Fit on at most ``n_docs`` documents of each class that are not held out.

    Documents are taken in the order of a hash of their id; each counts as many
    times as its class has documents for one in the sample. An id with several
    labels is toxic if one of them is; ids without a label or document are left
    out.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") >= 1).alias("toxic"))
    present = docs.select(F.col("doc_id").cast("long")).distinct()
    known = staged(known.join(present, "doc_id", "left_semi"), "labelled")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    order = [F.xxhash64("doc_id"), "doc_id"]
    sample = known.filter("toxic").orderBy(*order).limit(n_docs).unionAll(
        known.filter("not toxic").orderBy(*order).limit(n_docs))
    # At most 2 * n_docs ids are broadcast.
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample), "doc_id")
    rows = texts.dropDuplicates(["doc_id"]).toPandas()
    rows = rows.iloc[np.argsort(np.array([hash_order(i) for i in rows["doc_id"]], dtype=np.uint64), kind="stable")]
    toxic = rows["toxic"].to_numpy(bool)
    weight = np.where(toxic, sizes[True] / max(toxic.sum(), 1), sizes[False] / max((~toxic).sum(), 1))
    return fit([t or "" for t in rows["text"]], toxic, weight)


def hash_order(doc_id: int) -> int:
    """A fixed shuffle of ids, so that the held part of the sample is a mixed one."""
    return (int(doc_id) * 0x9E3779B97F4A7C15 + 0x7F4A7C15) % (1 << 64)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, score)`` for each row of ``docs(doc_id, text)``; 0 without a model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            values = model.scores(texts) if model else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def judge(docs: DataFrame, labels: DataFrame, n_docs: int = TRAIN_DOCS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs(doc_id, text)``.

    ``score`` depends on the text alone. Null and empty texts, and texts
    without a word of three letters, get the score of the most harmless text.
    Without labels of both classes every score is 0. Null and repeated ids keep
    a row each, null ids are not held out; other columns are not read.
    """
    out = score(docs, train(docs, labels, n_docs))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, n_docs: int = TRAIN_DOCS) -> DataFrame:
    """``docs`` without the documents whose text scores 0.5 or more."""
    model = train(docs, labels, n_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            values = model.scores(texts) if model else np.zeros(len(texts))
            yield batch.filter(pa.array(values < 0.5))

    return docs.mapInArrow(run, docs.schema)
