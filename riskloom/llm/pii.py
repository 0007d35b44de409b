"""Personal data: patterns, then weak supervision for spans the patterns miss.

Candidate spans get votes from labelers: value patterns, checks of the digits,
gazetteers of prefixes and endings, and the words before the span. Expectation
maximisation over the vote patterns estimates how reliable each labeler is for
each kind (after Dawid and Skene) and gives every pattern a distribution of
kinds; a softmax classifier over span features learns these distributions and
decides. The documents are read once; vote patterns and features are counted by
Spark, and as all of them are small codes their number has a fixed bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import staged

KINDS = ("email", "ip", "card", "phone", "secret")
NONE = len(KINDS)
_EMAIL, _IP, _CARD, _PHONE, _SECRET = range(len(KINDS))
ABSTAIN = -1
#: A candidate becomes a span if its kind has at least this probability.
CERTAIN = 0.8
ROUNDS = 50

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Runs of digits are taken whole: a shorter start never matches more, and long runs stay linear.
_IPV4 = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Candidates beyond the patterns above, of any length; possessive runs keep long ones linear.
_NUMBER = re.compile(r"(?<![\w+])[(+]?[0-9](?:[ ().-]*+[0-9])+(?!\w)")
NUMBER_CHARS = 7
_OPAQUE = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}+")
_SPELLED = re.compile(r"(?<![\w.+-])[\w.+-]++\s?(?:\[at\]|\(at\)|\bat\b|@)\s?[\w-]++(?:\s?(?:\[dot\]|\(dot\)|\bdot\b|\.)\s?[\w-]{2,}+)+", re.I)
_SPELLED_MARK = re.compile(r"[\[(](?:at|dot)[\])]|\bdot\b|@", re.I)

#: Gazetteers.
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65")
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49",
                 "52", "54", "55", "61", "64", "81", "82", "86", "90", "91", "351", "353", "358")
DOMAIN_ENDINGS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info")
SECRET_PREFIXES = ("AKIA", "ghp_", "gho_", "sk-", "sk_", "xoxb-", "xoxp-", "AIza", "glpat-", "eyJ")
CONTEXT = {
    _EMAIL: re.compile(r"(?:e-?mail|contact|write|mailto)\W*$", re.I),
    _IP: re.compile(r"\b(?:ip|host|server|addr(?:ess)?|dns|gateway|from)\W*$", re.I),
    _CARD: re.compile(r"\b(?:card|visa|credit|debit|mastercard|amex|carte|karte|tarjeta)\W*(?:no|nr|number)?\W*$", re.I),
    _PHONE: re.compile(r"\b(?:tel|phone|call|fax|mobile|cell|dial|telefon|whatsapp)\w*\W*$", re.I),
    _SECRET: re.compile(r"\b(?:token|secret|password|passwd|pwd|api[_-]?key|key|auth|bearer|credential)s?\W*$", re.I),
    NONE: re.compile(r"(?:version|isbn|order|invoice|page|chapter|id|commit|sha\d*|md5|§)\W*$", re.I),
}
CONTEXT_CHARS = 24
LABELERS = ("pattern", "shape", "check", "gazetteer", "context", "quote")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the pattern matches that pass their check, kind by kind."""
    found = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append((_EMAIL, start, match.end()))
            last = match.end()
        else:
            last = at + 1
        at = text.find("@", max(last, at + 1))
    for match in _IPV4.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.group().split(".")):
            found.append((_IP, *match.span()))
    for match in _DIGITS.finditer(text):
        if match.end() - match.start() >= 12:
            digits = re.sub("[ -]", "", match.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((_CARD, *match.span()))
    if "+" in text:
        for match in _PLUS.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in match.group()) <= 15:
                found.append((_PHONE, *match.span()))
    return found


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """``(start, end, base kind or ABSTAIN)``: pattern matches, and likely spans that overlap none of them."""
    taken = sorted((s, e) for _, s, e in base)
    more = [m.span() for m in _NUMBER.finditer(text) if m.end() - m.start() >= NUMBER_CHARS]
    more += [m.span() for m in _OPAQUE.finditer(text)
             if re.search("[0-9]", m.group()) and re.search("[A-Za-z]", m.group())]
    if _SPELLED_MARK.search(text):
        more += [m.span() for m in _SPELLED.finditer(text) if _SPELLED_MARK.search(m.group())]
    out = [(s, e, kind) for kind, s, e in base]
    last, i = 0, 0
    for s, e in sorted(more, key=lambda x: (x[0], -x[1])):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if s >= last and (i == len(taken) or taken[i][0] >= e):
            out.append((s, e, ABSTAIN))
            last = e
    return out


def votes(text: str, start: int, end: int, base: int) -> tuple[int, ...]:
    """One vote of each labeler: a kind, ``NONE`` or ``ABSTAIN``."""
    value = text[start:end]
    before = text[max(0, start - CONTEXT_CHARS) : start]
    digits = re.sub("[^0-9]", "", value)
    letters = bool(re.search("[A-Za-z]", value))
    dotted = re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", value)
    if _SPELLED_MARK.search(value):
        shape = _EMAIL
    elif dotted:
        shape = _IP
    elif letters:
        shape = _SECRET if len(digits) >= 4 and len(value) >= 16 and not re.search(r"[a-z]{8}", value) else NONE
    elif 12 <= len(digits) <= 19 and not re.search("[.()]", value):
        shape = _CARD
    elif 9 <= len(digits) <= 15 and re.search("[ ().-]", value):
        shape = _PHONE
    else:
        shape = NONE
    check = ABSTAIN
    if shape == _CARD:
        check = _CARD if luhn(digits) else NONE
    elif shape == _IP:
        check = _IP if all(len(p) <= 3 and int(p) <= 255 for p in value.split(".")) else NONE
    elif shape == _PHONE:
        check = _PHONE if re.fullmatch(r"(?:1?[2-9][0-9]{2}[2-9][0-9]{6}|[0-9]{9,15})", digits) and len(set(digits)) > 2 else NONE
    elif shape == _SECRET:
        check = _SECRET if len(set(value)) >= 10 else NONE
    gazetteer = ABSTAIN
    if value.startswith(SECRET_PREFIXES):
        gazetteer = _SECRET
    elif shape == _EMAIL:
        gazetteer = _EMAIL if re.split(r"\W+", value.lower())[-1] in DOMAIN_ENDINGS else NONE
    elif shape == _CARD:
        gazetteer = _CARD if digits.startswith(CARD_PREFIXES) else NONE
    elif shape == _PHONE and (value.startswith("+") or digits.startswith("00")):
        gazetteer = _PHONE if digits.lstrip("0").startswith(COUNTRY_CODES) else NONE
    context = next((kind for kind, words in CONTEXT.items() if words.search(before)), ABSTAIN)
    quoted = before[-1:] in ("\"", "'") and text[end : end + 1] == before[-1:]
    quote = _SECRET if quoted and letters else ABSTAIN
    return base, shape, check, gazetteer, context, quote


def features(text: str, start: int, end: int, ballot: tuple[int, ...]) -> tuple[int, ...]:
    """Small codes of a span: shape, check and context votes, and what the value looks like."""
    value = text[start:end]
    n_digits = sum("0" <= c <= "9" for c in value)
    return (ballot[1], ballot[2], ballot[4], min(len(value).bit_length(), 7), min(n_digits // 4, 5),
            int(bool(re.search("[ ().-]", value))), int("@" in value), int(text[max(0, start - 1) : start] in ("\"", "'", "=", ":")))


_FEATURE_SIZES = (NONE + 2, NONE + 2, NONE + 2, 8, 6, 2, 2, 2)


def one_hot(codes: np.ndarray) -> np.ndarray:
    out = []
    for j, size in enumerate(_FEATURE_SIZES):
        shifted = codes[:, j] + (1 if j < 3 else 0)
        out.append(np.eye(size)[shifted])
    out.append(np.ones((len(codes), 1)))
    return np.hstack(out)


def reliabilities(ballots: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind distribution of each ballot, priors, and ``P(vote | kind)`` of each labeler, by expectation maximisation.

    Starts from the share of votes, the pattern labeler counting as three.
    """
    n_kinds, n_votes = NONE + 1, NONE + 2
    hot = np.eye(n_votes)[ballots + 1]  # ballots x labelers x votes, abstention first
    belief = hot[:, :, 1:].sum(axis=1) + 2 * hot[:, 0, 1:] + 0.05
    belief /= belief.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        weighted = belief * counts[:, None]
        prior = (weighted.sum(axis=0) + 1) / (counts.sum() + n_kinds)
        # A vote for the right kind is expected: ten such ballots stand in front of the data.
        confusion = np.einsum("bk,blv->lkv", weighted, hot) + 0.1
        confusion[:, np.arange(n_kinds), np.arange(n_kinds) + 1] += 10.0
        confusion[:, :, 0] += 1.0
        confusion /= confusion.sum(axis=2, keepdims=True)
        log = np.log(prior)[None, :] + np.einsum("blv,lkv->bk", hot, np.log(confusion))
        log -= log.max(axis=1, keepdims=True)
        new = np.exp(log)
        new /= new.sum(axis=1, keepdims=True)
        done = np.abs(new - belief).max() < 1e-6
        belief = new
        if done:
            break
    return belief, prior, confusion


def softmax_fit(x: np.ndarray, target: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Weights of a softmax regression on distributions, by gradient steps with momentum."""
    w = np.zeros((x.shape[1], target.shape[1]))
    speed = np.zeros_like(w)
    share = np.sqrt(counts) / np.sqrt(counts).sum()
    for _ in range(rounds):
        p = np.exp((z := x @ w) - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        speed = 0.9 * speed - 1.0 * (x.T @ ((p - target) * share[:, None]) + 1e-4 * w)
        w = w + speed
    return w


@dataclass
class SpanModel:
    """What was learned: labeler reliabilities and the classifier."""

    prior: np.ndarray
    confusion: np.ndarray
    weights: np.ndarray

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        z = one_hot(codes) @ self.weights
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def fit(keys: list[str], counts: np.ndarray) -> SpanModel | None:
    """Reliabilities and classifier from candidate keys (ballot and feature codes) and their counts."""
    if not keys:
        return None
    split = np.array([[int(x) for x in key.split(",")] for key in keys])
    ballots, inverse = np.unique(split[:, : len(LABELERS)], axis=0, return_inverse=True)
    inverse = inverse.ravel()
    belief, prior, confusion = reliabilities(ballots, np.bincount(inverse, counts, len(ballots)))
    codes = split[:, len(LABELERS) :]
    return SpanModel(prior, confusion, softmax_fit(one_hot(codes), belief[inverse], counts.astype(float)))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: base spans, and starts, ends and keys of the other candidates and of all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                starts, ends, keys, known = [], [], [], []
                for s, e, kind in candidates(text, base):
                    ballot = votes(text, s, e, kind)
                    starts.append(s)
                    ends.append(e)
                    known.append(kind)
                    keys.append(",".join(map(str, ballot + features(text, s, e, ballot))))
                rows.append((starts, ends, known, keys))
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, type=pa.list_(pa.int32())) for c in columns[:3]],
                 pa.array(columns[3], type=pa.list_(pa.string()))],
                names=["doc_id", "starts", "ends", "base", "keys"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, starts array<int>, ends array<int>, base array<int>, keys array<string>")


def train(scanned: DataFrame) -> tuple[SpanModel | None, dict[str, int]]:
    """The model, and the kind of each candidate key that it is certain of.

    Keys are tuples of small codes, so the collected table has a fixed bound
    whatever the number of documents.
    """
    counted = scanned.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.orderBy("key").collect()
    keys, counts = [r["key"] for r in rows], np.array([r["n"] for r in rows])
    model = fit(keys, counts)
    if model is None:
        return None, {}
    codes = np.array([[int(x) for x in key.split(",")][len(LABELERS) :] for key in keys])
    p = model.probabilities(codes)
    best = p.argmax(axis=1)
    return model, {k: int(b) for k, b, top in zip(keys, best, p.max(axis=1)) if b != NONE and top >= CERTAIN}


def write_spans(spans: list[tuple[int, int, int]]) -> str:
    """``kind:start:end`` by start, then kind in the order of ``KINDS``, comma-joined."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], x[0], x[2])))


def find(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base, spans)`` for each row of ``docs(doc_id, text)``.

    ``base`` lists the pattern spans, ``spans`` these and the spans the
    classifier adds where no pattern span lies (kind ``secret`` besides the
    four). Positions count code points, ends are exclusive.

    Null and empty texts have no spans. Null and repeated ids keep a row each;
    other columns are not read. Without any candidate nothing is learned and
    nothing is added.
    """
    scanned = staged(scan(docs), "candidates")
    _, decided = train(scanned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base_text, all_text = [], [], []
            for starts, ends, known, keys in zip(*(c.to_pylist() for c in batch.columns[1:])):
                base = [(k, s, e) for k, s, e in zip(known, starts, ends) if k != ABSTAIN]
                more = [(decided[key], s, e) for key, k, s, e in zip(keys, known, starts, ends)
                        if k == ABSTAIN and key in decided]
                counts.append([sum(k == kind for k, _, _ in base) for kind in range(4)])
                base_text.append(write_spans(base))
                all_text.append(write_spans(base + more))
            table = np.array(counts, dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(table[:, i].copy()) for i in range(4)], pa.array(base_text, type=pa.string()),
                 pa.array(all_text, type=pa.string())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    return scanned.mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")
