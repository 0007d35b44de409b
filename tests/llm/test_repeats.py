"""Spelling variants, periodic runs and repeated byte strings against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from riskloom.llm import periodic, queries, spelling, substrings

SCHEMA = "doc_id long, text string, word string, n string, node string, spans string"


def table(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "w", "n", "x", "s") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randrange(6, 12))) for _ in range(60)]

    def spelled(word):
        at, how = rng.randrange(len(word)), rng.random()
        cut = rng.choice([0, 1]) if how < 0.4 else 1
        return word if how > 0.5 else word[:at] + rng.choice(["", "a", "zz", "É"]) + word[at + cut :]

    def prose(n):
        return " ".join(spelled(rng.choice(stems)) for _ in range(n))

    rows = [(i, prose(rng.randrange(0, 120))) for i in range(60)]
    shared = prose(90)
    rows += [(100 + i, prose(rng.randrange(60)) + "\n" + shared[rng.randrange(40) :] + "\t" + prose(rng.randrange(60))) for i in range(25)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (None, shared), (None, None), (203, shared), (203, shared), (203, prose(80))]
    rows += [(300, "ab" * 900), (301, "x" * 1500), (302, (prose(25) + " ") * 7), (303, "a " * 5000), (304, "ü" * 401)]
    return rows


def plain_counts(rows, edit=None):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if edit and h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def plain_forms(counts):
    out = {}
    for word, n in counts.items():
        near = [o for o in counts if one_edit(word, o)]
        best = min(near, key=lambda o: (-counts[o], o), default=None)
        form = best if best is not None and counts[best] >= 10 * n else None
        out[word] = [form, n, len(near), counts[form] if form else None]
    for word, found in out.items():
        root = word
        while out[root][0]:
            root = out[root][0]
        found.insert(1, root)
    return {w: tuple(v) for w, v in out.items()}


@pytest.mark.parametrize("edit", [None, queries.missing_letters])
def test_spelling_forms_equal_plain_version(spark, docs, edit):
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"])
           for r in spelling.spelling_variants(table(spark, docs), edit=edit).collect()}
    want = plain_forms(plain_counts(docs, edit))
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 10


def test_spelling_of_short_repeated_and_long_letters(spark):
    counts = {"a" * k: 10**k for k in range(1, 9)} | {"ab": 3, "ba": 3, "abab": 40, "baba": 4, "x" * 40: 2, "x" * 20 + "y" + "x" * 19: 30}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.spelling_forms(words).collect()}
    assert got == plain_forms(counts)


def test_empty_tables(spark):
    empty = table(spark, [])
    assert spelling.spelling_variants(empty).count() == 0
    assert periodic.find_runs(empty).count() == 0
    assert substrings.remove_repeats(empty).count() == 0


def plain_runs(words, least=12):
    seen, out = set(), []
    for p in range(1, len(words) // 2 + 1):
        x = 0
        while x + p < len(words):
            start = x
            while x + p < len(words) and words[x] == words[x + p]:
                x += 1
            if x > start and x + p - start >= max(least, 2 * p) and (start, x + p) not in seen:
                seen.add((start, x + p))
                out.append((start, x + p - start, p))
            x += x == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words_equal_plain_version():
    rng = random.Random(2)
    for _ in range(40):
        docs = []
        for _ in range(8):
            words = [str(rng.randrange(rng.choice([1, 2, 3, 40, 1000]))) for _ in range(rng.randrange(300))]
            for _ in range(rng.randrange(4)):
                p, at = rng.randrange(1, 110), rng.randrange(len(words) + 1)
                for i in range(at + p, min(len(words), at + rng.randrange(1, 300))):
                    words[i] = words[i - p]
            block = ([str(rng.randrange(3)) for _ in range(rng.randrange(1, 25))] * 100)[: rng.randrange(20, 90)]
            docs.append([w.encode() for w in (words + block * rng.randrange(5))])
        assert periodic.runs_of(docs) == [plain_runs(d) for d in docs]


def test_dense_documents_are_scanned_whole():
    block = [b"a", b"b"] * 60 + [b"a"]
    assert periodic.runs_of([block * 6]) == [plain_runs(block * 6)]


def test_runs_query_equals_plain_version(spark, docs, tmp_path):
    table(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect())
    want = Counter()
    for doc_id, text in docs:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        row = (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None)
        text = " ".join(w for i, w in enumerate(words) if i not in dropped)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want[(*row, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert got == want
    assert sum(r[1] > 0 for r in want) >= 4


def plain_repeats(rows, length=400):
    texts = [(t or "").encode() for _, t in rows]
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        cover = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                cover[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], cover[:-1].astype(int), [0]])))
        yield edges.reshape(-1, 2).tolist(), bytes(np.frombuffer(t, dtype=np.uint8)[~cover[:-1]])


@pytest.mark.parametrize("range_rows, chunk", [(500_000, 2 << 20), (7, 300)])
def test_removed_strings_equal_plain_version(spark, docs, monkeypatch, range_rows, chunk):
    monkeypatch.setattr(substrings, "RANGE_ROWS", range_rows)  # many ranges cut equal cells
    rows = [(i, t) for i, t in docs if i != 303] + [(400, "q" * 399 + "é"), (401, "é" + "q" * 400)]
    got = Counter((r["doc_id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["spans"]), bytes(r["kept"]))
                  for r in substrings.remove_repeats(table(spark, rows)).collect())
    want = Counter((i, len((t or "").encode()), tuple(map(tuple, spans)), kept) for (i, t), (spans, kept) in zip(rows, plain_repeats(rows)))
    assert got == want
    assert sum(bool(r[2]) and r[3] != b"" for r in want) > 10


def test_repeats_query_tells_planted_passages(spark, tmp_path):
    rng = random.Random(8)

    def prose(n, letters):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(letters)) for _ in range(n))

    long, short = prose(60, 7), prose(60, 4)  # 479 and 299 bytes: only the first reaches 400
    rows = [(i, f"{prose(70, 6)}\n{long}\n{prose(rng.randrange(90), 5)}") for i in range(6)]
    rows += [(10 + i, f"{prose(70, 6)}\n{short}\n{prose(rng.randrange(90), 5)}") for i in range(6)]
    rows += [(20 + i, prose(130 + i, 6)) for i in range(6)] + [(30, f"{(own := prose(60, 8))} é {own}"), (31, None)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_prefix_doubling"](spark, str(tmp_path)).collect()}
    assert {i for i, r in got.items() if r["n_removed"]} == {*range(6), 30}
    for (i, text), (spans, kept) in zip(rows, plain_repeats(rows), strict=True):
        n_removed = sum(end - start for start, end in spans)
        assert tuple(got[i]) == (i, len((text or "").encode()), n_removed, len(spans), hashlib.sha256(kept).hexdigest())


def test_anchors_do_not_depend_on_chunks():
    rng = np.random.default_rng(1)
    data = np.frombuffer(rng.integers(0, 3, 5000, dtype=np.uint8).tobytes(), dtype=np.uint8)

    def strings(starts, ends):
        at, low, high = substrings.anchors(data, np.array(starts), np.array(ends), 400, 128)
        return {(a - d, a) for a, x, y in zip(at, low, high) for d in range(x, y + 1)}

    whole = strings([0], [5000])
    assert {p for p, _ in whole} == set(range(4601))
    assert strings([0, 2101], [2500, 5000]) == whole
