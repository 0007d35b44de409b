"""SimHash groups, components and line dedup against plain versions."""

import random

import numpy as np
import pytest
import brute
from riskloom.llm import components, linededup, simhash
from riskloom.llm.common import staged
from riskloom.llm.components import connected_components

SCHEMA = "doc_id long, text string, fp string, mark int, pos int, n_dropped string, shard int, lang string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y", 3, "en") for i, t in rows], SCHEMA)


def words(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(500)}" for _ in range(n)]


def near_rows():
    """Exact and near copies, ties, nulls, repeated rows, a very long text."""
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a text without an id of its own"), (None, None), (40, "AbC É dE"), (41, "abc É de")]
    base = words(1, 300)
    for i in range(30):
        changed = list(base)
        changed[(7 * i) % 300] = f"new{i}"
        rows.append((100 + i, " ".join(changed)))
    rows += [(7, " ".join(words(2, 100)))] * 2 + [(8, " ".join(words(2, 100)))]
    rows.append((9, " ".join(words(3, 150_000))))
    rows += [(1000 + i, " ".join(words(1000 + i, 60))) for i in range(80)]
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    prints = [brute.fingerprint(t) if len(t or "") < 10_000 else simhash.fingerprint(t.encode()) for _, t in rows]
    label = brute.components(prints)
    smallest = {}
    for (doc_id, _), c in zip(rows, label):
        if doc_id is not None:
            smallest[c] = min(smallest.get(c, doc_id), doc_id)
    wanted = sorted((str(i), f"{p:016x}", smallest.get(c)) for (i, _), p, c in zip(rows, prints, label))
    found = simhash.near_duplicates(documents(spark, rows)).select("doc_id", simhash.hex_print(), "component_id").collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in found) == wanted


def test_near_duplicates_of_an_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).collect() == []
    assert simhash.keep_one(documents(spark, [])).collect() == []


def test_one_document_of_each_group_stays(spark):
    rows = near_rows()
    kept = simhash.keep_one(documents(spark, rows))
    assert kept.columns == documents(spark, []).columns
    ids = sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect())
    assert ids.count(7) == 1 and 8 not in ids and 1 in ids and 2 not in ids and 9 in ids
    assert sum(i >= 1000 for i in ids) == 80
    assert kept.filter("doc_id is null").count() == 1  # the other null id is in the group of doc 1


def first_of_groups(rows):
    first = {}
    for (i, _), c in zip(rows, brute.similar_components([t for _, t in rows])):
        first[c] = min(first.get(c, i), i)
    return sorted(first.values())


def test_pairs_behind_a_failed_candidate_are_compared(spark):
    """Three orders of the same words: the first is near neither of the others, which are near each other."""
    rng = random.Random(11)
    rows = []
    for group in range(6):
        base = [f"g{group}w{i}" for i in range(80)]
        other = rng.sample(base, len(base))
        rows += [(10 * group + i, " ".join(w)) for i, w in enumerate((base, other, other[:40] + [other[41], other[40]] + other[42:]))]
    assert len(first_of_groups(rows)) == 12
    assert sorted(r["doc_id"] for r in simhash.keep_one(documents(spark, rows)).collect()) == first_of_groups(rows)


def test_copies_with_a_passage_appended_go(spark):
    rng = random.Random(12)
    rows = [(5000, "a b c"), (5001, "A  b c"), (5002, "a b c d"), (5003, ""), (5004, None)]
    for i in range(60):
        n = rng.choice([14, 40, 100, 300])
        base = [f"w{int(rng.paretovariate(0.7)) % 5000}" for _ in range(n)]
        more = [f"w{int(rng.paretovariate(0.7)) % 5000}" for _ in range(rng.randint(1, n // 4))]
        rows += [(10 * i, " ".join(base)), (10 * i + 1, " ".join(base + more)), (10 * i + 2, " ".join(base[:-1] + ["last"]))]
    assert sorted(r["doc_id"] for r in simhash.keep_one(documents(spark, rows)).collect()) == first_of_groups(rows)


@pytest.mark.parametrize("n, copies", [(6_000, 0), (500, 5_000)])
def test_shards_find_every_link(n, copies):
    rng = np.random.default_rng(n)
    points = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    near = points[rng.integers(0, n, n // 4)] ^ (np.uint64(1) << rng.integers(0, 63, n // 4).astype(np.uint64))
    dense = points[0] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 20, (copies, 3)).astype(np.uint64), axis=1) if copies else near[:0]
    points = np.unique(np.concatenate((points, near, dense)))
    tree = simhash.TopTree(points[::7], 4)
    parts = {}
    for shard, part, home in tree.deal(points, simhash.RADIUS):
        parts.setdefault(shard, []).append((part, home))
    assert sum(h.sum() for p in parts.values() for _, h in p) == len(points)
    label = np.arange(len(points))
    for pieces in parts.values():
        part, home = np.concatenate([p for p, _ in pieces]), np.concatenate([h for _, h in pieces])
        got = simhash.link_shard(part, home).find(np.arange(len(part)))
        at = np.searchsorted(points, part)
        for i, j in zip(at[got != np.arange(len(part))], at[got[got != np.arange(len(part))]]):
            a, b = sorted((label[i], label[j]))
            label[label == b] = a
    # every pair within the radius ended in one component, and components are made of such pairs only
    for start in range(0, len(points), 500):
        near = np.bitwise_count(points[start : start + 500, None] ^ points[None, :]) <= simhash.RADIUS
        i, j = np.nonzero(near)
        assert (label[i + start] == label[j]).all()
    sizes = np.bincount(label)
    assert (sizes == 1).sum() > 0.5 * n * (copies == 0)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 3)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 200: 0, 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


LONG = "This line is long enough to count, and it repeats"


def line_rows():
    rng = random.Random(5)
    pool = [f"Shared line number {i} with some more words in it" for i in range(40)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.3 else f"own line {i} {j} of a document that has more" for j in range(12)))
            for i in range(150)]
    rows += [(i, LONG) for i in range(1000, 1500)]  # one hot key
    rows += [(2000, f"  {LONG.upper()}\t\n{LONG}\nshort\nshort")]
    rows += [(2001, "twice in two documents only!\ntwice in two documents only!"), (2002, "twice in two documents only!")]
    rows += [(3, None), (2003, ""), (2004, "\n\n"), (None, LONG), (None, None), (2005, "é" * 19), (2006, "é" * 19), (2007, "é" * 19)]
    rows += [(2008, f"{LONG}\nx")] * 2 + [(2008, f"x\n{LONG}")]
    rows += [(2009, "\n".join([LONG] * 20_000 + ["end"]))]
    return rows


@pytest.mark.parametrize("partitions", [3, 40])
def test_line_dedup_equals_brute_force(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = line_rows()
        out = linededup.dedup_lines(documents(spark, rows).repartition(4))
        assert set(out.columns) == {*documents(spark, []).columns, "kept_text"}
        found = [(r["doc_id"], r["n_dropped"], r["kept_text"]) for r in out.select("doc_id", "n_dropped", "kept_text").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    order = lambda x: (x[0] is None, x[0] or 0, x[2], x[1])
    assert sorted(found, key=order) == sorted(brute.kept_lines(rows), key=order)


def test_line_dedup_of_an_empty_table(spark):
    assert linededup.dedup_lines(documents(spark, [])).collect() == []


def test_bitmaps_hold_what_was_packed():
    positions = np.array([0, 3, 9, 4000])
    assert set(np.flatnonzero(linededup.unpack(linededup.pack(positions)) == 0)) == set(positions)


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n, m = rng.integers(0, 300, 2)
        k = rng.integers(0, min(n, m) + 1)
        pool = np.unique(rng.integers(-(2**63), 2**63 - 1, n + m))
        a, b = pool[:n], np.concatenate([pool[:k], pool[n : n + m - k]])
        bound = simhash.least_apart(simhash.parity_bits(a), simhash.parity_bits(b))
        assert bound <= len(np.setxor1d(a, b)) and (k < n or k < m or bound == 0)


def test_close_pairs_keep_all_similar_ones(spark):
    rng = random.Random(11)
    texts = []
    for base in range(12):
        own = words(base, rng.choice([3, 40, 200, 900]))
        for share in (0.0, 0.01, 0.02, 0.1):
            texts.append(" ".join(f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in own))
    frame = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    bits = simhash.shingle_prefixes(frame, 0.8)
    pairs = spark.createDataFrame([(i, j) for j in range(len(texts)) for i in range(j)], "a long, b long")
    kept = {tuple(r) for r in simhash.close_pairs(bits, pairs, 0.8).collect()}
    sets = [set(simhash.shingle_hashes(t.encode()).tolist()) for t in texts]
    alike = {(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert alike <= kept and len(kept) < 2 * len(alike)
    assert simhash.close_pairs(bits, pairs.limit(0), 0.8).count() == 0


def test_components_rounds(spark, monkeypatch):
    """Stars take no round; each half of a round is a plan of its own, and the last round is the one that makes stars."""
    written = []
    monkeypatch.setattr(components, "staged", lambda df, name: written.append(staged(df, name)) or written[-1])
    stars = spark.createDataFrame([(1, i) for i in range(2, 30)] + [(40 + i, 40) for i in range(1, 9)], "a long, b long")
    found = {r["node"]: r["root"] for r in connected_components(stars).collect()}
    assert found == {**{i: 1 for i in range(1, 30)}, **{i: 40 for i in range(40, 49)}}
    assert len(written) == 1
    written.clear()
    chain = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert {r["node"]: r["root"] for r in connected_components(chain).collect()} == {1: 1, 2: 1, 3: 1}
    assert len(written) == 3


def test_groups_stay_without_new_links(spark, monkeypatch):
    """Groups are made again only if the join of rare shingles finds links that they lack."""
    calls = []
    monkeypatch.setattr(simhash, "connected_components", lambda links: calls.append(links.count()) or connected_components(links))
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text), (3, " ".join(f"v{i}" for i in range(60)))]
    assert sorted(r["doc_id"] for r in simhash.keep_one(documents(spark, rows)).collect()) == [1, 3]
    assert len(calls) == 1
