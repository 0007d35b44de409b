"""SimHash near-duplicates found with vantage-point trees.

Fingerprints are points of the 64-bit Hamming space. A tree of vantage points,
fitted on a bounded sample, deals the distinct fingerprints to shards: a point
lives in the one shard its distances lead to, and also visits the shards behind
every boundary that a link could cross. Each shard then searches its points
with a tree of its own. The triangle inequality decides both steps: points
``p`` and ``q`` with ``d(p, q) <= radius`` have distances to any vantage point
that differ by no more than ``radius``.

The sample only balances the shards; links and components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import attach, discard, slices, staged
from riskloom.llm.components import connected_components

SHINGLE_WORDS = 4
RADIUS = 4
#: Fingerprints the top tree is fitted on; a bound, the tree only balances work.
TREE_SAMPLE = 32_768
#: Distinct fingerprints that one shard should own.
SHARD_POINTS = 200_000
MAX_DEPTH = 11
#: Points below which a shard compares all of them instead of splitting again.
LEAF_POINTS = 1_024
#: Points compared with a block of 256 at once, so that the differences stay in the cache.
TILE = 256
SEED = 42
#: For groups of similar texts: 64-bit fingerprints a text, least similarity and words of a shingle. More
#: fingerprints find more pairs before the join of rare shingles, which finds all that are left.
PARTS = 2
SIMILARITY = 0.8
VERIFY_WORDS = 5
#: Texts whose shingles are counted to put common ones last, and how many of those are told apart; both only order work.
ORDER_SAMPLE = 16_384
ORDER_SHINGLES = 200_000
#: Rare shingles in a sorted range.
RANGE_TOKENS = 2_000_000
#: An odd number that spreads bits when multiplied by.
MIX = 0x9E3779B97F4A7C15


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the word shingles of ``text``, A-Z lower-cased; 0 without words.

    Bit sums are taken over pieces of the shingles, so a long text needs no
    more memory than its hashes.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends.tolist()
    last = min(shingle_words, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[s:e], SEED) for s, e in zip(starts, ends[last:])),
        dtype=np.uint64, count=len(words) - last,
    )
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        piece = hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(piece, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp)`` for each row of ``docs(doc_id, text)``; null texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py(), shingle_words) for t in batch.column(1)]
            prints = np.array(values, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(
        run, "doc_id long, fp long"
    )


def distances(points: np.ndarray, centre: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ centre)


class TopTree:
    """Vantage points and split radii, node ``i`` above nodes ``2i+1`` and ``2i+2``."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.centres = np.zeros(2**depth, dtype=np.uint64)
        self.splits = np.zeros(2**depth, dtype=np.int16)
        parts = {0: sample}
        for node in range(2**depth - 1):
            part = parts.pop(node)
            if len(part):
                self.centres[node] = part[len(part) // 2]
                away = distances(part, self.centres[node])
                self.splits[node] = int(np.median(away))
                parts[2 * node + 1], parts[2 * node + 2] = (
                    part[away <= self.splits[node]], part[away > self.splits[node]])
            else:
                parts[2 * node + 1] = parts[2 * node + 2] = part

    def deal(self, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(shard, points, lives here)`` of every shard the points live in or visit."""
        todo = [(0, points, np.ones(len(points), dtype=bool))]
        while todo:
            node, part, home = todo.pop()
            if not len(part):
                continue
            if node >= 2**self.depth - 1:
                yield node, part, home
                continue
            away, split = distances(part, self.centres[node]).astype(np.int16), self.splits[node]
            inner = away <= split
            # Points living inside visit the outer side; a visitor goes wherever a link could end.
            to_inner = inner | (~home & (away <= split + radius))
            to_outer = ~inner | (away > split - radius)
            todo.append((2 * node + 1, part[to_inner], home[to_inner]))
            todo.append((2 * node + 2, part[to_outer], (home & ~inner)[to_outer]))


class Forest:
    """Union-find over positions, with vectorised look-ups and the pairs that joined components."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.pairs: list[tuple[int, int]] = []

    def find(self, at: np.ndarray) -> np.ndarray:
        roots = self.parent[at]
        while True:
            above = self.parent[roots]
            if np.array_equal(above, roots):
                break
            roots = above
        self.parent[at] = roots
        return roots

    def top(self, at: int) -> int:
        while self.parent[at] != at:
            at = self.parent[at]
        return int(at)

    def join(self, a: int, b: int) -> None:
        """Join the components of the linked positions ``a`` and ``b``."""
        low, high = sorted((self.top(a), self.top(b)))
        if low != high:
            self.parent[high] = low
            self.pairs.append((a, b))


def link_all(points: np.ndarray, forest: Forest, ask: np.ndarray, home: np.ndarray, radius: int) -> None:
    """Join each of ``ask`` with all of ``home`` within ``radius``, in blocks.

    Points already in one component are not compared with each other again,
    which keeps a dense group of near copies from costing its square.
    """
    within = ask is home
    bits, ones = np.empty(256 * TILE, dtype=np.uint64), np.empty(256 * TILE, dtype=np.uint8)
    while len(ask):
        labels = forest.find(ask)
        ask = ask[np.argsort(labels, kind="stable")]
        block, ask = ask[:256], ask[256:]
        if within:  # earlier blocks have met this one
            home = np.concatenate((block, ask))
        own, others = forest.find(block), home
        if (own == own[0]).all():
            others = home[forest.find(home) != own[0]]
        for at in range(0, len(others), TILE):
            part = others[at : at + TILE]
            shape = (len(block), len(part))
            differ = np.bitwise_xor(points[block][:, None], points[part][None, :], out=bits[: shape[0] * shape[1]].reshape(shape))
            counts = np.bitwise_count(differ, out=ones[: shape[0] * shape[1]].reshape(shape))
            if counts.min() > radius:
                continue
            rows, columns = np.nonzero(counts <= radius)
            roots = np.stack((forest.find(block)[rows], forest.find(part)[columns]), axis=1)
            apart = np.flatnonzero(roots[:, 0] != roots[:, 1])
            _, first = np.unique(roots[apart], axis=0, return_index=True)
            for i in apart[first]:
                forest.join(int(block[rows[i]]), int(part[columns[i]]))


def link_shard(points: np.ndarray, home: np.ndarray, radius: int = RADIUS) -> Forest:
    """Components of the points within ``radius`` of a point that lives here."""
    forest = Forest(len(points))
    todo = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while todo:
        own, visitors = todo.pop()
        if not len(own):
            continue
        split_up = False
        if len(own) > LEAF_POINTS:
            centre = points[own[len(own) // 2]]
            away = distances(points[own], centre).astype(np.int16)
            split = int(np.median(away))
            inner = away <= split
            split_up = 0 < inner.sum() < len(own)
        if not split_up:
            link_all(points, forest, own, own, radius)
            link_all(points, forest, visitors, own, radius)
            continue
        seen = distances(points[visitors], centre).astype(np.int16)
        todo.append((own[inner], visitors[seen <= split + radius]))
        todo.append((own[~inner], np.concatenate((own[inner & (away > split - radius)], visitors[seen > split - radius]))))
    return forest


def shard_links(prints: DataFrame, radius: int = RADIUS, *, pairs: bool = False) -> DataFrame:
    """Links ``(part, a, b)`` that connect the same fingerprints of a part as all pairs within ``radius`` do.

    ``prints(part, fp)`` holds each fingerprint of each part once; parts are
    searched apart. A shard returns a spanning forest of its components, never
    all pairs of a group: a link from each point to its component's
    representative, or, with ``pairs``, links that are within ``radius``
    themselves.
    """
    sizes = {r["part"]: r["count"] for r in prints.groupBy("part").count().collect()}  # a row for each part
    some = F.pmod(F.xxhash64("part", "fp"), F.lit(max(1, sum(sizes.values()) // TREE_SAMPLE))) == 0
    sample = prints.filter(some).limit(2 * TREE_SAMPLE).toPandas()
    trees = {}
    for part, n in sizes.items():
        own = sample.loc[sample["part"] == part, "fp"].to_numpy(np.int64).view(np.uint64)
        wanted = max(n / SHARD_POINTS, min(32.0, n / LEAF_POINTS), 1.0)
        trees[part] = TopTree(own, min(MAX_DEPTH, int(np.ceil(np.log2(wanted)))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(0).to_numpy(zero_copy_only=False)
            points = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for part in np.unique(parts):
                for shard, dealt, home in trees[part].deal(points[parts == part], radius):
                    n = len(dealt)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.full(n, shard, dtype=np.int32)),
                         pa.array(dealt.view(np.int64)), pa.array(home)], names=["part", "shard", "fp", "home"])

    def search(group: pa.Table) -> pa.Table:
        points = group.column("fp").to_numpy().view(np.uint64)
        forest = link_shard(points, group.column("home").to_numpy(zero_copy_only=False), radius)
        if pairs:
            a, b = (np.array(forest.pairs, dtype=np.int64).reshape(-1, 2)).T
        else:
            labels = forest.find(np.arange(len(points)))
            a = np.flatnonzero(labels != np.arange(len(points)))
            b = labels[a]
        part = np.full(len(a), group.column("part")[0].as_py(), dtype=np.int32)
        return pa.table({"part": part, "a": points[a].view(np.int64), "b": points[b].view(np.int64)})

    dealt = prints.select("part", "fp").mapInArrow(deal, "part int, shard int, fp long, home boolean")
    return dealt.groupBy("part", "shard").applyInArrow(search, "part int, a long, b long")


def near_duplicates(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS
) -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row of ``docs(doc_id, text)``.

    Documents link if their fingerprints differ in at most ``radius`` bits;
    ``component_id`` is the smallest doc_id reachable over links. Equal
    fingerprints are one point of the search, so exact copies cost one row.

    Null and empty texts have fingerprint 0 and link like any other. Rows with
    a null or repeated doc_id keep their own row; a null id is never a
    component_id unless the whole component has none. Other columns of ``docs``
    are not read. An empty table gives an empty table.
    """
    rows = staged(fingerprints(docs, shingle_words), "prints")
    points = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "points")
    links = shard_links(points.select(F.lit(0).alias("part"), "fp"), radius).select("a", "b")
    roots = staged(connected_components(links), "roots").withColumnRenamed("node", "fp")
    linked = points.join(roots, "fp")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = linked.join(smallest, "root").select("fp", "component_id")
    named = points.join(linked, "fp", "left").select(
        "fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_print(column: str = "fp"):
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def word_sketch(text: bytes | None, parts: int = PARTS) -> np.ndarray:
    """``parts`` 64-bit SimHashes of the distinct words of ``text``, A-Z lower-cased.

    A changed word touches one feature here and five of its shingles, so the
    bits of near copies differ far less than those of shingle fingerprints.
    """
    words = set((text or b"").lower().split())
    if not words:
        return np.zeros(parts, dtype=np.uint64)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
    ones = np.zeros(64 * parts, dtype=np.int64)
    for at in range(0, len(hashes), 16_384):
        piece = hashes[at : at + 16_384, None]
        mixed = (piece ^ (piece >> np.uint64(31))) * (np.arange(1, parts + 1, dtype=np.uint64) * np.uint64(MIX) | np.uint64(1))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(MIX)
        mixed ^= mixed >> np.uint64(32)
        ones += np.unpackbits(mixed.astype(">u8").view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(words)).view(">u8").astype(np.uint64)


def word_sketches(docs: DataFrame, parts: int = PARTS) -> DataFrame:
    """``(doc_id, mark, prints)`` for each row; ``mark`` is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([word_sketch(t.as_py(), parts) for t in batch.column(2)], dtype=np.uint64).reshape(-1)
            offsets = np.arange(0, len(prints) + 1, parts, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, prints.view(np.int64))],
                names=["doc_id", "mark", "prints"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), F.col("text").cast("binary"))
    return rows.mapInArrow(run, "doc_id long, mark long, prints array<long>")


def shingle_hashes(text: bytes | None, shingle_words: int = VERIFY_WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles of ``text``, A-Z lower-cased."""
    words = (text or b"").lower().split()
    runs = {b" ".join(words[i : i + shingle_words]) for i in range(max(1, len(words) - shingle_words + 1))} if words else ()
    return np.fromiter((xxhash.xxh3_64_intdigest(r) for r in runs), dtype=np.uint64, count=len(runs)).view(np.int64)


def shingle_sets(docs: DataFrame, shingle_words: int = VERIFY_WORDS) -> DataFrame:
    """``(node, shingles)`` of ``docs(node, text)``: distinct 64-bit hashes of the word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1):  # a few sets at once
                sets = [shingle_hashes(t.as_py(), shingle_words) for t in piece.column(1)]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sets, type=pa.list_(pa.int64()))], names=["node", "shingles"])

    return docs.select("node", F.col("text").cast("binary")).mapInArrow(run, "node long, shingles array<long>")


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of a sample of ``texts(node, text)`` hold, ascending, and how many do."""
    some = F.pmod(F.xxhash64("node"), F.lit(max(1, texts.count() // ORDER_SAMPLE))) == 0
    held = shingle_sets(texts.filter(some)).select(F.explode("shingles").alias("token"))
    counts = held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    found = counts.orderBy(F.desc("n"), "token").limit(ORDER_SHINGLES).toPandas().sort_values("token")
    return found["token"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def parity_bits(hashes: np.ndarray) -> bytes:
    """A bit per residue of the ``hashes``, set where an odd number of them falls; at least two bits a hash, a power of two."""
    width = max(64, 1 << (2 * len(hashes) - 1).bit_length() if len(hashes) else 0)
    odd = np.bincount(hashes & (width - 1), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def least_apart(a: bytes, b: bytes) -> int:
    """A bound from below on the members that only one of two sets with these ``parity_bits`` has.

    Members of both cancel out, so each bit that differs needs a member of its
    own. The wider one is folded: halves of it that fall together are added.
    """
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    least = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, least), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def shingle_prefixes(texts: DataFrame, similarity: float) -> DataFrame:
    """``(node, mark, size, tokens, bits)`` of ``texts(node, text)``: hash, size and ``parity_bits`` of the shingle set, and its rarest shingles.

    Sets of the wanted similarity share one of these ``tokens``: in any order
    common to all sets, two sets without a shared one among the first
    ``size - similarity * size + 1`` of each have too few left to share.
    """
    common, counts = common_shingles(texts)

    def prefix(hashes: np.ndarray) -> np.ndarray:
        often = np.zeros(len(hashes), dtype=np.int64)
        if len(common):
            at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
            often = np.where(common[at] == hashes, counts[at], 0)
        needed = int(np.ceil(similarity * len(hashes) - 1e-6))
        return hashes[np.lexsort((hashes, often))[: len(hashes) - needed + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1):
                sets = [np.sort(shingle_hashes(t.as_py())) for t in piece.column(1)]
                marks = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(marks), pa.array([len(s) for s in sets], type=pa.int32()),
                     pa.array([prefix(s) for s in sets], type=pa.list_(pa.int64())), pa.array([parity_bits(s) for s in sets], type=pa.binary())],
                    names=["node", "mark", "size", "tokens", "bits"])

    return texts.select("node", F.col("text").cast("binary")).mapInArrow(run, "node long, mark long, size int, tokens array<long>, bits binary")


def shared_tokens(prefixes: DataFrame) -> DataFrame:
    """``(token, node, size, pos)`` of the prefix shingles of staged ``prefixes`` that several nodes hold.

    Most have one holder and go no further: in the order of shingles they equal
    neither neighbour. The first and last row of a range always stay.
    """
    long = prefixes.select(F.posexplode("tokens").alias("pos", "token"), "node", "size").select("token", "node", "size", "pos")
    n_ranges = max(1, -(-(prefixes.agg(F.sum(F.size("tokens"))).first()[0] or 0) // RANGE_TOKENS))
    ranges = long.repartitionByRange(n_ranges, "token", "node").sortWithinPartitions("token", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None  # the last row so far and whether it stays
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = batch.column(0).to_numpy()
            same = np.concatenate([[last is None or last.column(0)[0].as_py() == tokens[0]], tokens[1:] == tokens[:-1]])
            if last is not None and (known or same[0]):
                yield last
            stays = same.copy()
            stays[:-1] |= same[1:]
            yield batch.slice(0, batch.num_rows - 1).filter(pa.array(stays[:-1]))
            last, known = batch.slice(batch.num_rows - 1), bool(stays[-1])
        if last is not None:
            yield last

    return staged(ranges.mapInArrow(run, "token long, node long, size int, pos int"), "shared")


def crossing_tokens(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """``(token, node, root, size, pos)`` of the ``shared_tokens`` that several of ``groups(node, root)`` hold."""
    long = attach(shared, groups, ["node"]).withColumn("root", F.coalesce("root", "node"))
    ends = long.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    mixed = staged(ends.filter("low <> high").select("token"), "mixed")
    return staged(attach(long, mixed, ["token"], "left_semi"), "crossing")


def crossing_pairs(rows: DataFrame, similarity: float, *, star: bool) -> DataFrame:
    """Pairs ``(a, b)`` of ``crossing_tokens`` in different groups that can be similar; with ``star``, those with the smallest node of a token.

    Up to their first shared shingle, two sets have nothing in common, so its
    positions bound what they can share. The smaller set of a pair is dealt to
    the band of sizes it lies in and, where its own position lets it reach
    that far, to the next; only sets of a band meet.
    """
    own = F.struct("node", "root", "size", "pos")
    shared = F.least(F.col("x.size") - F.col("x.pos"), F.col("y.size") - F.col("y.pos"))
    possible = shared * (1.0 + similarity) + 1e-6 >= F.lit(similarity) * (F.col("x.size") + F.col("y.size"))
    apart = F.col("x.root") != F.col("y.root")
    if star:
        met = rows.select("token", own.alias("x")).join(rows.groupBy("token").agg(F.min(own).alias("y")), "token")
        met = met.filter((F.col("x.node") > F.col("y.node")) & apart & possible)
    else:
        band = lambda size: F.floor(-F.log(F.greatest(size, F.lit(1.0))) / float(np.log(similarity)) + 1e-9).cast("int")
        size = F.col("size").cast("double")
        reach = (size - F.col("pos")) * (1.0 + similarity) / similarity - size + 1e-3  # the largest set it can be similar to
        left = rows.select("token", band(size).alias("band"), own.alias("x"))
        bands = F.sequence(band(size), F.greatest(band(size), F.least(band(size) + 1, band(reach))))
        right = rows.select("token", F.explode(bands).alias("band"), own.alias("y"))
        larger = F.struct("x.size", "x.node") > F.struct("y.size", "y.node")
        met = left.join(right, ["token", "band"]).filter(larger & apart & possible)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _nodes_of(pairs: DataFrame) -> DataFrame:
    return staged(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "used")


def close_pairs(bitmaps: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The staged ``pairs(a, b)`` that ``bitmaps(node, size, bits)`` do not show to be less similar than wanted.

    Sets of the wanted similarity differ in at most a fixed share of their
    sizes; ``least_apart`` and their sizes bound the difference from below, so
    none is lost.
    """
    share = (1.0 - similarity) / (1.0 + similarity)
    used = attach(bitmaps.select("node", "size", "bits"), _nodes_of(pairs), ["node"], "left_semi")
    left, right = (used.select(F.col("node").alias(c), F.col("size").alias(f"n_{c}"), F.col("bits").alias(f"w_{c}")) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 4))
            apart = np.array([least_apart(x.as_py(), y.as_py()) for x, y in zip(batch.column(3), batch.column(5))], dtype=np.int64)
            yield batch.select([0, 1]).filter(pa.array(np.maximum(apart, np.abs(n - m)) <= share * (n + m) + 1e-6))

    met = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "w_a", "n_b", "w_b")
    return staged(met.mapInArrow(run, "a long, b long"), "close")


def true_links(texts: DataFrame, bitmaps: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The staged ``pairs(a, b)`` whose ``texts(node, text)``, one row a node, have the wanted similarity.

    Only pairs that pass ``close_pairs`` send their sets of shingles.
    """
    pairs = close_pairs(bitmaps, pairs, similarity)
    used = _nodes_of(pairs)
    sets = shingle_sets(attach(texts, used, ["node"], "left_semi").select("node", "text"))
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s_{c}")) for c in "ab")
    met = pairs.join(left, "a").join(right, "b")  # both sides read one shuffle of the sets
    common = F.size(F.array_intersect("s_a", "s_b"))
    total = F.size("s_a") + F.size("s_b") - common
    return staged(met.filter(common >= F.lit(similarity) * total).select("a", "b"), "similar")


def _nodes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``node``, the doc_id where it names one row and else a hash; and the ids of several rows or none."""
    counts = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    shared = staged(counts.filter("n > 1 or doc_id is null").select("doc_id", F.lit(True).alias("__shared")), "shared")
    return _with_node(rows, shared), shared


def _with_node(rows: DataFrame, shared: DataFrame) -> DataFrame:
    marked = attach(rows, shared, ["doc_id"])
    node = F.when(F.col("__shared"), F.xxhash64("doc_id", "mark")).otherwise(F.col("doc_id"))
    return marked.withColumn("node", node).drop("__shared")


def similar_groups(
    docs: DataFrame, similarity: float = SIMILARITY, parts: int = PARTS, radius: int = RADIUS
) -> tuple[DataFrame, DataFrame]:
    """``(node, keeper)`` of every row in a group of similar texts, and the ids shared by several rows.

    The keeper of a group is the row with the smallest doc_id, null last.

    A pair links if the Jaccard similarity of its five-word shingles is at
    least ``similarity``, and groups are the components of all such links.
    Most are found between texts that agree within ``radius`` bits in one of
    ``parts`` fingerprints of their distinct words, along a spanning forest
    and to the smallest node of each fingerprint, and between equal sets of
    shingles. The rest is a prefix-filtered join: two texts of the wanted
    similarity share one of their rarest shingles, so every pair with such a
    shingle whose texts are not yet in one group is compared, first with the
    smallest node of the shingle, then all that are still apart.
    """
    rows, shared = _nodes(staged(word_sketches(docs, parts), "sketches"))
    long = staged(rows.select("node", F.posexplode("prints").alias("part", "fp")), "prints")
    points = staged(long.groupBy("part", "fp").agg(F.min("node").alias("first")), "points")
    same = long.join(points, ["part", "fp"]).filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    links = staged(shard_links(points, radius, pairs=True), "links")
    ends = [points.select("part", F.col("fp").alias(c), F.col("first").alias(f"node_{c}")) for c in "ab"]
    near = links.join(ends[0], ["part", "a"]).join(ends[1], ["part", "b"]).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    marked = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text")
    texts = _with_node(marked, shared).select("node", "text")
    if shared.limit(1).count():  # rows that repeat an id and a text are one node
        alone = attach(marked, shared, ["doc_id"], "left_anti").select(F.col("doc_id").alias("node"), "text")
        texts = alone.unionAll(_with_node(attach(marked, shared, ["doc_id"], "left_semi"), shared).select("node", "text").dropDuplicates(["node"]))
    prefixes = staged(shingle_prefixes(texts, similarity), "prefixes")
    sets = staged(prefixes.groupBy("mark", "size").agg(F.min("node").alias("first")), "sets")
    equal = prefixes.join(sets, ["mark", "size"]).filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    both = same.unionAll(near).unionAll(equal)
    pairs = staged(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().filter("a <> b"), "pairs")
    bitmaps = staged(prefixes.select("node", "size", "bits"), "bitmaps")
    found = true_links(texts, bitmaps, pairs, similarity)
    groups = staged(connected_components(found), "groups")
    rare = shared_tokens(attach(prefixes, sets.select(F.col("first").alias("node")), ["node"], "left_semi"))
    discard(prefixes)
    for star in (True, False):
        pairs = staged(crossing_pairs(crossing_tokens(rare, groups), similarity, star=star), "pairs")
        found = true_links(texts, bitmaps, pairs, similarity)
        if not found.isEmpty():  # the stars of the groups so far stand for their links
            links = groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(found)
            groups = staged(connected_components(links), "groups")
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("node"))
    keepers = groups.join(rows.select("node", "doc_id"), "node").groupBy("root").agg(F.min_by("node", first).alias("keeper"))
    return groups.join(keepers, "root").select("node", "keeper"), shared


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without all but one document of each group of similar texts; see ``similar_groups``.

    The document with the smallest doc_id stays. Texts without a word are
    similar to each other. Of rows that repeat an id and a text one stays; rows
    that share an id otherwise, and rows with a null id, count as documents of
    their own, of which one is kept per group. An empty table stays empty.
    """
    groups, shared = similar_groups(docs, similarity)
    leave = staged(groups.filter("node <> keeper").select("node"), "leave")
    marked = docs.withColumn("__mark", F.xxhash64("text"))
    marked = attach(marked, shared, ["doc_id"])
    node = F.when(F.col("__shared"), F.xxhash64(F.col("doc_id").cast("long"), "__mark")).otherwise(F.col("doc_id").cast("long"))
    marked = attach(marked.withColumn("node_", node), leave.withColumnRenamed("node", "node_"), ["node_"], "left_anti")
    out = marked.filter(F.col("__shared").isNull())
    if shared.limit(1).count():
        out = out.unionByName(marked.filter(F.col("__shared")).dropDuplicates(["node_"]))
    return out.select(*docs.columns)
