"""Spelling variants by a frontier of states over a distributed trie.

The words and the reversed words form two tries, whose edges are a table: a row
for each node (the hash of its prefix) with its children. Two words one edit
apart share the part before or the part after it, so a state takes its edit in
the second half of a word or of a reversed word, where tries are sparse. Level by
level, the states (word, rest of the word, node) at a depth are joined with the
nodes of that depth: words on their own path take a sibling's edge or skip a
character, states past their edit follow the next character of their rest.
States that end on a word are neighbours.

Skipping alone finds inserted and deleted characters: each pair is met from its
longer word, a replacement from the word whose character is smaller.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import attach, staged
from riskloom.session import work_path

#: ASCII letters in lower case and the code points U+00C0 to U+00FF, in UTF-8.
LETTERS = re.compile(rb"(?:[a-z]+|(?:\xc3[\x80-\xbf])+)+")
MIN_CHARS = 7
MIN_COUNT = 2
RATIO = 10
#: Distinct words whose counts a task adds up before it hands them over.
TASK_WORDS = 200_000

Edit = Callable[[str, list[bytes]], list[bytes]]


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, edit: Edit | None = None) -> DataFrame:
    """``(word, n)``: letter runs of ``docs(doc_id, text)``, A-Z lower-cased, and their occurrences.

    Words have at least ``min_chars`` code points and ``min_count``
    occurrences. ``edit`` maps the id of a document, as text, and its distinct
    runs of at least ``min_chars`` bytes to the words that they stand for.
    """

    def table(counts: Counter) -> pa.RecordBatch:
        words = pa.array(counts.keys(), type=pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(counts.values(), type=pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                own = Counter(w for w in LETTERS.findall(text.as_py().lower()) if len(w) >= min_chars)
                words = list(own) if edit is None else edit(doc_id.as_py(), list(own))
                for word, n in zip(words, own.values()):
                    total[word] += n
                if len(total) >= TASK_WORDS:
                    yield table(total)
                    total = Counter()
        yield table(total)

    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce("text", F.lit("")).cast("binary")
    found = docs.select(doc_id.alias("doc_id"), text.alias("text")).mapInArrow(run, "word string, n long")
    counts = found.filter(F.char_length("word") >= min_chars).groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= min_count)


def _node(side: Column | str, prefix: Column) -> Column:
    return F.xxhash64(side, prefix)


def sequences(words: DataFrame) -> DataFrame:
    """``(word, n, side, seq, half, size)``: each word forwards and backwards, and the depth from which it takes its edit."""
    both = [words.select("word", "n", F.lit(side).alias("side"), seq.alias("seq")) for side, seq in ((0, F.col("word")), (1, F.reverse("word")))]
    size = F.char_length("seq")
    half = F.floor((size + F.col("side")) / 2).cast("int")
    return both[0].unionAll(both[1]).select("*", half.alias("half"), size.alias("size"))


def trie_nodes(seqs: DataFrame) -> DataFrame:
    """``(node, children, depth)`` of the nodes from the half of a word on; ``children`` lists ``(ch, child)``.

    A node has as many children as the alphabet has letters, at most.
    """
    depths = seqs.filter("half < size").select("side", "seq", F.explode(F.sequence("half", F.col("size") - 1)).alias("depth"))
    ch = F.substring("seq", F.col("depth") + 1, F.lit(1))
    edges = depths.select(
        "depth", _node("side", F.substring("seq", F.lit(1), F.col("depth"))).alias("node"),
        F.struct(ch.alias("ch"), _node("side", F.substring("seq", F.lit(1), F.col("depth") + 1)).alias("child")).alias("edge"))
    nodes = edges.groupBy("depth", "node").agg(F.collect_set("edge").alias("children"))
    spark = seqs.sparkSession
    path = work_path(spark, "trie")
    nodes.write.partitionBy("depth").parquet(path)
    return spark.read.schema("node long, children array<struct<ch: string, child: long>>, depth int").parquet(path)


def _moves() -> Column:
    """Where a state may go from a node: an array of ``(node, rest)``."""
    first, after = F.substring("rest", 1, 1), F.substring("rest", F.lit(2), F.char_length("rest"))
    replaced = F.transform(F.filter("children", lambda e: e["ch"] > F.col("ch")),
                           lambda e: F.struct(e["child"].alias("node"), F.col("rest").alias("rest")))
    skipped = F.transform(F.filter("children", lambda e: (e["ch"] == first) & (e["ch"] != F.col("ch"))),
                          lambda e: F.struct(e["child"].alias("node"), after.alias("rest")))
    matched = F.transform(F.filter("children", lambda e: e["ch"] == F.col("ch")),
                          lambda e: F.struct(e["child"].alias("node"), F.col("rest").alias("rest")))
    return F.when(F.col("edited"), matched).otherwise(F.concat(replaced, skipped))


def near_pairs(words: DataFrame) -> DataFrame:
    """``(word, n, other, other_n)`` for each two of the staged ``words(word, n)`` one edit apart, once for each of the two."""
    spark, seqs = words.sparkSession, sequences(words)
    nodes = trie_nodes(seqs)
    levels = nodes.groupBy("depth").agg(F.max(F.size("children")).alias("most")).collect()  # a row for each depth
    forks = {r["depth"] for r in levels if r["most"] > 1}
    last = F.substring("seq", F.lit(1), F.col("size") - 1)  # the last character is skipped: no edge to follow
    ended = [seqs.select("word", "n", _node("side", last).alias("node"))]
    states, moving = None, False
    for depth in range(min(forks, default=0), max((r["depth"] for r in levels), default=-1) + 1):
        if not moving and depth not in forks:
            continue
        own = seqs.filter((F.col("half") <= depth) & (F.col("size") > depth)).select(
            "word", "n", _node("side", F.substring("seq", 1, depth)).alias("node"), F.lit(False).alias("edited"),
            F.substring("seq", depth + 1, 1).alias("ch"), F.substring("seq", F.lit(depth + 2), F.col("size")).alias("rest"))
        if moving:
            own = own.unionAll(states.filter("rest <> ''").select(
                "word", "n", "node", F.lit(True).alias("edited"), F.substring("rest", 1, 1).alias("ch"),
                F.substring("rest", F.lit(2), F.char_length("rest")).alias("rest")))
        met = own.join(nodes.filter(F.col("depth") == depth).select("node", "children"), "node")
        met = met.filter(F.col("edited") | (F.size("children") > 1))
        states = staged(met.select("word", "n", F.inline(_moves())), "states")
        ended.append(states.filter("rest = ''").select("word", "n", "node"))
        moving = not states.filter("rest <> ''").isEmpty()
    met = ended[0]
    for part in ended[1:]:
        met = met.unionAll(part)
    ends = seqs.select(_node("side", F.col("seq")).alias("node"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    true = F.levenshtein("word", "other", 1) == 1  # nodes are hashes
    pairs = staged(met.join(ends, "node").filter(true).select("word", "n", "other", "other_n").distinct(), "near")
    return pairs.unionAll(pairs.select("other", "other_n", "word", "n"))


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of the staged ``forms(word, form)``, whose chains end; each round doubles the steps."""
    now = forms.withColumnRenamed("form", "root")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = staged(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return now


def spelling_forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for each row of ``words(word, n)``.

    Words are near if they differ by one inserted, deleted or replaced code
    point. The form of a word is its most frequent near word (of those the
    smallest in code-point order), if that has at least ``ratio`` times its
    occurrences; the root follows forms to the last.

    Words are distinct and not null. An empty table gives an empty table. There
    is one round for each depth at which words part or states still move, so at
    most one for each character of the longest word.
    """
    words = staged(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("k"), F.col("other").alias("form")))
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"), F.first("n").alias("n"))
    is_form = -F.col("best.k") >= ratio * F.col("n")
    near = staged(near.select("word", "n_near", F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.k")).alias("form_n")), "neighbours")
    roots = _roots(near.filter("form is not null").select("word", "form"))
    out = attach(attach(words, near, ["word"]), roots, ["word"])
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, edit: Edit | None = None) -> DataFrame:
    """``spelling_forms`` of the words of ``docs(doc_id, text)``; see ``word_counts``.

    Null and empty texts hold no words; a null id counts as an empty one and
    repeated rows count each time. Other columns are not read.
    """
    return spelling_forms(word_counts(docs, min_chars, min_count, edit), ratio)
