"""The subsequence kernel, its machine on labelled texts, and the pipeline."""

import random
import zlib

import numpy as np
import pytest

import brute
import corpus_pipeline
from riskloom.llm import toxicity
from riskloom.llm.queries import ORACLES, QUERIES
from oracle_check import compare, connect

SCHEMA = "doc_id long, text string, lang string, source string, score double, predicted int, toxic int"
INSULTS = ["blockhead", "numbskull", "dimwit"]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0.0, 1, 1) for i, t in rows], SCHEMA)


def corpus(n=500):
    rng = random.Random(2)
    usual = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(usual, k=rng.randint(10, 120))
        if i % 4 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(i % 4 == 0)))
    return rows, labels


@pytest.fixture(scope="module")
def model():
    rows, labels = corpus()
    return toxicity.fit([t for _, t in rows], np.array([y for _, y in labels]), np.ones(len(rows)))


def test_folded_kernel_equals_its_definition():
    words = ["idiot", "idixot", "abc", "stonebridge", "xyz"]
    items = [toxicity.spelling(w := toxicity.words_of([x]), 0) for x in words]
    landmarks = toxicity.Landmarks(items[:3])
    got = landmarks.kernel(items)
    for i, a in enumerate(words):
        for j, b in enumerate(words[:3]):
            wanted = brute.subsequence_kernel(a, b) / toxicity.NORMS[len(a)] / toxicity.NORMS[len(b)]
            assert abs(got[i, j] - wanted) < 1e-9
    w = np.random.default_rng(0).normal(size=landmarks.whiten.shape[1])
    assert np.allclose(toxicity.fold(toxicity.from_spellings(items), landmarks.weights(w)), landmarks.map(items) @ w)


def test_words_are_cleaned():
    def spelled(text):
        words = toxicity.words_of([text])
        return ["".join(chr(96 + c) for c in toxicity.spelling(words, i)) for i in range(len(words.starts))]

    assert spelled("You i d i o t, an I.D-I_O.T! and 1d10t") == ["you", "idiot", "idiot", "and", "idiot"]
    assert spelled("") == [] == spelled(" a b ")
    long = spelled("x" * 20 + "blockhead" + "y" * 60)
    assert any("blockhead" in w for w in long) and all(len(w) <= toxicity.MAX_WORD for w in long)


def test_gapped_and_inserted_insults_score_high(model):
    clean = "the weather is mild today and the river is calm"
    toxic = ["you are a blockhead", "what a b l o c k h e a d", "such a BLOCK-HEAD!", "you bloxckhead", "n.u.m.b.s.k.u.l.l", "dimmwit", "n u m b s k u l l"]
    scores = model.scores([clean, "", "a b", *toxic])
    assert (scores[:3] < 0.5).all() and (scores[3:] >= 0.5).all()


def test_long_texts_are_scored_whole(model):
    filler = "mild weather and calm rivers " * 60_000
    scores = model.scores([filler, filler + " blockhead ", "blockhead " + filler, "z" * 3_000_000])
    assert scores[0] < 0.5 and (scores[1:3] >= 0.5).all() and scores[3] < 0.5


def test_held_out_accuracy_and_defined_cases(spark):
    rows, labels = corpus()
    extra = [(None, "no id"), (None, None), (9001, None), (9002, ""), (7, rows[7][1]), (9003, "dimwit")]
    marks = spark.createDataFrame([(i, y, "x") for i, y in labels] + [(None, 1, "x"), (3, None, "x"), (99_999, 1, "x")], "doc_id long, toxic int, text string")
    out = toxicity.judge(documents(spark, rows + extra), marks).toPandas()
    assert len(out) == len(rows) + len(extra) and out["score"].between(0, 1).all()
    assert ((out["score"] >= 0.5).astype(int) == out["predicted"]).all()
    known = out[out["doc_id"].notna()]
    assert all((zlib.crc32(str(int(i)).encode()) % 5 == 0) == h for i, h in zip(known["doc_id"], known["held_out"]))
    held = known[known["held_out"] & (known["doc_id"] < 500)]
    assert (held["predicted"] == (held["doc_id"] % 4 == 0)).mean() > 0.97
    kept = toxicity.drop_toxic(documents(spark, rows + extra), marks)
    assert kept.columns == documents(spark, []).columns
    assert kept.count() == int((out["predicted"] == 0).sum())


def test_without_labels_nothing_is_toxic(spark):
    rows, _ = corpus(20)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    for marks in (none, one):
        out = toxicity.judge(documents(spark, rows), marks).collect()
        assert len(out) == 20 and all(r["score"] == 0 and r["predicted"] == 0 for r in out)
        assert toxicity.drop_toxic(documents(spark, rows), marks).count() == 20
    assert toxicity.judge(documents(spark, []), one).collect() == []


def test_pipeline_equals_its_stages(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    judged = {r["doc_id"]: r["predicted"] for r in toxicity.judge(docs, labels).collect()}
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect() if not judged[r["doc_id"]]]
    texts = brute.kept_lines([(i, t) for i, t, _ in rows])
    source = {i: s for i, _, s in rows}
    first = {}
    for (i, _, t), c in zip(texts, brute.similar_components([t for _, _, t in texts])):
        first.setdefault(c, (i, t))
        first[c] = min(first[c], (i, t))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    clean = [(i, t) for i, t in first.values() if not brute.benchmark_hits(t, items)]
    size = {i: len(brute.WORD.findall(t)) for i, t in clean}
    totals = {}
    for i in size:
        totals[source[i]] = totals.get(source[i], 0) + size[i]
    target = brute.water_fill(totals)
    out = corpus_pipeline.run(spark, small_dir).collect()
    assert {r["doc_id"]: r["size"] for r in out} == size and len(out) == len(size) > 100
    assert all(abs(r["target"] - target[r["source"]]) < 1e-6 for r in out)


def test_stages_return_the_columns_of_documents(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small_dir).dtypes == docs.dtypes
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small_dir).collect() == []


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small_dir, name):
    assert compare(spark, connect(small_dir), small_dir, QUERIES[name], ORACLES[name]) is None
