"""Mixing, quality, decontamination, tokens and personal data."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from riskloom.llm import decontam, mixing, pii, quality, tokens

SCHEMA = ("doc_id long, text string, lang string, source string, key string, size string, target int, fp long, n long, "
          "words string, gid int, epochs int, block int, limit int, d2 double")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, s) + ("x", "y", 1, 2, 3, "z", 4, 5, 6, 7, 8.0) for i, t, lang, s in rows], SCHEMA)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "river", "cold", "of", "a", "stone", "bridges", "and", "weather", "in"]) + rng.choice(["", "s", "ly", "."])
                    for _ in range(n))


ODD = [(None, "no id here", "en", "a"), (None, "no id here", "en", "a"), (None, None, None, None), (1, "", "en", "b"), (2, None, "en", "b"),
       (3, " \n\t ", "de", None), (7, "same row", "fr", "c"), (7, "same row", "fr", "c")]


# mixing


def mix_rows():
    rows = list(ODD)
    for i in range(900):
        rows.append((100 + i, prose(i, 5 + i % 60), "en", ["a", "é", "b", "Z", None][min(i % 9, 4)]))
    rows.append((5000, prose(1, 40_000), "en", "big"))
    return rows


@pytest.mark.parametrize("block_rows", [7, 2_000])
def test_mix_reaches_the_targets(spark, block_rows):
    rows = mix_rows()
    out = mixing.mix(documents(spark, rows), block_rows).toPandas()
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(brute.WORD.findall(text or ""))
    wanted = brute.water_fill(sizes)
    assert len(out) == len(rows)
    for source, target in wanted.items():
        own = out[out["source"].isna()] if source is None else out[out["source"] == source]
        assert np.allclose(own["target"], target) and (own["source_size"] == sizes[source]).all()
        assert abs(own["taken"].sum() - target) <= own["size"].max() / 2 + 1e-6
        assert (own["taken"] <= 2 * own["size"]).all()


def test_blocks_and_reruns_do_not_change_the_mix(spark):
    docs = documents(spark, mix_rows())
    results = [sorted(map(str, mixing.mix(d, b).collect())) for d, b in ((docs, 7), (docs.repartition(11), 50), (docs, 10**6))]
    assert results[0] == results[1] == results[2]


def test_better_documents_come_first(spark):
    good = [(i, prose(i, 50), "en", "a") for i in range(300)]
    bad = [(1000 + i, " ".join(["a1#2$3%"] * 50), "en", "a") for i in range(300)]
    out = mixing.mix(documents(spark, good + bad)).toPandas()
    assert out[out.doc_id < 1000].taken.sum() > 1.2 * out[out.doc_id >= 1000].taken.sum()


def test_mix_of_nothing(spark):
    assert mixing.mix(documents(spark, [])).collect() == []
    empty = mixing.mix(documents(spark, [(1, None, None, "a"), (2, "", None, None)])).collect()
    assert sorted((r["doc_id"], r["size"], r["target"], r["taken"]) for r in empty) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


# quality


def quality_rows():
    rng = random.Random(3)
    rows = list(ODD)
    for i in range(400):
        words = [rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(int(np.exp(rng.gauss(4.5, 0.6))) + 20)]
        rows.append((100 + i, " ".join(words), "en" if i % 3 else "de", "a" if i % 5 else "b"))
    rows.append((5000, "x " * 50_000, "en", "a"))
    rows.append((5001, "one two three four five six seven eight\n" * 3 + prose(5, 200), "en", "a"))
    rows.append((5002, "a b c d e f g h i j a b c d e f g h " + prose(6, 90), "en", "a"))
    rows.append((5003, " ".join("#%$*&|" * 4 + str(i) for i in range(80)), "en", "a"))
    rows.append((5004, "\n".join(["  ", "line", "line", "", "line ", "other"]), "en", "a"))
    return rows


def test_base_statistics_equal_brute_force(spark):
    rows = quality_rows()
    found = quality.judge(documents(spark, rows)).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = sorted((str(r["doc_id"]), *[r[n] for n in names]) for r in found)
    assert got == sorted((str(i), *brute.statistics(t)) for i, t, _, _ in rows)


def test_outliers_go_and_prose_stays(spark):
    found = {r["doc_id"]: r["kept"] for r in quality.judge(documents(spark, quality_rows())).collect()}
    assert not found[5003] and not found[5000] and not found[1]
    assert sum(found[100 + i] for i in range(400)) >= 398


def test_repeated_lines_go_and_one_repeat_stays(spark):
    """Short repeated lines between lines of their own: no window of eight words repeats."""
    rows = [(i, "\n".join(prose(100 * i + j, 9) + f" {i}" for j in range(50)), "en", "a") for i in range(200)]
    again = [f"{prose(9000 + j, 9)} {j}\nin rivers" for j in range(40)]
    rows += [(1000, "\n".join(again), "en", "a"), (1001, rows[0][1] + "\nmenu\nmenu", "en", "a")]
    found = {r["doc_id"]: r for r in quality.judge(documents(spark, rows)).collect()}
    assert found[1000]["n_dup_lines"] == 39 and not found[1000]["base_failed"] and not found[1000]["kept"]
    assert found[1001]["n_dup_lines"] == 1 and found[1001]["kept"]


def test_distances_equal_numpy(spark):
    """The last concentration step against a plain fit of the same rows."""
    rows = documents(spark, [r for r in quality_rows() if r[0] and r[0] < 500 and r[0] >= 100])
    stats = quality.statistics(rows)
    data = stats.select("doc_id", F.lit(1).alias("gid"), *[c.alias(n) for n, c in quality.vectors().items()])
    fit = quality._fit(data).toPandas().iloc[0]
    x = data.toPandas()[quality.DIMS].to_numpy()
    cov = np.cov(x.T, bias=True) + np.diag([f**2 for f in quality.FLOORS.values()])
    lower = np.linalg.cholesky(cov)
    for i, a in enumerate(quality.DIMS):
        assert abs(fit[f"mean_{a}"] - x[:, i].mean()) < 1e-5
        for j, b in enumerate(quality.DIMS[: i + 1]):
            assert abs(fit[f"l_{a}_{b}"] - lower[i, j]) < 1e-3
    far = quality._distance(data, quality._fit(data)).toPandas()
    centred = x - x.mean(axis=0)
    wanted = np.einsum("ij,jk,ik->i", centred, np.linalg.inv(cov), centred)
    assert np.allclose(np.sort(far["d2"]), np.sort(wanted), rtol=1e-2, atol=1e-3)


def test_quality_of_nothing(spark):
    assert quality.judge(documents(spark, [])).collect() == []


def test_few_documents_reject_none(spark):
    rows = [(i, prose(i, 30), "en", str(i)) for i in range(5)] + [(9, "#" * 500 + prose(1, 40), "en", "z")]
    assert all(r["kept"] for r in quality.judge(documents(spark, rows)).collect())


@pytest.mark.parametrize("n", [20, 49, 51])
def test_one_verdict_around_the_smallest_group(spark, n):
    rows = [(i, prose(i, 60), "en", "a") for i in range(n)] + [(9_000, "#" * 500 + " " + prose(1, 60), "en", "a")]
    found = {r["doc_id"]: r["kept"] for r in quality.judge(documents(spark, rows)).collect()}
    assert found == {**{i: True for i in range(n)}, 9_000: False}


def test_small_groups_are_set_against_all_documents(spark):
    rows = [(i, prose(i, 60), "en", "a") for i in range(80)] + [(100 + i, prose(i + 7, 60), "de", str(i)) for i in range(3)]
    rows.append((9_000, "#" * 500 + " " + prose(1, 60), "fr", "z"))
    found = {r["doc_id"]: r["kept"] for r in quality.judge(documents(spark, rows)).collect()}
    assert len(found) == 84 and [i for i, kept in found.items() if not kept] == [9_000]


# decontamination


def benchmark(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "item_id long, text string, n int, fp string")


ITEMS = [(i, prose(900 + i, 12 + 7 * i)) for i in range(12)] + [(50, "two words"), (51, None), (52, ""), (53, prose(903, 33)), (54, "a a a a a a a a a a")]


def decontam_rows():
    rng = random.Random(8)
    rows = list(ODD) + [(3001, "Two Words", "en", "a"), (3002, "here are two words more", "en", "a"), (3003, "a " * 400, "en", "a")]
    for i in range(200):
        words = prose(5000 + i, 120).split()
        if i % 2:
            item = ITEMS[i % 12][1].split()
            for _ in range(i % 5):
                item[rng.randrange(len(item))] = "changed"
            if i % 7 == 0:
                item.insert(3, "more")
            at = rng.choice([0, 40, len(words)])
            words[at:at] = item
        if i % 10 == 4:
            words = ITEMS[i % 12][1].upper().split()
        rows.append((100 + i, " ".join(words), "en", "a"))
    rows.append((4000, " ".join(prose(7, 60_000).split() + ITEMS[3][1].split()), "en", "a"))
    return rows


def test_contamination_equals_brute_force(spark):
    rows = decontam_rows()
    found = decontam.contamination(documents(spark, rows), benchmark(spark, ITEMS)).collect()
    short = [r for r in rows if len(r[1] or "") < 100_000]
    got = {r["doc_id"]: (r["contaminated"], r["n_items"], r["item_id"], r["similarity"] and round(r["similarity"], 9)) for r in found}
    assert len(found) == len(rows) and got[4000][0]
    for doc_id, text, _, _ in short:
        hits = brute.benchmark_hits(text, ITEMS)
        best = max(hits.values(), default=None)
        item = min((i for i, v in hits.items() if v == best), default=None)
        assert got[doc_id] == (bool(hits), len(hits), item, best and round(best, 9)), (doc_id, text)
    kept = decontam.drop_contaminated(documents(spark, rows), benchmark(spark, ITEMS))
    assert kept.columns == documents(spark, []).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in found if not r["contaminated"])


def test_contamination_of_nothing(spark):
    docs = documents(spark, decontam_rows())
    assert decontam.contamination(docs.limit(0), benchmark(spark, ITEMS)).collect() == []
    none = decontam.contamination(docs, benchmark(spark, [])).collect()
    assert len(none) == docs.count() and not any(r["contaminated"] for r in none)


def test_blocks_of_the_benchmark_change_nothing(spark, monkeypatch):
    docs, items = documents(spark, decontam_rows()).filter("doc_id < 200"), benchmark(spark, ITEMS)
    one = sorted(map(tuple, decontam.matches(docs, items).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 8_000)
    assert sorted(map(tuple, decontam.matches(docs, items).collect())) == one and one


def test_column_simhash_and_index_radius(spark):
    rng = random.Random(1)
    lists = [[rng.getrandbits(64) - 2**63 for _ in range(n)] for n in (1, 2, 5, 80, 80, 500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<long>")
    found = {r["i"]: r["fp"] for r in df.select("i", decontam.simhash(F.col("v")).alias("fp")).collect()}
    for i, values in enumerate(lists):
        wanted = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))
        assert found[i] % 2**64 == wanted
    # eight blocks: radius 23 leaves at least one block with two differing bits or fewer
    assert decontam.BLOCKS * (decontam.BLOCK_RADIUS + 1) > decontam.RADIUS


# tokens


def test_tokens_equal_the_library(spark):
    texts = [None, "", "plain text, it's here's 'll 123 45", "a<|endoftext|>b <|endoftext|>", "<|endoftext|>", "  lead\n\n\n  tail   ", "\x1c\x1d \x85\xa0 x​é　",
             "日本語 テキスト ١٢٣ ½ ²", "emoji 👩‍👩‍👧 \U0001F1E9\U0001F1EA", "tab\t\tx\r\n\r\ny", "don't DON'T don’t", "x" * 50_000, prose(1, 30_000), "﻿bom é \x00\x01"]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)] + [(None, "no id", "en", "a"), (3, "again", "en", "a"), (3, "again", "en", "a")]
    tokenizer = Tokenizer.from_file(tokens.default_path())
    found = tokens.count_tokens(documents(spark, rows)).collect()
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found)
    wanted = []
    for i, text, _, _ in rows:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        wanted.append((str(i), len((text or "").encode()), n, n > 512))
    assert got == sorted(wanted)


def test_forgetting_pieces_changes_nothing(monkeypatch):
    texts = [prose(i, 200) for i in range(20)]
    counter = tokens.PieceCounter(tokens.default_path())
    once = counter.count(texts)
    monkeypatch.setattr(tokens, "KNOWN_PIECES", 5)
    assert sum((counter.count([t]) for t in texts), []) == once


# personal data

PERSONAL = [
    "mail a.b+c@x-y.example.com, x@y, @z.com and .@a.b.c.d", "a@b@c.de x@y.z@w.v", "a@b.c@d.e", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0000001.2.3.04 1.2.3",
    "4539 1488 0343 6467 and 4539-1488-0343-6468 123456789012345678901234567890 0000000000000", "+1 (555) 010-9999 +44 20 7946 0958 +1 2 +123456789 ++12345678901 +1(((((((((2",
    "1" * 5_000, "." * 2_000 + "1.1.1." * 500, "a" * 30_000 + "@", "é@é.com ünï+1@café.example.com", "call (415) 555-2671 or 415-555-2671 now",
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "write to jane (at) example (dot) org please", "+1 999.999.999.999 4111111111111111",
]


def test_base_spans_equal_brute_force(spark):
    rows = [(i, t, "en", "a") for i, t in enumerate(PERSONAL)] + ODD
    found = pii.find(documents(spark, rows)).collect()
    got = sorted((str(r["doc_id"]), r["base"]) for r in found)
    assert got == sorted((str(i), brute.personal_spans(t or "")) for i, t, _, _ in rows)
    for r in found:
        names = [x.split(":")[0] for x in r["base"].split(",") if x]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [names.count(k) for k in ("email", "ip", "card", "phone")]
        assert set(r["base"].split(",")) - {""} <= set(r["spans"].split(","))


def test_labelers_teach_the_classifier_to_add_spans(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        secret = hashlib.sha1(str(i).encode()).hexdigest()
        phone = f"({rng.randint(200, 989)}) {rng.randint(200, 989)}-{rng.randint(1000, 9999)}"
        rows.append((i, [f'set token = "{secret}" here', f"call {phone} today", f"phone +1 {phone} or mail a{i}@b.example.com", prose(i, 30)][i % 4], "en", "a"))
    found = {r["doc_id"]: r["spans"] for r in pii.find(documents(spark, rows)).collect()}
    assert sum("secret:" in found[i] for i in range(0, 300, 4)) == 75
    assert sum("phone:" in found[i] for i in range(1, 300, 4)) >= 70
    assert all(found[i] == "" for i in range(3, 300, 4))


def test_reliable_labelers_win():
    ballots, truth = [], []
    rng = random.Random(6)
    for _ in range(4_000):
        kind = rng.choice([0, 1, 2, 5])
        said = [kind if rng.random() < p else rng.choice([0, 1, 2, 5]) for p in (0.9, 0.9, 0.9, 0.2, 0.2, 0.2)]
        ballots.append(said)
        truth.append(kind)
    unique, inverse, counts = np.unique(ballots, axis=0, return_inverse=True, return_counts=True)
    belief, _, confusion = pii.reliabilities(unique, counts)
    assert (belief.argmax(axis=1)[inverse.ravel()] == truth).mean() > 0.95
    assert confusion[0, 0, 1] > 0.85 > 0.6 > confusion[4, 0, 1]


def test_no_personal_data(spark):
    assert pii.find(documents(spark, [])).collect() == []
    assert [tuple(r) for r in pii.find(documents(spark, [(1, "nothing", "en", "a")])).collect()] == [(1, 0, 0, 0, 0, "", "")]


def test_candidates_have_no_longest_length():
    key, digits = "Ab3/" * 1_250, "12-34 " * 20 + "5"
    mail = "n" * 300 + " [at] " + "d" * 300 + " [dot] org"
    text = f"token {key} and call {digits} or {mail} now"
    found = {text[a:b] for a, b, _ in pii.candidates(text, [])}
    assert {key, digits, mail} <= found
