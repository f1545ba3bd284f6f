import math
import zlib

import numpy as np
import pytest

from claimspark.llm import language_id as M


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_accuracy_and_contract(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = M.op3_language_id(spark, folder).collect()
    assert len(rows) == len(docs) and {r.doc_id for r in rows} == set(docs)
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    unseen = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in unseen)
    print(right, len(unseen))
    assert right >= 0.97 * len(unseen)


def corpus(spark):
    rows = []
    for i in range(120):
        lang, words = [("en", "the and with of this"), ("de", "der und mit von dies"), ("fr", "le et avec du ceci"), ("xx", "zyq kwx vvj qqz")][i % 4]
        rows.append((i, " ".join(words.split()[(i + k) % 4] for k in range(12)), lang))
    rows += [(200, None, "en"), (201, "", "de"), (202, "123 !! ½ ⅷ", "fr"), (None, "the and of", "zz"), (203, "der und mit von", None), (203, "der und mit von", None), (204, "é" * 100_000, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "true as held_out", "1 as score", "'q' as source")


def test_edges(spark):
    docs = corpus(spark)
    rows = M.identify(docs, M.train(docs)).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (200, 201, 202))
    assert [r.lang_pred for r in rows if r.doc_id == 203] == ["de", "de"]
    assert not by[None].held_out and "zz" not in {r.lang_pred for r in rows}
    assert all(by[i].lang_pred == ("en", "de", "fr", "xx")[i % 4] for i in range(120))
    kept = M.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3


def test_prediction_does_not_depend_on_labels_or_order(spark):
    docs = corpus(spark)
    model = M.train(docs)
    again = M.train(docs.repartition(3))
    assert np.array_equal(model.top.weights, again.top.weights)
    plain = sorted(map(str, M.identify(docs, model).collect()))
    assert plain == sorted(map(str, M.identify(docs.drop("lang", "source"), again).collect()))


@pytest.mark.parametrize("rows", [[], [(1, "abc", None)], [(1, None, "en")]])
def test_nothing_to_learn_from(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [r.lang_pred for r in M.identify(docs, M.train(docs)).collect()] == ["und"] * len(rows)


def test_svm_separates_what_can_be_separated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5)).astype(np.float32)
    y = np.where(x[:, 0] - x[:, 1] > 0, 1.0, -1.0)
    x[:, 0] += y
    assert ((x @ M.fit_svm(x, y) > 0) == (y > 0)).all()


def plain_features(text):
    """The n-gram counts one at a time."""
    points, counts = [ord(c) for c in f" {text.lower()} "], {}
    for order in range(1, M.ORDERS + 1):
        for i in range(len(points) - order + 1):
            gram = 0
            for p in points[i : i + order]:
                gram = (gram * 1_000_003) % 2**64 ^ p
            slot = (gram + order - 1) * 0x9E3779B97F4A7C15 % 2**64 >> 51
            counts[slot] = counts.get(slot, 0) + 1
    damped = {k: math.log1p(n) for k, n in counts.items()}
    norm = math.sqrt(sum(v * v for v in damped.values()))
    return {**{k: v / norm for k, v in damped.items()}, M.DIMENSIONS: 1.0}


def plain_vote(machines, x):
    """The name with the best mean chance over its pairs, and that chance."""
    names, won = machines.names, {name: [] for name in machines.names}
    for (i, j), weights in zip(machines.pairs, machines.weights, strict=True):
        chance = 1 / (1 + math.exp(-3 * sum(float(weights[k]) * v for k, v in x.items())))
        won[names[i]].append(chance)
        won[names[j]].append(1 - chance)
    means = {name: sum(c) / len(c) if c else 1.0 for name, c in won.items()}
    best = max(names, key=means.get)
    return best, means[best]


def test_decisions_are_those_of_a_plain_vote(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = M.train(docs)
    got = {r.doc_id: r for r in M.identify(docs, model).collect()}
    for r in docs.collect():
        if not M.has_letter(r.text):
            assert got[r.doc_id].lang_pred == "und"
            continue
        x = plain_features(r.text)
        family, sure = plain_vote(model.top, x)
        language, chance = plain_vote(model.within[model.top.names.index(family)], x)
        assert got[r.doc_id].lang_pred == language and abs(got[r.doc_id].score - sure * chance) < 1e-4
