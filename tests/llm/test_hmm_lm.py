import math
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from claimspark.llm import hmm_lm as M


def plain_tokens(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), None]


def remainder(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 10 if doc_id is not None else None


def plain_base(docs):
    """(n_tokens, n_known, train_tokens, base_score) of each document, from the contract."""
    counts = Counter()
    for doc_id, text in docs:
        if remainder(doc_id) not in (0, None):
            counts.update(plain_tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for doc_id, text in docs:
        tokens = plain_tokens(text)
        out.append((doc_id, remainder(doc_id) == 0, len(tokens), sum(counts[t] > 0 for t in tokens), n, sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)))
    return out


def compare(rows, docs):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows), key=str)
    wanted = sorted(plain_base(docs), key=str)
    assert len(got) == len(wanted)
    for a, b in zip(got, wanted, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)


def test_query_base_against_plain_counts_and_gain_on_held_out_texts(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = M.op10_hmm_lm(spark, folder).collect()
    compare(rows, docs)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_defined_cases_in_one_and_in_many_blocks(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * k) % 17}" for k in range(i % 9))) for i in range(60)] + [(100, None), (100, None), (101, ""), (102, "ÉA É\x1cq İ " * 800), (None, "w1 W1 w3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "true as train", "'s' as symbols", "1 as block", "2 as bucket")
    got = M.score(docs).collect()
    compare(got, rows)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert M.score(docs.limit(0)).count() == 0
    for name, value in (("BLOCK", 200), ("BUCKET", 500), ("CHUNK", 7), ("SHORT", 10), ("PIECE", 3)):
        monkeypatch.setattr(M, name, value)
    cut = M.score(docs).collect()
    compare(cut, rows)
    for a, b in zip(*(sorted(x, key=str) for x in (got, cut)), strict=True):
        assert a.score == pytest.approx(b.score, rel=0.01)


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(1000) if remainder(i) == 0)
    docs = [(held, "a b"), (None, "c")]
    compare(M.score(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)


def plain_score(docs, first):
    """Scores by textbook Baum-Welch on dictionaries, whole texts, one after the other; ``first`` gives the start."""
    train = [plain_tokens(t) for d, t in docs if remainder(d) not in (0, None)]
    counts = Counter(w for t in train for w in t)
    kind = lambda w: M.word_class(w.encode() if w is not None else b"")
    hashes = {w: M.word_hash(w.encode() if w is not None else b"") for w in counts}
    vocabulary = list(counts)
    at_start = first.counts(np.array([hashes[w] for w in vocabulary], np.uint64), np.array([kind(w) for w in vocabulary]), np.array([counts[w] for w in vocabulary], float))
    by_state, start, flow = dict(zip(vocabulary, at_start, strict=True)), first.start, first.flow

    def emission():
        mass, once, sums, met, own = Counter(), Counter(), {}, {}, by_state
        for w, c in counts.items():
            mass[kind(w)] += c
            once[kind(w)] += c == 1
            sums[kind(w)] = sums.get(kind(w), 0) + by_state[w]
            met[kind(w)] = met.get(kind(w), 0) + (by_state[w] >= 0.5)
        total, none = sum(sums.values()), np.zeros(M.STATES)
        whole = sum(mass[k] + 0.1 for k in range(M.CLASSES + 1))
        new = sum(s >= 0.5 for s in sums.values()) + 1

        def of(w):
            k = kind(w)
            chance = (sums.get(k, none) + new * (mass[k] + 0.1) / whole) / (total + new)
            unknown = (once[k] + 0.1) / (mass[k] + once[k] + 0.1)
            if not counts[w]:
                return chance * unknown
            return chance * (1 - unknown) * (own[w] + (met[k] + 1) * counts[w] / mass[k]) / (sums[k] + met[k] + 1)

        return of

    smooth = lambda x: (x + 0.5) / (x + 0.5).sum(axis=-1, keepdims=True)
    for _ in range(M.ROUNDS):
        of, a0, a = emission(), smooth(start), smooth(flow)
        start, flow, by_state = np.zeros(M.STATES), np.zeros((M.STATES, M.STATES)), {w: np.zeros(M.STATES) for w in counts}
        for text in train:
            emit = [of(w) for w in text]
            alpha = [a0 * emit[0]]
            for e in emit[1:]:
                alpha.append(alpha[-1] / alpha[-1].sum() @ a * e)
            beta = np.ones(M.STATES)
            for t in range(len(text) - 1, -1, -1):
                gamma = alpha[t] * beta
                by_state[text[t]] += gamma / gamma.sum()
                if t:
                    joint = alpha[t - 1][:, None] * a * (emit[t] * beta)
                    flow += joint / joint.sum()
                    beta = a @ (emit[t] * beta)
                    beta = beta / beta.sum()
            start += gamma / gamma.sum()
    of, a0, a, out = emission(), smooth(start), smooth(flow), []
    for _, text in docs:
        state, log = a0, 0.0
        for i, w in enumerate(plain_tokens(text)):
            state = (state if not i else state @ a) * of(w)
            log += math.log10(state.sum())
            state = state / state.sum()
        out.append(log)
    return out


def test_scores_against_textbook_training(spark, monkeypatch):
    """Over many blocks and buckets, with texts of many pieces; shares travel rounded to 8 bits."""
    for name, value in (("BLOCK", 4000), ("BUCKET", 9000), ("CHUNK", 300), ("SHORT", 100), ("PIECE", 16)):
        monkeypatch.setattr(M, name, value)
    rng = np.random.default_rng(7)
    docs = []
    for i in range(120):
        side, size = "xy"[i % 2], int(rng.integers(1, 60)) if i % 10 else 400
        docs.append((i, " ".join(f"{side}{int(k)}{'abc'[int(k) % 3]}" for k in rng.zipf(1.4, size) % 90)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    first = M.Start([t.encode() for d, t in docs if remainder(d) != 0])
    monkeypatch.setattr(M, "Start", lambda texts: first)
    got = {r.doc_id: r.score for r in M.score(frame).collect()}
    for (doc_id, _), wanted in zip(docs, plain_score(docs, first), strict=True):
        assert got[doc_id] == pytest.approx(wanted, rel=0.003)


def test_words_of_all_classes_and_unknown_ones_sum_to_one():
    rng, size = np.random.default_rng(2), 3000
    classes = rng.integers(0, M.CLASSES, size)
    c = rng.zipf(1.5, size).astype(float)
    counts = rng.dirichlet(np.ones(M.STATES), size) * c[:, None]
    model = M.model_of(M.class_sums(classes, c, counts), np.ones(M.STATES), np.eye(M.STATES))
    known, unknown = model.emissions(classes, c, counts).sum(axis=0), model.unknown
    assert np.allclose(known + unknown.sum(axis=0), 1)


def test_packed_integers_and_shares_come_back():
    rng = np.random.default_rng(1)
    for kind in ("u2", "u4", "i8", "u8"):
        for size in (0, 1, 1000):
            x = rng.integers(0, 60_000, size).astype(kind)
            assert (M.unpacked(M.packed(x), kind) == x).all()
    counts = rng.dirichlet(np.full(M.STATES, 0.3), 500) * 40
    assert np.abs(M.shares(M.roots(counts)) - counts / 40).max() < 0.004
    assert (M.shares(M.roots(np.zeros((3, M.STATES)))) == 0).all()


def small_model(states=3, symbols=5):
    rng = np.random.default_rng(3)
    emit = rng.random((symbols, states))
    return rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), emit / emit.sum(axis=0)


def paths(model, text):
    start, flow, emit = model
    for path in product(range(len(start)), repeat=len(text)):
        p = start[path[0]]
        for t, s in enumerate(path):
            p *= (flow[path[t - 1], s] if t else 1) * emit[text[t], s]
        yield path, p


def plain_likelihood(model, text):
    return math.log10(sum(p for _, p in paths(model, text)))


@pytest.mark.parametrize(("short", "piece"), [(1024, 256), (0, 3), (0, 1)])
def test_likelihood_against_all_paths(monkeypatch, short, piece):
    monkeypatch.setattr(M, "SHORT", short)
    monkeypatch.setattr(M, "PIECE", piece)
    model, rng = small_model(), np.random.default_rng(0)
    texts = [rng.integers(0, 5, n).astype(np.uint32) for n in (1, 7, 2, 8, 3, 1)]
    assert M.log_likelihood(*model, texts) == pytest.approx([plain_likelihood(model, t) for t in texts])


def test_vectors_and_matrices_agree_on_long_texts(monkeypatch):
    model, rng = small_model(), np.random.default_rng(0)
    texts = [rng.integers(0, 5, n).astype(np.uint32) for n in (900, 257, 512)]
    by_vectors, counts = M.log_likelihood(*model, texts), M.baum_welch(*model, texts)
    for short, piece, cells in ((10, 256, 1 << 19), (10, 7, 70), (10, 512, 100)):
        for name, value in (("SHORT", short), ("PIECE", piece), ("CELLS", cells)):
            monkeypatch.setattr(M, name, value)
        assert M.log_likelihood(*model, texts) == pytest.approx(by_vectors)
        for a, b in zip(M.baum_welch(*model, texts), counts, strict=True):
            assert np.allclose(a, b)


def test_probabilities_of_all_texts_of_a_length_sum_to_one():
    texts = [np.array(t, np.uint32) for t in product(range(5), repeat=4)]
    assert (10 ** M.log_likelihood(*small_model(), texts)).sum() == pytest.approx(1)


@pytest.mark.parametrize(("short", "piece"), [(1024, 256), (0, 3), (0, 1), (0, 2)])
def test_expected_counts_against_all_paths(monkeypatch, short, piece):
    monkeypatch.setattr(M, "SHORT", short)
    monkeypatch.setattr(M, "PIECE", piece)
    model, texts = small_model(), [np.array(t, np.uint32) for t in ([0, 3, 1, 4, 4, 2], [2], [1, 1, 0])]
    start, flow, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for text in texts:
        whole = 10 ** plain_likelihood(model, text)
        for path, p in paths(model, text):
            start[path[0]] += p / whole
            for t, s in enumerate(path):
                emit[text[t], s] += p / whole
                if t:
                    flow[path[t - 1], s] += p / whole
    for got, wanted in zip(M.baum_welch(*model, texts), (start, flow, emit), strict=True):
        assert np.allclose(got, wanted)


def test_words_of_one_count_and_ending_have_states_of_their_own(spark):
    """Each is met beside other words."""
    rng = np.random.default_rng(1)
    docs = []
    for i in range(400):
        side = "ab"[i % 2]
        often = [f"{side}{k}" for k in rng.integers(0, 4, 24)]
        docs.append((i, " ".join([*often[:12], f"{side}{i % 20 // 2}-word", *often[12:]])))
    own, other = [i for i in range(400, 1000) if remainder(i) == 0][:2]
    docs += [(own, "a0 a1 a2 a3 a0 a3-word a1 a2 a3"), (other, "a0 a1 a2 a3 a0 b3-word a1 a2 a3")]
    rows = {r.doc_id: r for r in M.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert abs(rows[own].base_score - rows[other].base_score) < 0.3
    assert rows[own].score > rows[other].score + 0.6
