import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from rivulet.llm import recurrent
from rivulet.llm.language_model import END_HASH, LEAST, MOST, SHARE, Corpus, _distinct, _network_words, score_texts
from rivulet.llm.recurrent import END, Gru


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) + [None]


def test_gradient_against_differences():
    model = Gru(11, hidden=5, seed=3)
    model.flat = model.flat.astype(np.float64)
    model.part = model._parts(model.flat, model.shapes)
    rng = np.random.default_rng(1)
    ids, words, keep = rng.integers(0, 11, (6, 4)), rng.integers(0, 11, (6, 4)), rng.random((6, 4)) < 0.8
    start = rng.normal(size=(4, 5))
    _, g, _ = model.gradient(ids, words, keep, start)
    for i in rng.choice(len(g), 150, replace=False):
        before = model.flat[i]
        values = []
        for step in (1e-5, -1e-5):
            model.flat[i] = before + step
            values.append(model.gradient(ids, words, keep, start)[0])
        model.flat[i] = before
        assert abs((values[0] - values[1]) / 2e-5 - g[i]) < 1e-4


def test_probabilities_and_carried_state():
    model = Gru(11, hidden=5, seed=3)
    h = np.random.default_rng(1).normal(size=(1, 5)).astype(np.float32)
    logs = model.outputs(np.repeat(h, 11, 0), np.arange(11))[0]
    assert abs(np.exp(logs).sum() - 1) < 1e-5
    texts = [np.array([*range(2, 11)] * 9 + [END]), np.array([END]), np.array([3, END])]
    assert np.allclose(model.score(texts, steps=7), model.score(texts, steps=500), atol=1e-3)
    assert np.allclose(model.score(texts, lanes=1), model.score(texts), atol=1e-3)


def test_scores(spark):
    rng = random.Random(8)
    pairs = {f"k{i}": [f"K{(i * 7 + d) % 40}" for d in (1, 2)] for i in range(40)}
    rows = []
    for i in range(600):
        w = ["k1"]
        for _ in range(rng.randint(5, 80)):
            w.append(rng.choice(pairs[w[-1].lower()]))
        if i % 9 == 0:
            w.insert(3, f"rare{i}")
        rows.append((i, " ".join(w)))
    rows += [(700, None), (701, ""), (702, "\x1c é"), (None, "k1 k8"), (5, rows[5][1]), (5, rows[5][1]), (703, "k1 " * 5000)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(3)
    got = score_texts(docs, words=30, hidden=8, chunks=5).collect()
    learn = lambda d: zlib.crc32(str(d if d is not None else "").encode()) % 5 != 1
    counts = Counter(t for d, x in rows if learn(d) for t in tokens(x))
    total, distinct = sum(counts.values()), len(counts)
    wanted = []
    for d, x in rows:
        t = tokens(x)
        base = sum(math.log10((counts[k] + 0.5) / (total + 0.5 * (distinct + 1))) for k in t)
        wanted.append((d, not learn(d), len(t), sum(counts[k] > 0 for k in t), total, round(base, 6)))
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == sorted(wanted, key=str)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    held = [r for r in got if r.held_out and r.doc_id and r.doc_id < 600]
    # the next word is one of two: far better than counts
    assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)
    assert score_texts(docs.limit(0)).collect() == []


def test_network_words_grow_with_the_corpus():
    sizes = []
    for many in (10_000, 100_000, 1_000_000):
        count = np.sort(np.maximum(1, many // np.arange(1, many // 4)))[::-1]
        n = _network_words(count[:MOST], int(count.sum()), None)
        assert n in (LEAST, MOST) or count[:n].sum() >= SHARE * count.sum() > count[: n - 1].sum()
        sizes.append(n)
    assert 1022 <= sizes[0] < sizes[1] < sizes[2]
    assert _network_words(count, int(count.sum()), 30) == 30
    assert _network_words(count[:0], 0, None) == 0


def test_start_from_counts():
    model = Gru(3000, hidden=4)
    counts = np.arange(3000.0)[::-1]
    model.start_from(counts)
    for name in "oc":
        model.part[name][:] = 0
    logs = model.outputs(np.zeros((3000, 4), np.float32), np.arange(3000))[0]
    assert np.allclose(np.exp(logs), (counts + 0.5) / (counts + 0.5).sum(), atol=1e-6)


def test_large_weights_and_large_states_keep_their_probabilities():
    for grown, size in ((1, 1), (300, 1), (1, 2000)):
        model = Gru(40, hidden=5, seed=3)
        model.flat *= grown
        h = np.random.default_rng(1).uniform(-size, size, (1, 5)).astype(np.float32)
        assert (model.tables()[2] >= np.abs(h).max()) == (grown == size == 1)  # only then no maximum is taken out
        words, part = np.arange(40), {k: v.astype(np.float64) for k, v in model.part.items()}
        log_softmax = lambda x: x - x.max() - np.log(np.exp(x - x.max()).sum())
        by_class = log_softmax(h[0] @ part["c"] + part["d"])
        inside = h[0] @ part["o"].T + part["b"]
        wanted = np.concatenate([by_class[c] + log_softmax(inside[i:j]) for c, (i, j) in enumerate(zip(model.cuts[:-1], model.cuts[1:]))])
        assert np.allclose(model.outputs(np.repeat(h, 40, 0), words)[0], wanted, rtol=1e-4, atol=1e-4)


def test_training_moves_by_corrected_means():
    words = np.random.default_rng(2).integers(0, 30, (10, 1))
    model, twin = Gru(30, hidden=4, seed=1), Gru(30, hidden=4, seed=1)
    assert model.train(words[:, 0], lanes=1, steps=10) == 10
    _, g, _ = twin.gradient(np.concatenate([[[END]], words[:-1]]), words, np.ones((10, 1), bool), np.zeros((1, 4), np.float32))
    # after one window both means, corrected, are the slope and its square
    assert np.allclose(model.flat, twin.flat + 0.02 * g / (np.abs(g) + 1e-6), atol=1e-4)


def test_texts_share_lanes_without_gaps(monkeypatch):
    model, steps = Gru(40, hidden=5, seed=3), []
    states = Gru.states
    monkeypatch.setattr(Gru, "states", lambda self, ids, *rest, **more: steps.append(len(ids)) or states(self, ids, *rest, **more))
    texts = [np.append(np.random.default_rng(i).integers(2, 40, n - 1), END) for i, n in enumerate([400, *[10] * 40, 1])]
    apart = [model.score([x])[0] for x in texts]
    steps.clear()
    assert np.allclose(model.score(texts, lanes=2, steps=30), apart, atol=1e-3)
    assert sum(steps) <= 401  # the longest text sets the pace, the others fill the second lane


def test_gradient_over_many_pieces(monkeypatch):
    ids = np.random.default_rng(4).integers(0, 60, (9, 7))
    whole = Gru(60, hidden=4, seed=2).gradient(ids, ids[::-1], np.ones((9, 7), bool), np.zeros((7, 4), np.float32))
    monkeypatch.setattr(recurrent, "LOGITS", 16)
    cut = Gru(60, hidden=4, seed=2).gradient(ids, ids[::-1], np.ones((9, 7), bool), np.zeros((7, 4), np.float32))
    assert abs(whole[0] - cut[0]) < 1e-5 and np.allclose(whole[1], cut[1], atol=1e-6)


def test_ids_and_distinct_hashes():
    rng = np.random.default_rng(6)
    # hashes that share their first bits, at both ends of the range
    known = np.unique(np.concatenate([rng.integers(0, 2**64, 500, dtype=np.uint64), np.arange(9, dtype=np.uint64), np.uint64(2**64 - 1) - np.arange(9, dtype=np.uint64)]))
    known = rng.permutation(known)
    h = np.concatenate([rng.choice(known, 2000), rng.integers(0, 2**64, 500, dtype=np.uint64), [END_HASH]])
    at = {int(x): i + 2 for i, x in enumerate(known)} | {int(END_HASH): END}
    assert Corpus(0, 0, known, 0, 0, None).ids(h).tolist() == [at.get(int(x), 0) for x in h]
    assert Corpus(0, 0, known[:0], 0, 0, None).ids(h).tolist() == [0] * 2500 + [END]
    for some in (h, h[:0]):
        assert all(np.array_equal(a, b) for a, b in zip(_distinct(some), np.unique(some, return_inverse=True)))
