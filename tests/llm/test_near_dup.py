import random
import re

from rivulet.llm import near_dup
from rivulet.llm.components import components


def shingle_set(text, n):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n):
    sets = [shingle_set(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        least = min(ids) if ids and sets[i] else d
        out.append((d, len(sets[i]), least, d == least))
    return sorted(out, key=str)


def sample():
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(3000)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows = []
    for _ in range(25):
        seed = prose(rng.randint(30, 300))
        for _ in range(rng.choice([1, 2, 6, 60])):
            copy = list(seed)
            for _ in range(rng.randint(0, max(1, len(copy) // 18))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    rows += [" ".join(prose(rng.randint(1, 12))) for _ in range(60)] + ["a b c d e", "a b c d e f", "A b c d E", "b c", "x", "X", None, "", " \n", "of the " * 4000, "of the " * 2]
    chain = prose(100)
    for k in range(12):
        rows.append(" ".join(chain[k * 4 : k * 4 + 60]))
    rng.shuffle(rows)
    rows = [(i * 3, t) for i, t in enumerate(rows)]
    return rows + [(0, rows[5][1]), (rows[9][0], rows[9][1]), (None, rows[7][1]), (None, "nothing like it at all here")]


def check(spark, rows, n):
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, node long, members string").repartition(4)
    got = near_dup.link_components(docs, words_per_shingle=n).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id, bool(r.kept)) for r in got), key=str), docs


def test_same_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rows = sample()
    got, docs = check(spark, rows, 2)
    wanted = brute(rows, 2)
    # a null id is null in the brute force as well
    assert [(d, n, c, d == c) for d, n, c, _ in got] == wanted
    kept = near_dup.keep_first(docs, words_per_shingle=2)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _, c, k in got if k}


def test_five_words_and_empty(spark):
    rows = sample()[::2]
    got, docs = check(spark, rows, 5)
    assert [(d, n, c, d == c) for d, n, c, _ in got] == brute(rows, 5)
    assert near_dup.link_components(docs.limit(0)).collect() == []


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(0, 70)] + [(200, 199), (199, 205)] + [(300, k) for k in range(301, 330)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(71)}, 199: 199, 200: 199, 205: 199, **{k: 300 for k in range(300, 330)}}


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(5, 5)] + [(1000 + i, 1000 + (i * 7) % 50) for i in range(50)]
    parent = {n: n for e in links for n in e}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    alone = {a for a, b in links if a == b} - {n for a, b in links if a != b for n in (a, b)}
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent if n not in alone}


def near_copies(rng, n, words, edits):
    seed = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(seed)
        for at in rng.sample(range(words), edits):
            copy[at] = f"x{rng.randrange(10**9)}"
        out.append(" ".join(copy))
    return out


def test_a_large_group_below_the_limit_sends_no_pairs(spark):
    """Copies that agree but do not link: one edge a class at most goes out, and none of them is a link."""
    rng, sent = random.Random(12), []
    texts = near_copies(rng, 300, 120, 12)
    rows = list(enumerate(texts))
    docs = near_dup.row_key(spark.createDataFrame(rows, "doc_id long, text string"))
    classes = near_dup._classes(near_dup.sketch(docs, 2)).cache()

    def kept(frame, name):
        frame = frame.cache()
        sent.append((name, frame.count()))
        return frame

    family = near_dup._families(near_dup._shared_heads(classes), 80, kept)
    assert dict(sent)["agreeing"] <= 300 * near_dup.COORDINATES and family.count() == 300
    got = near_dup.link_components(docs.select("doc_id", "text"), words_per_shingle=2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == brute(rows, 2)
    assert all(r.kept for r in got)


def test_no_pair_at_the_limit_is_missed():
    """Pairs of a similarity of exactly 0.8 agree in enough coordinates: none of 20,000 drawn ones falls short."""
    import numpy as np

    rng = np.random.default_rng(5)
    least = near_dup.COORDINATES
    for _ in range(20_000):
        keys = rng.integers(0, 2**63, 20, dtype=np.uint64)
        values = ((keys[None, :] * near_dup._SEEDS[:, :1] + near_dup._SEEDS[:, 1:]) >> np.uint64(32)).astype(np.uint32)
        least = min(least, int((values[:, :18].min(1) == values[:, 2:].min(1)).sum()))
    assert least >= near_dup.MATCHES


def test_one_row_of_a_component_stays(spark):
    long = " ".join(f"w{i}" for i in range(60))
    near = long.replace("w30", "changed")
    rows = [(None, long, "a"), (None, near, "b"), (None, "other words stand here now", "c"), (4, None, "d"), (4, None, "d"), (5, " ", "e"), (7, "some five words are here", "f"), (7, "some five words are here", "g"), (7, "quite another text of that id", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    kept = near_dup.keep_first(docs, words_per_shingle=2).collect()
    assert kept and sorted(r.doc_id for r in kept if r.doc_id is not None) == [4, 4, 5, 7, 7]
    assert sum(r.text in (long, near) for r in kept) == 1 and sum(r.doc_id is None for r in kept) == 2
    assert [r.key for r in kept if r.doc_id == 4] == ["d", "d"]
    withid = spark.createDataFrame([*rows, (9, near.replace("w31", "also"), "z")], "doc_id long, text string, key string")
    kept = near_dup.keep_first(withid, words_per_shingle=2).collect()
    assert [r.doc_id for r in kept if r.text and r.text.startswith("w0 w1 ")] == [9]
