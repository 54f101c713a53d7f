import random
import re
from collections import Counter, defaultdict

from rivulet.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least, top):
    count, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        own = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        groups.add((lang, source))
        count[lang, source].update(own)
        df[lang].update(set(own))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in df[lang].items() if n >= least]
        sources = sorted(s for x, s in groups if x == lang)

        def share(n, counts):
            return 1 + 1_000_000_000 * (n + 5) // (sum(counts[t] for t in kept) + 5 * len(kept))

        whole = sum((count[lang, s] for s in sources), Counter())
        p = {s: {t: share(count[lang, s][t], count[lang, s]) for t in kept} for s in sources}
        q = {t: share(whole[t], whole) for t in kept}
        for s in sources:
            far = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            over = [(q[t] - p[s][t], t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(far)), ("term", sorted(over)[:top])):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def sample():
    rng = random.Random(8)
    words = [f"w{chr(97 + k % 26)}{'é' * (k % 3)}{chr(97 + k // 26)}" for k in range(70)] + ["日本", "Übel", "ﬀ", "𝒳y"]
    rows = []
    for i in range(220):
        source = rng.choice(["s0", "s0", "s1", "s2", "s9é", None])
        text = rng.choice([" ", ", ", "1", "_"]).join(rng.choice(words[rng.randrange(4) :: 4] + words[:6]).swapcase() for _ in range(rng.randint(0, 30)))
        rows += [(text, rng.choice(["en", "en", "de", None]), source)] * rng.choice([1, 1, 1, 9])
    return rows + [("only here", "xx", "a"), ("", "xx", "b"), (None, "yy", "a"), (None, None, "nothing")] + [("hot text with words", "en", f"s{k % 3}") for k in range(400)]


def test_against_brute_force(spark, monkeypatch):
    rows = sample()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, n int").repartition(5)
    for least, top, block, pairs, few in ((3, 50, 50_000, 1 << 19, 100_000), (1, 4, 10, 40, 2), (30, 50, 20, 7, 100_000)):
        for name, value in (("BLOCK", block), ("_PAIRS", pairs), ("FEW", few)):
            monkeypatch.setattr(divergence, name, value)
        got = sorted(map(tuple, divergence.audit(docs, least=least, top=top).collect()))
        assert got == brute(rows, least, top)


def test_empty_and_without_terms(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(docs).collect() == []
    docs = spark.createDataFrame([("1 2", "en", "a"), ("a", "en", "b")], "text string, lang string, source string")
    assert sorted(map(tuple, divergence.audit(docs).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
