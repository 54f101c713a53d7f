"""Cutting benchmark words out of texts: brute force on small texts, and one text with thousands of hits."""

import random
import re
import time

from rivulet.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def cut(text, items, n):
    found = list(WORD.finditer(text or ""))
    w, hit = [low(m[0]) for m in found], set()
    for item in items:
        own = [low(x) for x in WORD.findall(item or "")]
        size = min(len(own), n)
        for i in range(len(own) - size + 1 if own else 0):
            for p in range(len(w) - size + 1):
                if w[p : p + size] == own[i : i + size]:
                    hit.update(range(p, p + size))
    out, last = [], 0
    for k in sorted(hit):
        out.append(text[last : found[k].start()])
        last = found[k].end()
    return None if text is None else "".join(out) + text[last:]


def test_against_brute_force(spark):
    rng = random.Random(4)
    prose = lambda k: "".join(rng.choice(["a", "B", "c", "dé"]) + rng.choice([" ", " ", "\n", ", ", "--"]) for _ in range(k))
    items = [prose(rng.randint(1, 9)) for _ in range(25)] + [None, "", "!!"]
    texts = [prose(rng.randint(0, 60)) for _ in range(80)] + ["  " + prose(9), "A", None, "", "?!", items[0], items[1] + items[2]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, cuts string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for n in (4, 5):
        for most in (50_000, 2):
            got = {r.doc_id: r for r in decontaminate.remove_spans(docs, bench, n, max_set=most).collect()}
            assert len(got) == len(texts) and all(r.cuts == "x" for r in got.values())
            for i, t in enumerate(texts):
                assert got[i].text == cut(t, items, n), (n, most, t)


def test_many_hits_in_one_text(spark):
    item = " ".join(f"item{k}" for k in range(10))
    text = " ".join(f"{item} own{k}, " for k in range(5000))
    docs = spark.createDataFrame([(1, text), (2, "clean text")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    begun = time.time()
    got = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench).collect()}
    assert time.time() - begun < 10
    assert WORD.findall(got[1]) == [f"own{k}" for k in range(5000)] and got[2] == "clean text"
