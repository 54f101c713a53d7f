import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import decontaminate, licences, mixing, toxicity

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def wordlist(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def brute_report(docs, bench, n=10):
    out = []
    items = [(i, wordlist(t)) for i, t in bench]
    for doc, text in docs:
        w, hit, found = wordlist(text), set(), set()
        for i, v in items:
            size = min(n, len(v))
            grams = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)} if v else set()
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in grams:
                    hit.update(range(k, k + size))
                    found.add(i)
        ids = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((doc, len(w), len(hit), len([i for i in found if i is not None]), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def leaks():
    rng = random.Random(2)
    word = lambda: rng.choice(["the", "Of", "é", "x1", "Straße", "B", "日本"])
    some = lambda n: " ".join(word() + rng.choice(["", ",", " -"]) for _ in range(n))
    bench = [(i, some(rng.randint(9, 30))) for i in range(10)] + [(10, "Zeta, eta!"), (11, None), (12, ""), (13, "zeta eta"), (14, " ".join(f"w{k}" for k in range(40)))]
    docs = [(i, some(rng.randint(0, 60)) + rng.choice(["", " " + rng.choice(bench)[1] if rng.random() < 2 and bench[0][1] else ""]) if i % 3 else some(20)) for i in range(5)]
    docs += [(10 + i, some(12) + ". " + (bench[i][1] or "") + "; " + some(8)) for i in range(14)] + [(40, None), (41, ""), (42, "..."), (None, "zeta eta"), (43, "a zeta\teta b zeta eta"), (43, "a zeta\teta b zeta eta"), (44, "w5 " * 3000), (45, " ".join(f"w{k}" for k in range(3, 30)))]
    return docs, bench


@pytest.mark.parametrize("max_set", [50_000, 3])
def test_decontamination(spark, max_set):
    docs, bench = leaks()
    d = spark.createDataFrame([(*r, 1, "g") for r in docs], "doc_id long, text string, n_words int, gram string").repartition(3)
    b = spark.createDataFrame([(*r, 2) for r in bench], "item_id long, text string, doc_id int")
    got = decontaminate.report(d, b, max_set=max_set).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_report(docs, bench)
    cut = decontaminate.remove_spans(d, b, max_set=max_set)
    assert cut.columns == d.columns
    before = {(r[0], r[1]): r for r in brute_report(docs, bench)}
    for r in cut.collect():
        if r.doc_id is not None:
            text = dict(docs)[r.doc_id]
            row = before[(r.doc_id, len(wordlist(text)))]
            assert len(wordlist(r.text)) == row[1] - row[2]
            assert row[5] or r.text == text
    assert decontaminate.remove_documents(d, b, max_set=max_set).count() == sum(not r[5] for r in brute_report(docs, bench))
    assert decontaminate.report(d, b.limit(0), max_set=max_set).where("contaminated").count() == 0
    assert decontaminate.report(d.limit(0), b, max_set=max_set).count() == 0


def test_licences(spark):
    s = licences.SENTENCES
    mit = f"MIT License\n\n{s['mit-grant'].capitalize()}: \n{s['mit-copies'].upper()}.\n\nfoo. {s['as-is']}."
    bsd = ". ".join(s[k] for k in ("bsd-use", "bsd-source", "bsd-binary"))
    rows = [(1, "Prose here. Released under the MIT License.\nMore."), (2, mit), (3, bsd + "."), (4, bsd + ".\n" + s["bsd-names"]), (5, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."), (6, "the license of life"), (7, None), (8, ""), (None, "SPDX-License-Identifier: MIT"), (9, "This was released under the MIT License once."), (9, "x " * 9000 + ". Released under the MIT license!"), (9, "x " * 9000 + ". Released under the MIT license!"), (10, s["bsd-binary"] + ". " + s["bsd-use"])]
    got = licences.scan_licences(spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, licence string")).collect()
    assert len(got) == len(rows)
    named = {r.doc_id: (r.licence, r.n_known) for r in got if r.doc_id != 9}
    assert named == {1: ("MIT", 1), 2: ("MIT", 3), 3: ("BSD-2-Clause", 3), 4: ("BSD-3-Clause", 4), 5: ("CC-BY-NC-4.0", 2), 6: (None, 0), 7: (None, 0), 8: (None, 0), None: ("MIT", 1), 10: (None, 2)}
    assert sorted(str(r.licence) for r in got if r.doc_id == 9) == ["MIT", "MIT", "None"]
    assert {r.licences for r in got if r.doc_id == 5} == {"CC-BY-NC-4.0,Apache-2.0"}
    assert all(any(m in x for m in licences.MARKS) for x in s.values())
    assert {i for _, rule in licences.RULES for i in rule} == set(s) and all(re.fullmatch("[a-z0-9 ]+", x) for x in s.values())


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
(b) Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
* Neither the name of the copyright holder nor the names of its
  contributors may be used to endorse or promote products derived from
  this software without specific prior written permission."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the"""
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'


@pytest.mark.parametrize("leader", ["", " * ", "# ", "// ", ";; ", "dnl "])
def test_wrapped_licences(spark, leader):
    cover = lambda t: "".join(f"{leader}{x}".rstrip() + end for x in t.split("\n") for end in ["\r\n" if leader == "# " else "\n"])
    rows = [(1, MIT), (2, BSD), (3, ISC), (4, GPL), (5, APACHE), (6, "This is free and unencumbered software released into the public\ndomain."), (7, "It was\nreleased under the MIT\n\nlicense."), (8, "A title\nReleased under the\nMIT License")]
    got = licences.scan_licences(spark.createDataFrame([(i, cover(t)) for i, t in rows], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.licence, r.sentence_ids) for r in got} == {
        1: ("MIT", "mit-grant mit-copies as-is"), 2: ("BSD-3-Clause", "bsd-use bsd-source bsd-binary bsd-names"), 3: ("ISC", "isc-grant"), 4: ("GPL-3.0-or-later", "gpl-free gpl-hope"),
        5: ("Apache-2.0", "apache-head apache-use"), 6: ("Unlicense", "unlicense"), 7: (None, ""), 8: ("MIT", "mit-notice"),
    }


def test_mixture_without_budget(spark):
    rng = random.Random(1)
    rows = [(i, "abcd"[min(3, int(rng.expovariate(1.2)))], "w " * rng.randint(0, 30)) for i in range(900)]
    rows += [(1000 + i, None, "x y z") for i in range(5)] + [(2000, "void", ""), (2001, "void", None), (None, "a", "q r"), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, source string, text string, n_tokens int").repartition(5)
    got = mixing.mix_sources(docs, target_entropy=0.9, max_repeats=500.0).collect()
    tokens, count = {}, {}
    for _, s, t in rows:
        tokens[s] = tokens.get(s, 0) + len((t or "").split())
        count[s] = count.get(s, 0) + 1
    real = {s: n for s, n in tokens.items() if n}
    total = sum(real.values())
    shares = np.array(list(real.values())) / total

    def entropy(a):
        w = shares**a / (shares**a).sum()
        return -(w * np.log(w)).sum()

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(mid) >= 0.9 * math.log(len(real)) else (low, mid)
    weights = dict(zip(real, shares**low / (shares**low).sum(), strict=True))
    for r in got:
        assert abs(r.weight - weights.get(r.source, 0)) < 1e-6
    least = min(weights[s] / real[s] for s in real)
    for s in tokens:
        mine = [r for r in got if r.source == s]
        first = [r for r in mine if r["pass"] == 1]
        assert len(first) == count[s]
        assert sorted(r.position for r in mine) == list(range(len(mine)))
        if s in real:
            wanted = weights[s] / least
            assert wanted - 1 <= sum(r.n_tokens for r in mine) <= wanted + 31
            assert [r["pass"] for r in sorted(mine, key=lambda r: r.position)] == sorted(r["pass"] for r in mine)
    orders = [[r.doc_id for r in sorted(got, key=lambda r: r.position) if r.source == "d" and r["pass"] == k] for k in (1, 2)]
    assert orders[0] != orders[1] and set(orders[1]) <= set(orders[0])
    limited = mixing.mix_sources(docs, target_entropy=1.0, max_repeats=3.0).agg(F.max("pass")).head()[0]
    assert limited == 3


def test_mixture_with_budget(spark):
    rows = [(i, "big" if i % 4 else "small", "w " * 10) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix_sources(docs, budget=2000, target_entropy=1.0)
    sums = {r.source: r.n for r in got.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    assert sums == {"big": 1000, "small": 1000}
    half = [r.source for r in got.orderBy("at").limit(100).collect()]
    assert 40 <= half.count("big") <= 60
    assert mixing.mix_sources(docs.limit(0)).collect() == []


def test_severity_on_held_out_rows(spark):
    rng = random.Random(4)
    bad = ["vile", "Foul,", "rotten"]
    rows, labels = [], []
    for i in range(1200):
        n, k = rng.randint(5, 120), rng.choice([0, 0, 1, 4])
        w = [f"w{int(rng.paretovariate(0.5)) % 300}" for _ in range(n)]
        for _ in range(k):
            w[rng.randrange(n)] = rng.choice(bad)
        k = sum(x in bad for x in w)
        rows.append((i, " ".join(w), 8))
        labels.append((i, 1, int(k > 0)))
    rows += [(5000, None, 8), (5001, "", 8), (None, "vile", 8), (5002, "Vile rotten", 8), (5002, "Vile rotten", 8), (5003, "w1 " * 20000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    known = spark.createDataFrame([r for r in labels if r[0] % 2] + [(None, 1, 1), (7, 1, None), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, known)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 2
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows)
    flag = {r.doc_id: r.toxic for r in got}
    held = [(flag[i], bool(t)) for i, _, t in labels if i % 2 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert flag[None] and flag[5002] and not flag[5000] and not flag[5001] and not flag[5003]
    few = np.mean([r.severity for r in got if r.doc_id in {i for i, t, _ in rows[:1200] if 1 == sum(x in t.split() for x in bad)}])
    more = np.mean([r.severity for r in got if r.doc_id in {i for i, t, _ in rows[:1200] if 3 == sum(x in t.split() for x in bad)}])
    assert few < more
    assert toxicity.score(docs, toxicity.fit(docs, known.limit(0))).where("toxic").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0
