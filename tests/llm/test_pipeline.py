import random

import corpus_pipeline
from rivulet.llm import quality
from tests.llm.test_near_dup import brute as brute_links
from tests.llm.test_repeats import brute as brute_repeats
from tests.llm.test_sql_operators import brute_report, wordlist
from tests.llm.test_text_operators import base


def corpus():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdeghilmnorstuü") for _ in range(rng.randint(2, 9)))
    line = lambda: " ".join(word() for _ in range(rng.randint(6, 14))).capitalize() + "."
    passages = [" ".join(line() for _ in range(6)) for _ in range(3)]
    bench = [(i, line() + " " + line()) for i in range(6)]
    docs = []
    for i in range(60):
        lines = [line() for _ in range(rng.randint(4, 14))]
        if i % 5 == 0:
            lines.insert(1, passages[i % 3])
        if i % 7 == 0:
            lines.insert(2, bench[i % 6][1])
        if i % 4 == 0:
            lines.insert(0, "Home | News | More | About")
        docs.append((i, "\n".join(lines)))
    for i in range(12):
        w = docs[i * 2][1].split(" ")
        w[rng.randrange(len(w))] = "changed"
        docs.append((100 + i, " ".join(w)))
    docs += [(200 + i, docs[3][1]) for i in range(8)] + [(300, None), (301, ""), (302, "short."), (303, "x%%% y### " * 80)]
    return docs, bench


def test_stages_against_brute_force(spark, tmp_path):
    docs, bench = corpus()
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = []
    for i, t in docs:
        n, *_, failed = base(t)
        _, lost, clean = quality._clean((t or "").encode(), 12)
        if not failed and lost <= 0.5 * n:
            rows.append((i, clean.decode()))
    wanted = [sorted(rows)]
    rows = sorted((i, dict(rows)[i]) for i, _, c, k in brute_links(rows, 5) if k)
    wanted.append(rows)
    removed = {i: n for i, _, n, _, _ in brute_repeats(rows)}
    frame, given = spark.read.parquet(str(tmp_path / "documents.parquet")), None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        given, frame = frame, spark.read.parquet(str(tmp_path / name))
        got = {r.doc_id: r for r in frame.collect()}
        if k < 4:
            assert frame.columns == given.columns
            assert all(r.n_chars == len(r.text) for r in got.values())
        if k < 2:
            assert sorted((r.doc_id, r.text) for r in got.values()) == wanted[k]
        if k == 2:
            assert set(got) == {i for i, _ in rows} and any(removed.values())
            for i, t in rows:  # what is left of cut characters goes too
                assert 0 <= len(t.encode()) - removed[i] - len(got[i].text.encode()) <= 3 * removed[i]
                assert removed[i] or got[i].text == t
            texts = {i: r.text for i, r in got.items()}
        if k == 3:
            hits = {i: h for i, _, h, *_ in brute_report(sorted(texts.items()), bench)}
            assert any(hits.values())
            for i, t in texts.items():
                assert len(wordlist(got[i].text)) == len(wordlist(t)) - hits[i]
        if k == 4:
            assert set(got) == set(texts)
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == len(texts)
