import hashlib
import random

from rivulet.llm import fill_middle
from tests.compare import compare, connect


def expected(doc_id, text):
    text = text or ""
    n = len(text)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    spm = h4 % 100 < 20
    return doc_id, n, "spm" if spm else "psm", a, b - a, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def rows():
    rng = random.Random(1)
    some = "ab é日𝒳<PSM>\n"
    out = [(i, "".join(rng.choice(some) for _ in range(rng.randrange(40)))) for i in range(300)]
    return out + [(400, None), (401, ""), (402, "<"), (403, "x<P>y"), (404, "<S"), (405, "a" * 200_000 + "𝒳" * 1000), (None, "no id"), (None, None), (5, "again"), (5, "again"), (-7, "minus")]


def test_outputs_and_exact_round_trip(spark):
    data = [(*r, "x", 1) for r in rows()]
    docs = spark.createDataFrame(data, "doc_id long, text string, output string, n int").repartition(3)
    got = fill_middle.restore(fill_middle.transform(docs)).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((expected(*r) for r in rows()), key=str)
    assert sorted((r.restored for r in got)) == sorted(t or "" for _, t in rows())
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.restore(fill_middle.transform(docs.limit(0))).collect() == []


def test_rotation():
    for i, j, k in [(0, 0, 0), (0, 3, 7), (1, 1, 5), (2, 7, 7), (0, 4, 8)]:
        buf = bytearray(b"abcdefgh")
        fill_middle.rotate(buf, i, j, k)
        text = b"abcdefgh"
        assert bytes(buf) == text[:i] + text[j:k] + text[i:j] + text[k:]


def test_sql_twin(spark, tmp_path):
    from rivulet.llm.queries import ORACLE, QUERIES

    spark.createDataFrame(rows(), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = connect(str(tmp_path))
    con.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert compare(spark, con, str(tmp_path), "op13", QUERIES["op13_fill_in_middle"], ORACLE["op13_fill_in_middle"])[0] == "ok"
