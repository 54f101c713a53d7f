import hashlib
import random
import re

import public_tokenizers
import pytest
import sentencepiece

from rivulet.llm import quality, token_counts, warc

SPACES = b" \t\n\x0b\x0c\r"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", "a", "a\nb", "a \nb", " a", "a ", "a  b", "x y 　 z", "▁a b", "<s>a</s> <unk>", "a\tb\r\nc", "\0a", "é" * 300, "a\n\n b\n", "日本 語", "word " * 5000, "  \x1c x", "🙂 ok"]


def base(text):
    data = (text or "").encode()
    ws = re.findall(rb"[^\x20\x09-\x0D]+", data)
    lines = [x for x in data.split(b"\n") if re.search(rb"[^\x20\x09-\x0D]", x)]
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    many = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else set(grams)
    hit = {i + k for i, g in enumerate(grams) if g in many for k in range(3)}
    n = len(ws)
    return n, sum(len(w.decode()) for w in ws), sum(data.count(c.encode()) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def texts():
    rng = random.Random(3)
    some = ["the", "of", "ünd", "x#", "|", "end.", "a*b", "re d", "\n", "\n\n", "\t"]
    return [*ODD, *(" ".join(rng.choice(some) + rng.choice(["", str(rng.randint(0, 40))]) for _ in range(rng.randint(1, 300))) for _ in range(60))]


def test_quality_base_rules(spark):
    rows = [(i, t, "old") for i, t in enumerate(texts())] + [(None, "a b", None), (3, "a b", "old")]
    got = quality.clean_lines(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(r.text), r
        assert not (r.kept and r.base_failed)


def test_quality_lines(spark):
    body = "\n".join(" ".join(f"w{i}x{k}" for k in range(14)) + "." for i in range(9))
    menu, junk = "Home | News | Sport | About", "x### y*** z%%%"
    rows = [(1, body), (2, f"{menu}\n{body}\n{junk}\nSubscribe to our letter now."), (3, "\n".join([body.split("\n")[0]] + [f"{menu} {i}" for i in range(30)]))]
    got = {r.doc_id: r for r in quality.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[1].clean_text == body and got[1].n_lost_words == 0
    assert got[2].kept and got[2].clean_text == body
    assert not got[3].kept
    assert [quality.judge_line(x) for x in (menu.encode(), junk.encode(), b"Read more.", b"short line", b"It ends.")] == ["navigation", "symbols", "boilerplate", "punctuation", None]


def test_furniture_in_running_text():
    for line in ("The design in this house is old.", "A design upgrade.", "It was spread more evenly.", "She sells cookies and tea on Sundays with her old friends.", "word " * 4000 + "javascript and cookies and subscribe.", "They sign up to read more about it when the long day is over."):
        assert quality.judge_line(line.encode()) is None, line[:60]
    for line in ("Read more.", "\u201cSubscribe\u201d to our letter now.", "Please click here.", "© 2024 Some Firm. All rights reserved.", "We use cookies."):
        assert quality.judge_line(line.encode()) == "boilerplate", line


def test_furniture_in_other_languages():
    for line in ("Alle Rechte vorbehalten.", "© 2024 Firma, siehe Impressum.", "Jetzt anmelden!", "Tous droits réservés.", "Lire la suite…", "Conditions d’utilisation.", "Todos los derechos reservados.", "Haz clic aquí.", "Suscríbete!"):
        assert quality.judge_line(line.encode()) == "boilerplate", line
    for line in ("Sie wollte am nächsten Tag noch mehr erfahren, als er ihr sagte.", "Il voulait en savoir plus sur la vie de son voisin.", "Quería saber más sobre la casa vieja de sus abuelos."):
        assert quality.judge_line(line.encode()) is None, line


def test_one_mention_in_a_text_on_one_line(spark):
    text = " ".join(f"w{k}" for k in range(300)) + " with cookies and a design in it."
    got = quality.clean_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).head()
    assert got.kept and got.n_lost_words == 0 and got.clean_text == text


def test_punctuation_on_paragraphs():
    prose = "\n\n".join("\n".join(" ".join(f"word{p}{i}{k}" for k in range(9)) for i in range(5)) + "." for p in range(3))
    verse = "The moon is on the water now,\nThe reeds are bending low,\nAnd no one hears the ferryman\nWho sang here long ago"
    things = "What it takes:\n\n- two eggs\n- flour\n- a cup of milk\n- a pinch of salt\n- butter and sugar"
    for text in (prose, verse, things):
        assert quality._clean(text.encode(), 12) == (0, 0, text.encode())
    assert quality._clean(prose.replace("\n", "\r\n").encode(), 12)[1] == 0
    body = " ".join(f"w{k}" for k in range(30)) + "."
    stack = "\n".join(["Home", "News", "Sport", "About us", "Contact", "Shop", "Jobs", "Press", "Help", "Log out", "Archive", "Letters", "Weather"])
    for junk in (stack, "A heading", f"{stack}\nIt ends."):
        assert quality._clean(f"{junk}\n{body}".encode(), 12)[2].decode().split("\n")[-1] == body
        assert quality._clean(f"{junk}\n{body}".encode(), 12)[1] == len(stack.split() if stack in junk else junk.split())


@pytest.mark.parametrize(("sample", "room"), [(1000, 100_000), (0, 50)])
def test_token_counts_equal_the_library(spark, sample, room):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(i, t, 5) for i, t in enumerate(texts())] + [(None, "a b", 5), (3, "a b", 5), (3, "a b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = token_counts.count_tokens(docs, MODEL, sample=sample, room=room).collect()
    wanted = sorted(((i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t, _ in rows), key=str)
    assert sorted((tuple(r) for r in got), key=str) == wanted
    assert any(r.over_limit for r in got)


def test_archive_round_trip(spark, tmp_path):
    rng = random.Random(9)
    big = "".join(rng.choice("añ🙂\r\n<b>WARC/1.1") for _ in range(40_000))
    rows = [(5, "u", big), (4, "v", big), (9, None, big + "x"), (1, "w", None), (2, "w", ""), (3, "w", "short"), (6, "w\r\nX: y", "short"), (7, "w", "y" * 100), (8, "w", "y" * 100), (8, "w", "y" * 100), (7, "w", "y" * 100), (None, "w", "y" * 100), (None, "w", "z" * 200), (None, "w", "z" * 200)]
    pages = spark.createDataFrame([(*r, "more") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path, segment_bytes=1000, records_per_file=7)
    got = warc.read_pages(spark, path).collect()
    first = {big: 4, "y" * 100: 7}
    wanted = []
    for i, _, t in rows:
        f = first.get(t)
        later = f is not None and (i is None or i > f)
        data = (t or "").encode()
        wanted.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if later else "response", f if later else None, None if later else data))
    assert sorted((tuple(r)[:5] + (None if r.payload is None else bytes(r.payload),) for r in got), key=str) == sorted(wanted, key=str)
    segments = warc.read_records(spark, path)
    assert segments.where("record_type = 'continuation'").count() > 40
    with pytest.raises(Exception, match="segments missing"):
        warc.reassemble(segments.where("segment is null or segment != 2")).collect()
    warc.write_archive(pages.limit(0), path + "-empty")
    assert warc.read_pages(spark, path + "-empty").collect() == []


def test_chunked_framing():
    data = bytes(range(256)) * 50
    assert warc.from_chunked(warc.to_chunked(data, 1000)) == data
    assert warc.from_chunked(b"3;x=1\r\nabc\r\n0\r\nA: b\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.from_chunked(b"5\r\nabc\r\n")


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality.clean_lines(docs).collect() == []
    assert token_counts.count_tokens(docs, MODEL).collect() == []
