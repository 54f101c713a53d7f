"""Line-first cleaning: rules judge lines, lines that fail go, documents that lose too much are rejected.

Lines are what "\\n" separates. A line without a word is neutral. Any other line fails if one of these holds:

* symbols: more than one of ``#*$%&|<>`` for every two words;
* navigation: two or more of ``| > » · •`` standing between words, and no end mark;
* boilerplate: it has fewer than ``open_words`` words, of which whole phrases of ``BOILERPLATE`` (lower-cased) make up a
  third, or a fifth if it opens with one; or it equals an earlier line of the text;
* punctuation: it has no end mark and fewer than ``open_words`` words, and its paragraph does not carry it.

A paragraph is a run of lines with words. It carries its open lines (wrapped prose, verse, lists) if it ends with an end mark or
has ``open_words`` words, none of its lines has twice as many (then lines are paragraphs themselves), and its open
lines have 4 words on average (menus have fewer) or a line that ends with ":" leads to it. Lines that fail by another rule are not counted in it.

A document is kept if the base rules pass (words, share of repeated 3-word windows) and its failed lines
hold at most ``max_loss`` of its words. Text is split and counted on bytes; words are runs without
ASCII white space. A null or empty text has no words, and so is rejected. Every row is judged alone, so
repeated rows get equal results; an empty table gives an empty result. Long texts are taken whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rivulet.llm.text import SPACE, flat, grams, mix, pieces, row_sums, whole, word_hash, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
# Phrases of page furniture, by language.
PHRASES = {
    "en": ("all rights reserved", "cookie policy", "cookies", "enable javascript", "javascript", "lorem ipsum", "privacy policy", "sign in", "sign up", "subscribe", "terms of service", "terms of use", "click here", "read more"),
    "de": ("alle rechte vorbehalten", "allgemeine geschäftsbedingungen", "cookie-einstellungen", "datenschutzerklärung", "hier klicken", "impressum", "jetzt anmelden", "jetzt registrieren", "mehr erfahren", "mehr lesen", "newsletter abonnieren", "nutzungsbedingungen", "siehe impressum", "weiterlesen"),
    "fr": ("activer javascript", "cliquez ici", "conditions d'utilisation", "conditions générales", "en savoir plus", "inscrivez-vous", "lire la suite", "mentions légales", "politique de confidentialité", "s'abonner", "s'inscrire", "se connecter", "tous droits réservés"),
    "es": ("activar javascript", "aviso legal", "condiciones de uso", "haga clic aquí", "haz clic aquí", "iniciar sesión", "leer más", "política de cookies", "política de privacidad", "regístrate", "saber más", "suscríbete", "términos y condiciones", "todos los derechos reservados"),
}
BOILERPLATE = tuple(phrase.encode() for phrases in PHRASES.values() for phrase in phrases)
_FURNITURE = re.compile(b"|".join(map(re.escape, BOILERPLATE)))
_PHRASE = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(x.decode()) for x in BOILERPLATE) + r")(?!\w)")
_MENU = re.compile(rb"[^\x20\x09-\x0D][\x20\x09]*(?:\||>|\xc2\xbb|\xc2\xb7|\xe2\x80\xa2)(?:[\x20\x09]|$)")
_END = tuple(x.encode() for x in ".!?:;\"')]}…。！？”’»")
_FIELDS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("n_lost_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("clean_text", "string")]


def _furniture(line: bytes, n: int) -> bool:
    """Whether whole phrases of page furniture make up a large part of a line of n words."""
    low = line.lower().replace("’".encode(), b"'")
    if not _FURNITURE.search(low):
        return False
    text = low.decode("utf-8", "replace")
    found = list(_PHRASE.finditer(text))
    size = sum(len(m[0].split()) for m in found)
    opens = bool(found) and not re.search(r"\w", text[: found[0].start()])
    return bool(found) and (3 * size >= n or opens and 5 * size >= n)


def _ended(line: bytes) -> bool:
    return line.rstrip(b" \t\r\x0b\x0c").endswith(_END)


def judge_line(line: bytes, open_words: int = 12) -> str | None:
    """The rule that a line with words fails, or None; punctuation as if the line were a paragraph."""
    n = len(line.split())
    if 2 * sum(map(line.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))) > n:
        return "symbols"
    ended = _ended(line)
    if not ended and len(_MENU.findall(line)) >= 2:
        return "navigation"
    if n < open_words and _furniture(line, n):
        return "boilerplate"
    return None if ended or n >= open_words else "punctuation"


def _carried(lines: list[bytes], open_lines: list[bytes], led: bool, open_words: int) -> bool:
    """Whether a paragraph of these lines carries its open ones; ``led``: the line before it ends with a colon."""
    sizes = [len(x.split()) for x in lines]
    led = led or lines[0].rstrip().endswith(b":")
    return max(sizes) < 2 * open_words and (_ended(lines[-1]) or sum(sizes) >= open_words) and (led or sum(len(x.split()) for x in open_lines) >= 4 * len(open_lines))


def _clean(text: bytes, open_words: int) -> tuple[int, int, bytes]:
    """Repeated lines, words in failed lines, the text without them."""
    lines = text.split(b"\n")
    seen, again, fails, paragraph, led = set(), 0, [False] * len(lines), [], False
    for i, line in enumerate([*lines, b""]):
        if line.strip():
            if line in seen:
                again += 1
                fails[i] = True
                continue
            seen.add(line)
            rule = judge_line(line, open_words)
            fails[i] = rule is not None
            if rule in (None, "punctuation"):
                paragraph.append(i)
        elif paragraph:
            is_open = [k for k in paragraph if fails[k]]
            if is_open and _carried([lines[k] for k in paragraph], [lines[k] for k in is_open], led, open_words):
                for k in is_open:
                    fails[k] = False
            led, paragraph = lines[paragraph[-1]].rstrip().endswith(b":"), []
    lost = sum(len(x.split()) for x, f in zip(lines, fails, strict=True) if f)
    return again, lost, b"\n".join(x for x, f in zip(lines, fails, strict=True) if not f)


def _counts(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    start, end, row = words(buf, offsets)
    size = len(offsets) - 1
    points = ((buf & 0xC0) != 0x80) & ~SPACE[buf]
    inside = whole(row, 3)
    key = (grams(word_hash(buf, start, end), row, 3) ^ mix(row[: len(inside)].astype(np.uint64) + np.uint64(7)))[inside]
    _, which, many = np.unique(key, return_inverse=True, return_counts=True)
    at = np.flatnonzero(inside)[many[which] >= 2]
    hit = np.zeros(len(row), bool)
    for k in range(3):
        hit[at + k] = True
    return np.bincount(row, minlength=size), row_sums(points, offsets), row_sums(SYMBOLS[buf], offsets), np.bincount(row[hit], minlength=size)


def clean_lines(docs: DataFrame, *, text: str = "text", open_words: int = 12, max_loss: float = 0.5, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """docs and the columns of ``_FIELDS``; clean_text is the text without its failed lines.

    Columns of docs with those names are replaced.
    """
    names = [n for n, _ in _FIELDS]
    docs = docs.select(*(f"`{c}`" for c in docs.columns if c not in names))
    kinds = {"long": T.LongType(), "boolean": T.BooleanType(), "string": T.StringType()}
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, kinds[k]) for n, k in _FIELDS)])

    def judged(batches):
        for table in pieces(batches, text):
            buf, offsets = flat(table.column(text))
            n, points, symbols, repeats = _counts(buf, offsets)
            raw = [buf[i:j].tobytes() for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            lines = [_clean(t, open_words) for t in raw]
            lost = np.array([x for _, x, _ in lines], np.int64)
            failed = (n < min_words) | (100 * repeats > max_repeat_percent * n)
            more = [n, points, symbols, [x for x, _, _ in lines], repeats, lost, failed, ~failed & (lost <= max_loss * n), [t.decode("utf-8", "replace") for _, _, t in lines]]
            types = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
            added = [pa.array(v, types[k]) for v, (_, k) in zip(more, _FIELDS, strict=True)]
            yield from pa.table([*table.columns, *added], names=[*table.column_names, *names]).to_batches()

    return docs.mapInArrow(judged, schema)
