"""Licence scans by sentences and rules, with DataFrame functions alone.

A sentence ends after end marks before white space, at a blank line and before a list marker; a line break
and a ";" may end one or stand inside one, so sentences are found on one line as well as hard-wrapped, also behind
comment leaders. A text is lower-cased and everything else but ASCII letters and digits becomes one space. Sentences
that are known become their identifiers, in the order of the text (of those that start at one place the longest), and
the rules, in their own order, look for their identifiers as a subsequence. The first rule that matches names the
licence, and all that match are listed. The SQL twin reads line by line and knows neither wrapped sentences nor ";".

The known sentences are a fixed list in this file. Each of them holds one of ``MARKS``; a text with
none of these, which are single words so that no line break parts them, is not cut at all. A null or empty text, or one without known sentences, has no licence (null) and
empty lists. Rows are judged one by one, whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.text import named

MARKS = ("licen", "redistribut", "warranty", "permission", "spdx", "unencumbered")
# Identifiers of sentences, normalised, as licences and their usual notices have them.
SENTENCES = {
    "mit-notice": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-copies": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-head": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-notice": "licensed under cc by 4 0",
    "cc-by-sa-notice": "licensed under cc by sa 4 0",
    "cc-by-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "bsd-use": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache": "spdx license identifier apache 2 0",
    "spdx-gpl3": "spdx license identifier gpl 3 0 or later",
}
# Rules in order, the first that matches names the licence; longer ones stand before what they hold.
RULES = [
    ("BSD-3-Clause", ["bsd-use", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-use", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-grant", "mit-copies"]),
    ("MIT", ["mit-grant", "as-is"]),
    ("ISC", ["isc-grant"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope"]),
    ("Apache-2.0", ["apache-head", "apache-use"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("GPL-3.0-or-later", ["spdx-gpl3"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-work"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-work"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-notice"]),
    ("CC-BY-4.0", ["cc-by-work"]),
    ("CC-BY-4.0", ["cc-by-notice"]),
    ("Apache-2.0", ["apache-notice"]),
    ("Apache-2.0", ["apache-head"]),
    ("Apache-2.0", ["spdx-apache"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["spdx-mit"]),
    ("Unlicense", ["unlicense"]),
]
# Replacements in their order, up to one "\n" for a possible end of a sentence and \x01 for a certain one.
MARKERS = r"(?:[0-9]{1,2}|[a-z]|[ivx]{2,4})[.)][\x20\x09]"
STEPS = (
    (r"(?md)^[^a-z0-9\n]+", ""),  # comment leaders, indents, bullets
    (r"(?md)^(?:dnl|rem)\b[^a-z0-9\n]*", ""),
    (rf"(?md)^{MARKERS}|[.!?]+[\x20\x09-\x0D]|\n(?=\n)", "\x01"),
    (";", "\n"),
    (r"[^a-z0-9\n\x01]+", " "),
    (r" ?\n[ \n]*", "\n"),
    (r"[ \n]?\x01[ \n\x01]*", "||"),
    (r"\n", "|"),
)
KNOWN = r"(?<=\|)(?:" + "|".join(s.replace(" ", "[ |]") for s in sorted(SENTENCES.values(), key=len, reverse=True)) + r")(?=\|)"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in its order."""
    low = F.lower(text)
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.contains(low, F.lit(mark))
    plain = F.concat(F.translate(low, "\x01", " "), F.lit("\n"))
    for old, new in STEPS:
        plain = F.regexp_replace(plain, F.lit(old), F.lit(new))
    known = F.regexp_extract_all(F.concat(F.lit("|"), plain), F.lit(KNOWN), F.lit(0))
    names = F.create_map(*(F.lit(x) for name, s in SENTENCES.items() for x in (s, name)))
    none = F.array().cast("array<string>")
    return F.coalesce(F.when(marked, F.transform(known, lambda s: F.element_at(names, F.translate(s, "|", " ")))), none)


def _pattern(ids: list[str]) -> str:
    """A subsequence of identifiers in a text like " a b c "."""
    return "( .*)? ".join(f" {i}" if k == 0 else i for k, i in enumerate(ids)) + " "


def scan_licences(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids (joined by spaces), n_known, licence, licences (distinct, in order of the rules, joined by commas)."""
    ids = named(docs, "doc_id", "text").select("doc_id", F.array_join(sentence_ids(F.col("text")), " ").alias("sentence_ids"))
    line = F.concat(F.lit(" "), F.col("sentence_ids"), F.lit(" "))
    each = F.array(*(F.when(F.regexp_like(line, F.lit(_pattern(rule))), F.lit(name)) for name, rule in RULES))
    all_of = F.when(F.col("sentence_ids") != "", F.array_distinct(F.array_compact(each))).otherwise(F.array().cast("array<string>"))
    count = F.when(F.col("sentence_ids") == "", 0).otherwise(F.size(F.split("sentence_ids", " ")))
    return ids.select("doc_id", "sentence_ids", count.cast("long").alias("n_known"), all_of.alias("found")).select("doc_id", "sentence_ids", "n_known", F.try_element_at("found", F.lit(1)).alias("licence"), F.array_join("found", ",").alias("licences"))


def oracle() -> str:
    """The same scan in SQL, from the same fixed values."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = "MAP {" + ", ".join(f"{quote(s)}: {quote(n)}" for n, s in SENTENCES.items()) + "}"
    rules = ", ".join(f"CASE WHEN regexp_matches(line, {quote(_pattern(r))}) THEN {quote(n)} END" for n, r in RULES)
    return f"""
        WITH cut AS (
            SELECT doc_id, list_transform(string_split_regex(lower(coalesce(text, '')), '[.!?]+[\\x20\\x09-\\x0D]+|[.!?]*\\n'), lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))) AS plain FROM documents
        ), ids AS (
            SELECT doc_id, array_to_string(list_filter(list_transform(plain, lambda s: map_extract({known}, s)[1]), lambda x: x IS NOT NULL), ' ') AS sentence_ids FROM cut
        ), lines AS (
            SELECT doc_id, coalesce(sentence_ids, '') AS sentence_ids, ' ' || coalesce(sentence_ids, '') || ' ' AS line FROM ids
        ), found AS (
            SELECT doc_id, sentence_ids, list_filter([{rules}], lambda x: x IS NOT NULL) AS every FROM lines
        )
        SELECT doc_id, sentence_ids,
               CASE WHEN sentence_ids = '' THEN 0 ELSE len(string_split(sentence_ids, ' ')) END::BIGINT AS n_known,
               every[1] AS licence,
               coalesce(array_to_string(list_transform(list_filter(list_zip(every, range(len(every))), lambda z: list_position(every, z[1]) = z[2] + 1), lambda z: z[1]), ','), '') AS licences
        FROM found"""
