"""Registered queries of the training-data operators, over whole tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import decontaminate, divergence, fill_middle, language_model, licences, mixing, near_dup, piece_codec, quality, repeats, token_counts, toxicity, warc


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_temperature_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, folder, "documents"))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, folder, "labels")))


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.clean_lines(_table(spark, folder, "documents").select("doc_id", "text")).drop("text", "clean_text")


def op4_suffix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, folder, "documents"), keep_bytes=False).drop("kept")


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(_table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.link_components(_table(spark, folder, "documents"), words_per_shingle=2)


def op7_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan_licences(_table(spark, folder, "documents"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.report(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op9_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.score_texts(_table(spark, folder, "documents"))


def op10_warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(_table(spark, folder, "pages")).drop("payload", "url")


def op11_sentencepiece_codec(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = piece_codec.encode(_table(spark, folder, "documents"), path, decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(_table(spark, folder, "documents"))


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    rows = fill_middle.restore(fill_middle.transform(_table(spark, folder, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_temperature_mixing, op2_toxicity, op3_quality_rules, op4_suffix_repeats, op5_token_counts, op6_near_duplicates, op7_licence_scan, op8_decontamination, op9_language_model, op10_warc_round_trip, op11_sentencepiece_codec, op12_source_divergence, op13_fill_in_middle)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_TERMS = _WORDS.replace(r"\x00-\x2F\x3A-\x60", r"\x00-\x40\x5B-\x60")

ORACLE = {
    "op7_licence_scan": licences.oracle(),
    "op8_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        g AS (
            SELECT DISTINCT item_id, size, array_to_string(w[p:p + size - 1], ' ') AS gram
            FROM (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)
        ),
        sizes AS (SELECT DISTINCT size FROM g),
        o AS (
            SELECT row_id, size, p, array_to_string(w[p:p + size - 1], ' ') AS gram
            FROM (SELECT row_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)
        ),
        h AS (SELECT o.row_id, o.p, o.size, g.item_id FROM o JOIN g USING (gram, size)),
        n AS (SELECT row_id, count(DISTINCT q) AS n_hit FROM (SELECT row_id, unnest(range(p, p + size)) AS q FROM h) GROUP BY 1),
        t AS (SELECT row_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (row_id) LEFT JOIN t USING (row_id)""",
    "op10_warc_round_trip": """
        WITH payloads AS (
            SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages
        ), firsts AS (
            SELECT payload_digest, min(page_id) AS first FROM payloads WHERE payload_bytes >= 100 GROUP BY 1
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > first THEN first END AS refers_to
        FROM payloads LEFT JOIN firsts USING (payload_digest)""",
    "op12_source_divergence": f"""
        WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        o AS (SELECT row_id, lang, source, unnest({_TERMS}) AS term FROM d),
        per AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row_id) AS docs FROM o GROUP BY ALL),
        kept AS MATERIALIZED (SELECT lang, term, sum(n)::HUGEINT AS lang_n FROM per GROUP BY ALL HAVING sum(docs) >= 30),
        v AS (SELECT lang, count(*) AS terms, sum(lang_n) AS lang_total FROM kept GROUP BY 1),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS MATERIALIZED (SELECT g.lang, g.source, k.term, k.lang_n, coalesce(per.n, 0)::HUGEINT AS n FROM g JOIN kept k USING (lang) LEFT JOIN per USING (lang, source, term)),
        t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
        s AS MATERIALIZED (
            SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * terms) AS p, 1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * terms) AS q
            FROM c JOIN t USING (lang, source) JOIN v USING (lang)
        ),
        far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
        over AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM s WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM over))
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50""",
    "op13_fill_in_middle": """
        WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
        d AS (SELECT doc_id, text, length(text)::BIGINT AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM h),
        f AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                   CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM d
        ),
        p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p""",
}
