"""Registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from sqlscore.llm.bpe import bpe_encode
from sqlscore.llm.collocations import collocations
from sqlscore.llm.decontaminate import decontaminate
from sqlscore.llm.exact_dedup import exact_dedup
from sqlscore.llm.langid import language_id
from sqlscore.llm.lexical_search import lexical_search
from sqlscore.llm.line_dedup import BLOCK, HIDDEN, HOST, TAG, host_of, html_lines, line_dedup
from sqlscore.llm.mixing import pfair_mix
from sqlscore.llm.settings import MIX_BLOCK_ROWS, MIX_PARTS, MIX_REST_PARTS, N_SHARDS, toxicity_categories
from sqlscore.llm.sharding import shard_by_bytes
from sqlscore.llm.simhash import simhash_dedup
from sqlscore.llm.suffix_dedup import suffix_dedup
from sqlscore.llm.toxicity import toxicity_chain
from sqlscore.llm.warc import read_archive, write_archive
from sqlscore.session import scratch_path
from sqlscore.sources.tables import load


def held_out():
    """Fold rule of language identification: crc32 of the identifier's text, modulo 5."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    return language_id(docs, may_learn=~held_out()).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity_chain(load(spark, sf, "documents"), load(spark, sf, "labels"), toxicity_categories())


def op3_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash_dedup(load(spark, sf, "documents"))


def op4_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate(load(spark, sf, "documents"), load(spark, sf, "benchmark"))


def op5_warc(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archive(load(spark, sf, "pages"), path)
    return read_archive(spark, path).select(
        F.col("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        "payload_digest", "record_type", "refers_to")


def op6_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "source")
    mixed = pfair_mix(docs, MIX_PARTS, rest_parts=MIX_REST_PARTS, block_rows=MIX_BLOCK_ROWS)
    return mixed.select("row.doc_id", "row.source", "block", "slot", "place")


def op8_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    pages = load(spark, sf, "pages")
    return line_dedup(pages, "page_id", host_of(F.col("url")), html_lines(F.col("html")))


def op7_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return shard_by_bytes(load(spark, sf, "documents"), n_shards=N_SHARDS)


def op9_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = suffix_dedup(load(spark, sf, "documents"), length=400)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
                      (F.size("spans") > 0).alias("removed"), F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"))


def op10_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup(load(spark, sf, "documents"))


def op11_bpe(spark: SparkSession, sf: str) -> DataFrame:
    tokens = bpe_encode(load(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), decode=True)
    return tokens.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations(load(spark, sf, "documents"))


def op13_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical_search(load(spark, sf, "documents"), load(spark, sf, "benchmark"))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)


LLM_QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_simhash": op3_simhash,
    "op4_decontaminate": op4_decontaminate,
    "op5_warc": op5_warc,
    "op6_mixing": op6_mixing,
    "op7_sharding": op7_sharding,
    "op8_line_dedup": op8_line_dedup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_bpe": op11_bpe,
    "op12_collocations": op12_collocations,
    "op13_lexical_search": op13_lexical_search,
    "pipeline": pipeline,
}

LLM_ORACLE = {
    # all item-sized windows that start at a shingle of the item, without fingerprints
    "op4_decontaminate": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
             b AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
             d AS (SELECT doc_id, len(w) - 4 AS n, unnest(range(len(w) - 4)) AS p, w FROM w WHERE len(w) >= 5),
             ds AS (SELECT doc_id, n, p, array_to_string(list_slice(w, p + 1, p + 5), ' ') AS s FROM d),
             i AS (SELECT item_id, len(w) - 4 AS m, unnest(range(len(w) - 4)) AS p, w FROM b WHERE len(w) >= 5),
             its AS (SELECT item_id, m, array_to_string(list_slice(w, p + 1, p + 5), ' ') AS s, count(*) AS k
                     FROM i GROUP BY ALL),
             hit AS (SELECT DISTINCT doc_id, n, p, item_id, m, s, k FROM ds JOIN its USING (s)),
             held AS (SELECT a.doc_id, a.item_id, a.p AS start, a.m, least(a.m, a.n - a.p) AS size, h.s, h.k,
                             count(*) AS c
                      FROM hit a JOIN hit h ON a.doc_id = h.doc_id AND a.item_id = h.item_id
                       AND h.p >= a.p AND h.p < a.p + a.m GROUP BY ALL),
             win AS (SELECT doc_id, item_id, start, m, size, sum(least(c, k)) AS common FROM held GROUP BY ALL),
             sim AS (SELECT doc_id, item_id, start, CAST(common AS DOUBLE) / (m + size - common) AS similarity FROM win)
        SELECT doc_id, item_id, max(similarity) AS similarity,
               CAST(min_by(start, (-similarity, start)) AS INTEGER) AS start_word
        FROM sim WHERE similarity >= 0.8 GROUP BY doc_id, item_id""",
    "op5_warc": r"""
        WITH t AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
             h AS (SELECT page_id, p, strlen(p) AS payload_bytes, sha1(p) AS s FROM t),
             b AS (SELECT page_id, p, payload_bytes, array_to_string(list_transform(range(32), lambda i:
                     substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
                       (CAST('0x' || substr(s, 1 + 5 * (i // 4), 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31
                       AS INTEGER), 1)), '') AS payload_digest FROM h),
             g AS (SELECT p, min(page_id) AS first FROM t GROUP BY p)
        SELECT b.page_id, b.payload_bytes, b.payload_digest,
               CASE WHEN b.page_id = g.first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN b.page_id = g.first THEN NULL ELSE g.first END AS refers_to
        FROM b JOIN g USING (p)""",
    "op8_line_dedup": rf"""
        WITH raw AS (SELECT page_id, nullif(lower(regexp_extract(url, '{HOST}', 1)), '') AS host,
                            regexp_replace(regexp_replace(regexp_replace(html, '{HIDDEN}', ' ', 'g'),
                              '{BLOCK}', chr(10), 'g'), '{TAG}', '', 'g') AS t FROM pages),
             cut AS (SELECT page_id, host, list_filter(coalesce(string_split(trim(regexp_replace(regexp_replace(
                              t, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' '), chr(10)), []),
                              lambda x: x <> '') AS lines FROM raw),
             seen AS (SELECT page_id, host, unnest(list_distinct(lines)) AS line FROM cut WHERE host IS NOT NULL),
             totals AS (SELECT host, count(*) AS pages FROM cut GROUP BY host),
             often AS (SELECT host, line, count(*) AS n FROM seen GROUP BY host, line),
             boiler AS (SELECT o.host, list(o.line) AS boiler FROM often o JOIN totals USING (host)
                        WHERE o.n >= 2 AND o.n / totals.pages > 0.3 GROUP BY o.host),
             kept AS (SELECT page_id, cut.host, lines, list_filter(lines,
                        lambda x: NOT list_contains(coalesce(boiler, []), x)) AS kept
                      FROM cut LEFT JOIN boiler ON cut.host = boiler.host)
        SELECT page_id, host, len(lines) AS n_lines, len(lines) - len(kept) AS n_dropped,
               array_to_string(kept, chr(10)) AS text FROM kept""",
    # every string of 400 bytes by its MD5
    "op9_suffix_dedup": r"""
        WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
             w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 399)) AS i FROM t)),
             r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
             s AS (SELECT doc_id, i, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM (
                     SELECT doc_id, i, CAST(i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -401) + 400 AS INTEGER) AS starts FROM r)),
             c AS (SELECT doc_id, span, min(i) AS lo, max(i) + 400 AS hi FROM s GROUP BY doc_id, span),
             p AS (SELECT doc_id, lo AS upto, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since FROM (
                     SELECT doc_id, lo, hi FROM c UNION ALL SELECT doc_id, n, n FROM t)),
             k AS (SELECT p.doc_id, string_agg(substr(h, 2 * since + 1, 2 * (upto - since)), '' ORDER BY since, upto) AS kept FROM p JOIN t USING (doc_id) GROUP BY p.doc_id),
             m AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed FROM c GROUP BY doc_id)
        SELECT t.doc_id, t.n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(kept)) AS kept_sha256, coalesce(n_spans, 0) > 0 AS removed, decode(unhex(kept)) AS kept_text
        FROM t JOIN k USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op10_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h
                   FROM documents),
             g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY h)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.h AS text_sha256
        FROM t JOIN g USING (h)""",
    "op12_collocations": r"""
        WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
             w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
             g AS (SELECT lang, list_slice(w, i, i + k - 1) AS g
                   FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
                         FROM (SELECT lang, w, unnest(range(1, 6)) AS k FROM w))),
             f AS (SELECT lang, g, count(*) AS f FROM g GROUP BY lang, g),
             t AS (SELECT lang, sum(f) AS n FROM f WHERE len(g) = 1 GROUP BY lang),
             c AS (SELECT lang, g, f AS a FROM f WHERE len(g) > 1 AND f >= 100),
             x AS (SELECT lang, g, max(a) AS longer FROM (
                     SELECT lang, g[1:len(g) - 1] AS g, a FROM c UNION ALL SELECT lang, g[2:len(g)], a FROM c) GROUP BY lang, g),
             k AS (SELECT c.lang, c.g, c.a, unnest(range(1, len(c.g))) AS k FROM c LEFT JOIN x ON c.lang = x.lang AND c.g = x.g
                   WHERE x.longer IS NULL OR 100 * x.longer < 100 * c.a),
             s AS (SELECT k.lang, k.g, k.a, k.k, fl.f AS l, fr.f AS r, CAST(t.n AS BIGINT) AS n,
                          CAST((1000::HUGEINT * k.a * t.n) // (fl.f::HUGEINT * fr.f) AS BIGINT) AS score
                   FROM k JOIN t ON k.lang = t.lang
                   JOIN f fl ON fl.lang = k.lang AND fl.g = k.g[1:k.k]
                   JOIN f fr ON fr.lang = k.lang AND fr.g = k.g[k.k + 1:len(k.g)]),
             m AS (SELECT lang, array_to_string(g, ' ') AS phrase, any_value(a) AS a, min_by(l, (score, k)) AS l, min_by(r, (score, k)) AS r,
                          any_value(n) AS n, min(score) AS score FROM s GROUP BY lang, g),
             o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
                          phrase, a, l, r, n, score FROM m)
        SELECT * FROM o WHERE rank <= 2000""",
    "op13_lexical_search": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
             b AS (SELECT item_id, row_number() OVER () AS i, regexp_extract_all(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
             total AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
             m AS (SELECT d, doc_id, 100 - 25 + ((25 * len(w) * n_docs) // n_terms) AS m FROM d, total WHERE len(w) > 0),
             q AS (SELECT item_id, i, t, count(*) AS times FROM (SELECT item_id, i, unnest(w) AS t FROM b) GROUP BY ALL),
             tf AS (SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(w) AS t FROM d) GROUP BY d, t),
             wt AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
                    FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), total),
             s AS (SELECT q.item_id, q.i, m.doc_id, tf.d, CAST(sum(q.times * wt.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * m.m))) AS BIGINT) AS score
                   FROM q JOIN tf ON q.t = tf.t JOIN wt ON wt.t = q.t JOIN m ON m.d = tf.d GROUP BY ALL),
             r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
                   FROM s WHERE score > 0)
        SELECT * FROM r WHERE rank <= 20""",
}
