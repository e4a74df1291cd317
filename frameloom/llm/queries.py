"""One query for each operator, over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arc, bpe, chat, fingerprints, langid, line_dedup, minhash, packing, prefix_trie, quality, rangecoder, style_tree, whitening
from .common import materialize


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_neighbours(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rangecoder.token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_events(chat.as_events(own.union(more))))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out()))
    out = langid.identify(docs.select("doc_id", "text"), model, spans=False)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality.quality_report(table(spark, sf_dir, "documents"))
    return report.drop("rejected_by")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.extract_main_text(table(spark, sf_dir, "pages"))


def op7_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc.archive_round_trip(table(spark, sf_dir, "pages")).drop("url")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.placements(packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), digests=True)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(table(spark, sf_dir, "embeddings")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.positions(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(*prefix_trie.grafted(materialize(turns, "positions")))


QUALITY_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, i, row(w[i], w[i + 1], w[i + 2]) AS tri
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM c, (SELECT unnest([0, 1, 2]) AS d) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(x) - length(translate(x, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         length(x) - length(translate(x, '!', '')) AS bangs, length(x) - length(translate(x, '0123456789', '')) AS digits, len(lines) AS n_lines,
         len(list_filter(lines, lambda l: regexp_matches(l, '^[\x20\x09-\x0D]*[-*\x{2022}]'))) AS bullets,
         len(list_filter(lines, lambda l: regexp_matches(l, '([.][.][.]|\x{2026})[\x20\x09-\x0D]*$'))) AS cuts
  FROM t LEFT JOIN r ON t.doc_id = r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * n_words OR 100 * bangs > 30 * n_words
            OR word_chars > 15 * n_words OR word_chars < 2 * n_words OR 100 * n_dup_lines > 60 * n_lines
            OR 100 * digits > 30 * word_chars OR 100 * bullets > 90 * n_lines OR 100 * cuts > 30 * n_lines) AS kept
FROM m
"""

ARCHIVES_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, max(page_id) AS response FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.response IS NULL OR f.response = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.response <> p.page_id THEN f.response END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 1000
"""

LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
c AS (
  SELECT key, max(doc_id) AS owner FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT doc_id, line, pos, coalesce(c.owner <> l.doc_id, false) AS gone FROM l LEFT JOIN c ON l.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

TRIE_SQL = """
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) - 1 AS i, d, b
  FROM (SELECT conv_id, turn, strlen(coalesce(text, '')) AS b,
               sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d
        FROM conversations WHERE conv_id IS NOT NULL)),
crc_table(n, k, v) AS (SELECT * FROM (
  WITH RECURSIVE r(n, k, v) AS (
    SELECT range, 0, CAST(range AS BIGINT) FROM range(256)
    UNION ALL SELECT n, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, CAST(3988292384 AS BIGINT)) ELSE v // 2 END FROM r WHERE k < 8)
  SELECT n, k, v FROM r WHERE k = 8)),
hash(c, i, v) AS (SELECT * FROM (
  WITH RECURSIVE r(c, i, v) AS (
    SELECT DISTINCT c, 0, CAST(4294967295 AS BIGINT) FROM t
    UNION ALL
    SELECT r.c, r.i + 1, xor(r.v // 256, x.v)
    FROM r JOIN crc_table x ON x.n = xor(r.v % 256, ascii(substr(CAST(r.c AS VARCHAR), r.i + 1, 1)))
    WHERE r.i < length(CAST(r.c AS VARCHAR)))
  SELECT c, i, v FROM r WHERE i = length(CAST(c AS VARCHAR)))),
n AS (SELECT c, count(*) AS n FROM t GROUP BY c),
k AS (SELECT n.c, n.n, hash.c - hash.c % 5 AS base, xor(hash.v, CAST(4294967295 AS BIGINT)) % 9 AS h FROM n JOIN hash ON n.c = hash.c),
kb AS (SELECT k.*, least(k.h, coalesce(n.n, 0)) AS head FROM k LEFT JOIN n ON n.c = k.base),
rows AS (
  SELECT kb.c, t.i + 1 AS depth, t.d, t.b FROM kb JOIN t ON t.c = kb.base WHERE t.i < kb.h
  UNION ALL SELECT kb.c, t.i - kb.h + kb.head + 1, t.d, t.b FROM kb JOIN t ON t.c = kb.c WHERE t.i >= kb.h),
p AS (
  SELECT c, depth, b, sha256(string_agg(d, ',') OVER (PARTITION BY c ORDER BY depth)) AS p FROM rows
  UNION ALL SELECT c, 0, 0, '' FROM kb),
l AS (SELECT c, max(depth) AS len FROM p GROUP BY c),
nodes AS (
  SELECT p.depth, p.p, min(p.c) AS o, count(*) AS n, any_value(p.b) AS b,
         sha256(coalesce(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (l.len = p.depth), '')) AS e
  FROM p JOIN l ON l.c = p.c GROUP BY p.depth, p.p),
up AS (
  SELECT m.depth, m.p, m.o, m.n, m.b, m.e, q.o AS parent
  FROM nodes m LEFT JOIN p a ON a.c = m.o AND a.depth = m.depth - 1 LEFT JOIN nodes q ON q.depth = a.depth AND q.p = a.p),
kids AS (SELECT parent, depth - 1 AS depth, count(*) AS k FROM up WHERE depth > 0 GROUP BY ALL),
sums AS (
  SELECT a.depth, a.p, sum((m.n - 1) * m.b) AS saved, count(*) FILTER (kids.k IS NULL) AS leaves
  FROM nodes m LEFT JOIN kids ON kids.parent = m.o AND kids.depth = m.depth JOIN p a ON a.c = m.o AND a.depth <= m.depth
  GROUP BY a.depth, a.p)
SELECT up.o AS conv_id, CAST(up.depth AS BIGINT) AS depth, up.parent AS parent_conv_id, up.n AS n_convs,
       CAST(coalesce(kids.k, 0) AS BIGINT) AS n_children, CAST(sums.leaves AS BIGINT) AS n_leaves,
       CAST(sums.saved AS BIGINT) AS saved_tokens, up.e AS ends_sha256
FROM up JOIN sums ON sums.depth = up.depth AND sums.p = up.p LEFT JOIN kids ON kids.parent = up.o AND kids.depth = up.depth
"""

QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_token_files, op3_chat, op4_language, op5_quality, op6_main_text, op7_archives, op8_packing, op9_near_duplicates, op10_bpe, op11_line_dedup, op12_whitening, op13_prefix_trie)}
ORACLE_SQL = {"op5_quality": QUALITY_SQL, "op7_archives": ARCHIVES_SQL, "op11_line_dedup": LINES_SQL, "op13_prefix_trie": TRIE_SQL}
