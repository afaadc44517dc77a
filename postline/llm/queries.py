"""Queries of the training-data operators over the whole driver tables, and
their DuckDB statements where SQL expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postline.llm import brown, chat, decontam, hdlang, jaccard, license, pieces, quality, suffix, urlfilter, variants, wavelet, whitening
from postline.llm.textops import table


def tokenizer_path(name: str) -> str:
    """Where a vocabulary file of the public tokenizers is."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _remainder(n: int):
    """crc32 of the id as text, modulo n (null id: 0)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n, F.lit(0))


def op1_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(table(spark, sf_dir, "documents"), _remainder(5) != 1)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed URLs: those that a feed links to (``utm_source=feed``)."""
    pages = table(spark, sf_dir, "pages")
    feed = pages.where(F.col("url").contains("utm_source=feed")).select(urlfilter.canonical(F.col("url")))
    return urlfilter.judge(pages, feed)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.report(license.scan(table(spark, sf_dir, "documents")))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.report(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return hdlang.identify(docs.withColumn("held_out", _remainder(3) == 1), ~F.col("held_out"), keep=("held_out",))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit("\\### Assistant: </turn> ok").alias("text"))
    rows = rows.unionByName(fixed)
    records = rows.select("conv_id", "turn", F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    return chat.read_back(chat.format_turns(chat.canonical(records)))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op11_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_back(wavelet.write(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_brown_scores": op1_brown_scores,
    "op2_url_filter": op2_url_filter,
    "op3_license_scan": op3_license_scan,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_decontamination": op5_decontamination,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_language_id": op7_language_id,
    "op8_chat_format": op8_chat_format,
    "op9_quality_rules": op9_quality_rules,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_wavelet_shards": op11_wavelet_shards,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_embedding_whitening": op13_embedding_whitening,
}

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE = {
    "op2_url_filter": r"""
WITH parts AS (
  SELECT page_id, url, instr(url, '://') > 0 AS ok,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
         regexp_replace(regexp_replace(regexp_extract(url, '^.*?://[^?#]*\?([^#]*)', 1, 's'),
                        '(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&+|&+$', '', 'g') AS query
  FROM pages
), keyed AS (
  SELECT *, CASE WHEN ok THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '')
                              || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS key
  FROM parts
), judged AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/') THEN 'org/' END AS rule
  FROM keyed
), listed AS (
  SELECT DISTINCT key FROM keyed WHERE key IS NOT NULL AND contains(url, 'utm_source=feed')
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       rule IS NULL AND l.key IS NOT NULL AS listed
FROM judged LEFT JOIN listed l ON judged.key = l.key
""",
    "op5_decontamination": rf"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w
  FROM benchmark
), item_shingles AS (
  SELECT DISTINCT item_id, least(5, len(w)) AS width, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(5, len(w)) + 1)) AS i FROM item_words WHERE len(w) > 0)
), sizes AS (
  SELECT item_id, count(*) AS n FROM item_shingles GROUP BY item_id
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w
  FROM documents
), widths AS (
  SELECT DISTINCT width FROM item_shingles
), doc_shingles AS (
  SELECT DISTINCT doc_id, width, array_to_string(w[i:i + width - 1], ' ') AS s
  FROM (SELECT doc_id, width, w, unnest(generate_series(1, len(w) - width + 1)) AS i FROM doc_words, widths WHERE len(w) >= width)
), found AS (
  SELECT doc_id, item_id, count(*) AS n_found FROM doc_shingles JOIN item_shingles USING (width, s) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, n AS n_shingles, n_found, n_found / n AS containment
FROM found JOIN sizes USING (item_id) WHERE n_found / n >= 0.8 - 1e-9
""",
    "op8_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '<turn', '\<turn'), '</turn', '\</turn') AS body,
         replace(replace(replace(replace(role, '\', '\\'), '<turn', '\<turn'), '</turn', '\</turn'), '>', '\>') AS head
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(head) + length(body) + length('<turn ' || '>' || chr(10) || chr(10) || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
""",
    # near words: equal to the other without one code point, or equal without the code point at the same place
    "op12_spelling_variants": r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) AS t(i))
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents
), folded AS (
  SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM runs WHERE length(run) >= 5
), hashed AS (
  SELECT run, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(id || ':' || run, ''), lambda c:
                    CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(192 + (unicode(c) >> 6) AS BIGINT), 128 + (unicode(c) & 63)] END))),
                  lambda h, b: xor(h >> 8, crc[CAST(xor(h, b) & 255 AS INTEGER) + 1])), 4294967295) AS h
  FROM folded, crc_table
), words AS (
  SELECT word, count(*) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING count(*) >= 3
), shorter AS (
  SELECT word, i, word[1:i] || word[i + 2:] AS less FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS other FROM shorter a JOIN shorter b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT s.word, w.word FROM shorter s JOIN words w ON s.less = w.word
  UNION SELECT w.word, s.word FROM shorter s JOIN words w ON s.less = w.word
), best AS (
  SELECT p.word, count(*) AS n_near, arg_min(p.other, {'n': -o.n, 'w': p.other}) AS other, max(o.n) AS other_n
  FROM pairs p JOIN words o ON o.word = p.other GROUP BY p.word
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 2 * w.n THEN b.other END AS form,
         CASE WHEN b.other_n >= 2 * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)
), walk AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN walk w USING (word) JOIN forms last ON last.word = w.at WHERE last.form IS NULL
""",
}
