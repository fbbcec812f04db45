"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import chat_format, decontaminate, language_id, media, mixing, simhash, substring_dedup, suffix_dedup, token_store, url_filter
from loomframe.llm.common import new_path, table, written

#: The rules of the URL query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, texts, corpus = substring_dedup.repeated_words(table(spark, sf_dir, "documents"))
    told = texts.select("digest", F.col("n").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    out = written(ids.join(told, "digest").drop("digest"), "substring-dedup")
    corpus.drop()
    return out


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS h FROM d, LATERAL (SELECT unnest(range(1, len(ws) - 33)) AS i)),
again AS (SELECT doc_id, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM again, range(35) AS r(j)),
words AS (SELECT doc_id, i, ws[i] AS word FROM d, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, texts, corpus = suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents"))
    told = texts.select("digest", F.col("n").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    out = written(ids.join(told, "digest").drop("digest"), "suffix-dedup")
    corpus.drop()
    return out


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = media.features(media.stored(table(spark, sf_dir, "documents")))
    return got.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration", "n_keyframes")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(language_id.learning_rows(docs))
    got = language_id.identified(docs.select("doc_id", "text"), model)
    return got.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, url_filter.rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
r(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best AS (
  SELECT u.page_id, u.host, u.path, max({'n': length(r.h || r.p), 'rule': r.h || r.p, 'v': r.verdict}) AS b
  FROM u LEFT JOIN r ON (u.host = r.h OR u.host LIKE '%.' || r.h) AND starts_with(u.path, r.p)
  GROUP BY ALL)
SELECT page_id, host, path, CASE WHEN b.n IS NOT NULL THEN b.rule END AS rule, CASE WHEN b.n IS NOT NULL THEN b.v ELSE 'allow' END AS verdict FROM best
"""


PLANTED = '{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}'


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    record = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(PLANTED).alias("record"))
    turns = chat_format.canonical_turns(chat_format.row_records(rows).unionByName(record), "conv_id", "record").select("conv_id", "turn", "role", "text")
    out = chat_format.parsed(written(chat_format.formatted(turns), "chat"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), chat_format.learned_text(F.col("turns"), F.col("mask")).alias("learned"), F.length("formatted").cast("long").alias("formatted_chars")).select("conv_id", "n_turns", "turns_sha256", F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(role, '([<\[])(~*)(/?s>|/?INST\])', '\1~\2\3', 'g') AS er, regexp_replace(text, '([<\[])(~*)(/?s>|/?INST\])', '\1~\2\3', 'g') AS et FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(6 + length(er) + 7 + length(et) + 4) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

#: Production parameters: weights of named sources; the others share the rest. Ids of the tokenizer's file.
WEIGHTS = {"src0": 0.10, "src1": 0.08, "src2": 0.08, "src3": 0.06}
END_ID = 1


def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mixed(docs, WEIGHTS).select("doc_id", "source", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_at")


OP5_SQL = """
WITH RECURSIVE
w(s, w) AS (VALUES ('src0', 0.10::DOUBLE), ('src1', 0.08::DOUBLE), ('src2', 0.08::DOUBLE), ('src3', 0.06::DOUBLE)),
k AS (SELECT source AS s, row_number() OVER (ORDER BY source NULLS FIRST) AS i FROM documents GROUP BY source),
have AS (SELECT k.s, k.i, w.w FROM k LEFT JOIN w ON k.s = w.s),
want AS (SELECT s, i, coalesce(w, (1 - (SELECT sum(w) FROM have)) / (SELECT count(*) FROM have WHERE w IS NULL)) AS x FROM have),
e AS (SELECT *, round(x / (SELECT sum(x) FROM want) * 1000, 9) AS ex FROM want),
o AS (SELECT *, CAST(floor(ex) AS BIGINT) AS q0, row_number() OVER (ORDER BY floor(ex) - ex, s NULLS FIRST) AS r FROM e),
q AS (SELECT s, i, q0 + CASE WHEN r <= 1000 - (SELECT sum(q0) FROM o) THEN 1 ELSE 0 END AS q FROM o),
plan(slot, q, done, pick) AS (
  SELECT CAST(-1 AS BIGINT), list(CAST(q AS BIGINT) ORDER BY i), list(CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM q
  UNION ALL
  SELECT slot + 1, q, list_transform(done, lambda d, j: d + CASE WHEN j = p THEN 1 ELSE 0 END), p
  FROM (SELECT *, list_min(list_transform(done, lambda d, j: CASE WHEN d < q[j] AND d * 1000 // q[j] <= slot + 1 THEN ((d + 1) * 1000 + q[j] - 1) // q[j] * 1000 + j ELSE 1000000000 END)) % 1000 AS p FROM plan WHERE slot < 999)),
slots AS (SELECT slot, pick AS i, done[pick] - 1 AS turn, q[pick] AS q FROM plan WHERE slot >= 0),
d AS (SELECT doc_id, source, k.i, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS rank FROM documents JOIN k ON source IS NOT DISTINCT FROM k.s),
b AS (SELECT *, rank // 16 AS block FROM d)
SELECT doc_id, source, block AS mix_block, block // q * 1000 + turn * 1000 // q AS mix_release, block // q * 1000 + ((turn + 1) * 1000 + q - 1) // q AS mix_deadline,
       block // q * 1000 + slot AS mix_slot, (block // q * 1000 + slot) * 16 + rank % 16 AS mix_at
FROM b JOIN slots ON slots.i = b.i AND slots.turn = b.block % slots.q
"""


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "tokens")
    token_store.write_store(table(spark, sf_dir, "documents"), out, tokenizer_path(), END_ID)
    return token_store.read_sums(spark, out, width=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_simhash": op3_simhash,
    "op4_media_columns": op4_media_columns,
    "op5_mixing_sources": op5_mixing_sources,
    "op6_language_id": op6_language_id,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_url_filters": op8_url_filters,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_token_store": op10_token_store,
}
SQL = {"op1_substring_dedup": OP1_SQL, "op5_mixing_sources": OP5_SQL, "op8_url_filters": OP8_SQL, "op9_chat_formatting": OP9_SQL}
