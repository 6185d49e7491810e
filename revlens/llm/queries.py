"""Registered queries of this package: production parameters, whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from revlens.llm import bpe, chat, collisions, decontamination, gam, merkle, negatives, packing, records, repair, repair_sql, simhash, suffixes, toxicity


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


ENTRIES: dict[str, Entry] = {}


def query(sql: str | None = None):
    def wrap(fn):
        ENTRIES[fn.__name__] = Entry(fn, sql)
        return fn

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Place of a public tokenizer file; the environment may name another folder."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op1_best_fit_packing(spark, folder):
    return packing.pack(packing.pieces(table(spark, folder, "documents"), tokenizer("word_bpe_49k.json")))


@query()
def op4_token_counts(spark, folder):
    return bpe.token_counts(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"))


@query()
def op5_binary_records(spark, folder):
    files = records.write(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"))
    return records.read(files).select("doc_id", "start", "n_tokens", "ids_crc32")


@query()
def op8_simhash(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


CONTAMINATION_SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d JOIN lens ON len(w) >= n)),
hit AS (SELECT r, k, n, item_id FROM dw JOIN iw USING (win, n)),
marked AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT r, k, n FROM hit)) GROUP BY r),
names AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN marked USING (r) LEFT JOIN names USING (r)
"""


@query(CONTAMINATION_SQL)
def op9_decontamination(spark, folder):
    return decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query()
def op10_repeated_passages(spark, folder):
    return suffixes.repeated_bytes(table(spark, folder, "documents"))


@query()
def op2_merkle_fingerprints(spark, folder):
    return merkle.fingerprints(table(spark, folder, "documents"))


@query()
def op6_toxicity_chain(spark, folder):
    docs = table(spark, folder, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, toxicity.label_columns(table(spark, folder, "labels"))))


@query()
def op7_quality_additive(spark, folder):
    docs = table(spark, folder, "documents")
    return gam.quality(docs, gam.fit(docs, table(spark, folder, "labels")))


CHAT_SQL = f"""
WITH RECURSIVE crc AS (SELECT {repair_sql.CRC_TABLE} AS t),
asked AS (SELECT conv_id, turn, role, text, {repair_sql.CRC} % 12 AS kind FROM conversations, crc WHERE role IN ('user', 'system')),
calls AS (
  SELECT conv_id, 'c' || turn AS call_id, turn AS seq, CASE WHEN kind = 6 THEN 'search' WHEN role = 'user' THEN 'reply' ELSE 'configure' END AS name, text, kind,
    CASE WHEN kind >= 2 THEN 'c' || (turn + CASE kind WHEN 7 THEN 2 WHEN 8 THEN 4 WHEN 9 THEN 0 ELSE -2 END) END AS need,
    CASE kind WHEN 3 THEN json_object('turn', turn) WHEN 4 THEN json_object('prompt', text, 'turn', CAST(turn AS VARCHAR))
      WHEN 5 THEN json_object('note', 1, 'prompt', text, 'turn', turn) ELSE json_object('prompt', text, 'turn', turn) END AS arguments
  FROM asked),
edges AS (SELECT c.conv_id, c.call_id, c.need, CASE WHEN n.seq >= c.seq THEN 1 ELSE 0 END AS back FROM calls c JOIN calls n ON n.conv_id = c.conv_id AND n.call_id = c.need),
most AS (SELECT conv_id, sum(back) AS most FROM edges GROUP BY 1),
ways AS (
  SELECT conv_id, call_id, CAST(0 AS INTEGER) AS level FROM calls
  UNION SELECT e.conv_id, e.call_id, w.level + e.back FROM ways w JOIN edges e ON e.conv_id = w.conv_id AND e.need = w.call_id
    JOIN most m ON m.conv_id = e.conv_id WHERE w.level <= m.most + 1),
levels AS (SELECT w.conv_id, call_id, CASE WHEN max(level) <= coalesce(max(most), 0) THEN max(level) END AS level FROM ways w LEFT JOIN most m ON m.conv_id = w.conv_id GROUP BY 1, 2),
results AS (
  SELECT conv_id, 'c' || (turn - 1) AS call_id, min(turn) AS seq, min(coalesce(text, '')) AS result, count(*) AS n
  FROM conversations WHERE role = 'assistant' GROUP BY 1, 2)
SELECT c.conv_id, c.call_id, c.seq, level, c.name, CASE WHEN n IS NULL THEN 'unanswered' ELSE 'linked' END AS status, coalesce(n, 0) AS n_results,
  CASE WHEN kind = 6 THEN 'unknown tool' ELSE concat_ws('; ', CASE WHEN kind = 3 THEN 'missing prompt' WHEN text IS NULL THEN 'kind of prompt' END,
    CASE WHEN kind = 4 THEN 'kind of turn' END, CASE WHEN kind = 5 THEN 'unknown note' END) END AS problems,
  CAST(json_object('arguments', arguments, 'call_id', c.call_id, 'conv_id', c.conv_id, 'name', c.name, 'result', result) AS VARCHAR) AS json
FROM calls c JOIN levels l ON l.conv_id = c.conv_id AND l.call_id = c.call_id LEFT JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
UNION ALL
SELECT r.conv_id, r.call_id, r.seq, NULL, NULL, 'orphan', n, '',
  CAST(json_object('arguments', NULL, 'call_id', r.call_id, 'conv_id', r.conv_id, 'name', NULL, 'result', result) AS VARCHAR)
FROM results r ANTI JOIN calls c ON c.conv_id = r.conv_id AND c.call_id = r.call_id
"""


@query(CHAT_SQL)
def op3_chat_tool_calls(spark, folder):
    calls, results = chat.turn_calls(table(spark, folder, "conversations"))
    return chat.formatted(calls, results, spark.createDataFrame(chat.TOOLS, "name string, field string, kind string, required boolean"))


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, v.vec_id AS id, v.label, CAST(list_dot_product(a.e, v.e) AS BIGINT) AS score
  FROM v a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score, CAST(row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS INTEGER) AS positive_rank
  FROM s WHERE own = label QUALIFY positive_rank <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score, positive_rank
FROM p JOIN s USING (anchor_id) WHERE own <> label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""


@query(NEGATIVES_SQL)
def op11_hard_negatives(spark, folder):
    points = negatives.relabelled(table(spark, folder, "embeddings"))
    return negatives.hard_negatives(points, points.where("vec_id % 100 = 0"))


@query(repair_sql.SQL)
def op12_conversation_repair(spark, folder):
    return repair.repaired_after_damage(table(spark, folder, "conversations"))


@query()
def op13_collision_neighbours(spark, folder):
    points = table(spark, folder, "embeddings")
    return collisions.nearest(points, points.where("vec_id % 100 = 0"))
