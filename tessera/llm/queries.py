"""The operators' queries, by the names they are registered under, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, exact_dedup, html_extract, lm, near_dup, packing, secrets, token_store, toxicity
from tessera.llm.common import table, work


def op3(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    with work(spark) as keep:
        read = chat.read_back(chat.format_chat(turns.unionByName(own)))
        return keep(read.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"), "chat")


def op5(spark, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), packing.vocabulary())


def op8(spark, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", F.col("group_size"), "kept", "text_sha256")


QUERIES = {
    "op1_secret_scan": secrets.op1,
    "op2_html_extract": html_extract.op2,
    "op3_chat_format": op3,
    "op4_ngram_jaccard": near_dup.op4,
    "op5_best_fit_pack": op5,
    "op6_lm_score": lm.op6,
    "op7_toxicity": toxicity.op7,
    "op8_exact_dedup": op8,
    "op9_token_store": token_store.op9,
    "op10_decontaminate": decontaminate.op10,
}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op3_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(role, '(\\|<s>|</s>|\[/ROLE\]|\[INST\]|\[/INST\])', '\\\1', 'g')) + length(regexp_replace(text, '(\\|<s>|</s>|\[/ROLE\]|\[INST\]|\[/INST\])', '\\\1', 'g')) + 14 AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars,
  bool_and(list_contains(['start system', 'start user', 'system user', 'user assistant', 'assistant user', 'assistant tool', 'tool assistant'], before || ' ' || role)) AND arg_max(role, (turn, role, text)) = 'assistant' AS valid
FROM (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), 'start') AS before FROM e) GROUP BY conv_id""",
    "op4_ngram_jaccard": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT p.a, r.c FROM r JOIN p ON p.b = r.doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)""",
    "op8_exact_dedup": f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256({LOWER}) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY {LOWER})""",
    "op10_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, array_to_string(w[i:i + k - 1], ' ') AS g, k FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM g))),
h AS (SELECT p.doc_id, p.i, p.k, g.item_id FROM p JOIN g ON p.g = g.g AND p.k = g.k),
c AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256, c.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)""",
}
