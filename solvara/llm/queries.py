"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvara.llm import chat_format, collocations, decontaminate, exact_dedup, hard_negatives, html_text, jaccard_join, language_id, mixing, sharding, toxicity, training_order, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A conversation whose texts are control strings themselves.
HOSTILE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.union(spark.createDataFrame(HOSTILE, "conv_id long, turn long, role string, text string"))
    return chat_format.conversation_digests(chat_format.format_turns(chat_format.text_messages(rows)))


def chat_typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as conversations with document parts, formatted and read back (op1 with typed parts)."""
    turns = chat_format.format_turns(chat_format.page_messages(_table(spark, sf_dir, "pages")))
    return chat_format.conversation_digests(turns)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.training_shards(_table(spark, sf_dir, "documents"))


def op4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_derivatives(_table(spark, sf_dir, "pages"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.sharded(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATE_SQL = rf"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bm AS (SELECT item_id, w, least(10, len(w)) AS m FROM bw WHERE len(w) > 0),
bwin AS (SELECT DISTINCT item_id, m, array_to_string(w[j : j + m - 1], ' ') AS win FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS j FROM bm)),
ms AS (SELECT DISTINCT m FROM bm),
dwin AS (SELECT r, p, m, array_to_string(w[p : p + m - 1], ' ') AS win FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM dw, ms WHERE len(w) >= m)),
occ AS (SELECT r, p, dwin.m, item_id FROM dwin JOIN bwin ON dwin.win = bwin.win AND dwin.m = bwin.m),
pos AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + m)) AS q FROM (SELECT DISTINCT r, p, m FROM occ)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM occ) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""

#: The template puts 23 characters around role and text; escaping adds one to each backslash and
#: control string, whose starts are counted here one pattern at a time.
CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
p AS (SELECT unnest(['\', '<|', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>']) AS p),
x AS (SELECT conv_id, sum((length(role || chr(0) || text) - length(replace(role || chr(0) || text, p, ''))) // length(p)) AS more FROM c, p GROUP BY conv_id),
g AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
         coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
         sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
         sum(length(role) + length(text) + 23) AS plain
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, (plain + more)::BIGINT AS formatted_chars, 0::BIGINT AS expanded_tokens
FROM g JOIN x USING (conv_id)
"""

#: Placeholders are 13 characters and their number; documents expand to 512 tokens a page.  Urls hold
#: no control strings, else the lengths would differ.
PARTS_SQL = r"""
WITH p AS (SELECT page_id AS conv_id, coalesce(url, '') AS url, len(regexp_extract_all(coalesce(html, ''), 'href="([^"]*)"', 1))::BIGINT AS n FROM pages)
SELECT conv_id, 2::BIGINT AS n_turns, sha256('user' || chr(10) || url || 'What do these say?' || chr(10) || 'assistant' || chr(10) || n || url || chr(10)) AS turns_sha256,
       (length(n::VARCHAR) + length(url))::BIGINT AS loss_chars, sha256(n || url) AS loss_sha256,
       (2 * 23 + 4 + 9 + 2 * length(url) + 18 + length(n::VARCHAR) + 13 * n + coalesce(list_sum(list_transform(range(0, n), lambda k: length(k::VARCHAR))), 0))::BIGINT AS formatted_chars, (512 * n)::BIGINT AS expanded_tokens
FROM p
"""

EXACT_DEDUP_SQL = f"""
WITH h AS (SELECT doc_id, sha256({_FOLD}) AS text_sha256 FROM documents),
g AS (SELECT *, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM h)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""

JACCARD_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[j : j + 4], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS j FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 80 * (na.n + nb.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS x, b AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
c AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(c.y, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.x = w.doc_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "chat_typed_parts": chat_typed_parts,
    "op2_toxicity": op2_toxicity,
    "op3_training_order": op3_training_order,
    "op4_mixture": op4_mixture,
    "op5_decontaminate": op5_decontaminate,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_warc_derivatives": op7_warc_derivatives,
    "op8_main_text": op8_main_text,
    "op9_language_id": op9_language_id,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_sharding": op11_sharding,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op1_chat_format": CHAT_SQL,
    "chat_typed_parts": PARTS_SQL,
    "op4_mixture": mixing.MIX_SQL,
    "op5_decontaminate": DECONTAMINATE_SQL,
    "op6_exact_dedup": EXACT_DEDUP_SQL,
    "op10_jaccard_join": JACCARD_SQL,
    "op11_sharding": sharding.SHARDING_SQL,
    "op12_hard_negatives": hard_negatives.NEGATIVES_SQL,
    "op13_collocations": collocations.COLLOCATIONS_SQL,
}
