"""The named queries of the text operators: thin wrappers that read the tables and digest results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm import (
    chat_repair,
    decontaminate,
    exact_dedup,
    html_text,
    katz,
    lang_centroids,
    line_dedup,
    near_dedup,
    piece_codec,
    pivot_search,
    substring_dedup,
    token_align,
    toxic_neighbours,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the public tokenizer package keeps the models that operators 8 and 13 are asked for."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op3_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 10
"""


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_centroids.identify(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(table(spark, sf_dir, "documents"), digest=True)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_neighbours.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair(chat_repair.damage(table(spark, sf_dir, "conversations")))


def _op11_sql() -> str:
    """Row by row from the last: for each state, cost (nine digits) and audit of the best edits of the rest; then
    the edits are replayed from the first row."""
    more = lambda v, cost, edit: f"printf('%09d', CAST({v}[1:9] AS BIGINT) + {cost}) || '{edit}' || {v}[10:]"  # noqa: E731
    kept = {0: "CASE x WHEN 's' THEN v1 WHEN 'u' THEN v2 END", 1: "CASE x WHEN 'u' THEN v2 END", 2: "CASE x WHEN 'a' THEN v3 END", 3: "CASE x WHEN 'u' THEN v2 END"}
    after = (2, 2, 3, 2)
    own = ", ".join(f"least({more(f'v{s}', 3, 'D')}, CASE WHEN NOT gone THEN {more(f'v{after[s]}', '2 + cut', 'R')} END, CASE WHEN NOT gone THEN {more(f'({kept[s]})', 'cut', 'K')} END) AS w{s}" for s in range(4))
    return rf"""
WITH RECURSIVE coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) % 20 AS kind
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM coded WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS x,
    NOT regexp_matches(text, '[^ 	-]') AS blank,
    regexp_extract(text, '([^ 	-])[ 	-]*$', 1) NOT IN ('.', '!', '?') AS open
  FROM damaged
), marked AS (
  SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS y
  FROM placed
), rowed AS (
  SELECT *, blank OR again AS gone, CAST(open AND NOT blank AND NOT again AS INTEGER) AS cut FROM marked
), counted AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, count(*) FILTER (cut = 1) AS truncated,
    count(*) FILTER (y IS NOT NULL AND y || x NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rowed GROUP BY conv_id
), solved AS (
  SELECT conv_id, n + 1 AS i, '000000000' AS v0, '000000004II' AS v1, '000000002I' AS v2, '000000000' AS v3 FROM counted
  UNION ALL
  SELECT conv_id, i, least(w0, {more('w2', 2, 'I')}, {more('w3', 4, 'II')}), least(w1, {more('w2', 2, 'I')}, {more('w3', 4, 'II')}),
    least(w2, {more('w3', 2, 'I')}), least(w3, {more('w2', 2, 'I')})
  FROM (SELECT r.conv_id, r.i, {own} FROM solved AS s JOIN rowed AS r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i - 1)
), best AS (
  SELECT conv_id, CAST(v0[1:9] AS BIGINT) AS cost, v0[10:] AS audit FROM solved WHERE i = 1
), played AS (
  SELECT conv_id, audit, 1 AS k, 1 AS i, 0 AS state, CAST([] AS VARCHAR[]) AS lines FROM best
  UNION ALL
  SELECT p.conv_id, audit, k + 1, CASE audit[k] WHEN 'I' THEN p.i ELSE p.i + 1 END,
    CASE audit[k] WHEN 'D' THEN state WHEN 'K' THEN CASE r.x WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE state WHEN 2 THEN 3 ELSE 2 END END,
    CASE audit[k] WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, r.role || ':' || r.text)
      ELSE list_append(lines, CASE state WHEN 2 THEN 'assistant:' ELSE 'user:' END || CASE audit[k] WHEN 'R' THEN r.text ELSE '' END) END
  FROM played AS p LEFT JOIN rowed AS r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i
  WHERE k <= length(audit)
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c
LEFT JOIN counted AS n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best AS b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN (SELECT * FROM played WHERE k = length(audit) + 1) AS p ON p.conv_id IS NOT DISTINCT FROM c.conv_id
"""


OP11_SQL = _op11_sql()


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.label_copies(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
FROM t
"""


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.alignment_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path())


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_katz": op2_katz,
    "op3_pivot_search": op3_pivot_search,
    "op4_language": op4_language,
    "op5_near_dedup": op5_near_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_html_text": op9_html_text,
    "op10_decontaminate": op10_decontaminate,
    "op11_chat_repair": op11_chat_repair,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_token_align": op13_token_align,
}

#: Only operators that SQL can express over whole tables.
ORACLE: dict[str, str] = {
    "op3_pivot_search": OP3_SQL,
    "op11_chat_repair": OP11_SQL,
    "op12_exact_dedup": OP12_SQL,
}
