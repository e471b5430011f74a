"""The registered corpus queries and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, centroids, decontaminate, exact_dedup, licences, line_dedup, parsing, quality, repair, simhash, suffix_tree, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats, model = quality.train(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    scored = quality.score_statistics(stats, model)
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= quality.KEEP_FROM, 1).otherwise(0).alias("predicted")
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(_table(spark, sf_dir, "pages"))
    return records.select(
        F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumn("item_id", F.col("item_id").cast("long"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.find_licences(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op8_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.edited_likeness(_table(spark, sf_dir, "documents"))


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_documents(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(_table(spark, sf_dir, "embeddings"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), keep="largest")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(_table(spark, sf_dir, "conversations")))


OP10_SQL = """
WITH keyed AS (
  SELECT DISTINCT doc_id, text FROM documents
), lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM keyed
), windows AS (
  SELECT doc_id, text, pos, line AS l1, lead(line) OVER w AS l2, lead(line, 2) OVER w AS l3
  FROM lines WINDOW w AS (PARTITION BY doc_id, text ORDER BY pos)
), ranked AS (
  SELECT doc_id, text, pos, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, pos) AS n
  FROM windows WHERE l3 IS NOT NULL AND trim(l1 || l2 || l3) <> ''
), covered AS (
  SELECT DISTINCT doc_id, text, pos + k AS pos FROM ranked, (VALUES (0), (1), (2)) AS three(k) WHERE n > 1
), cut AS (
  SELECT l.doc_id, l.text AS old, count(*) AS n_lines, count(c.pos) AS n_removed,
         coalesce(string_agg(CASE WHEN c.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '') AS text
  FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.text = c.text AND l.pos = c.pos
  GROUP BY l.doc_id, l.text
)
SELECT d.doc_id, cut.text, CAST(cut.n_lines AS BIGINT) AS n_lines, CAST(cut.n_removed AS BIGINT) AS n_removed
FROM documents d JOIN cut ON d.doc_id = cut.doc_id AND d.text = cut.old
"""


def _terms(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


OP7_SQL = f"""
WITH parts AS (
  SELECT page_id, url, coalesce(strpos(url, '://'), 0) AS mark,
         translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded
  FROM pages
), named AS (
  SELECT page_id, folded,
         CASE WHEN mark = 0 THEN '' ELSE regexp_extract(substr(folded, mark + 3), '^([^/?#]*)', 1) END AS host,
         CASE WHEN mark = 0 THEN '' ELSE regexp_extract(substr(url, mark + 3), '^[^/?#]*([^?#]*)', 1) END AS path
  FROM parts
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    CAST(len(list_filter(string_split_regex(folded, '[^a-z0-9]+'), lambda t: list_contains({_terms(url_filter.STRICT)}, t))) AS INTEGER) AS strict_hits,
    CAST(len(list_distinct(list_filter(string_split_regex(folded, '[^a-z0-9]+'), lambda t: list_contains({_terms(url_filter.SOFT)}, t)))) AS INTEGER) AS soft_hits
  FROM named
)
SELECT page_id, host, path, rule, strict_hits, soft_hits, CAST(strict_hits * 2 + soft_hits AS INTEGER) AS weight,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN strict_hits * 2 + soft_hits >= 2 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

OP12_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def _round_sql(r: int) -> str:
    """Round ``r`` of op11: every vector to the nearest centroid of ``c{r}``, then the centroids ``c{r + 1}``."""
    return f""", a{r} AS MATERIALIZED (
  SELECT id, vec_id, x, c, d FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, c) AS place FROM (
      SELECT v.*, c, CAST(list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM vectors v, c{r}
    )) WHERE place = 1
), c{r + 1} AS MATERIALIZED (
  SELECT c{r}.c, coalesce(new.m, c{r}.m) AS m FROM c{r} LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM (
      SELECT c, i, sum(e) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY c, i
    ) GROUP BY c) new USING (c)
)"""


OP11_SQL = f"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS c, x AS m
  FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, x FROM vectors ORDER BY h NULLS LAST, x LIMIT 8)
){"".join(_round_sql(r) for r in range(11))}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a10 JOIN c10 USING (c)
"""


def _edit(path: str, cost: str, letter: str) -> str:
    """A path of op13, nine digits of cost and its letters, with one more edit; null stays null."""
    return f"printf('%09d', CAST(substr({path}, 1, 9) AS BIGINT) + {cost}) || substr({path}, 10) || '{letter}'"


def _least(*paths: str) -> str:
    return f"least({', '.join(paths)})"


def _if(condition: str, path: str) -> str:
    return f"CASE WHEN {condition} THEN {path} END"


def _from(*states: str, cost: str, letter: str) -> list[str]:
    return [_if(f"{s} IS NOT NULL", _edit(s, cost, letter)) for s in states]


_CRC_BYTE = "list_reduce(list_concat([xor(crc, byte)], range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
_CRC = f"list_reduce(list_concat([4294967295], list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda crc, byte: {_CRC_BYTE})"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP13_SQL = f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), cases AS (
  SELECT *, xor({_CRC}, 4294967295) % 20 AS f FROM raw
), convs AS MATERIALIZED (
  SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)
), damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM cases WHERE f <> 0
), ordered AS (
  SELECT c, d.*, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS initial, rtrim(text, {_WHITE}) AS said
  FROM damaged d JOIN convs ON d.conv_id IS NOT DISTINCT FROM convs.conv_id
), faults AS MATERIALIZED (
  SELECT *, CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
         lag(initial) OVER (PARTITION BY c ORDER BY i) || initial AS pair
  FROM ordered
), paths AS (
  SELECT c, CAST(0 AS BIGINT) AS i, '000000000' AS s0, CAST(NULL AS VARCHAR) AS s1, '000000003I' AS s2, '000000006II' AS s3 FROM convs
  UNION ALL
  SELECT c, i, n0, n1, m2, {_least("n3", *_from("m2", cost="3", letter="I"))} FROM (
    SELECT *, {_least("n2", *_from("n0", "n1", "n3", cost="3", letter="I"))} AS m2 FROM (
      SELECT r.c, r.i, {_from("s0", cost="4", letter="D")[0]} AS n0,
        {_least(*_from("s1", cost="4", letter="D"), _if("fine AND initial = 's'", *_from("s0", cost="e", letter="K")))} AS n1,
        {_least(*_from("s2", cost="4", letter="D"), _if("fine AND initial = 'u'", _least(*_from("s0", "s1", "s3", cost="e", letter="K"))),
                _if("fine", _least(*_from("s0", "s1", "s3", cost="3 + e", letter="R"))))} AS n2,
        {_least(*_from("s3", cost="4", letter="D"), _if("fine AND initial = 'a'", *_from("s2", cost="e", letter="K")), _if("fine", *_from("s2", cost="3 + e", letter="R")))} AS n3
      FROM paths JOIN (SELECT *, fault IN ('none', 'truncated') AS fine, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS e FROM faults) r
        ON r.c = paths.c AND r.i = paths.i + 1))
), best AS MATERIALIZED (
  SELECT c, arg_max({_least("s0", "s3")}, i) AS path FROM paths GROUP BY c
), letters AS (
  SELECT *, sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN letter <> 'D' THEN 1 ELSE 0 END) OVER w AS nth FROM (
    SELECT c, unnest(string_split(substr(path, 10), '')) AS letter, generate_subscripts(string_split(substr(path, 10), ''), 1) AS k FROM best WHERE length(path) > 9
  ) WINDOW w AS (PARTITION BY c ORDER BY k)
), written AS (
  SELECT l.*, f.role, f.text, max(CASE WHEN letter = 'K' AND nth = 1 AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.c) AS led
  FROM letters l LEFT JOIN faults f ON l.c = f.c AND l.i = f.i WHERE letter <> 'D'
), repaired AS (
  SELECT c, string_agg(CASE WHEN letter = 'K' THEN role WHEN (nth - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END,
                       chr(10) ORDER BY nth) AS body
  FROM written GROUP BY c
), counts AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY c
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(substr(path, 1, 9) AS BIGINT) AS cost, substr(path, 10) AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM convs JOIN best USING (c) LEFT JOIN counts USING (c) LEFT JOIN repaired USING (c)
"""

QUERIES = {
    "op1_quality": op1_quality, "op2_simhash": op2_simhash, "op3_warc": op3_warc, "op4_bpe": op4_bpe, "op5_decontamination": op5_decontamination, "op6_licences": op6_licences,
    "op7_url_filter": op7_url_filter, "op8_parsing": op8_parsing,
    "op9_suffix_tree": op9_suffix_tree, "op10_line_dedup": op10_line_dedup, "op11_centroids": op11_centroids, "op12_exact_dedup": op12_exact_dedup,
    "op13_repair": op13_repair, "pipeline": corpus_pipeline.run,
}
ORACLE = {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
ORACLE |= {"op7_url_filter": OP7_SQL, "op10_line_dedup": OP10_SQL, "op11_centroids": OP11_SQL, "op12_exact_dedup": OP12_SQL, "op13_repair": OP13_SQL}
