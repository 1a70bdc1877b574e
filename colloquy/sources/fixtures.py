"""Facts and dimensions made from the driver's tables by portable SQL: the same text runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloquy.functions.domains import NODE_TYPES, RELATIONS

_TYPE = "split_part('" + ",".join(NODE_TYPES) + "', ',', CAST({0} % 9 + 1 AS INT))"
_FORM = "CASE {1} % 3 WHEN 0 THEN concat('Concept ', {0}) WHEN 1 THEN concat('  concept  ', {0}) ELSE concat('CONCEPT ', {0}, ' ') END"

EDGES = f"""
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS edge_id,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE concat('concept ', l_suppkey % 40) END AS source_node_id,
  concat('concept ', l_partkey % 40) AS target_node_id,
  {_FORM.format("l_suppkey % 40", "l_linenumber")} AS source_label, {_TYPE.format("(l_suppkey % 40 + CASE WHEN l_linenumber = 5 THEN 1 ELSE 0 END)")} AS source_type,
  {_FORM.format("l_partkey % 40", "l_orderkey")} AS target_label, {_TYPE.format("(l_partkey % 40)")} AS target_type,
  split_part('{",".join(RELATIONS)}', ',', CAST((l_partkey + l_linenumber) % 15 + 1 AS INT)) AS relation,
  CAST(o_custkey AS STRING) AS participant_id, c_name AS speaker, n_name AS table_id, CAST(year(o_orderdate) AS STRING) AS round_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'asserted' WHEN '2-HIGH' THEN 'rejected' WHEN '3-MEDIUM' THEN 'questioned' WHEN '4-NOT SPECIFIED' THEN 'uncertain' ELSE 'reported' END AS stance,
  CASE l_returnflag WHEN 'A' THEN 'supports' WHEN 'R' THEN 'opposes' ELSE 'neutral' END AS polarity,
  CASE o_orderstatus WHEN 'F' THEN 'explicit' WHEN 'O' THEN 'near_explicit' ELSE 'inferred' END AS explicitness,
  CAST(round(l_discount * 100) * 10 AS DOUBLE) / 100 AS confidence,
  concat('Line ', l_linenumber, ' of ', o_custkey % 7) AS evidence_text
FROM {{lineitem}} l JOIN {{orders}} o ON l_orderkey = o_orderkey JOIN {{customer}} c ON o_custkey = c_custkey JOIN {{nation}} n ON c_nationkey = n_nationkey"""

STANCES = f"""
SELECT concat('s-', o_orderkey) AS stance_id,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat('concept ', (o_orderkey * 7 + o_custkey) % 40) END AS concept_node_id,
  {_FORM.format("(o_orderkey * 7 + o_custkey) % 40", "o_custkey")} AS concept_label, {_TYPE.format("((o_orderkey * 7 + o_custkey) % 40)")} AS concept_type,
  CASE o_orderstatus WHEN 'F' THEN 'supports' WHEN 'O' THEN 'opposes' ELSE 'neutral' END AS polarity,
  CAST(o_custkey AS STRING) AS participant_id, c_name AS speaker, n_name AS table_id, CAST(year(o_orderdate) AS STRING) AS round_id,
  CASE WHEN o_orderkey % 4 = 0 THEN 'inferred' ELSE 'explicit' END AS explicitness,
  CAST(o_orderkey % 101 AS DOUBLE) / 100 AS confidence, concat('Order ', o_orderkey % 50) AS evidence_text
FROM {{orders}} o JOIN {{customer}} c ON o_custkey = c_custkey JOIN {{nation}} n ON c_nationkey = n_nationkey"""

DEMOGRAPHICS = """
SELECT CAST(c_custkey AS STRING) AS participant_id, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END AS political_affiliation,
  CASE WHEN c_custkey % 7 = 0 THEN 'CONSENT_REVOKED' WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
  CASE WHEN c_custkey % 13 = 0 THEN 'x' ELSE CAST(16 + c_custkey % 60 AS STRING) END AS age, r_name AS ethnicity
FROM {customer} c JOIN {nation} n ON c_nationkey = n_nationkey JOIN {region} r ON n_regionkey = r_regionkey"""

#: Fifty concepts, ten of which no record mentions.
REGISTRY = f"""
SELECT DISTINCT concat('concept ', p_partkey % 50) AS node_id, concat('concept ', p_partkey % 50) AS label, {_TYPE.format("(p_partkey % 50)")} AS type FROM {{part}}"""

#: Utterance input: integer microseconds, so gaps are exact.
SEGMENTS = """
SELECT event_id AS ord, CAST(user_id AS STRING) AS table_id, concat('r', event_id % 3) AS round_id, 'room' AS room_id, CAST(user_id AS STRING) AS participant_id, event_type AS speaker,
  {micros} AS start_time, {micros} + CAST(round(value * 1000000) AS BIGINT) AS end_time, concat(' ', event_type, ' ', event_id, ' ') AS transcript
FROM {events}"""
MICROS = {"spark": "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)", "duckdb": "epoch_us(ts)"}

TURNS = """
SELECT concat(conv_id, '-', turn) AS turn_id, CAST(conv_id AS STRING) AS table_id, '1' AS round_id, concat('p', conv_id % 17, role) AS participant_id, role AS speaker, coalesce(text, '') AS text, turn AS start_time
FROM {conversations}"""

#: Vectors that ground concepts: the first thirty are the vocabulary, the others mentions.
VECTORS = "SELECT vec_id, CAST(label AS STRING) AS type, embedding FROM {embeddings}"

_TABLES = ("region", "nation", "customer", "part", "orders", "lineitem", "events", "conversations", "embeddings")


def sql_text(text: str, engine: str = "duckdb") -> str:
    """The text with plain table names, for an engine that has the tables as views."""
    return text.format(micros=MICROS[engine], **{t: t for t in _TABLES})


def frame(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    text = text.replace("{micros}", MICROS["spark"])
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if f"{{{t}}}" in text})
