"""Readers and writers of transcripts, demographics, records and vocabularies."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions import domains as D
from colloquy.functions.text import stripped

_NODE = "struct<label:string,type:string,concept_id:string>"
EDGE_SCHEMA = f"edge_id string, source_node {_NODE}, relation string, target_node {_NODE}, speaker string, participant_id string, discussion_id string, room_id string, table_id string, round_id string, turn_ids array<string>, evidence_text string, stance string, polarity string, explicitness string, confidence double, extraction_method string, created_at timestamp, source_node_id string, target_node_id string"
STANCE_SCHEMA = f"stance_id string, concept {_NODE}, polarity string, speaker string, participant_id string, discussion_id string, room_id string, table_id string, round_id string, turn_ids array<string>, evidence_text string, explicitness string, confidence double, extraction_method string, created_at timestamp, concept_node_id string"
TURN_SCHEMA = "turn_id string, discussion_id string, room_id string, table_id string, round_id string, participant_id string, speaker string, text string, start_time double, end_time double, raw_segment_count long"
VOCAB_SCHEMA = "concept_id string, label string, type string, aliases array<string>, mention_count long"
REGISTRY_SCHEMA = "node_id string, label string, type string, aliases array<string>"
GOLD_SCHEMA = "turn_id string, speaker string, table_id string, round_id string, text string, annotations struct<concepts:array<string>,edges:array<struct<source:string,relation:string,target:string>>,notes:string>"


def segments(raw: DataFrame) -> DataFrame:
    """Transcript rows of any reader: header names trimmed, known columns only, cells trimmed strings, blank transcripts
    dropped, times as double, in the order that `ord` gives."""
    have = {c.strip(): c for c in raw.columns}
    cols = [stripped(F.col(f"`{have[c]}`").cast("string")).alias(c) for c in D.SEGMENT_COLUMNS if c in have]
    out = raw.select(*cols, F.monotonically_increasing_id().alias("ord") if "ord" not in raw.columns else F.col("ord"))
    out = out.where(F.coalesce(F.col("transcript") != "", F.lit(False)))
    return out.withColumnRenamed("iteration_cycle", "round_id").withColumns({c: F.col(c).try_cast("double") for c in ("start_time", "end_time") if c in have})


def in_file_order(df: DataFrame) -> DataFrame:
    """df, read from files, with `ord`: path, place of the part in its file, and place in that part, however files are split
    and dealt to tasks."""
    return df.select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias("ord"))


def read_segments(spark: SparkSession, path: str, format: str = "csv", **options: str) -> DataFrame:
    """Segments of a CSV, JSON or Parquet transcript, or of the sheet `discussion` of an XLSX workbook, which one driver
    reads (needs openpyxl). CSV cells may hold line ends, so each file is one task; multiLine="false" splits large files
    whose cells have none."""
    if format == "xlsx":
        import pandas as pd

        return segments(spark.createDataFrame(pd.read_excel(path, sheet_name="discussion", dtype=str).astype(object).where(lambda x: x.notna(), None)))
    defaults = {"header": "true", "multiLine": "true", "escape": '"'} if format == "csv" else {}
    raw = spark.read.format(format).options(**{**defaults, **options}).load(path)
    return segments(raw if "ord" in raw.columns else in_file_order(raw))


def merge_cohorts(files: list[DataFrame]) -> DataFrame:
    """(participant_id, key, value) of cohort tables with different columns, in the order given: the last value that is not
    blank wins for each participant and key. Tables without a participant column, and rows without an id, count for nothing."""
    parts = []
    for at, df in enumerate(files):
        who = next((c for c in D.PARTICIPANT_COLUMNS if c in df.columns), None)
        keys = [c for c in df.columns if c not in (who, "ord")]
        if who is None or not keys:
            continue
        cells = F.array(*[F.struct(F.lit(k).alias("key"), F.trim(F.col(f"`{k}`").cast("string")).alias("value")) for k in keys])
        rows = df.select(F.trim(F.col(f"`{who}`").cast("string")).alias("participant_id"), F.struct(F.lit(at).alias("file"), *(F.col("ord") if "ord" in df.columns else F.monotonically_increasing_id().alias("ord"),)).alias("place"), F.explode(cells).alias("x"))
        parts.append(rows.select("participant_id", "place", "x.*"))
    if not parts:
        raise ValueError("no table has a participant column")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    out = out.where("coalesce(participant_id, '') != '' and coalesce(value, '') != ''")
    return out.groupBy("participant_id", "key").agg(F.max_by("value", "place").alias("value"))


def demographics(cells: DataFrame) -> DataFrame:
    """(participant_id, political_affiliation, sex, age, ethnicity) from cells; of a row's spellings of an attribute the
    first that has a value counts."""
    value = lambda c: F.nullif(F.trim(F.max(F.when(F.col("key") == c, F.col("value")))), F.lit(""))
    return cells.groupBy("participant_id").agg(*[F.coalesce(*map(value, columns)).alias(name) for name, columns in D.ATTRIBUTE_COLUMNS.items()])


def read_demographics(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Demographics of CSV files, merged in the order of their sorted paths."""
    return demographics(merge_cohorts([in_file_order(spark.read.option("header", "true").csv(p)) for p in sorted(paths)]))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False, optional: bool = False) -> DataFrame:
    """Records of a JSON array (or lines) with a fixed schema; an optional file that is missing is an empty table."""
    if optional and not exists(spark, path):
        return spark.createDataFrame([], T._parse_datatype_string(schema))
    return spark.read.schema(schema).option("multiLine", str(not lines).lower()).json(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return flat_edges(read_json(spark, path, EDGE_SCHEMA))


def read_stances(spark: SparkSession, path: str) -> DataFrame:
    return flat_stances(read_json(spark, path, STANCE_SCHEMA, optional=True))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, GOLD_SCHEMA, lines=True).where("annotations is not null")


def flat_edges(edges: DataFrame) -> DataFrame:
    """Edges with the labels and types of their ends as columns, as the operators take them."""
    ends = [F.col(f"{e}_node.{c}").alias(f"{e}_{c}") for e in ("source", "target") for c in ("label", "type")]
    return edges.select(*[c for c in edges.columns if c not in ("source_node", "target_node")], *ends)


def flat_stances(stances: DataFrame) -> DataFrame:
    return stances.select(*[c for c in stances.columns if c != "concept"], F.col("concept.label").alias("concept_label"), F.col("concept.type").alias("concept_type"))


def write_turns(turns: DataFrame, path: str) -> None:
    """Turns in order of table, round (as text) and start, never with a real name."""
    turns.drop("speaker_original").repartitionByRange("table_id", "round_id").sortWithinPartitions("table_id", "round_id", "start_time").write.mode("overwrite").parquet(path)


def write_facts(facts: DataFrame, path: str) -> None:
    facts.write.mode("overwrite").partitionBy("table_id").parquet(path)


def write_table(df: DataFrame, path: str, format: str = "json") -> None:
    df.write.mode("overwrite").format(format).save(path)


def _one_file(lines: DataFrame, opens: list[str], closes: str, path: str) -> None:
    """Rows of (part, line) as one text: a part is its opening, its lines in order with commas, and closes. One task sorts
    them, beyond memory if need be, and streams them; the file then takes its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first = -1, True

        def until(part: int) -> list[str]:
            nonlocal now, first
            out = []
            while now < part:
                out += [closes + ","] if now >= 0 else ["{"]
                now, first = now + 1, True
                out.append(opens[now])
            return out

        for b in batches:
            text = []
            for part, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if part == len(opens):
                    continue
                text += until(part)
                text.append(line if first else f",{line}")
                first = False
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array([*until(len(opens) - 1), closes + "}"], pa.string())], ["value"])

    spark, folder = lines.sparkSession, f"{path}.parts"
    # A last row, so that there is a task where there are no lines.
    lines = lines.union(spark.range(1).select(F.lit(len(opens)), F.lit("")))
    lines.repartition(1).sortWithinPartitions("part", "line").mapInArrow(run, "value string").write.mode("overwrite").text(folder)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    (part,) = [f.getPath() for f in fs.listStatus(hadoop(folder)) if f.getPath().getName().startswith("part-")]
    fs.delete(hadoop(path), True)
    fs.rename(part, hadoop(path))
    fs.delete(hadoop(folder), True)


def _json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})


def write_document(tables: dict[str, DataFrame], path: str) -> None:
    """One JSON object with an array of records for each table, as the viewer fetches it."""
    parts = [df.select(F.lit(k).alias("part"), _json(df.columns).alias("line")) for k, df in enumerate(tables.values())]
    _one_file(reduce(DataFrame.union, parts), [f"{json.dumps(name)}:[" for name in tables], "]", path)


def write_keyed(df: DataFrame, key: str, path: str) -> None:
    """One JSON object with a record for each key."""
    name = F.regexp_replace(F.to_json(F.struct(F.col(key).alias("k"))), r'^\{"k":|\}$', "")
    _one_file(df.select(F.lit(0).alias("part"), F.concat(name, F.lit(":"), _json(df.columns)).alias("line")), [""], "", path)


def read_keyed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON object that has one for each key."""
    kind = f"map<string,struct<{', '.join(':'.join(f.split(maxsplit=1)) for f in schema.split(', '))}>>"
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("key", "x")).select("x.*")
