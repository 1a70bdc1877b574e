"""Checking, verifying and deduplicating extracted records, and reviewing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import domains as D
from colloquy.functions.text import contains_evidence, polarity_sign, stripped

EDGE = "struct<source_label:string,source_type:string,source_concept_id:string,relation:string,target_label:string,target_type:string,target_concept_id:string,evidence_text:string,stance:string,polarity:string,explicitness:string,confidence:double>"
STANCE = "struct<concept_label:string,concept_type:string,concept_id:string,polarity:string,evidence_text:string,explicitness:string,confidence:double>"
RESULT = f"struct<edges:array<{EDGE}>,stances:array<{STANCE}>>"


def parse_response(raw: Column) -> Column:
    """A model's answer as RESULT, code fences removed; null if it is no JSON object."""
    bare = F.regexp_replace(F.trim(raw), r"(?s)^```[A-Za-z]*\s*|\s*```$", "")
    is_object = F.startswith(F.get_json_object(bare, "$"), F.lit("{"))  # null where it doesn't parse
    return F.when(is_object, F.from_json(bare, RESULT))


def valid_edge(x: Column) -> Column:
    ok = x["source_label"].isNotNull() & x["target_label"].isNotNull() & x["evidence_text"].isNotNull() & x["source_type"].isin(*D.NODE_TYPES) & x["target_type"].isin(*D.NODE_TYPES) & x["relation"].isin(*D.RELATIONS) & x["stance"].isin(*D.STANCES)
    return F.coalesce(ok & _valid(x), F.lit(False))


def valid_stance(x: Column) -> Column:
    return F.coalesce(x["concept_label"].isNotNull() & x["evidence_text"].isNotNull() & x["concept_type"].isin(*D.NODE_TYPES) & _valid(x), F.lit(False))


def _valid(x: Column) -> Column:
    return F.coalesce(x["polarity"], F.lit("neutral")).isin(*D.POLARITIES) & x["explicitness"].isin(*D.EXPLICITNESS) & x["confidence"].between(0, 1)


def extracted(windows: DataFrame, raw: str = "raw", strict: bool = True) -> DataFrame:
    """Windows with their parsed records. With strict, one invalid record makes a whole window's answer invalid, and
    the window has no records; else only the invalid ones go. `valid` says whether all were."""
    w = windows.withColumn("__r", parse_response(F.col(raw)))
    edges, stances = F.coalesce("__r.edges", F.array().cast(f"array<{EDGE}>")), F.coalesce("__r.stances", F.array().cast(f"array<{STANCE}>"))
    w = w.withColumn("edges", edges).withColumn("stances", stances)
    w = w.withColumn("valid", F.col("__r").isNotNull() & F.forall("edges", valid_edge) & F.forall("stances", valid_stance)).drop("__r")
    if strict:
        return w.withColumn("edges", F.when(F.col("valid"), F.col("edges")).otherwise(F.array())).withColumn("stances", F.when(F.col("valid"), F.col("stances")).otherwise(F.array()))
    return w.withColumn("edges", F.filter("edges", valid_edge)).withColumn("stances", F.filter("stances", valid_stance))


def verified(records: DataFrame, text: str = "window_text", evidence: str = "evidence_text") -> DataFrame:
    """Records whose evidence is, white space and case aside, part of the window's text."""
    return records.where(contains_evidence(F.col(text), F.col(evidence)))


def _first(records: DataFrame, key: list[Column], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return records.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def dedup_edges(edges: DataFrame, order: list[str]) -> DataFrame:
    """The first record of each (source label, relation, target label, table, evidence), case aside."""
    return _first(edges, [F.lower("source_label"), F.col("relation"), F.lower("target_label"), F.col("table_id"), stripped(F.lower("evidence_text"))], order)


def dedup_stances(stances: DataFrame, order: list[str]) -> DataFrame:
    """The first record of each (concept label, polarity, participant, evidence), case aside."""
    return _first(stances, [F.lower("concept_label"), F.col("polarity"), F.col("participant_id"), stripped(F.lower("evidence_text"))], order)


def raw_edges(edges: DataFrame) -> DataFrame:
    return edges.select("edge_id", "source_node_id", "target_node_id", "relation", "speaker", "participant_id", "table_id", "round_id", "evidence_text", "stance", "polarity", polarity_sign(F.col("polarity")).alias("polarity_sign"), "explicitness", "confidence")


def raw_stances(stances: DataFrame) -> DataFrame:
    return stances.select("stance_id", "concept_node_id", "concept_label", "concept_type", "polarity", polarity_sign(F.col("polarity")).alias("polarity_sign"), "speaker", "participant_id", "table_id", "round_id", "evidence_text", "explicitness", "confidence")


def reviewed(edges: DataFrame, reviews: DataFrame) -> DataFrame:
    """Edges after review: each edge's latest decision (by reviewed_at, then review_id) approves it, rejects it, edits its
    relation or flips its direction; edges without one stay as they are."""
    w = Window.partitionBy("edge_id").orderBy(F.desc("reviewed_at"), F.desc("review_id"))
    last = reviews.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").select("edge_id", "action", "new_relation")
    e = edges.join(last, "edge_id", "left").where(F.coalesce(F.col("action") != "reject", F.lit(True)))
    flip, edit = F.coalesce(F.col("action") == "flip", F.lit(False)), F.coalesce(F.col("action") == "edit", F.lit(False))
    swap = {"source_node_id": F.when(flip, F.col("target_node_id")).otherwise(F.col("source_node_id")), "target_node_id": F.when(flip, F.col("source_node_id")).otherwise(F.col("target_node_id"))}
    return e.withColumns(swap | {"relation": F.when(edit, F.coalesce("new_relation", "relation")).otherwise(F.col("relation"))}).select(*edges.columns, F.coalesce("action", F.lit("unreviewed")).alias("review"))


def without_participants(facts: DataFrame, gone: DataFrame) -> DataFrame:
    """Facts without anything that the given participants said."""
    return facts.join(gone.select("participant_id").distinct(), "participant_id", "left_anti").select(*facts.columns)


#: Phrases that mark a causal statement, with the relation each stands for.
CUES = {
    "causes": "causes", "leads to": "causes", "results in": "causes", "increases": "increases", "reduces": "reduces",
    "prevents": "prevents", "drives": "causes", "makes people": "causes", "because of": "causes", "due to": "causes",
    "as a result of": "causes", "reinforces": "reinforces", "undermines": "undermines",
}


def causal_cues(turns: DataFrame) -> DataFrame:
    """(turn_id, cue, relation, left, right) for each causal phrase in a turn's sentences, and the words around it up to the
    phrases beside it."""
    sentence = F.explode(F.filter(F.split("text", r"[.!?\n]+"), lambda s: F.trim(s) != ""))
    pattern = rf"(?i)\b(?:{'|'.join(sorted(CUES, key=len, reverse=True))})\b"
    t = turns.select("turn_id", sentence.alias("sentence"))
    t = t.select("turn_id", F.regexp_extract_all("sentence", F.lit(pattern), F.lit(0)).alias("cues"), F.split("sentence", pattern).alias("parts")).where(F.size("cues") > 0)
    t = t.select("turn_id", "parts", F.posexplode("cues").alias("at", "cue")).withColumn("cue", F.lower("cue"))
    relation = F.create_map(*[F.lit(x) for kv in CUES.items() for x in kv])[F.col("cue")]
    return t.select("turn_id", "cue", relation.alias("relation"), F.trim(F.get("parts", F.col("at"))).alias("left"), F.trim(F.get("parts", F.col("at") + 1)).alias("right"))
