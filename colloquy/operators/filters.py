"""Filters over facts as Column predicates, and segments of participants."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import domains as D
from colloquy.functions.text import age_group, without_junk


@dataclass(frozen=True)
class Selection:
    """What a view shows; None means all. segment maps dimensions to wanted values."""

    entity_type: str | None = None
    round_id: str | None = None
    table_id: str | None = None
    participant_id: str | None = None
    min_confidence: float = 0.0
    stance: str | None = None
    show_inferred: bool = True
    segment: dict[str, str] = field(default_factory=dict)


def clean_demographics(demographics: DataFrame) -> DataFrame:
    """One row for each participant with junk values as null and the age's group."""
    return demographics.select("participant_id", without_junk(F.col("political_affiliation")).alias("political_affiliation"), age_group(F.col("age")).alias("age_group"), without_junk(F.col("sex")).alias("sex"), without_junk(F.col("ethnicity")).alias("ethnicity"))


def in_segment(facts: DataFrame, demographics: DataFrame, segment: dict[str, str]) -> DataFrame:
    """Facts of participants who have every wanted value; a missing value fails, an empty segment passes all."""
    if not segment:
        return facts
    who = clean_demographics(demographics)
    for name, value in segment.items():
        who = who.where(F.col(name) == value)
    return facts.join(who.select("participant_id").distinct(), "participant_id", "left_semi").select(*facts.columns)


def _common(s: Selection) -> Column:
    ok = F.col("confidence") >= s.min_confidence
    for name in ("round_id", "table_id", "participant_id"):
        if getattr(s, name) is not None:
            ok &= F.col(name) == getattr(s, name)
    if not s.show_inferred:
        ok &= F.col("explicitness") != "inferred"
    return ok


def _of_type(facts: DataFrame, registry: DataFrame, wanted: str, ends: list[str]) -> DataFrame:
    """Facts with any of the ends of the wanted type."""
    nodes = registry.where(F.col("type") == wanted).select("node_id").distinct()
    if len(ends) == 1:
        return facts.join(nodes.withColumnRenamed("node_id", ends[0]), ends[0], "left_semi").select(*facts.columns)
    out, hit = facts, F.lit(False)
    for e in ends:
        out = out.join(nodes.select(F.col("node_id").alias(f"__{e}")), F.col(e) == F.col(f"__{e}"), "left")
        hit = hit | F.col(f"__{e}").isNotNull()
    return out.where(hit).select(*facts.columns)


def select_edges(edges: DataFrame, registry: DataFrame, demographics: DataFrame, s: Selection = Selection(), where: Column | None = None) -> DataFrame:
    """Edges that a selection shows; `where` is any further predicate."""
    out = edges.where(_common(s)) if s.stance is None else edges.where(_common(s) & (F.col("stance") == s.stance))
    out = out if where is None else out.where(where)
    out = out if s.entity_type is None else _of_type(out, registry, s.entity_type, ["source_node_id", "target_node_id"])
    return in_segment(out, demographics, s.segment)


def select_stances(stances: DataFrame, registry: DataFrame, demographics: DataFrame, s: Selection = Selection(), where: Column | None = None) -> DataFrame:
    """The same for stance records, to which the assertion mode doesn't apply."""
    out = stances.where(_common(s))
    out = out if where is None else out.where(where)
    out = out if s.entity_type is None else _of_type(out, registry, s.entity_type, ["concept_node_id"])
    return in_segment(out, demographics, s.segment)


def with_group(facts: DataFrame, demographics: DataFrame, attribute: str = "political_affiliation") -> DataFrame:
    """Facts with the participant's value of an attribute, Unknown where there is none; of several the least."""
    who = demographics.groupBy("participant_id").agg(F.min(attribute).alias("__group"))
    return facts.join(who, "participant_id", "left").withColumn("group", F.coalesce("__group", F.lit(D.UNKNOWN))).drop("__group")


def dimension_counts(facts_participants: DataFrame, demographics: DataFrame) -> DataFrame:
    """(dimension, value, participants) over participants that speak; dimensions without values are absent."""
    who = clean_demographics(demographics).join(facts_participants.select("participant_id").distinct(), "participant_id", "left_semi")
    long = who.unpivot(["participant_id"], list(D.DIMENSIONS), "dimension", "value").where("value is not null")
    return long.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("participants"))


def describe_segment(segment: dict[str, str]) -> str:
    return ", ".join(segment[d] for d in D.DIMENSIONS if segment.get(d)) or "All participants"
