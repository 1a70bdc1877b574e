"""Quality figures of extracted records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import domains as D
from colloquy.functions.text import mean_of, present
from colloquy.operators.filters import with_group


def distributions(edges: DataFrame, columns: tuple[str, ...] = ("relation", "stance", "explicitness", "polarity")) -> DataFrame:
    """(dimension, value, mentions) of each column, in one pass."""
    long = edges.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in columns])).alias("x")).select("x.*")
    return long.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("mentions"))


def confidence_stats(edges: DataFrame) -> DataFrame:
    return edges.agg(mean_of(F.col("confidence")).alias("mean"), F.median("confidence").alias("median"), F.min("confidence").alias("min"), F.max("confidence").alias("max"))


def causal_value_share(edges: DataFrame) -> DataFrame:
    n, causal, value = F.count(F.lit(1)), F.count_if(F.col("relation").isin(*D.CAUSAL_RELATIONS)), F.count_if(F.col("relation").isin(*D.VALUE_RELATIONS))
    share = lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0))
    return edges.agg(causal.alias("causal"), value.alias("value_stance"), (n - causal - value).alias("other"), share(causal).alias("causal_fraction"), share(value).alias("value_fraction"))


def grounding_coverage(edges: DataFrame, stances: DataFrame) -> DataFrame:
    """One row: shares of edge ends and of stances with a concept, and distinct concepts."""
    ends = edges.select(F.explode(F.array("source_node_id", "target_node_id")).alias("id"), F.lit(True).alias("end")).union(stances.select("concept_node_id", F.lit(False)))
    ok = F.when(present(F.col("id")), F.col("id"))
    share = lambda c: F.coalesce(F.try_divide(F.count_if(c & present(F.col("id"))), F.count_if(c)), F.lit(0.0))
    return ends.agg(share(F.col("end")).alias("edge_endpoints_grounded_fraction"), share(~F.col("end")).alias("stances_grounded_fraction"), F.countDistinct(ok).alias("unique_grounded_concepts"))


def precision_recall(predicted: DataFrame, gold: DataFrame, keys: tuple[str, ...] = ("source", "relation", "target")) -> DataFrame:
    """One row of precision, recall and F1 over distinct keys, case aside; any keys make it a figure for another stage."""
    low = lambda df: df.select(*[F.lower(F.coalesce(k, F.lit(""))).alias(k) for k in keys]).distinct()
    both = low(predicted).withColumn("p", F.lit(1)).join(low(gold).withColumn("g", F.lit(1)), list(keys), "full")
    n = both.agg(F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("true_positives"), F.count("p").alias("predicted_count"), F.count("g").alias("gold_count"))
    n = n.withColumn("precision", F.coalesce(F.try_divide("true_positives", "predicted_count"), F.lit(0.0))).withColumn("recall", F.coalesce(F.try_divide("true_positives", "gold_count"), F.lit(0.0)))
    return n.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def gold_triples(gold: DataFrame) -> DataFrame:
    """(source, relation, target) from rows of annotated turns."""
    return gold.select(F.explode("annotations.edges").alias("e")).select("e.source", "e.relation", "e.target")


def affiliation_filters(edges: DataFrame, stances: DataFrame, demographics: DataFrame, attribute: str = "political_affiliation") -> DataFrame:
    """(value, edge_count, speaker_count): all participants, and each group that has edges, Unknown aside."""
    people = edges.select("participant_id").union(stances.select("participant_id")).distinct()
    e = with_group(edges, demographics, attribute).groupBy("group").agg(F.count(F.lit(1)).alias("edge_count"))
    s = with_group(people, demographics, attribute).groupBy("group").agg(F.count(F.lit(1)).alias("speaker_count"))
    groups = e.where(F.col("group") != D.UNKNOWN).join(s, "group", "left").select(F.col("group").alias("value"), "edge_count", F.coalesce("speaker_count", F.lit(0)).alias("speaker_count"))
    total = edges.agg(F.count(F.lit(1)).alias("edge_count")).join(people.agg(F.count(F.lit(1)).alias("speaker_count")))
    return total.select(F.lit("all").alias("value"), "edge_count", "speaker_count").union(groups)


def metadata(edges: DataFrame, stances: DataFrame) -> DataFrame:
    """(kind, value): the speakers of edges and stances, and the tables and rounds of edges."""
    people = edges.select("participant_id").union(stances.select("participant_id"))
    kinds = (("speaker", people), ("table", edges.select("table_id")), ("round", edges.select("round_id")))
    parts = [df.distinct().toDF("value").select(F.lit(k).alias("kind"), "value") for k, df in kinds]
    return parts[0].union(parts[1]).union(parts[2])


def totals(edges: DataFrame, stances: DataFrame, registry: DataFrame) -> DataFrame:
    parts = (("edges", edges), ("stances", stances), ("nodes", registry))
    rows = [df.agg(F.count(F.lit(1)).alias("total")).select(F.lit(k).alias("kind"), "total") for k, df in parts]
    return rows[0].union(rows[1]).union(rows[2])


def stage_keys() -> dict[str, tuple[Column, Column]]:
    """For each stage of the pipeline which records say something about it, and what: labels count case aside."""
    low = lambda c: F.lower(F.col(c))
    ends, yes = (low("source_label"), low("target_label")), F.lit(True)
    key = lambda *c: F.array(F.concat_ws("|", *[F.coalesce(x, F.lit("")) for x in c]))
    of = lambda *c: key(*ends, *map(F.col, c))
    return {
        "concept_extraction": (yes, F.array(*ends)),
        "concept_normalisation": (yes, F.concat(key(ends[0], F.col("source_node_id")), key(ends[1], F.col("target_node_id")))),
        "edge_detection": (yes, key(F.least(*ends), F.greatest(*ends))),
        "relation_classification": (yes, of("relation")),
        "causal_direction": (F.col("relation").isin(*D.CAUSAL_RELATIONS), of()),
        "stance_classification": (yes, of("relation", "stance")),
        "explicitness_classification": (yes, of("relation", "explicitness")),
    }


def stage_scores(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(stage, true_positives, predicted_count, gold_count, precision, recall, f1) of the seven stages, over distinct keys, in
    one pass; 0 where a share has no denominator. Both sides are edges."""
    each = F.array(*[F.struct(F.lit(name).alias("stage"), F.when(about, keys).otherwise(F.array().cast("array<string>")).alias("keys")) for name, (about, keys) in stage_keys().items()])
    long = lambda df, p: df.select(F.explode(each).alias("x")).select("x.stage", F.explode("x.keys").alias("key"), F.lit(p).alias("p"))
    seen = long(predicted, True).union(long(gold, False)).groupBy("stage", "key").agg(F.bool_or("p").alias("p"), F.bool_or(~F.col("p")).alias("g"))
    n = seen.groupBy("stage").agg(F.count_if(F.col("p") & F.col("g")).alias("true_positives"), F.count_if("p").alias("predicted_count"), F.count_if("g").alias("gold_count"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    n = n.withColumns({"precision": share("true_positives", "predicted_count"), "recall": share("true_positives", "gold_count")})
    return n.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
