"""Statistics of the concept graph over atomic edges and stances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import domains as D
from colloquy.functions.text import mean_of, polarity_sign, present

TRIPLE = ("source_node_id", "target_node_id", "relation")


def _mean_sign() -> Column:
    return F.sum(polarity_sign(F.col("polarity"))) / F.count(F.lit(1))


def aggregate_edges(edges: DataFrame) -> DataFrame:
    """One row for each (source, target, relation), null ends included: counts, shares of the closed enumerations in one
    pass, mean polarity and confidence. Share columns are named after dimension and value."""
    total = F.count(F.lit(1))
    shares = [(F.count_if(F.col(c) == v) / total).alias(f"{c}_{v}") for c, values in (("stance", D.STANCES), ("explicitness", D.EXPLICITNESS), ("polarity", D.POLARITIES)) for v in values]
    return edges.groupBy(*TRIPLE).agg(
        total.alias("mention_count"),
        F.countDistinct("participant_id").alias("unique_speakers"),
        F.countDistinct("table_id").alias("unique_tables"),
        F.countDistinct("round_id").alias("unique_rounds"),
        *shares,
        _mean_sign().alias("mean_polarity"),
        mean_of(F.col("confidence")).alias("mean_confidence"),
    )


def edge_distributions(edges: DataFrame, columns: tuple[str, ...] = ("stance", "explicitness", "polarity")) -> DataFrame:
    """The same shares in long form: (source, target, relation, dimension, value, mentions, share), only what occurs."""
    long = edges.select(*TRIPLE, F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in columns])).alias("x"))
    n = long.groupBy(*TRIPLE, "x.dimension", "x.value").agg(F.count(F.lit(1)).alias("mentions"))
    return n.withColumn("share", F.col("mentions") / F.sum("mentions").over(Window.partitionBy(*TRIPLE, "dimension")))


def evidence_samples(edges: DataFrame, n: int = 5, order: str = "edge_id") -> DataFrame:
    """The first n evidence texts of each triple, in order."""
    w = Window.partitionBy(*TRIPLE).orderBy(order)
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(*TRIPLE, "rank", "evidence_text")


def edge_speakers(edges: DataFrame) -> DataFrame:
    return edges.groupBy(*TRIPLE).agg(F.array_sort(F.collect_set("participant_id")).alias("speaker_ids"))


def mentions_of(edges: DataFrame, stances: DataFrame | None = None, *more: str) -> DataFrame:
    """(node_id, sign, *more) for each end of an edge, and each stance's concept; null and empty ids count for nothing."""
    out = edges.select(F.explode(F.array("source_node_id", "target_node_id")).alias("node_id"), polarity_sign(F.col("polarity")).alias("sign"), *more)
    if stances is not None:
        out = out.union(stances.select("concept_node_id", polarity_sign(F.col("polarity")), *more))
    return out.where(present(F.col("node_id")))


def node_weights(edges: DataFrame, registry: DataFrame, stances: DataFrame | None = None) -> DataFrame:
    """Every node of the registry, and any other that is mentioned, with its mentions: ends of edges (both of a loop), and
    stances if given. Nodes without mentions have weight 0."""
    n = mentions_of(edges, stances).groupBy("node_id").agg(F.count(F.lit(1)).alias("weight"))
    nodes = registry.select("node_id", "label", "type")
    return nodes.join(n, "node_id", "left").withColumn("weight", F.coalesce("weight", F.lit(0)).cast("long"))


def node_polarity(edges: DataFrame, stances: DataFrame) -> DataFrame:
    """Mean sign over all mentions of a node, and their number."""
    return mentions_of(edges, stances).groupBy("node_id").agg((F.sum("sign") / F.count(F.lit(1))).alias("mean_polarity"), F.count(F.lit(1)).alias("mentions"))


def aggregate_stances(stances: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    return (
        stances.where(present(F.col("concept_node_id")))
        .groupBy("concept_node_id")
        .agg(total.alias("stance_count"), F.countDistinct("participant_id").alias("unique_speakers"), *[(F.count_if(F.col("polarity") == p) / total).alias(f"polarity_{p}") for p in D.POLARITIES], _mean_sign().alias("mean_polarity"))
    )


def viewer_edges(edges: DataFrame) -> DataFrame:
    """Aggregated edges as the viewer shows them. has_inferred covers near-explicit records too."""
    return edges.groupBy(*TRIPLE).agg(
        F.count(F.lit(1)).alias("mention_count"),
        F.countDistinct("participant_id").alias("unique_speakers"),
        mean_of(F.col("confidence")).alias("mean_confidence"),
        _mean_sign().alias("mean_polarity"),
        F.bool_or(F.col("explicitness").isin("inferred", "near_explicit")).alias("has_inferred"),
    )


def degrees(links: DataFrame) -> DataFrame:
    """(node_id, degree): distinct neighbours either way; a loop makes a node its own neighbour once."""
    ends = links.where(present(F.col("source_node_id")) & present(F.col("target_node_id")))
    both = ends.select(F.col("source_node_id").alias("node_id"), F.col("target_node_id").alias("other")).union(ends.select("target_node_id", "source_node_id"))
    return both.distinct().groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def top_central(scores: DataFrame, weights: DataFrame, n: int = 15, score: str = "score") -> DataFrame:
    """The n highest scores above 0 among nodes with mentions; equal ones by id."""
    seen = weights.where("weight > 0").select("node_id")
    return scores.where(F.col(score) > 0).join(seen, "node_id", "left_semi").orderBy(F.desc(score), "node_id").limit(n)


def relative_to_highest(nodes: DataFrame, column: str) -> tuple[DataFrame, Column]:
    """nodes beside the highest value of a column (at least 1), which is one row that is joined to all, and that value."""
    top = nodes.agg(F.greatest(F.coalesce(F.max(column), F.lit(1)), F.lit(1)).alias("__top")).withColumn("__all", F.lit(1))
    return nodes.withColumn("__all", F.lit(1)).join(F.broadcast(top), "__all").drop("__all"), F.col("__top")


def visual_encoding(links: DataFrame, weights: DataFrame, central: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sizes that a drawing gives to links and nodes."""
    drawn = links.select(*TRIPLE, F.least(F.greatest(F.col("mention_count").cast("double"), F.lit(2.0)), F.lit(7.0)).alias("width_by_count"), F.least(F.greatest(F.col("unique_speakers") * 1.5, F.lit(1.0)), F.lit(6.0)).alias("width_by_speakers"), (F.col("mean_confidence") * 0.65 + 0.35).alias("opacity"), F.col("has_inferred").alias("dashed"))
    weights, top = relative_to_highest(weights, "weight")
    nodes = weights.join(central.select("node_id", F.lit(True).alias("central")), "node_id", "left")
    radius = F.when(F.col("weight") > 0, F.col("weight") * 20.0 / top + 6).otherwise(4.0) + F.when(F.col("central"), 6.0).otherwise(0.0)
    return drawn, nodes.select("node_id", "weight", radius.alias("radius"), F.coalesce("central", F.lit(False)).alias("central"))


def node_links(links: DataFrame, node_id: str) -> DataFrame:
    """Links of one node with their direction; a loop is both outgoing and incoming."""
    out = links.where(F.col("source_node_id") == node_id).withColumn("direction", F.lit("outgoing"))
    return out.union(links.where(F.col("target_node_id") == node_id).withColumn("direction", F.lit("incoming")))


def edge_evidence(edges: DataFrame, demographics: DataFrame, source: str, target: str) -> DataFrame:
    """All evidence between two concepts with speaker and affiliation; a blank affiliation is Unknown, of several the least
    that is not blank counts."""
    who = demographics.groupBy("participant_id").agg(F.min(F.nullif("political_affiliation", F.lit(""))).alias("political_affiliation"))
    e = edges.where((F.col("source_node_id") == source) & (F.col("target_node_id") == target)).join(who, "participant_id", "left")
    return e.select("edge_id", "relation", "evidence_text", "speaker", F.coalesce(F.nullif("political_affiliation", F.lit("")), F.lit(D.UNKNOWN)).alias("affiliation"), "stance", "polarity")


def digraph(edges: DataFrame, registry: DataFrame, order: str = "edge_id") -> DataFrame:
    """A simple directed graph: of the records between two concepts, in order, only the last run of one relation is kept.
    Concepts without edges follow as rows without a target."""
    w = Window.partitionBy("source_node_id", "target_node_id").orderBy(order)
    e = edges.where("source_node_id is not null and target_node_id is not null")
    e = e.withColumn("__new", F.when(F.lag("relation").over(w) == F.col("relation"), 0).otherwise(1))
    e = e.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = e.groupBy("source_node_id", "target_node_id", "__run").agg(F.first("relation").alias("relation"), F.count(F.lit(1)).alias("records"), F.max(order).alias("last_record"))
    last = runs.groupBy("source_node_id", "target_node_id").agg(F.max_by(F.struct("relation", "records", "last_record"), "__run").alias("x")).select("source_node_id", "target_node_id", "x.*")
    ends = last.select("source_node_id").union(last.select("target_node_id")).distinct()
    alone = registry.select(F.col("node_id").alias("source_node_id")).join(ends, "source_node_id", "left_anti")
    none = F.lit(None).cast("string")
    return last.union(alone.select("source_node_id", none, none, F.lit(0).cast("long"), none))


def grouped_edges(edges: DataFrame, *keys: str) -> DataFrame:
    """Mentions, speakers, mean polarity, shares of assertion modes and of what is explicit, by any keys."""
    total = F.count(F.lit(1))
    return edges.groupBy(*keys).agg(
        total.alias("mentions"), F.countDistinct("participant_id").alias("speakers"), _mean_sign().alias("mean_polarity"),
        *[(F.count_if(F.col("stance") == s) / total).alias(f"share_{s}") for s in ("asserted", "rejected", "questioned")],
        (F.count_if(F.col("explicitness") == "explicit") / total).alias("share_explicit"), (F.count_if(F.col("explicitness") == "inferred") / total).alias("share_inferred"),
        F.min("round_id").alias("first_round"), F.max("round_id").alias("last_round"),
    )


def grouping_sets(edges: DataFrame, keys: tuple[str, ...] = ("relation", "table_id", "round_id")) -> DataFrame:
    """Mentions and speakers by each key alone and for the whole, in one pass."""
    sets = [[], *[[F.col(k)] for k in keys]]
    return edges.groupingSets(sets, *[F.col(k) for k in keys]).agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("participant_id").alias("speakers"))


def disagreement(edges: DataFrame) -> DataFrame:
    """Triples that some assert and others reject."""
    g = edges.groupBy(*TRIPLE).agg(F.count_if(F.col("stance") == "asserted").alias("asserted"), F.count_if(F.col("stance") == "rejected").alias("rejected"))
    return g.withColumn("disputed", (F.col("asserted") > 0) & (F.col("rejected") > 0))


def suppress_small(edges: DataFrame, least: int = 5, keys: tuple[str, ...] = TRIPLE) -> DataFrame:
    """Groups that at least `least` participants stand behind; smaller ones are not reported."""
    return edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("participant_id").alias("speakers")).where(F.col("speakers") >= least)


def round_evolution(edges: DataFrame) -> DataFrame:
    """Mentions of each triple by round, and the change since the round before in which it occurs."""
    g = edges.groupBy(*TRIPLE, "round_id").agg(F.count(F.lit(1)).alias("mentions"))
    return g.withColumn("change", F.col("mentions") - F.lag("mentions").over(Window.partitionBy(*TRIPLE).orderBy("round_id")))
