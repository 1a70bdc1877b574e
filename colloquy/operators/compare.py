"""Where the maps of two groups or segments agree and differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import domains as D
from colloquy.functions.text import polarity_sign, present
from colloquy.operators.filters import with_group
from colloquy.operators.graph import TRIPLE, mentions_of


def available_groups(edges: DataFrame, stances: DataFrame, demographics: DataFrame, attribute: str = "political_affiliation", compat: bool = True) -> DataFrame:
    """Groups that take part. With compat, Unknown is left out only if it comes from stances alone; else always."""
    e = with_group(edges, demographics, attribute).select("group").distinct()
    s = with_group(stances, demographics, attribute).select("group").distinct().where(F.col("group") != D.UNKNOWN)
    out = e.union(s).distinct()
    return out if compat else out.where(F.col("group") != D.UNKNOWN)


def default_groups(edges: DataFrame, stances: DataFrame, demographics: DataFrame, attribute: str = "political_affiliation", compat: bool = True) -> list[str]:
    """Two groups to compare: the first two by name (compat), or the two with most edges. Fewer if there are fewer."""
    if compat:
        rows = available_groups(edges, stances, demographics, attribute).orderBy("group").limit(2)
    else:
        n = with_group(edges, demographics, attribute).where(F.col("group") != D.UNKNOWN).groupBy("group").agg(F.count(F.lit(1)).alias("n"))
        rows = n.orderBy(F.desc("n"), "group").limit(2)
    return [r["group"] for r in rows.collect()]


def _signs(edges: DataFrame, stances: DataFrame, demographics: DataFrame, attribute: str) -> DataFrame:
    e = with_group(edges, demographics, attribute).select("group", F.explode(F.array("source_node_id", "target_node_id")).alias("node_id"), polarity_sign(F.col("polarity")).alias("sign"))
    s = with_group(stances, demographics, attribute).select("group", F.col("concept_node_id").alias("node_id"), polarity_sign(F.col("polarity")).alias("sign"))
    return e.union(s).where(present(F.col("node_id")))


def concept_divergence(edges: DataFrame, stances: DataFrame, demographics: DataFrame, a: str, b: str, attribute: str = "political_affiliation", compat: bool = True) -> DataFrame:
    """Mean signs of each concept in both groups and their distance, from one pass over both.

    With compat, a group that never mentions a concept has mean 0 there; else null, and so the distance.
    """
    s = _signs(edges, stances, demographics, attribute).where(F.col("group").isin(a, b))

    def of(g: str) -> tuple[Column, Column]:
        n = F.count_if(F.col("group") == g)
        mean = F.try_divide(F.sum(F.when(F.col("group") == g, F.col("sign"))), n)
        return (F.coalesce(mean, F.lit(0.0)) if compat else mean), n

    (ma, na), (mb, nb) = of(a), of(b)
    out = s.groupBy("node_id").agg(ma.alias("mean_polarity_a"), mb.alias("mean_polarity_b"), na.alias("n_a"), nb.alias("n_b"))
    return out.withColumn("divergence", F.abs(F.col("mean_polarity_a") - F.col("mean_polarity_b")))


def top_divergence(divergence: DataFrame, n: int = 40) -> DataFrame:
    return divergence.orderBy(F.desc("divergence"), F.desc(F.col("n_a") + F.col("n_b")), "node_id").limit(n)


def triple_presence(edges: DataFrame, demographics: DataFrame, a: str, b: str, attribute: str = "political_affiliation") -> DataFrame:
    """Distinct triples with both ends, and which of the groups has them."""
    e = with_group(edges, demographics, attribute).where(F.col("group").isin(a, b) & present(F.col("source_node_id")) & present(F.col("target_node_id")))
    return e.groupBy(*TRIPLE).agg(F.bool_or(F.col("group") == a).alias("in_a"), F.bool_or(F.col("group") == b).alias("in_b"))


def triple_overlap(presence: DataFrame) -> DataFrame:
    """One row: shared and one-sided triples, and their Jaccard similarity, 0 without any."""
    n = presence.agg(F.count_if(F.col("in_a") & F.col("in_b")).alias("shared_triples"), F.count_if(F.col("in_a") & ~F.col("in_b")).alias("only_a_triples"), F.count_if(~F.col("in_a") & F.col("in_b")).alias("only_b_triples"))
    total = F.col("shared_triples") + F.col("only_a_triples") + F.col("only_b_triples")
    return n.withColumn("triple_jaccard", F.coalesce(F.try_divide("shared_triples", total), F.lit(0.0)))


def edge_divergence(presence: DataFrame, a: str, b: str, n: int | None = 40) -> DataFrame:
    """One-sided triples: those of a before those of b, cut to n as a whole (so b's may be missing); all with n=None."""
    d = presence.where(F.col("in_a") != F.col("in_b")).select(*TRIPLE, F.when(F.col("in_a"), a).otherwise(b).alias("only_in"))
    return d if n is None else d.orderBy(F.when(F.col("only_in") == a, 0).otherwise(1), *TRIPLE).limit(n)


def flagged(facts: DataFrame, picked_a: DataFrame, picked_b: DataFrame, key: str) -> DataFrame:
    """facts that either segment shows, with in_a and in_b, from the keys that each shows."""
    marks = picked_a.select(key, F.lit(True).alias("__a"), F.lit(False).alias("__b")).union(picked_b.select(key, F.lit(False), F.lit(True)))
    marks = marks.groupBy(key).agg(F.bool_or("__a").alias("in_a"), F.bool_or("__b").alias("in_b"))
    return facts.join(marks, key)


def compare_links(edges: DataFrame) -> DataFrame:
    """Links of two segments side by side, from edges with in_a and in_b, in one pass. Counts and speakers are sums (a
    participant of both counts twice), means and has_inferred are the first segment's where it has the link.

    Sums are taken for each participant of a link first, so speakers are counted without a set of them."""
    micros = F.round(F.col("confidence") * 1_000_000).cast("long")
    inferred = F.col("explicitness").isin("inferred", "near_explicit")
    parts, sums, side = [], [], {}
    for g in "ab":
        mine = F.col(f"in_{g}")
        parts += [F.count_if(mine).alias(f"n_{g}"), F.sum(F.when(mine, polarity_sign(F.col("polarity")))).alias(f"sign_{g}"), F.sum(F.when(mine, micros)).alias(f"micros_{g}"), F.count(F.when(mine, micros)).alias(f"rated_{g}"), F.bool_or(F.when(mine, inferred)).alias(f"inferred_{g}")]
        sums += [F.sum(f"{c}_{g}").alias(f"{c}_{g}") for c in ("n", "sign", "micros", "rated")] + [F.bool_or(f"inferred_{g}").alias(f"inferred_{g}"), F.count_if((F.col(f"n_{g}") > 0) & F.col("participant_id").isNotNull()).alias(f"speakers_{g}")]
        side[g] = (F.try_divide(F.try_divide(f"micros_{g}", f"rated_{g}"), F.lit(1_000_000.0)).alias("mean_confidence"), F.try_divide(f"sign_{g}", f"n_{g}").alias("mean_polarity"), F.col(f"inferred_{g}").alias("has_inferred"))
    j = edges.groupBy(*TRIPLE, "participant_id").agg(*parts).groupBy(*TRIPLE).agg(*sums)
    here, there = F.col("n_a") > 0, F.col("n_b") > 0
    shown = [F.when(here, a).otherwise(b).alias(name) for a, b, name in zip(side["a"], side["b"], ("mean_confidence", "mean_polarity", "has_inferred"), strict=True)]
    return j.where(here | there).select(*TRIPLE, (F.col("n_a") + F.col("n_b")).alias("mention_count"), (F.col("speakers_a") + F.col("speakers_b")).alias("unique_speakers"), *shown, F.when(here & there, "both").when(here, "a").otherwise("b").alias("presence"))


def polarity_divergence(edges: DataFrame, stances: DataFrame) -> DataFrame:
    """Each node's distance between two segments' mean polarity, 0 standing for no mention, from facts with in_a and in_b."""
    m = mentions_of(edges, stances, "in_a", "in_b")
    mean = lambda g: F.coalesce(F.try_divide(F.sum(F.when(F.col(f"in_{g}"), F.col("sign"))), F.count_if(f"in_{g}")), F.lit(0.0))
    j = m.where("in_a or in_b").groupBy("node_id").agg(mean("a").alias("polarity_a"), mean("b").alias("polarity_b"))
    return j.withColumn("divergence", F.abs(F.col("polarity_a") - F.col("polarity_b")))


def differential_centrality(edges: DataFrame) -> DataFrame:
    """The distance of a node's degrees in two segments, each relative to the segment's highest (at least 1), from edges
    with in_a and in_b."""
    ends = edges.where(present(F.col("source_node_id")) & present(F.col("target_node_id")))
    both = ends.select(F.col("source_node_id").alias("node_id"), F.col("target_node_id").alias("other"), "in_a", "in_b").union(ends.select("target_node_id", "source_node_id", "in_a", "in_b"))
    pairs = both.groupBy("node_id", "other").agg(F.bool_or("in_a").alias("in_a"), F.bool_or("in_b").alias("in_b"))
    n = pairs.groupBy("node_id").agg(F.count_if("in_a").alias("a"), F.count_if("in_b").alias("b")).where("a + b > 0")
    top = n.agg(*[F.greatest(F.coalesce(F.max(c), F.lit(1)), F.lit(1)).alias(f"top_{c}") for c in "ab"]).withColumn("__all", F.lit(1))
    j = n.withColumn("__all", F.lit(1)).join(F.broadcast(top), "__all")
    return j.select("node_id", F.abs(F.col("a") / F.col("top_a") - F.col("b") / F.col("top_b")).alias("score"))


def group_report(edges: DataFrame, stances: DataFrame, demographics: DataFrame, attribute: str = "political_affiliation", a: str | None = None, b: str | None = None, top_n: int = 40, compat: bool = True) -> dict:
    """The comparison of two groups as a dictionary of DataFrames and names; both groups are chosen unless both are given."""
    groups = available_groups(edges, stances, demographics, attribute, compat)
    if a is None or b is None:
        two = default_groups(edges, stances, demographics, attribute, compat)
        if len(two) < 2:
            return {"available_groups": groups, "concept_divergence": None, "edge_divergence": None}
        a, b = two
    presence = triple_presence(edges, demographics, a, b, attribute)
    return {
        "attribute": attribute, "group_a": a, "group_b": b, "available_groups": groups, "overlap": triple_overlap(presence),
        "concept_divergence": top_divergence(concept_divergence(edges, stances, demographics, a, b, attribute, compat), top_n),
        "edge_divergence": edge_divergence(presence, a, b, top_n),
    }
