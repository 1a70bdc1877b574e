"""What the interactive view shows, as parameterised plans over facts and dimensions, and the exported graph document."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import polarity_label, short_label
from colloquy.operators import compare as C
from colloquy.operators import evaluate as E
from colloquy.operators import graph as G
from colloquy.operators.filters import Selection, in_segment, select_edges, select_stances
from colloquy.operators.records import raw_edges, raw_stances


@dataclass(frozen=True)
class Store:
    """Facts and dimensions that every view is made of."""

    edges: DataFrame
    stances: DataFrame
    registry: DataFrame
    demographics: DataFrame

    def compared(self, a: Selection, b: Selection) -> tuple[DataFrame, DataFrame]:
        """(edges, stances) that either selection shows, with in_a and in_b: facts are read once beside the flags. Where both
        selections differ in nothing but the participants' segment, the flags come from the participants alone."""
        same = replace(a, segment={}) == replace(b, segment={})
        if same:
            who = [in_segment(self.demographics, self.demographics, s.segment).select("participant_id").distinct() if s.segment else None for s in (a, b)]
            if None not in who:
                base = replace(a, segment={})
                return tuple(C.flagged(f, *who, "participant_id") for f in self.picked(base))
        (ea, sa), (eb, sb) = self.picked(a), self.picked(b)
        return C.flagged(self.edges, ea, eb, "edge_id"), C.flagged(self.stances, sa, sb, "stance_id")

    def picked(self, s: Selection) -> tuple[DataFrame, DataFrame]:
        return select_edges(self.edges, self.registry, self.demographics, s), select_stances(self.stances, self.registry, self.demographics, s)


def single_view(store: Store, s: Selection = Selection(), hide_isolated: bool = False) -> dict[str, DataFrame]:
    """Links, nodes and the most central nodes of one segment."""
    edges, stances = store.picked(s)
    links = G.viewer_edges(edges)
    nodes = G.node_weights(edges, store.registry, stances).join(G.node_polarity(edges, stances).drop("mentions"), "node_id", "left")
    nodes = nodes.withColumns({"polarity_label": polarity_label(F.col("mean_polarity")), "short_label": short_label(F.col("label"))})
    central = G.top_central(G.degrees(links).withColumnRenamed("degree", "score"), nodes)
    return {"links": links, "nodes": nodes.where("weight > 0") if hide_isolated else nodes, "central": central}


def compare_view(store: Store, a: Selection, b: Selection) -> dict[str, DataFrame]:
    """The same for two segments: links with presence, summed weights, divergence and differential centrality."""
    edges, stances = store.compared(a, b)
    twice = lambda facts: facts.where("in_a").drop("in_a", "in_b").unionByName(facts.where("in_b").drop("in_a", "in_b"))
    weights = G.node_weights(twice(edges), store.registry, twice(stances))
    central = G.top_central(C.differential_centrality(edges), weights)
    return {"links": C.compare_links(edges), "nodes": weights, "divergence": C.polarity_divergence(edges, stances), "central": central}


def visible(edges: DataFrame, stances: DataFrame, registry: DataFrame, shown: DataFrame) -> DataFrame:
    """(kind, total): all nodes, edges and stances, and the edges a selection shows."""
    return E.totals(edges, stances, registry).union(shown.agg(F.count(F.lit(1)).alias("total")).select(F.lit("visible").alias("kind"), "total"))


def graph_document(store: Store) -> dict[str, DataFrame]:
    """The tables of the exported document; write each, or together as JSON with document_json()."""
    report = C.group_report(store.edges, store.stances, store.demographics)
    out = {
        "nodes": G.node_weights(store.edges, store.registry), "aggregated_edges": G.aggregate_edges(store.edges), "raw_edges": raw_edges(store.edges),
        "raw_stances": raw_stances(store.stances), "stance_summary": G.aggregate_stances(store.stances), "participant_demographics": store.demographics,
        "metadata": E.metadata(store.edges, store.stances), "demographic_filters": E.affiliation_filters(store.edges, store.stances, store.demographics),
        "totals": E.totals(store.edges, store.stances, store.registry),
    }
    return out | {f"group_{k}": v for k, v in report.items() if isinstance(v, DataFrame)}


def document_json(tables: dict[str, DataFrame], path: str) -> None:
    """Each table of the document as JSON lines in a folder of its own; nothing is gathered on the driver."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
