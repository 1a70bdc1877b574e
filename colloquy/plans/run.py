"""Whole runs: from a transcript to the exported graph, and again from stored records without any extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.config import Settings
from colloquy.operators import compare as C
from colloquy.operators import evaluate as E
from colloquy.operators import sessionize as S
from colloquy.operators import vocabulary as V
from colloquy.plans import pipeline as P
from colloquy.plans import viewer
from colloquy.plans.models import Embedder, Extractor, Namer
from colloquy.sources import files


def metrics(edges: DataFrame, stances: DataFrame, demographics: DataFrame, gold: DataFrame | None = None, attribute: str = "political_affiliation") -> dict[str, DataFrame]:
    """Quality figures; without edges only the totals."""
    out = {"totals": E.totals(edges, stances, edges.limit(0)).where("kind <> 'nodes'")}
    if edges.isEmpty():
        return out
    out |= {"distributions": E.distributions(edges), "confidence_stats": E.confidence_stats(edges), "causal_vs_value_share": E.causal_value_share(edges), "grounding_coverage": E.grounding_coverage(edges, stances)}
    report = C.group_report(edges, stances, demographics, attribute, top_n=10)
    if "overlap" in report:
        out |= {"group_overlap": report["overlap"].withColumns({"group_a": F.lit(report["group_a"]), "group_b": F.lit(report["group_b"])}), "top_divergent_concepts": report["concept_divergence"]}
    if gold is not None:
        predicted = edges.select(F.col("source_label").alias("source"), "relation", F.col("target_label").alias("target"))
        out["gold_comparison"] = E.precision_recall(predicted, E.gold_triples(gold))
    return out


def mine(edges: DataFrame, stances: DataFrame, embedder: Embedder, s: Settings, namer: Namer | None = None) -> DataFrame:
    return P.mine_vocabulary(edges, stances, embedder, s.cluster_similarity, s.merge_similarity, namer)


def acquire_vocabulary(turns: DataFrame, out: str, extractor: Extractor, embedder: Embedder, s: Settings, namer: Namer | None = None, remine: bool = False, bootstrap: bool = False) -> DataFrame:
    """The stored vocabulary unless it is to be mined again; else one mined from stored records, or, with bootstrap or
    without such records, from those of the busiest tables. What is mined is stored."""
    spark, path = turns.sparkSession, f"{out}/concept_vocab"
    if files.exists(spark, path) and not remine:
        return spark.read.schema(files.VOCAB_SCHEMA).json(path)
    if not bootstrap and files.exists(spark, f"{out}/edges"):
        edges, stances = spark.read.parquet(f"{out}/edges"), spark.read.parquet(f"{out}/stances")
    else:
        some = turns.join(S.busiest_tables(turns, s.seed_tables).select("table_id"), "table_id", "left_semi")
        edges, stances = P.extract(some, extractor, None, s.window_size, s.window_overlap, s.attribution, f"{out}/seed_answers")
    files.write_table(mine(edges, stances, embedder, s, namer), path)
    return spark.read.schema(files.VOCAB_SCHEMA).json(path)


def finish(edges: DataFrame, stances: DataFrame, vocab: DataFrame, turns: DataFrame, demographics: DataFrame, out: str, embedder: Embedder, s: Settings, gold: DataFrame | None = None) -> viewer.Store:
    """Grounds stored records, and writes registry, report, graph document, labelling template and metrics."""
    spark = edges.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        files.write_table(df, f"{out}/{name}")
        return spark.read.schema(df.schema).json(f"{out}/{name}")

    e, st, _, grown = P.ground(edges, stances, vocab, embedder, s.ground_similarity, lambda report: stored(report, "grounding_report"))
    for name, df in (("grounded_edges", e), ("grounded_stances", st)):
        files.write_facts(df, f"{out}/{name}")
    files.write_table(V.registry_of(stored(grown, "grown_vocab")), f"{out}/node_registry")
    registry = spark.read.schema(files.REGISTRY_SCHEMA).json(f"{out}/node_registry")
    store = viewer.Store(spark.read.parquet(f"{out}/grounded_edges"), spark.read.parquet(f"{out}/grounded_stances"), registry, demographics)
    document = viewer.graph_document(store)
    viewer.document_json(document, f"{out}/graph_data")
    files.write_document(document, f"{out}/graph_data.json")
    files.write_keyed(registry, "node_id", f"{out}/node_registry.json")
    files.write_table(S.labelling_template(turns, s.labelling_sample, s.labelling_seed), f"{out}/labeling_template")
    viewer.document_json(metrics(store.edges, store.stances, demographics, gold), f"{out}/metrics")
    return store


def run_pipeline(spark: SparkSession, segments: DataFrame, demographics: DataFrame, out: str, extractor: Extractor, embedder: Embedder, s: Settings = Settings(), namer: Namer | None = None, busiest: int | None = None, remine: bool = False, bootstrap: bool = False, gold: DataFrame | None = None) -> viewer.Store:
    """Segments to graph: utterances, pseudonyms, vocabulary, extraction (of the busiest tables, or all), grounding, export."""
    turns = S.pseudonymised(S.utterances(segments, s.gap_seconds), s.salt)
    files.write_turns(turns, f"{out}/canonical_turns")
    turns = spark.read.parquet(f"{out}/canonical_turns")
    vocab = acquire_vocabulary(turns, out, extractor, embedder, s, namer, remine, bootstrap)
    chosen = turns if busiest is None else turns.join(S.busiest_tables(turns, busiest).select("table_id"), "table_id", "left_semi")
    edges, stances = P.extract(chosen, extractor, vocab, s.window_size, s.window_overlap, s.attribution, f"{out}/answers")
    files.write_facts(edges, f"{out}/edges")
    files.write_facts(stances, f"{out}/stances")
    return post_process(spark, demographics, out, embedder, s, gold)


def post_process(spark: SparkSession, demographics: DataFrame, out: str, embedder: Embedder, s: Settings = Settings(), gold: DataFrame | None = None, remine: bool = False, namer: Namer | None = None) -> viewer.Store:
    """Everything after extraction, from what a run has stored."""
    edges, stances = spark.read.parquet(f"{out}/edges"), spark.read.parquet(f"{out}/stances")
    if remine:
        files.write_table(mine(edges, stances, embedder, s, namer), f"{out}/concept_vocab")
    vocab = spark.read.schema(files.VOCAB_SCHEMA).json(f"{out}/concept_vocab")
    return finish(edges, stances, vocab, spark.read.parquet(f"{out}/canonical_turns"), demographics, out, embedder, s, gold)
