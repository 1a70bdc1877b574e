"""From transcript to graph: the batch pipeline, and its second half over stored records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import normal, record_id
from colloquy.operators import records as R
from colloquy.operators import sessionize as S
from colloquy.operators import vocabulary as V
from colloquy.plans.models import Embedder, Extractor, Namer, answers, assigned_names, embedded, response_schema


def prompts(windows: DataFrame, block: str) -> DataFrame:
    """window texts with the prompt: the vocabulary's block, then the excerpt."""
    return windows.withColumn("prompt", F.concat(F.lit(f"VOCABULARY\n{block}\nEXCERPT\n"), F.col("excerpt"), F.lit(f"\nAnswer with JSON of this schema alone:\n{response_schema()}")))


def prompt_block(vocab: DataFrame | None) -> str:
    """The block as one string; the number of concepts in it is bounded."""
    if vocab is None:
        return "(no vocabulary; use short neutral labels)"
    return "\n".join(r["line"] for r in V.vocabulary_block(vocab).orderBy("type").collect())


def extract(turns: DataFrame, extractor: Extractor, vocab: DataFrame | None = None, size: int = 3, overlap: int = 1, attribution: str = "first_turn", answers_at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, stances) of all windows: answered, checked, verified against the window, attributed and deduplicated.

    Every window is asked once: answers are stored as a table at answers_at, or else kept on the executors' disks, and both
    results are made of what is stored.

    attribution first_turn credits a window's first turn; evidence_turn the first turn that holds the evidence.
    """
    w = S.turn_windows(turns, size, overlap)
    texts = prompts(S.window_texts(w), prompt_block(vocab))
    given = answers(texts, extractor).drop("prompt")
    if answers_at is None:
        given = given.persist(StorageLevel.DISK_ONLY)
    else:
        given.write.mode("overwrite").parquet(answers_at)
        given = turns.sparkSession.read.schema(given.schema).parquet(answers_at)
    answered = R.extracted(given)
    place = ["table_id", "round_id", "window_start"]
    out = []
    for kind, label in (("edges", "edge_id"), ("stances", "stance_id")):
        r = answered.select(*place, "turn_ids", "window_text", "speaker", "participant_id", F.posexplode(kind).alias("item", "x"))
        r = r.select(*place, "turn_ids", "window_text", "speaker", "participant_id", "item", "x.*")
        r = R.verified(r).withColumn(label, record_id(F.lit(label), *[F.col(p) for p in place], F.col("item")))
        if attribution == "evidence_turn":
            t = w.select(*place, "position", F.col("speaker").alias("s"), F.col("participant_id").alias("p"), "text")
            own = r.join(t, place).where(F.contains(normal(F.col("text")), normal(F.col("evidence_text")))).groupBy(label).agg(F.min_by(F.struct("s", "p"), "position").alias("own"))
            r = r.join(own, label, "left").withColumn("speaker", F.coalesce("own.s", "speaker")).withColumn("participant_id", F.coalesce("own.p", "participant_id")).drop("own")
        dedup = R.dedup_edges if kind == "edges" else R.dedup_stances
        out.append(dedup(r.drop("window_text"), [*place, "item"]))
    return out[0], out[1]


def mine_vocabulary(edges: DataFrame, stances: DataFrame | None, embedder: Embedder, similarity: float = V.CLUSTER_SIMILARITY, merge: float = V.MERGE_SIMILARITY, namer: Namer | None = None) -> DataFrame:
    """Candidates, clustered within types, named (by the namer, else by their most mentioned label), and names that are
    alike folded. Clusters are kept on the executors' disks, so labels are embedded once."""
    c = V.candidates(V.label_mentions(edges, stances)).persist(StorageLevel.DISK_ONLY)
    members = c.join(V.clusters(embedded(c.select("norm", "type", "label"), embedder), similarity), ["type", "norm"]).persist(StorageLevel.DISK_ONLY)
    names = V.named(members, None if namer is None else assigned_names(members, namer)).persist(StorageLevel.DISK_ONLY)
    distinct = names.groupBy(normal(F.col("canonical_label")).alias("norm")).agg(F.min(F.struct(F.col("canonical_type").alias("type"), F.col("canonical_label").alias("label"))).alias("x")).select("norm", "x.*")
    merged = V.clusters(embedded(distinct, embedder), merge).select("norm", F.concat_ws("|", "type", "cluster").alias("head_group"))
    return V.vocabulary(members, names, merged)


def ground(edges: DataFrame, stances: DataFrame, vocab: DataFrame, embedder: Embedder | None = None, threshold: float = V.GROUND_SIMILARITY, stored: Callable[[DataFrame], DataFrame] = lambda report: report.persist(StorageLevel.DISK_ONLY)) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(edges, stances, report, vocabulary) with concept ids: by label, alias, similarity, or as new concepts. The other
    three are made of what `stored` gives for the report, so that mentions are matched and embedded once."""
    mentions = V.collected_mentions(V.label_mentions(edges, stances))
    entries = vocab.withColumn("ord", F.row_number().over(_by_count()) - 1)
    similar = None
    if embedder is not None:
        rest = V.exact_matches(mentions, entries).where("method is null")
        m = embedded(rest.select(F.col("norm").alias("key"), "type", "label"), embedder).persist(StorageLevel.DISK_ONLY)
        v = embedded(entries.select(F.col("concept_id").alias("concept"), "type", "label", "ord"), embedder).persist(StorageLevel.DISK_ONLY)
        similar = V.nearest(m, v, threshold).where("grounded").select(F.col("key").alias("norm"), F.col("concept").alias("concept_id"))
    report = stored(V.grounded(mentions, entries, similar))
    ids = report.select("norm", "concept_id")
    s = stances.withColumn("__norm", normal(F.col("concept_label"))).join(ids.toDF("__norm", "__id"), "__norm", "left").withColumn("concept_node_id", F.col("__id")).drop("__norm", "__id")
    return V.grounded_edges(edges, ids), s, report, V.grown(vocab, report)


def _by_count():
    from pyspark.sql import Window

    return Window.orderBy(F.desc("mention_count"), "concept_id")
