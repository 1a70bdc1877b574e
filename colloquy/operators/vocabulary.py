"""Mining a shared concept vocabulary and grounding mentions on it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import hashed_id, is_speaker_label, normal, stripped

CLUSTER_SIMILARITY, MERGE_SIMILARITY, GROUND_SIMILARITY = 0.55, 0.88, 0.60
REPRESENTATIVES, BATCH, IN_PROMPT = 6, 40, 400


def label_mentions(edges: DataFrame, stances: DataFrame | None = None, order: str = "edge_id", stance_order: str = "stance_id") -> DataFrame:
    """(label, type, place) of each edge's source, then its target, then of stances; place gives that order."""
    e = edges.select(F.explode(F.array(*[F.struct(F.col(f"{end}_label").alias("label"), F.col(f"{end}_type").alias("type"), F.struct(F.lit(0).alias("part"), F.col(order).alias("record"), F.lit(k).alias("end")).alias("place")) for k, end in enumerate(("source", "target"))])).alias("x")).select("x.*")
    if stances is None:
        return e
    return e.union(stances.select(F.col("concept_label"), F.col("concept_type"), F.struct(F.lit(1).alias("part"), F.col(stance_order).alias("record"), F.lit(0).alias("end"))))


def _surface_forms(mentions: DataFrame) -> DataFrame:
    """(label, type, n, place): distinct surface forms, so that what follows is done once for each and not for each mention."""
    return mentions.groupBy("label", "type").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))


def candidates(mentions: DataFrame) -> DataFrame:
    """(norm, label, type, mentions): the first surface form, and the type most often given (of equal ones the first).
    Labels that name a speaker are left out, tested as they stand."""
    m = _surface_forms(mentions).where((F.col("label") != "") & ~is_speaker_label(F.col("label"))).withColumn("norm", normal(F.col("label"))).where("norm != ''")
    by_type = m.groupBy("norm", "type").agg(F.sum("n").alias("n"), F.min("place").alias("place"), F.min_by("label", "place").alias("label"))
    best = F.row_number().over(Window.partitionBy("norm").orderBy(F.desc("n"), "place"))
    first = Window.partitionBy("norm")
    out = by_type.withColumn("rank", best).withColumn("label", stripped(F.min_by("label", "place").over(first))).withColumn("mentions", F.sum("n").over(first))
    return out.where("rank = 1").select("norm", "label", "type", "mentions")


def collected_mentions(mentions: DataFrame) -> DataFrame:
    """(norm, label, type, mentions) with the first label and the first type; speaker labels stay."""
    m = _surface_forms(mentions).withColumn("norm", normal(F.col("label"))).where("norm != ''")
    return m.groupBy("norm").agg(stripped(F.min_by("label", "place")).alias("label"), F.min_by("type", "place").alias("type"), F.sum("n").alias("mentions"))


def _parts(unit: np.ndarray, distance: float, block: int = 1024) -> np.ndarray:
    """For each row the first row of its component in the graph of pairs nearer than distance; clusters never reach across
    components. Distances are taken block by block."""
    label = np.arange(len(unit))
    while True:
        new = label.copy()
        for at in range(0, len(unit), block):
            near = 1 - unit[at : at + block] @ unit.T < distance
            near[np.arange(len(near)), at + np.arange(len(near))] = True
            new[at : at + block] = np.where(near, label[None, :], len(unit)).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _linked(unit: np.ndarray, distance: float) -> np.ndarray:
    """Average linkage of one component: chains of nearest neighbours, whose ends merge. As clusters that merge never come
    nearer to others by that, a pair that is too far apart is final."""
    n = len(unit)
    d = 1 - unit @ unit.T
    np.fill_diagonal(d, np.inf)
    size, head, chain, left = np.ones(n), np.arange(n), [], np.ones(n, bool)
    while left.sum() > 1:
        if not chain:
            chain.append(int(left.argmax()))
        x = chain[-1]
        y = int(d[x].argmin())
        if len(chain) < 2 or d[x, chain[-2]] > d[x, y]:
            chain.append(y)
            continue
        y = chain[-2]
        del chain[-2:]
        i, j = min(x, y), max(x, y)
        if not d[i, j] < distance:
            left[[i, j]] = False
            d[[i, j]] = np.inf
            d[:, [i, j]] = np.inf
            chain.clear()
            continue
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        left[j] = False
        head[head == j] = i
    return head


def average_linkage(vectors: np.ndarray, distance: float) -> np.ndarray:
    """Cluster numbers by average linkage on cosine distance: the closest two clusters merge while they are nearer than
    distance. Numbers go by each cluster's first row."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    head = _parts(unit, distance)
    for first in np.flatnonzero(np.bincount(head, minlength=len(unit)) > 1):
        at = np.flatnonzero(head == first)
        head[at] = at[_linked(unit[at], distance)]
    return np.unique(head, return_inverse=True)[1]


def clusters(items: DataFrame, similarity: float = CLUSTER_SIMILARITY, key: str = "norm", group: str = "type", vector: str = "embedding") -> DataFrame:
    """(type, key, cluster): average linkage within each type; cluster is the least key of its members.

    A type is one task, which holds its vectors and the distances within one component of near pairs; so this is for
    vocabularies (tens of thousands of labels), which the number of distinct labels bounds, and not for records.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable").reset_index(drop=True)
        number = average_linkage(np.array(pdf[vector].tolist(), float), 1 - similarity) if len(pdf) > 1 else np.zeros(len(pdf), int)
        head = pdf.groupby(number)[key].transform("min")
        return pd.DataFrame({group: pdf[group].tolist(), key: pdf[key].tolist(), "cluster": head.tolist()})

    kinds = dict(items.dtypes)
    return items.select(group, key, vector).groupBy(group).applyInPandas(one, f"{group} {kinds[group]}, {key} {kinds[key]}, cluster {kinds[key]}")


def representatives(members: DataFrame, n: int = REPRESENTATIVES) -> DataFrame:
    """The n most mentioned members of each cluster, with the batch of clusters that are named together."""
    rank = F.row_number().over(Window.partitionBy("type", "cluster").orderBy(F.desc("mentions"), "norm"))
    return members.withColumn("rank", rank).where(F.col("rank") <= n)


def named(members: DataFrame, assignments: DataFrame | None = None) -> DataFrame:
    """(type, cluster, canonical_label, canonical_type): the given names, and the most mentioned label where there is none."""
    own = members.groupBy("type", "cluster").agg(F.min_by(F.struct("label", "type"), F.struct((-F.col("mentions")).alias("n"), "norm")).alias("x")).select("type", "cluster", F.col("x.label").alias("own_label"), F.col("x.type").alias("own_type"))
    if assignments is None:
        return own.withColumnsRenamed({"own_label": "canonical_label", "own_type": "canonical_type"})
    j = own.join(assignments.select("type", "cluster", "canonical_label", "canonical_type"), ["type", "cluster"], "left")
    return j.select("type", "cluster", F.coalesce("canonical_label", "own_label").alias("canonical_label"), F.coalesce("canonical_type", "own_type").alias("canonical_type"))


def vocabulary(members: DataFrame, names: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """(concept_id, label, type, aliases, mention_count): clusters of one normalised name are one concept with all their
    labels as aliases. `merged` (norm, head_group) folds names that a second clustering found to be one; the most
    mentioned name heads such a group."""
    m = members.join(names, ["type", "cluster"]).withColumn("name", normal(F.col("canonical_label")))
    first = F.struct("type", "cluster")
    by_name = m.groupBy("name").agg(F.min_by("canonical_label", first).alias("canonical_label"), F.min_by("canonical_type", first).alias("concept_type"), F.collect_set("label").alias("labels"), F.sum("mentions").alias("n"))
    if merged is not None:
        by_name = by_name.join(merged.select(F.col("norm").alias("name"), "head_group"), "name", "left").withColumn("head_group", F.coalesce("head_group", "name"))
    else:
        by_name = by_name.withColumn("head_group", F.col("name"))
    head = F.struct((-F.col("n")).alias("n"), "name")
    g = by_name.groupBy("head_group").agg(F.min_by("name", head).alias("label"), F.min_by("concept_type", head).alias("type"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("aliases"), F.sum("n").alias("mention_count"))
    return g.select(hashed_id(F.col("label")).alias("concept_id"), "label", "type", "aliases", "mention_count")


def vocabulary_block(vocab: DataFrame, most: int = IN_PROMPT) -> DataFrame:
    """(type, line) of the prompt's block: the most mentioned concepts, by type, labels in order."""
    top = vocab.orderBy(F.desc("mention_count"), "concept_id").limit(most)
    labels = F.array_join(F.array_sort(F.collect_list("label")), ", ")
    return top.groupBy("type").agg(F.concat(F.lit("["), F.first("type"), F.lit("] "), labels).alias("line"))


def exact_matches(mentions: DataFrame, vocab: DataFrame, order: str = "ord") -> DataFrame:
    """mentions with method and concept_id: by label, else by alias, else null. Of equal labels the last entry counts, of
    equal aliases the first."""
    labels = vocab.groupBy(normal(F.col("label")).alias("norm")).agg(F.max_by("concept_id", order).alias("by_label"))
    aliases = vocab.select(F.explode("aliases").alias("alias"), "concept_id", order).groupBy(normal(F.col("alias")).alias("norm")).agg(F.min_by("concept_id", order).alias("by_alias"))
    j = mentions.join(labels, "norm", "left").join(aliases, "norm", "left")
    method = F.when(F.col("by_label").isNotNull(), "exact_label").when(F.col("by_alias").isNotNull(), "alias")
    return j.select(*mentions.columns, method.alias("method"), F.coalesce("by_label", "by_alias").alias("concept_id"))


def nearest(mentions: DataFrame, vocab: DataFrame, threshold: float = GROUND_SIMILARITY, block: int = 4096) -> DataFrame:
    """mentions (key, type, embedding) with the most similar vocabulary entry (concept, type, embedding, ord): of the same
    type where any entry has it, else of all; of equal ones the first. Similarity at the threshold counts.

    The vocabulary is the stated set that all mentions meet: both sides come in blocks of about `block` vectors, each pair of
    blocks is one matrix product, and the best of a mention's blocks wins, so neither side has to fit in one task.
    """
    # Types are few, so their counts come to the driver.
    counted = lambda df: {r["type"]: r["count"] for r in df.groupBy("type").count().collect()}
    entries, asked = counted(vocab), counted(mentions)
    lefts: dict[str, int] = {t: n for t, n in asked.items() if t in entries}
    if other := sum(n for t, n in asked.items() if t not in entries):
        lefts[""] = other
        entries[""] = sum(entries.values())
    ways = lambda counts, t: F.element_at(F.create_map(*[F.lit(x) for k in lefts for x in (k, max(1, -(-counts[k] // block)))]), t) if lefts else F.lit(1)
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    place = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    known = F.coalesce(F.col("type").isin(*[t for t in lefts if t]), F.lit(False))
    left = mentions.select("key", F.when(known, F.col("type")).otherwise("").alias("__type"), "embedding")
    left = left.select("__type", place("key", ways(lefts, F.col("__type"))).alias("__i"), each(ways(entries, F.col("__type"))).alias("__j"), "key", "embedding")
    right = vocab.select(F.explode(F.array("type", F.lit("")) if "" in lefts else F.array("type")).alias("__type"), "concept", "ord", F.col("embedding").alias("entry")).where(F.col("__type").isin(*lefts))
    right = right.select("__type", each(ways(lefts, F.col("__type"))).alias("__i"), place("concept", ways(entries, F.col("__type"))).alias("__j"), "concept", "ord", "entry")
    kinds = dict(mentions.dtypes) | dict(vocab.dtypes)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(a) and len(b):
            b = b.sort_values("ord", kind="stable")
            u, v = np.array(a["embedding"].tolist(), float), np.array(b["entry"].tolist(), float)
            concept, ord_ = b["concept"].tolist(), b["ord"].tolist()
            for at in range(0, len(u), 256):
                sims = u[at : at + 256] @ v.T
                for k, row in enumerate(sims):
                    # What rounding may have put in another order is added up again, from left to right.
                    near = np.flatnonzero(row >= row.max() - 1e-9)
                    exact = [float(np.cumsum(u[at + k] * v[n])[-1]) for n in near]
                    n = int(np.argmax(exact))
                    rows.append((a["key"].iloc[at + k], exact[n], ord_[near[n]], concept[near[n]]))
        return pd.DataFrame(rows, columns=["key", "similarity", "ord", "concept"])

    key = ["__type", "__i", "__j"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(best, f"key {kinds['key']}, similarity double, ord {kinds['ord']}, concept {kinds['concept']}")
    top = found.groupBy("key").agg(F.max_by(F.struct("concept", "similarity"), F.struct("similarity", (-F.col("ord")).alias("first"))).alias("b"))
    return top.select("key", "b.concept", "b.similarity", (F.col("b.similarity") >= threshold).alias("grounded"))


def grounded(mentions: DataFrame, vocab: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    """The report: (norm, label, method, concept_id) of each mention; what matches nothing is a new concept.

    `similar` (norm, concept_id) are matches by embedding for mentions without an exact one.
    """
    m = exact_matches(mentions, vocab)
    if similar is not None:
        m = m.join(similar.select("norm", F.col("concept_id").alias("__near")), "norm", "left")
    else:
        m = m.withColumn("__near", F.lit(None).cast("string"))
    method = F.coalesce("method", F.when(F.col("__near").isNotNull(), "embedding"), F.lit("new_concept"))
    return m.select("norm", "label", "type", "mentions", method.alias("method"), F.coalesce("concept_id", "__near", hashed_id(F.col("label"))).alias("concept_id"))


def grown(vocab: DataFrame, report: DataFrame) -> DataFrame:
    """The vocabulary after grounding: aliases of embedding matches appended, then new concepts; counts of old ones stay."""
    more = report.where("method = 'embedding'").groupBy("concept_id").agg(F.array_sort(F.collect_set("label")).alias("more"))
    none = F.array().cast("array<string>")
    old = vocab.join(more, "concept_id", "left").withColumn("known", F.transform("aliases", lambda a: normal(a)))
    extra = F.filter(F.coalesce("more", none), lambda x: ~F.array_contains(F.col("known"), normal(x)))
    old = old.select("concept_id", "label", "type", F.concat("aliases", extra).alias("aliases"), F.col("mention_count").cast("long").alias("mention_count"))
    new = report.where("method = 'new_concept'").join(vocab.select("concept_id"), "concept_id", "left_anti")
    new = new.groupBy("concept_id").agg(F.min_by(F.struct("norm", "type", "label", "mentions"), "norm").alias("x"))
    return old.union(new.select("concept_id", F.col("x.norm"), F.col("x.type"), F.array("x.label"), F.col("x.mentions").cast("long")))


def grounded_edges(edges: DataFrame, label_ids: DataFrame) -> DataFrame:
    """Edges with the concept ids of their labels; null where a label has none. label_ids: (norm, concept_id)."""
    out = edges
    for end in ("source", "target"):
        ids = label_ids.select(F.col("norm").alias(f"__{end}"), F.col("concept_id").alias(f"__{end}_id"))
        out = out.withColumn("__norm", normal(F.col(f"{end}_label"))).join(ids, F.col("__norm") == F.col(f"__{end}"), "left").withColumn(f"{end}_node_id", F.col(f"__{end}_id")).drop("__norm", f"__{end}", f"__{end}_id")
    return out


def registry_of(vocab: DataFrame) -> DataFrame:
    return vocab.select(F.col("concept_id").alias("node_id"), "label", "type", "aliases")


def surface_registry(mentions: DataFrame) -> DataFrame:
    """A registry straight from labels: (node_id, label, type, aliases) with aliases in order of first use."""
    m = mentions.withColumn("norm", normal(F.col("label")))
    first = m.groupBy("norm", "label").agg(F.min("place").alias("place"), F.min_by("type", "place").alias("type"))
    g = first.groupBy("norm").agg(F.min_by("type", "place").alias("type"), F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]).alias("aliases"))
    return g.select(hashed_id(F.col("norm"), "node_").alias("node_id"), F.col("norm").alias("label"), "type", "aliases")


def merge_proposals(vectors: DataFrame, threshold: float, overrides: DataFrame | None = None, block: int = 1024) -> DataFrame:
    """(a, b, similarity) with a < b for concepts of one type at least that similar, without pairs that a reviewer
    rejected. Vectors of a type meet in pairs of blocks inside a task, and only proposals become rows."""

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, row in b.iterrows():
                left, right = row["left"], row["right"]
                u, v = np.array([x["embedding"] for x in left], float), np.array([x["embedding"] for x in right], float)
                sims = u @ v.T
                i, j = np.nonzero(sims >= threshold)
                a, c = np.array([x["key"] for x in left])[i], np.array([x["key"] for x in right])[j]
                ok = (a < c) if row["same"] else np.ones(len(a), bool)
                yield pd.DataFrame({"a": np.minimum(a, c)[ok], "b": np.maximum(a, c)[ok], "similarity": sims[i, j][ok]})

    counted = vectors.groupBy("type").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("ways"))
    g = vectors.join(counted, "type").withColumn("block", F.pmod(F.xxhash64("key"), F.col("ways"))).groupBy("type", "block").agg(F.collect_list(F.struct("key", "embedding")).alias("left"))
    other = g.select("type", F.col("block").alias("other"), F.col("left").alias("right"))
    both = g.join(other, "type").where("block <= other").select("left", "right", (F.col("block") == F.col("other")).alias("same"))
    out = both.mapInPandas(pairs, "a long, b long, similarity double")
    if overrides is not None:
        out = out.join(overrides.where("action = 'reject'").select("a", "b"), ["a", "b"], "left_anti")
    return out
