"""Mixing sources to target weights by capped water-filling and seeded repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import WORD, without, written

#: Hex digits of a document's seeded hash that make its bucket: 4096 buckets a source.
BUCKET = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources by code point, null last, take the weights in turn and share the sum of all sizes. Sources whose share
    exceeds epochs times their size are clamped there and the excess is shared again by weight until none is above.
    Clamping goes by the ratio of cap to weight, so that fixed point has a closed form: with sources in this order and
    running sums, a source is clamped if its cap is at most its share of what the ones before it leave. The order is
    taken over one row for each source, never over documents.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    s = s.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("__cap", F.col("source_size") * epochs)
    order = Window.orderBy(F.col("__cap") / F.col("__w"), "__w", F.col("source").isNull(), "source")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("__left", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("__cap").over(before), F.lit(0)))
    s = s.withColumn("__weights", F.sum("__w").over(after))
    s = s.withColumn("__clamped", F.col("__cap").cast("double") * F.col("__weights") <= F.col("__left").cast("double") * F.col("__w"))
    # What the clamped ones leave, and the weights it is shared by: those of the first source that is not clamped.
    open_ = ~F.col("__clamped")
    all_ = Window.partitionBy()
    left, by = F.max(F.when(open_, F.col("__left"))).over(all_), F.max(F.when(open_, F.col("__weights"))).over(all_)
    s = s.withColumn("target", F.when(F.col("__clamped"), F.col("__cap").cast("double")).otherwise(F.col("__w") * left.cast("double") / by))
    return s.select("source", "source_size", "target")


def _draw(id_col: Column, text: Column, seed: int) -> list[Column]:
    """A document's place in the seeded order: a hash of its id (of its text where the id is null), then of its text."""
    v = F.md5(F.coalesce(text, F.lit("")))
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.concat(F.lit("null:"), v)))).alias("__u"), v.alias("__v")]


def _cuts(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """For each source its whole repetitions and the document at which the fractional one ends, with the words taken of it.

    Sums by (source, bucket) find the bucket, its documents alone are put in order: a source of any size is spread over
    4096 buckets and only one of them is ever sorted.
    """
    t = targets.withColumn("__whole", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)))
    t = t.withColumn("__more", F.round("target").cast("long") - F.col("__whole") * F.col("source_size"))
    bucket = F.substring("__u", 1, BUCKET)
    sums = sized.groupBy("source", bucket.alias("__b")).agg(F.sum("size").alias("__n"))
    w = Window.partitionBy("__s").orderBy("__b")
    sums = sums.withColumn("__s", F.struct("source")).withColumn("__upto", F.sum("__n").over(w))
    sums = sums.join(t.select(F.col("source").alias("__source"), "__more"), F.col("source").eqNullSafe(F.col("__source")))
    edge = sums.where((F.col("__upto") >= F.col("__more")) & (F.col("__upto") - F.col("__n") < F.col("__more")))
    edge = edge.select("__source", "__b", "__more", (F.col("__upto") - F.col("__n")).alias("__base"))
    inside = sized.join(edge, F.col("source").eqNullSafe(F.col("__source")) & (bucket == F.col("__b")))
    # Rows equal in id and text are one entry of the order, and share what it takes.
    inside = inside.groupBy("__source", "__more", "__base", "__u", "__v").agg(F.sum("size").alias("__n"), F.count(F.lit(1)).alias("__rows"))
    w = Window.partitionBy("__source").orderBy("__u", "__v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("__upto", F.col("__base") + F.sum("__n").over(w))
    cut = inside.where((F.col("__upto") >= F.col("__more")) & (F.col("__upto") - F.col("__n") < F.col("__more")))
    part = F.floor((F.col("__more") - F.col("__upto") + F.col("__n")) / F.col("__rows"))
    cut = cut.groupBy(F.col("__source").alias("__cut_source")).agg(F.min(F.struct(F.col("__u").alias("u"), F.col("__v").alias("v"))).alias("__cut"), F.min(part).alias("__part"))
    return t.withColumnRenamed("source", "__source").join(cut, F.col("__source").eqNullSafe(F.col("__cut_source")), "left").drop("__cut_source", "__more")


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with size, source_size, target and taken: the words that the mix takes of each document, repeats counted.

    Every document of a source is taken floor(target / source_size) times whole; the rest of the target goes to documents
    in an order seeded by id until it is used up, the last of them taken in part. So a source's taken words are its
    target, rounded, and no document exceeds epochs times its size.

    Null text has size 0; a null source is a source of its own, after the others; null ids go by their text. Rows equal in
    id and text are taken alike: where the target is reached among k of them, each takes a k-th, and up to k - 1 words are
    missing. Sources without words have target 0. An empty table
    gives an empty result. Columns of docs stay, but for those that the result adds.
    """
    docs = without(docs, "size", "source_size", "target", "taken")
    text = F.col(text_col)
    sized = written(docs.select(F.col(source_col).alias("source"), _size(text).alias("size"), *_draw(F.col(id_col), text, seed)), "mix-sizes")
    return _taken(docs.select("*", _size(text).alias("size"), *_draw(F.col(id_col), text, seed)), sized, weights, epochs, source_col).select(*[F.col(f"`{c}`") for c in docs.columns], "size", "source_size", "target", "taken")


def _taken(rows: DataFrame, sized: DataFrame, weights: tuple[int, ...], epochs: int, source_col: str) -> DataFrame:
    cuts = written(_cuts(sized, written(source_targets(sized, weights, epochs), "mix-targets")), "mix-cuts")
    rows = rows.join(cuts, F.col(source_col).eqNullSafe(F.col("__source")))
    here, cut = F.struct(F.col("__u").alias("u"), F.col("__v").alias("v")), F.col("__cut")
    more = F.when(cut.isNull(), F.lit(0)).when(here < cut, F.col("size")).when(here == cut, F.least("__part", "size")).otherwise(F.lit(0))
    return rows.withColumn("taken", (F.col("__whole") * F.col("size") + more).cast("long"))


def mix_taken(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, seed: int = 0) -> DataFrame:
    """(doc_id, size, source_size, target, taken) as mix_sources gives them, from one pass over the texts."""
    sized = written(docs.select("doc_id", "source", _size(F.col("text")).alias("size"), *_draw(F.col("doc_id"), F.col("text"), seed)), "mix-sizes")
    return _taken(sized, sized, weights, epochs, "source").select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, seed: int = 0) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each repetition; a last one in part has the first words,
    one space apart."""
    rows = mix_sources(docs, weights, epochs, seed)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0))
    rest = F.col("taken") - whole * F.col("size")
    head = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("__rest").cast("int")), " ")
    rows = rows.withColumn("__rest", rest)
    copies = F.array_repeat(F.col("text"), whole.cast("int"))
    parts = F.when(F.col("__rest") > 0, F.concat(copies, F.array(head))).otherwise(copies)
    return rows.withColumn("text", F.explode(parts)).select(*[F.col(f"`{c}`") for c in docs.columns])
