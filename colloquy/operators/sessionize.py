"""Utterances from timed segments, and windows of consecutive turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import pseudonym, record_id, stripped


def _islands(segments: DataFrame, gap, group: tuple[str, ...], order: str) -> DataFrame:
    """segments with __island, by one running sum over each group."""
    w = Window.partitionBy(*group).orderBy("start_time", order)
    same = F.lag("speaker").over(w).eqNullSafe(F.col("speaker")) & (F.col("start_time") - F.lag("end_time").over(w) <= gap)
    starts = F.when(F.row_number().over(w) == 1, 1).when(F.coalesce(same, F.lit(False)), 0).otherwise(1)
    return segments.withColumn("__new", starts).withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def _renamed(key: list[str]) -> list[Column]:
    return [F.col(k).alias(f"__of_{k}") for k in key]


def _islands_by_bucket(segments: DataFrame, gap, group: tuple[str, ...], order: str, bucket) -> DataFrame:
    """The same where a group may be too large for one task: rows are put in order within buckets of start_time only.
    What a bucket needs of earlier ones, the last segment and the number of islands so far, comes from one row a bucket."""
    key = [*group, "__bucket"]
    s = segments.withColumn("__bucket", F.floor(F.col("start_time") / bucket))
    place = F.struct("start_time", order)
    before = Window.partitionBy(*group).orderBy("__bucket")
    ends = s.groupBy(*key).agg(F.max_by(F.struct("speaker", "end_time"), place).alias("__end"))
    ends = ends.select(*_renamed(key), F.lag("__end").over(before).alias("__carried"), (F.row_number().over(before) == 1).alias("__first"))
    w = Window.partitionBy(*key).orderBy("start_time", order)
    on = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in key]
    s = s.join(ends, on)
    at_start = F.row_number().over(w) == 1
    speaker = F.when(at_start, F.col("__carried.speaker")).otherwise(F.lag("speaker").over(w))
    end = F.when(at_start, F.col("__carried.end_time")).otherwise(F.lag("end_time").over(w))
    same = speaker.eqNullSafe(F.col("speaker")) & (F.col("start_time") - end <= gap)
    starts = F.when(at_start & F.col("__first"), 1).when(F.coalesce(same, F.lit(False)), 0).otherwise(1)
    s = s.withColumn("__new", starts).withColumn("__inside", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    counts = s.groupBy(*key).agg(F.sum("__new").alias("__n"))
    counts = counts.select(*_renamed(key), F.coalesce(F.sum("__n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__so_far"))
    s = s.drop(*[f"__of_{k}" for k in key]).join(counts, on)
    return s.select(*segments.columns, (F.col("__so_far") + F.col("__inside")).alias("__island"))


def utterances(segments: DataFrame, gap, group: tuple[str, ...] = ("table_id", "round_id"), order: str = "ord", discussion_id: str = "", bucket=None) -> DataFrame:
    """Merges consecutive segments of one speaker into turns.

    Within a group segments go by start_time, then by `order`. A segment goes on the turn before it if the speaker is the
    same (two nulls are) and it starts at most `gap` after the end of the segment before; overlaps merge too. A turn has
    the first segment's attributes, the last one's end, the stripped non-empty texts one space apart, and the number of
    segments. Islands and their aggregate share one exchange on the group. With `bucket` (a length of time), a group is
    put in order bucket by bucket, so that one group may hold much of the table; the result is the same.
    """
    s = _islands(segments, gap, group, order) if bucket is None else _islands_by_bucket(segments, gap, group, order, bucket)
    place = F.struct("start_time", order)
    text = F.when(stripped(F.col("transcript")) != "", stripped(F.col("transcript")))
    t = s.groupBy(*group, "__island").agg(
        F.min_by(F.struct("room_id", "participant_id", "speaker"), place).alias("__first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("start_time", order, text.alias("text"))))), lambda x: x["text"]), " ").alias("text"),
        F.min("start_time").alias("start_time"),
        F.max_by("end_time", place).alias("end_time"),
        F.count(F.lit(1)).alias("raw_segment_count"),
    )
    return t.select(record_id(*[F.col(g) for g in group], F.col("__island")).alias("turn_id"), F.lit(discussion_id).alias("discussion_id"), *group, "__first.*", "text", "start_time", "end_time", "raw_segment_count")


def pseudonymised(turns: DataFrame, salt: str, keep_original: bool = False) -> DataFrame:
    """Replaces speakers by pseudonyms. The real name is kept only on request, for callers that need it in memory."""
    out = turns.withColumn("speaker_original", F.col("speaker")) if keep_original else turns
    return out.withColumn("speaker", pseudonym(F.col("speaker"), salt))


def turn_windows(turns: DataFrame, size: int = 3, overlap: int = 1, group: tuple[str, ...] = ("table_id", "round_id"), order: tuple[str, ...] = ("start_time", "turn_id")) -> DataFrame:
    """Turns with the windows they are in: window_start is the position of a window's first turn.

    Windows start at every multiple of max(1, size - overlap) below the number of turns; those at the end may be short.
    A turn may be in several windows and, with a negative overlap, in none.
    """
    step = max(1, size - overlap)
    pos = (F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1).cast("int")
    low = F.greatest(F.lit(0), F.ceil((F.col("position") - size + 1) / step)).cast("int")
    high = F.floor(F.col("position") / step).cast("int")
    starts = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    return turns.withColumn("position", pos).withColumn("window_start", F.explode(starts)).withColumn("window_start", F.col("window_start") * step)


def window_texts(windows: DataFrame, group: tuple[str, ...] = ("table_id", "round_id")) -> DataFrame:
    """One row for each window: its turns' ids in order, text, prompt excerpt, and the first turn's attribution."""
    turns = F.array_sort(F.collect_list(F.struct("position", "turn_id", "speaker", "participant_id", "text")))
    w = windows.groupBy(*group, "window_start").agg(turns.alias("__t"))

    def joined(of, sep: str) -> Column:
        return F.array_join(F.transform("__t", of), sep)

    return w.select(
        *group,
        "window_start",
        F.transform("__t", lambda t: t["turn_id"]).alias("turn_ids"),
        joined(lambda t: t["text"], " ").alias("window_text"),
        joined(lambda t: F.concat(F.lit("["), t["speaker"], F.lit("]: "), t["text"]), "\n").alias("excerpt"),
        F.col("__t")[0]["speaker"].alias("speaker"),
        F.col("__t")[0]["participant_id"].alias("participant_id"),
    )


def busiest_tables(turns: DataFrame, n: int = 5, least_words: int = 4) -> DataFrame:
    """The n tables with most turns of at least least_words words; of equal ones the one whose first such turn is first."""
    from colloquy.functions.text import word_count

    t = turns.where(word_count(F.col("text")) >= least_words).groupBy("table_id").agg(F.count(F.lit(1)).alias("turns"), F.min(F.struct("start_time", "turn_id")).alias("first"))
    return t.orderBy(F.desc("turns"), "first", "table_id").limit(n).select("table_id", "turns")


def sample_turns(turns: DataFrame, n: int = 120, seed: int = 42, least_words: int = 6) -> DataFrame:
    """A seeded sample without replacement of turns that have something to label."""
    from colloquy.functions.text import word_count

    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("turn_id")), 256)
    return turns.where(word_count(F.col("text")) >= least_words).orderBy(order, "turn_id").limit(n)


def labelling_template(turns: DataFrame, n: int = 120, seed: int = 42) -> DataFrame:
    """A sampled turn for each row, with an empty annotation for people to fill in."""
    edge = "array<struct<source:string,relation:string,target:string>>"
    empty = F.struct(F.array().cast("array<string>").alias("concepts"), F.array().cast(edge).alias("edges"), F.lit("").alias("notes"))
    return sample_turns(turns, n, seed).select("turn_id", "speaker", "table_id", "round_id", "text", empty.alias("annotations"))
