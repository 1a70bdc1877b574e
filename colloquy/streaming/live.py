"""Live versions: utterances from a stream of segments, and running edge statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import polarity_sign
from colloquy.operators.graph import TRIPLE

_TURN = "table_id string, round_id string, participant_id string, speaker string, text string, start_time double, end_time double, raw_segment_count long"


def live_utterances(segments: DataFrame, gap: float = 1.5, idle: str = "5 minutes", delay: str = "1 minute") -> DataFrame:
    """Turns from a stream of (table_id, round_id, participant_id, speaker, start_time, end_time, transcript, at): a turn
    comes out when another segment ends it, or when the watermark has passed its group for `idle`.

    State is one open turn for each (table, round). Segments of a batch are put in order of start; one older than the open
    turn's start starts a turn of its own, as an ended turn is not opened again.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    span = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        now = list(state.get) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(*key, *now)] if now else [], columns=[c.split()[0] for c in _TURN.split(", ")])
            return
        rows = pd.concat(list(batches)).sort_values(["start_time", "end_time"], kind="stable")
        for r in rows.itertuples(index=False):
            text = (r.transcript or "").strip()
            if now is not None and r.speaker == now[1] and r.start_time >= now[3] and r.start_time - now[4] <= gap:
                now[2], now[4], now[5] = " ".join(x for x in (now[2], text) if x), r.end_time, now[5] + 1
            else:
                if now is not None:
                    done.append((*key, *now))
                now = [r.participant_id, r.speaker, text, r.start_time, r.end_time, 1]
        state.update(tuple(now))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(rows["at"].max().timestamp() * 1000)) + span)
        yield pd.DataFrame(done, columns=[c.split()[0] for c in _TURN.split(", ")])

    grouped = segments.withWatermark("at", delay).groupBy("table_id", "round_id")
    return grouped.applyInPandasWithState(run, _TURN, "participant_id string, speaker string, text string, start_time double, end_time double, raw_segment_count long", "append", GroupStateTimeout.EventTimeTimeout)


def live_edges(edges: DataFrame) -> DataFrame:
    """Running mentions and mean polarity of each triple, for update or complete mode. Speakers are counted approximately,
    as exact distinct counts have no bounded state."""
    return edges.groupBy(*TRIPLE).agg(F.count(F.lit(1)).alias("mention_count"), F.approx_count_distinct("participant_id").alias("unique_speakers"), (F.sum(polarity_sign(F.col("polarity"))) / F.count(F.lit(1))).alias("mean_polarity"))


def live_rounds(edges: DataFrame, window: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Mentions of each triple by window of event time `created_at`; late records within `delay` count."""
    return edges.withWatermark("created_at", delay).groupBy(F.window("created_at", window), *TRIPLE).agg(F.count(F.lit(1)).alias("mention_count"))
