from __future__ import annotations

from datetime import datetime, timedelta

from colloquy.operators.graph import TRIPLE
from colloquy.streaming.live import live_edges, live_rounds, live_utterances

SEG = "table_id string, round_id string, participant_id string, speaker string, start_time double, end_time double, transcript string, at timestamp"
T0 = datetime(2024, 1, 1)


def run(df, mode, name, spark):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


def test_utterances_end_with_the_next_turn_or_when_idle(spark, tmp_path):
    def seg(table, speaker, start, end, text):
        return (table, "1", "p", speaker, float(start), float(end), text, T0 + timedelta(seconds=start))

    batches = [[seg("t", "A", 0, 1, "a"), seg("t", "A", 2, 3, "b")], [seg("t", "A", 4, 5, "c"), seg("t", "B", 6, 7, "d")], [seg("u", "C", 4000, 4001, "e")], [seg("u", "C", 8000, 8001, "f")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SEG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{k}"))
    s = spark.readStream.schema(SEG).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = sorted((r.table_id, r.speaker, r.text, r.raw_segment_count) for r in run(live_utterances(s), "append", "live_turns", spark))
    assert ("t", "A", "a b c", 3) in got and ("t", "B", "d", 1) in got and ("u", "C", "e", 1) in got


def test_running_edges(spark, tmp_path):
    schema = "source_node_id string, target_node_id string, relation string, participant_id string, polarity string, created_at timestamp"
    for k in range(2):
        spark.createDataFrame([("a", "b", "causes", f"p{k}", "supports", T0 + timedelta(minutes=30 * k))], schema).write.mode("append").parquet(str(tmp_path / "e"))
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    rows = run(live_edges(read()), "complete", "live_edges", spark)
    assert [(tuple(r[k] for k in TRIPLE), r.mention_count, r.unique_speakers, r.mean_polarity) for r in rows] == [(("a", "b", "causes"), 2, 2, 1.0)]
    rows = run(live_rounds(read()), "append", "live_rounds", spark)
    assert [r.mention_count for r in rows] == [1]
