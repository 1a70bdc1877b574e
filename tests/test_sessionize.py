from __future__ import annotations

import random

import pytest

from colloquy.operators.sessionize import pseudonymised, turn_windows, utterances

COLS = "ord int, table_id string, round_id string, room_id string, participant_id string, speaker string, start_time double, end_time double, transcript string"


def seg(k, speaker, start, end, text, table="t1", round_id="1"):
    return (k, table, round_id, "r1", "p1", speaker, float(start), float(end), text)


def turns(spark, rows, gap=1.5):
    """Of both ways to find islands, which agree."""
    df = spark.createDataFrame(rows, COLS)
    out = utterances(df, gap).orderBy("table_id", "round_id", "start_time", "turn_id").collect()
    for bucket in (1.0, 7.5):
        assert utterances(df, gap, bucket=bucket).orderBy("table_id", "round_id", "start_time", "turn_id").collect() == out
    return [(r.table_id, r.speaker, r.text, r.start_time, r.end_time, r.raw_segment_count) for r in out]


def test_same_speaker_merges_within_gap(spark):
    got = turns(spark, [seg(0, "Alice", 1, 2, "Hello"), seg(1, "Alice", 2.5, 3.5, "how are you"), seg(2, "Bob", 4, 5, "Fine")])
    assert got == [("t1", "Alice", "Hello how are you", 1.0, 3.5, 2), ("t1", "Bob", "Fine", 4.0, 5.0, 1)]


def test_gap_splits_but_its_bound_merges(spark):
    assert len(turns(spark, [seg(0, "A", 1, 2, "a"), seg(1, "A", 5, 6, "b")])) == 2
    assert len(turns(spark, [seg(0, "A", 1, 2, "a"), seg(1, "A", 3.5, 6, "b")])) == 1


def test_speakers_tables_and_rounds_never_merge(spark):
    assert len(turns(spark, [seg(0, "A", 1, 2, "a"), seg(1, "B", 2, 3, "b"), seg(2, "A", 3, 4, "c")])) == 3
    assert len(turns(spark, [seg(0, "A", 1, 2, "a"), seg(1, "A", 2, 3, "b", table="t2"), seg(2, "A", 2, 3, "c", round_id="2")])) == 3


def test_overlap_disorder_nulls_and_blank_texts(spark):
    got = turns(spark, [seg(2, None, 4, 5, " "), seg(1, None, 3, 9, " b "), seg(0, None, 1, 2, "a")])
    assert got == [("t1", None, "a b", 1.0, 5.0, 3)]  # the end is the last segment's, not the latest


def test_empty_table(spark):
    assert turns(spark, []) == []


def test_random_against_a_loop(spark):
    rng = random.Random(3)
    rows = [seg(k, rng.choice("AB"), rng.randint(0, 40), rng.randint(0, 45), str(k), table=rng.choice("xy")) for k in range(200)]
    want = []
    for table in "xy":
        now = None
        for r in sorted((r for r in rows if r[1] == table), key=lambda r: (r[6], r[0])):
            if now and now[0] == r[5] and r[6] - now[3] <= 1.5:
                now[1] += " " + r[8]
                now[3], now[4] = r[7], now[4] + 1
            else:
                if now:
                    want.append((table, *now))
                now = [r[5], r[8], r[6], r[7], 1]
        if now:
            want.append((table, *now))
    assert sorted(turns(spark, rows)) == sorted(want)


@pytest.mark.parametrize("n,size,overlap", [(1, 3, 1), (3, 3, 1), (4, 3, 1), (7, 3, 1), (5, 2, 0), (6, 3, 2), (9, 2, -2), (5, 1, 4), (0, 3, 1)])
def test_windows_against_a_loop(spark, n, size, overlap):
    rows = [("t", "1", f"u{k:02d}", float(k)) for k in range(n)]
    t = spark.createDataFrame(rows, "table_id string, round_id string, turn_id string, start_time double")
    step = max(1, size - overlap)
    want = sorted((i, k) for i in range(0, n, step) for k in range(i, min(i + size, n)))
    assert sorted((r.window_start, r.position) for r in turn_windows(t, size, overlap).collect()) == want


def test_pseudonyms_are_stable_and_distinct(spark):
    t = spark.createDataFrame([("Ann",), ("Bob",), ("Ann",), (None,)], "speaker string")
    got = [r.speaker for r in pseudonymised(t, "salt").collect()]
    assert got[0] == got[2] != got[1] and all(g.startswith("Speaker_") and len(g) == 16 for g in got)
    assert "speaker_original" not in pseudonymised(t, "salt").columns
