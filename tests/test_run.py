"""Whole runs on a small transcript."""

from __future__ import annotations

import json
import uuid
from collections import Counter

from colloquy.config import Settings
from colloquy.operators import vocabulary as V
from colloquy.plans import models as M
from colloquy.plans import pipeline as P
from colloquy.plans import run as R

SEG = "ord int, table_id string, round_id string, room_id string, participant_id string, speaker string, start_time double, end_time double, transcript string"
WHO = "participant_id string, political_affiliation string, sex string, age string, ethnicity string"


def test_a_run_and_its_second_half(spark, tmp_path):
    talk = [("tax", "cuts help many people here"), ("jobs", "growth follows tax cuts now"), ("Tax ", "Cuts hurt the schools badly"), ("jobs", "growth is slow in towns")]
    rows = [(k, f"t{k % 2}", "1", "r", f"p{k % 3}", f"Name{k % 3}", 10.0 * k, 10.0 * k + 5, f"{a} {b}") for k, (a, b) in enumerate(talk * 3)]
    segments = spark.createDataFrame(rows, SEG)
    people = spark.createDataFrame([("p0", "X", "F", "30", None), ("p1", "Y", "M", "50", None)], WHO)
    out = str(tmp_path / "out")
    store = R.run_pipeline(spark, segments, people, out, M.WordPairs(), M.HashedLetters(), Settings(salt="s"))
    assert store.edges.where("source_node_id is null").count() == 0 < store.edges.count()
    assert spark.read.parquet(f"{out}/canonical_turns").where("speaker like 'Name%'").count() == 0
    first = sorted(r.edge_id for r in store.edges.collect())
    again = R.post_process(spark, people, out, M.HashedLetters(), Settings(salt="s"))
    assert sorted(r.edge_id for r in again.edges.collect()) == first
    names = {p.name for p in (tmp_path / "out" / "metrics").iterdir()}
    assert {"totals", "distributions", "confidence_stats", "grounding_coverage", "group_overlap"} <= names
    assert spark.read.json(f"{out}/labeling_template").count() > 0
    assert set(R.metrics(store.edges.limit(0), store.stances, people)) == {"totals"}


def test_every_window_is_asked_once(spark, tmp_path):
    class Counting:
        def __init__(self, at):
            self.at = at

        def __call__(self, prompt, text):
            with open(f"{self.at}/{uuid.uuid4().hex}", "w") as f:
                f.write(text)
            if "jobs" in text and "slow" in text:
                raise OSError("down")
            return M.WordPairs()(prompt, text)

    rows = [(k, "t", "1", "r", f"p{k}", f"Name{k}", 10.0 * k, 10.0 * k + 5, f"word{k} follows here {'jobs slow' if k == 9 else ''}") for k in range(20)]
    segments, people = spark.createDataFrame(rows, SEG), spark.createDataFrame([], WHO)
    calls = tmp_path / "calls"
    calls.mkdir()
    out = str(tmp_path / "out")
    R.run_pipeline(spark, segments, people, out, Counting(str(calls)), M.HashedLetters(), Settings(salt="s"), namer())
    answers, seed = spark.read.parquet(f"{out}/answers"), spark.read.parquet(f"{out}/seed_answers")
    asked = [p.read_text() for p in calls.iterdir()]
    assert len(asked) == answers.count() + seed.count() and max(Counter(asked).values()) == 2  # with and without the vocabulary
    assert {r.error for r in answers.where("raw is null").collect()} == {"OSError: down"}
    for p in calls.iterdir():
        p.unlink()
    turns = spark.read.parquet(f"{out}/canonical_turns")
    edges, stances = P.extract(turns, Counting(str(calls)))
    assert edges.count() and stances.count() and len(list(calls.iterdir())) == answers.count()


def namer():
    return lambda batch: [(n, phrases[0], kind) for n, kind, phrases in batch]


def test_names_come_from_the_namer_or_the_most_mentioned_label(spark):
    class Upper:
        def __call__(self, batch):
            if any(t == "event" for _, t, _ in batch):
                raise OSError("down")
            return [(n, phrases[0].upper(), "topic") for n, _, phrases in batch if n != 1] + [(999, "x", "topic"), (0, "bad", "no type")][:1]

    rows = [("topic", 0, "a", "a", 5), ("topic", 0, "b", "b", 7), ("topic", 1, "c", "c", 1), ("value", 2, "d", "d", 1)]
    m = spark.createDataFrame(rows, "type string, cluster int, norm string, label string, mentions long")
    got = {(r.type, r.cluster): r.canonical_label for r in V.named(m, M.assigned_names(m, Upper(), 2)).collect()}
    assert got == {("topic", 0): "B", ("topic", 1): "c", ("value", 2): "D"}
    down = spark.createDataFrame([("event", 0, "a", "a", 5)], m.schema)
    assert [r.canonical_label for r in V.named(down, M.assigned_names(down, Upper())).collect()] == ["a"]


def test_the_response_schema_names_all_fields():
    s = json.loads(M.response_schema())
    assert set(s["required"]) == {"edges", "stances"} and "confidence" in s["properties"]["edges"]["items"]["required"]
