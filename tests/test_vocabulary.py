from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import vocabulary as V
from colloquy.plans import models as M
from colloquy.plans import pipeline as P


def naive(vectors, distance):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    d = 1 - unit @ unit.T
    groups = [[i] for i in range(len(vectors))]
    while len(groups) > 1:
        best = min(((np.mean([d[x, y] for x in a for y in b]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        if best[0] >= distance:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("seed", range(5))
def test_average_linkage_against_a_naive_one(seed):
    x = np.random.default_rng(seed).normal(size=(25, 4))
    got = V.average_linkage(x, 0.45)
    assert {frozenset(np.flatnonzero(got == c).tolist()) for c in set(got)} == naive(x, 0.45)


@pytest.mark.parametrize("distance", [0.05, 0.2, 0.6, 1.1])
def test_average_linkage_over_several_components(distance):
    rng = np.random.default_rng(9)
    x = np.concatenate([c + 0.15 * rng.normal(size=(12, 6)) for c in rng.normal(size=(5, 6))])
    got = V.average_linkage(x, distance)
    assert {frozenset(np.flatnonzero(got == c).tolist()) for c in set(got)} == naive(x, distance)
    assert got.tolist() == np.unique(got[np.sort(np.unique(got, return_index=True)[1])], return_inverse=True)[1][got].tolist()


def test_average_linkage_of_many_labels_takes_seconds():
    x = np.random.default_rng(3).normal(size=(4000, 16))
    start = time.perf_counter()
    V.average_linkage(x, 0.45)
    assert time.perf_counter() - start < 20


def test_average_linkage_does_not_merge_at_the_threshold():
    x = np.array([[1.0, 0.0], [0.0, 1.0]])
    assert len(set(V.average_linkage(x, 1.0))) == 2
    assert len(set(V.average_linkage(x, 1.01))) == 1


MENTION = "label string, type string, place struct<part:int,record:string,end:int>"


def test_candidates_take_the_majority_type_and_first_form(spark):
    rows = [(" Tax ", "topic", (0, "1", 0)), ("tax", "policy", (0, "1", 1)), ("TAX", "policy", (0, "2", 0)), ("speaker_1", "actor", (0, "3", 0)), (" speaker_2", "actor", (0, "3", 1)), ("", "actor", (1, "1", 0)), ("jobs", "topic", (1, "2", 0)), ("jobs", "value", (1, "3", 0))]
    m = spark.createDataFrame(rows, MENTION)
    got = {r.norm: (r.label, r.type, r.mentions) for r in V.candidates(m).collect()}
    assert got == {"tax": ("Tax", "policy", 3), "speaker_2": ("speaker_2", "actor", 1), "jobs": ("jobs", "topic", 2)}
    first = {r.norm: r.type for r in V.collected_mentions(m).collect()}
    assert first == {"tax": "topic", "speaker_1": "actor", "speaker_2": "actor", "jobs": "topic"}


def test_nearest_prefers_the_type_then_falls_back(spark):
    vocab = spark.createDataFrame([("c0", "x", [1.0, 0.0], 0), ("c1", "y", [0.8, 0.6], 1), ("c2", "y", [0.8, 0.6], 2)], "concept string, type string, embedding array<double>, ord int")
    m = spark.createDataFrame([("a", "y", [1.0, 0.0]), ("b", "z", [1.0, 0.0]), ("c", "x", [0.0, 1.0])], "key string, type string, embedding array<double>")
    for block in (1, 2, 4096):
        got = {r.key: (r.concept, round(r.similarity, 6), r.grounded) for r in V.nearest(m, vocab, 0.8, block).collect()}
        assert got == {"a": ("c1", 0.8, True), "b": ("c0", 1.0, True), "c": ("c0", 0.0, False)}


def test_label_beats_alias_and_the_last_label_and_first_alias_win(spark):
    vocab = spark.createDataFrame([("c0", "Tax", ["levy"], 0), ("c1", "tax", ["levy", "jobs"], 1), ("c2", "jobs", ["x"], 2)], "concept_id string, label string, aliases array<string>, ord int")
    m = spark.createDataFrame([("tax",), ("levy",), ("jobs",), ("new",)], "norm string")
    got = {r.norm: (r.method, r.concept_id) for r in V.exact_matches(m, vocab).collect()}
    assert got == {"tax": ("exact_label", "c1"), "levy": ("alias", "c0"), "jobs": ("exact_label", "c2"), "new": (None, None)}


def test_whole_pipeline_offline(spark):
    rows = [("u1", "t", "1", "p1", "Ann", "tax cuts help\njobs grow fast", 1.0), ("u2", "t", "1", "p2", "Bob", "Tax Cuts hurt", 2.0), ("u3", "t", "1", "p1", "Ann", "jobs grow fast", 3.0), ("u4", "t", "1", "p2", "Bob", "x", 4.0)]
    turns = spark.createDataFrame(rows, "turn_id string, table_id string, round_id string, participant_id string, speaker string, text string, start_time double")
    edges, stances = P.extract(turns, M.WordPairs())
    assert edges.select("edge_id").distinct().count() == edges.count() > 0
    vocab = P.mine_vocabulary(edges, stances, M.HashedLetters())
    assert vocab.where("size(aliases) = 0").count() == 0
    e, s, report, grown = P.ground(edges, stances, vocab, M.HashedLetters())
    assert e.where("source_node_id is null or target_node_id is null").count() == 0
    assert s.where("concept_node_id is null").count() == 0
    assert grown.count() >= vocab.count()
    again, _ = P.extract(turns, M.WordPairs())
    assert sorted(r.edge_id for r in again.collect()) == sorted(r.edge_id for r in edges.collect())
    by_turn, _ = P.extract(turns, M.WordPairs(), attribution="evidence_turn")
    assert {r.source_label: r.speaker for r in by_turn.collect()}["tax"] == "Ann"


def test_attempts_retry_unreadable_answers_only():
    calls, slept = [], []
    answers = iter(["no", "```json\n{}\n```"])
    assert M.attempts(lambda: calls.append(1) or next(answers), sleep=slept.append) == "```json\n{}\n```"
    assert len(calls) == 2 and slept == [2.0]
    with pytest.raises(ValueError):
        M.attempts(lambda: "no", sleep=slept.append)

    def broken():
        raise OSError("down")

    with pytest.raises(OSError):
        M.attempts(broken, sleep=slept.append)


def test_a_failing_extractor_costs_its_window(spark):
    class Picky:
        def __call__(self, prompt, text):
            if "bad" in text:
                raise OSError("down")
            return "{}"

    w = spark.createDataFrame([("p", "good"), ("p", "bad")], "prompt string, window_text string")
    assert {r.window_text: (r.raw, r.error) for r in M.answers(w, Picky()).collect()} == {"good": ("{}", None), "bad": (None, "OSError: down")}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], MENTION)
    assert V.candidates(empty).count() == V.collected_mentions(empty).count() == 0
    v = spark.createDataFrame([], "type string, norm string, embedding array<double>")
    assert V.clusters(v).count() == 0
    assert V.merge_proposals(v.select("type", F.lit(1).cast("long").alias("key"), "embedding"), 0.5).count() == 0
