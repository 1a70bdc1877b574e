from __future__ import annotations

import json

from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.operators import compare as C
from colloquy.operators import graph as G
from colloquy.operators import records as R

GOOD = {"source_label": "a", "source_type": "topic", "relation": "causes", "target_label": "b", "target_type": "value", "evidence_text": "a b", "stance": "asserted", "polarity": "neutral", "explicitness": "explicit", "confidence": 0.5}
STANCE = {"concept_label": "a", "concept_type": "topic", "polarity": "supports", "evidence_text": "a", "explicitness": "explicit", "confidence": 1.0}


def answers(spark, *raw):
    return spark.createDataFrame(list(enumerate(raw)), "w int, raw string")


def test_a_bad_record_costs_its_window_when_strict(spark):
    rows = [
        json.dumps({"edges": [GOOD], "stances": [STANCE]}), "```json\n" + json.dumps({"edges": [GOOD], "stances": []}) + "\n```", json.dumps({"edges": [GOOD, GOOD | {"relation": "eats"}], "stances": [STANCE]}),
        json.dumps({"edges": [GOOD | {"confidence": 1.2}], "stances": []}), "no json", None, json.dumps({"edges": [], "stances": []}),
    ]
    strict = {r.w: (len(r.edges), len(r.stances), r.valid) for r in R.extracted(answers(spark, *rows)).collect()}
    assert strict == {0: (1, 1, True), 1: (1, 0, True), 2: (0, 0, False), 3: (0, 0, False), 4: (0, 0, False), 5: (0, 0, False), 6: (0, 0, True)}
    loose = {r.w: (len(r.edges), len(r.stances)) for r in R.extracted(answers(spark, *rows), strict=False).collect()}
    assert loose[2] == (1, 1) and loose[3] == (0, 0)


def test_evidence_ignores_case_and_space_and_empty_passes(spark):
    rows = [("The  Cat\nsat", "the cat"), ("The cat", "dog"), ("x", ""), (None, "a")]
    got = R.verified(spark.createDataFrame(rows, "window_text string, evidence_text string")).collect()
    assert len(got) == 2


def test_normal_label_knows_unicode_space(spark):
    rows = [(" A  b\tC\x1f\n",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(X.normal(F.col("x"))).collect()]
    assert got == ["a b c", "", None]


def test_age_groups(spark):
    rows = [("17",), ("29",), ("30-34",), ("59",), ("60",), ("x",), ("",), (None,), (" 45",)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(X.age_group(F.col("x"))).collect()]
    assert got == ["18-29", "18-29", "30-44", "45-59", "60+", None, None, None, "45-59"]


def test_polarity_labels(spark):
    rows = [(0.151,), (0.15,), (-0.2,), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x double").select(X.polarity_label(F.col("x"))).collect()]
    assert got == ["0.15 (supports)", "0.15 (neutral)", "-0.20 (opposes)", "n/a"]


EDGE = "edge_id string, source_node_id string, target_node_id string, relation string, participant_id string, table_id string, round_id string, stance string, polarity string, explicitness string, confidence double"


def edges(spark, rows):
    return spark.createDataFrame([(f"e{k}", s, t, r, p, "t", "1", "asserted", pol, "near_explicit", 0.5) for k, (s, t, r, p, pol) in enumerate(rows)], EDGE)


def test_last_run_of_a_relation_wins_in_the_digraph(spark):
    e = edges(spark, [("a", "b", "causes", "p", "neutral"), ("a", "b", "reduces", "p", "neutral"), ("a", "b", "causes", "p", "neutral"), ("a", "b", "causes", "p", "neutral"), (None, "b", "causes", "p", "neutral")])
    reg = spark.createDataFrame([("a",), ("b",), ("c",)], "node_id string")
    got = {(r.source_node_id, r.target_node_id): (r.relation, r.records) for r in G.digraph(e, reg).collect()}
    assert got == {("a", "b"): ("causes", 2), ("c", None): (None, 0)}


def test_null_ends_are_groups_but_no_nodes(spark):
    e = edges(spark, [(None, "b", "causes", "p", "supports"), (None, "b", "causes", "q", "opposes"), ("b", "b", "causes", "p", "supports"), ("", "b", "causes", "p", "supports")])
    agg = {(r.source_node_id, r.target_node_id): r.mention_count for r in G.aggregate_edges(e).collect()}
    assert agg == {(None, "b"): 2, ("b", "b"): 1, ("", "b"): 1}
    assert [(r.node_id, r.degree) for r in G.degrees(e).collect()] == [("b", 1)]


def people(spark):
    return spark.createDataFrame([("p", "X"), ("q", "Y"), ("r", None)], "participant_id string, political_affiliation string")


STANCES = "concept_node_id string, participant_id string, polarity string"


def test_one_sided_concepts_count_as_zero_only_with_compat(spark):
    e = edges(spark, [("a", "b", "causes", "p", "supports")])
    s = spark.createDataFrame([("a", "q", "opposes")], STANCES)
    got = {r.node_id: r.divergence for r in C.concept_divergence(e, s, people(spark), "X", "Y").collect()}
    assert got == {"a": 2.0, "b": 1.0}
    assert {r.node_id: r.divergence for r in C.concept_divergence(e, s, people(spark), "X", "Y", compat=False).collect()} == {"a": 2.0, "b": None}


def test_unknown_counts_as_a_group_if_it_has_edges(spark):
    e, s = edges(spark, [("a", "b", "causes", "r", "supports")]), spark.createDataFrame([("a", "q", "opposes"), ("a", "z", "opposes")], STANCES)
    assert sorted(r.group for r in C.available_groups(e, s, people(spark)).collect()) == ["Unknown", "Y"]
    assert sorted(r.group for r in C.available_groups(e, s, people(spark), compat=False).collect()) == ["Y"]
    assert C.default_groups(e, s, people(spark)) == ["Unknown", "Y"]


def test_fewer_than_two_groups_give_a_short_report(spark):
    e, s = edges(spark, [("a", "b", "causes", "p", "supports")]), spark.createDataFrame([], STANCES)
    assert set(C.group_report(e, s, people(spark))) == {"available_groups", "concept_divergence", "edge_divergence"}
    none = C.triple_overlap(C.triple_presence(edges(spark, []), people(spark), "X", "Y")).collect()[0]
    assert none.triple_jaccard == 0


def side(df, a, b):
    return df.withColumns({"in_a": F.lit(a), "in_b": F.lit(b)})


def test_facts_of_both_segments_carry_both_flags(spark):
    e = edges(spark, [("a", "b", "causes", p, "supports") for p in "ppqr"])
    who = spark.createDataFrame([("p",), ("q",)], "participant_id string"), spark.createDataFrame([("q",)], "participant_id string")
    got = sorted((r.participant_id, r.in_a, r.in_b) for r in C.flagged(e, *who, "participant_id").collect())
    assert got == [("p", True, False), ("p", True, False), ("q", True, True)]
    link = C.compare_links(C.flagged(e, *who, "participant_id")).collect()[0]
    assert (link.mention_count, link.unique_speakers, link.presence) == (4, 3, "both")


def test_compare_sums_speakers_and_keeps_the_first_means(spark):
    a, b = edges(spark, [("a", "b", "causes", "p", "supports"), (None, "b", "causes", "p", "supports")]), edges(spark, [("a", "b", "causes", "p", "opposes"), (None, "b", "causes", "q", "opposes"), ("c", "b", "causes", "p", "opposes")])
    got = {(r.source_node_id): (r.mention_count, r.unique_speakers, r.mean_polarity, r.presence, r.has_inferred) for r in C.compare_links(side(a, True, False).union(side(b, False, True))).collect()}
    assert got == {"a": (2, 2, 1.0, "both", True), None: (2, 2, 1.0, "both", True), "c": (1, 1, -1.0, "b", True)}


def test_causal_cues(spark):
    t = spark.createDataFrame([("u1", "Tax cuts lead somewhere. Cuts to youth services increases crime! It fell due to rain"), ("u2", "nothing"), ("u3", None), ("u4", "A increases B and reduces C")], "turn_id string, text string")
    got = sorted((r.cue, r.relation, r.left, r.right) for r in R.causal_cues(t).collect())
    assert got == [("due to", "causes", "It fell", "rain"), ("increases", "increases", "A", "B and"), ("increases", "increases", "Cuts to youth services", "crime"), ("reduces", "reduces", "B and", "C")]
