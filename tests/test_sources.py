from __future__ import annotations

import json

from colloquy.plans import viewer
from colloquy.queries import PICK, Tables
from colloquy.sources import files

from conftest import SMALL


def test_transcript_rows_are_trimmed_and_blank_ones_dropped(spark, tmp_path):
    (tmp_path / "a.csv").write_text(' table_id ,iteration_cycle,speaker,start_time,end_time,transcript,other\n t1 ,1,Ann,0.5,1, Hello ,x\nt1,1,Ann,1,2,"  ",x\nt1,1,Bob,bad,2,"multi\nline",x\n')
    got = files.read_segments(spark, str(tmp_path / "a.csv")).orderBy("ord").collect()
    assert [(r.table_id, r.round_id, r.speaker, r.start_time, r.transcript) for r in got] == [("t1", "1", "Ann", 0.5, "Hello"), ("t1", "1", "Bob", None, "multi\nline")]
    assert "other" not in got[0].asDict()


def test_cohort_files_merge_in_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Participant id,Political affiliation,Sex\np1,Left,F\np2,Right,\n,X,M\n")
    (tmp_path / "b.csv").write_text("participant_id,U.s. political affiliation,Age,Ethnicity simplified\np1, Centre ,44,E1\np3,,20,\n")
    (tmp_path / "c.csv").write_text("name,Sex\np1,M\n")
    got = {r.participant_id: tuple(r)[1:] for r in files.read_demographics(spark, [str(tmp_path / f) for f in ("c.csv", "b.csv", "a.csv")]).collect()}
    assert got == {"p1": ("Centre", "F", "44", "E1"), "p2": ("Right", None, None, None), "p3": (None, None, "20", None)}


def test_json_records_round_trip(spark, tmp_path):
    edge = {"edge_id": "e1", "source_node": {"label": "a", "type": "topic"}, "target_node": {"label": "b", "type": "value"}, "relation": "causes", "confidence": 0.5, "turn_ids": ["u1"]}
    (tmp_path / "edges.json").write_text(json.dumps([edge]))
    e = files.read_edges(spark, str(tmp_path / "edges.json")).collect()[0]
    assert (e.source_label, e.target_type, e.turn_ids) == ("a", "value", ["u1"])
    assert files.read_stances(spark, str(tmp_path / "missing.json")).count() == 0
    gold = {"turn_id": "u1", "annotations": {"concepts": [], "edges": [{"source": "A", "relation": "causes", "target": "b"}], "notes": ""}}
    (tmp_path / "gold.jsonl").write_text(json.dumps(gold) + "\n\n")
    from colloquy.operators.evaluate import gold_triples

    assert [tuple(r) for r in gold_triples(files.read_gold(spark, str(tmp_path / "gold.jsonl"))).collect()] == [("A", "causes", "b")]


def test_written_turns_have_no_real_names(spark, tmp_path):
    t = spark.createDataFrame([("u", "t", "1", "S", "Ann", 0.0)], "turn_id string, table_id string, round_id string, speaker string, speaker_original string, start_time double")
    files.write_turns(t, str(tmp_path / "turns"))
    assert "speaker_original" not in spark.read.parquet(str(tmp_path / "turns")).columns


def test_views_and_document(spark, tmp_path):
    store = Tables(spark, SMALL).store
    view = viewer.single_view(store, PICK)
    assert view["nodes"].count() == store.registry.count()
    two = viewer.compare_view(store, PICK, viewer.Selection())
    assert two["links"].where("presence = 'a'").count() == 0
    viewer.document_json(viewer.graph_document(store), str(tmp_path / "doc"))
    assert spark.read.json(str(tmp_path / "doc" / "raw_edges")).count() == store.edges.count()
    tables = viewer.graph_document(store) | {"empty": store.edges.limit(0)}
    files.write_document(tables, str(tmp_path / "graph.json"))
    doc = json.loads((tmp_path / "graph.json").read_text())
    assert {k: len(v) for k, v in doc.items()} == {k: df.count() for k, df in tables.items()}
    assert set(doc["raw_edges"][0]) == set(tables["raw_edges"].columns)  # nulls too
    assert sorted(p.name for p in tmp_path.iterdir() if "graph" in p.name) in (["graph.json"], [".graph.json.crc", "graph.json"])


def test_registry_as_an_object_by_id(spark, tmp_path):
    r = spark.createDataFrame([('n"1', "a", "topic", ["A", None]), ("n2", None, "value", [])], files.REGISTRY_SCHEMA)
    path = str(tmp_path / "registry.json")
    files.write_keyed(r, "node_id", path)
    assert json.loads((tmp_path / "registry.json").read_text())['n"1'] == {"node_id": 'n"1', "label": "a", "type": "topic", "aliases": ["A", None]}
    assert sorted(map(str, files.read_keyed(spark, path, files.REGISTRY_SCHEMA).collect())) == sorted(map(str, r.collect()))
    files.write_keyed(r.limit(0), "node_id", path)
    assert json.loads((tmp_path / "registry.json").read_text()) == {}


def test_rows_go_by_their_place_in_files(spark, tmp_path):
    """However a file is split: the last value of a participant wins, and segments keep their order."""
    (tmp_path / "a.csv").write_text("participant_id,sex\n" + "".join(f"p1,{k}\n" for k in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert files.read_demographics(spark, [str(tmp_path / "a.csv")]).collect()[0].sex == "2999"
        (tmp_path / "s.csv").write_text("table_id,transcript\n" + "".join(f"t,{k}\n" for k in range(3000)))
        got = files.read_segments(spark, str(tmp_path / "s.csv"), multiLine="false")
        assert got.rdd.getNumPartitions() > 1 and [r.transcript for r in got.orderBy("ord").collect()] == [str(k) for k in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
