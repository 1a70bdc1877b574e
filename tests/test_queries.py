"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from conftest import SMALL, same
from test_vocabulary import naive

from colloquy.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    if name in ORACLE_SQL:
        same(df, duck, ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_clusters_against_a_naive_version(spark):
    """Average linkage within each type, from all distances."""
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    by_type = defaultdict(list)
    for r in rows:
        by_type[str(r.label)].append((r.vec_id, np.array(r.embedding, float)))
    got = defaultdict(set)
    for r in QUERIES["clusters"](spark, SMALL).collect():
        got[r.type, r.cluster].add(r.key)
    want = set()
    for kind, items in by_type.items():
        items.sort(key=lambda x: x[0])
        for g in naive(np.array([v for _, v in items]), 1 - 0.15):
            want.add((kind, frozenset(items[i][0] for i in g)))
    assert {(kind, frozenset(keys)) for (kind, _), keys in got.items()} == want and all(head == min(keys) for (_, head), keys in got.items())


#: Queries whose rows on the smallest tables would prove nothing if they were fewer.
KINDS = {"grounding_methods": 4, "table_stance_filter": 1, "grown_vocabulary": 14, "merge_proposals": 1, "invalid_records": 1, "speaker_labels_left_out": 40}


@pytest.mark.parametrize("name", sorted(KINDS))
def test_queries_have_what_they_are_about(spark, name):
    assert QUERIES[name](spark, SMALL).count() >= KINDS[name]


def test_entry_has_rows_and_all_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
