"""Near-duplicates of texts and vectors against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from conftest import SMALL

from colloquy.llm import near_dedup as N
from colloquy.llm.embedding_dedup import _near_bits, embedding_dedup, fit_quantiser, table_recall, table_sizes
from colloquy.llm.graph import components
from colloquy.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """{id: (n_shingles, component)} for rows with ids of their own."""
    s = {i: shingles(t) for i, t in rows}
    ids = sorted(s)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if s[a] and 100 * (n := len(s[a] & s[b])) >= 75 * (len(s[a]) + len(s[b]) - n)]
    r = roots(ids, links)
    return {i: (len(s[i]), r[i]) for i in ids}


def found(df):
    out = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}
    assert all(kept == (c == i) for i, (_, c, kept) in out.items())
    return {i: x[:2] for i, x in out.items()}


def made(n=400, seed=1):
    """Groups of copies of copies with a few words changed, a passage in every third text, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(70))
    rows, old = [], []
    for i in range(n):
        if old and rng.random() < 0.6:
            w = rng.choice(old[-40:]).split(" ")
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(rng.choice([3, 4, 5, 30, 120]))]
        text = " ".join(w)
        old.append(text)
        rows.append((i * 3 + 1, text + (" " + passage if i % 3 == 0 else "") if i % 50 else rng.choice(["", None, " \n"])))
    return rows


@pytest.mark.parametrize("blocks", [False, True])
def test_near_dedup_against_brute_force(spark, monkeypatch, blocks):
    if blocks:  # many blocks in a cluster
        monkeypatch.setattr(N, "BLOCK_TEXTS", 4)
        monkeypatch.setattr(N, "BLOCK_SHINGLES", 400)
        monkeypatch.setattr(N, "SHORT", 3)
    rows = made()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, KEPT int")
    assert found(N.near_dedup(df).drop("other")) == brute(rows)


def common_passages(n=6000, copies=60, seed=7):
    """Texts of twelve of 300 passages each, and near copies of some. The same four words stand between passages, so that
    every shingle but those of a changed word is in some 240 texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    pool = [[word() for _ in range(20)] + "and then it goes".split() for _ in range(300)]
    texts = [[w for p in rng.sample(pool, 12) for w in p] for _ in range(n)]
    ids = rng.sample(range(1 << 20), n + copies)  # in no order, as the pivots go by the bits of ids
    rows, pairs = list(zip(ids, texts, strict=False)), []
    for new, (k, w) in zip(ids[n:], rng.sample(rows, copies), strict=True):
        rows.append((new, [*w[:-1], word()]))
        pairs.append((k, new))
    return [(k, " ".join(w)) for k, w in rows], pairs


@pytest.mark.parametrize("block", [500, 3])
def test_near_copies_of_texts_of_common_passages_alone(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BAND_BLOCK", block)
    rows, pairs = common_passages() if block == 500 else common_passages(2000, 20)
    got = found(N.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [p for p in pairs if got[p[0]][1] != got[p[1]][1]] == []
    assert len({c for _, c in got.values()}) == len(rows) - len(pairs)  # nothing else is linked


def test_texts_of_a_template_are_one_cluster_but_linked_only_where_alike(spark, monkeypatch):
    """All texts share half of what they say, so one cluster of many blocks has many components; a few are linked."""
    monkeypatch.setattr(N, "BLOCK_TEXTS", 20)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    template = [word() for _ in range(80)]
    rows = [(k * 2, template + [word() for _ in range(rng.choice([14, 18, 30, 50]))]) for k in range(300)]
    rows += [(2 * k + 1, [*w[:-3], word(), word()]) for k, (_, w) in enumerate(rows[:60])]
    rows += [(1000 + k, [*template[:70], *rows[299][1][-20:], word(), word()]) for k in range(50)]  # a component of many blocks
    rows = [(k, " ".join(w)) for k, w in rows]
    assert found(N.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_filters_go_by_percent():
    assert (N.shared_least(75), N.band_rows(75)) == (12, 5)
    assert N.shared_least(100) == N.KEPT and N.shared_least(40) < N.shared_least(50) < 12
    assert all((1 - (p / 100) ** N.band_rows(p)) ** N.BANDS <= N.LOST for p in range(25, 101))


def test_union_sketches_by_blocks():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.choice(np.arange(1, 60, dtype=np.uint64), rng.integers(1, 50)))[: N.KEPT] for _ in range(80)]
    got = N.sketches_alike(sets[:30], sets[30:], 12)
    for a in range(30):
        for b in range(50):
            union = np.union1d(sets[a], sets[30 + b])[: N.KEPT]
            want = len(np.intersect1d(union, np.intersect1d(sets[a], sets[30 + b]))) * N.KEPT >= 12 * len(union)
            assert got[a, b] == want


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert found(QUERIES["op3_near_dedup"](spark, SMALL)) == brute([tuple(r) for r in docs])


def test_shingle_hashes_are_sets_of_words():
    texts = ["A b\tc\x0bd e f", "a B c d e  f\n", "a b c d e", "a b c", "a b c ", "é É ä ö ü", None, "", " \r\n", "a b c d e a b c d e a b c d e"]
    got = N.shingle_sets(texts)
    assert [len(g) for g in got] == [len(shingles(t)) for t in texts]
    assert (got[0] == got[1]).all() and got[2][0] in got[0] and (got[3] == got[4]).all()


def test_repeated_null_and_missing_rows(spark):
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(1, long), (1, long), (2, long + " x"), (None, long), (None, "alone in the world of words"), (5, None), (6, "one version here of five"), (6, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_dedup(df).collect()), key=str)
    assert len(got) == len(rows)
    assert got.count((1, 36, 1, True)) == 2 and (2, 37, 1, False) in got and (None, 36, 1, False) in got and (5, 0, 5, True) in got
    assert (None, 2, None, True) in got or (None, 2, 1, False) in got
    assert N.near_dedup(df.limit(0)).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, 501 + k) for k in range(50)] + [(7, 7)] + [(rng.randint(1000, 1200), rng.randint(1000, 1200)) for _ in range(120)]
    want = {n: r for n, r in roots({x for e in edges for x in e}, edges).items() if n != r}
    df = spark.createDataFrame([*edges, (None, 3), (900, None)], "a long, b long").repartition(5)
    assert {r.node: r.root for r in components(df).collect()} == want
    assert components(df.limit(0)).count() == 0


def vectors_brute(x):
    fit = {i: np.array(v, float) / np.abs(v).max() for i, v in x if v is not None and None not in v and np.isfinite(v).all() and np.abs(v).max() > 0}
    unit = {i: v / np.linalg.norm(v) for i, v in fit.items()}
    ids = sorted(unit)
    m = np.array([unit[i] for i in ids])
    ok = m @ m.T >= 0.9
    r = roots([i for i, _ in x], [(ids[a], ids[b]) for a, b in np.argwhere(ok) if a < b])
    return {i: (int(ok[ids.index(i)].sum() - 1) if i in unit else 0, r[i]) for i, _ in x}


def near_vectors(seed=3, dim=64):
    """Random vectors, tight and loose groups, and pairs at cosines around the threshold."""
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dim) for _ in range(300)]
    for size, noise in ((80, 0.01), (60, 0.03), (40, 0.05), (30, 0.06)):
        base = rng.normal(size=dim)
        rows += [base + noise * np.sqrt(dim) * rng.normal(size=dim) * 0.9 for _ in range(size)]
    pairs = []
    for cosine in np.linspace(0.86, 0.995, 150):
        a, b = rng.normal(size=dim), rng.normal(size=dim)
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        pairs += [a, cosine * a + np.sqrt(1 - cosine**2) * b]
    return [(k * 2 + 1, v.tolist()) for k, v in enumerate(rows + pairs)]


def test_embedding_dedup_against_brute_force(spark):
    rows = near_vectors()
    extra = [(9001, None), (9002, [0.0] * 64), (9003, [float("nan")] * 64), (9004, [1.0, 2.0]), (9005, []), (9006, [None] * 64), (9007, rows[0][1]), (9008, [x * 1e300 for x in rows[0][1]])]
    df = spark.createDataFrame([(*r, "x") for r in rows + extra] + [(1, rows[0][1], "x")], "vec_id long, embedding array<double>, n_links string")
    want = vectors_brute([r for r in rows + extra if r[0] not in (9004, 9005)]) | {9004: (0, 9004), 9005: (0, 9005)}
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup(df).collect()}
    assert got.keys() == want.keys()
    assert sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)  # none below the threshold
    assert np.mean([got[i] == want[i] for i in want]) > 0.95
    assert all(got[i] == want[i] for i in want if i < 1000 or i > 9000)  # groups and odd vectors
    assert embedding_dedup(df.limit(0)).count() == 0


def test_query_links(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op5_embedding_dedup"](spark, SMALL).collect()} == vectors_brute(rows)


def test_codes_are_balanced_and_near_vectors_have_near_codes():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 64)) + 0.3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = fit_quantiser(x, 16, 8)
    bits = (x - q.mean) @ q.axes >= 0
    assert bits.shape[1] == 128 and np.abs(bits.mean(0) - 0.5).max() < 0.1
    y = x + 0.02 * rng.normal(size=x.shape)
    near = (((y / np.linalg.norm(y, axis=1, keepdims=True) - q.mean) @ q.axes >= 0) != bits).sum(1).mean()
    assert near < 20 < (bits[:1500] != bits[1500:]).sum(1).mean()


def test_tables_go_with_the_corpus():
    assert table_sizes(0, 0.9)[0] == 8 and table_sizes(1 << 40, 0.9)[0] == 30
    for n in (6000, 65536, 10**6, 10**8):
        bits, tables = table_sizes(n, 0.9)
        assert 2 ** (bits - 1) < n <= 2**bits and table_recall(0.9, bits, tables) >= 0.95 > table_recall(0.9, bits, tables - 1)


@pytest.mark.parametrize("bits,tables", [table_sizes(6000, 0.9), (16, 8)])
@pytest.mark.parametrize("common", [0.0, 0.5, 0.7, 0.8])
def test_vectors_with_a_common_direction_meet(common, bits, tables):
    """Pairs at a cosine of 0.9 and more, all of whose vectors share a direction of that norm."""
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    shared = unit(rng.normal(size=(1, 64)))
    x = unit(common * shared + np.sqrt(1 - common**2) * unit(rng.normal(size=(2000, 64))))
    q = fit_quantiser(x, bits, tables)
    for cosine in (0.9, 0.92, 0.95):
        # The other vector of a pair, at that cosine, with a common component of the same size.
        side = rng.normal(size=x.shape)
        side -= (side * x).sum(1, keepdims=True) * x
        side = unit(unit(side) * np.sqrt(1 - common**2) + common * unit(shared - (x @ shared.T) * x))
        side -= (side * x).sum(1, keepdims=True) * x
        y = cosine * x + np.sqrt(1 - cosine**2) * unit(side)
        apart = np.bitwise_count(q.codes(x) ^ q.codes(y))
        met = (apart.min(1) <= 1) & (apart.sum(1) <= _near_bits(np.arccos(cosine), bits * tables))
        print("mean", common, "cosine", cosine, "found", met.mean())
        assert met.mean() >= table_recall(cosine, bits, tables) - 0.03


def test_other_tables_find_the_same_groups(spark):
    rows = near_vectors()[:500]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, got = vectors_brute(rows), {r.vec_id: r.n_links for r in embedding_dedup(df, bits=20, tables=12).collect()}
    assert sum(got.values()) >= 0.97 * sum(n for n, _ in want.values()) and all(got[i] <= want[i][0] for i in want)
    assert table_recall(0.9, 20, 12) > 0.9
