from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SMALL, same

from colloquy.llm import media as M
from colloquy.llm.line_dedup import LAST, line_dedup
from colloquy.llm.mixing import mix_sources, mix_taken, mixed_documents, source_targets
from colloquy.llm.queries import ORACLE_SQL, QUERIES

SPACE = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, duck, name):
    same(QUERIES[name](spark, SMALL), duck, ORACLE_SQL[name])


def brute_lines(rows, least=10, n=2):
    holders = defaultdict(set)
    cut = lambda t: (t or "").split("\n")
    key = lambda x: x.strip(SPACE).translate(LOW)
    for i, t in rows:
        for x in cut(t):
            if len(key(x)) >= least:
                holders[key(x)].add(LAST if i is None else i)
    gone = {k: min(v) for k, v in holders.items() if len(v) >= n}
    return sorted((str(i), len(cut(t)), "\n".join(x for x in cut(t) if gone.get(key(x), LAST if i is None else i) == (LAST if i is None else i))) for i, t in rows)


ROWS = [
    (5, "Shared line one\nown 5 own 5 own\n\nshared LINE one  "), (3, " shared line one\t\nshort\nThird line here"), (4, "short\nthird line here\r\nÄpfel und Birnen"), (9, "äpfel und birnen\nÄpfel und birnen"),
    (2, None), (7, ""), (8, "\n\n"), (3, " shared line one\t\nshort\nThird line here"), (3, "another version\nshared line one"), (None, "Third line here\nnull's own line"), (None, "null's own line"),
    (11, "x" * 200_000 + "\nthird line here"),
]


@pytest.mark.parametrize("n", [2, 3])
def test_line_dedup_against_brute_force(spark, n):
    df = spark.createDataFrame([(i, t, "kept", 1) for i, t in ROWS], "doc_id long, text string, N_lines string, other int")
    got = line_dedup(df, min_docs=n)
    assert got.columns == ["doc_id", "text", "other", "n_lines", "n_dropped", "kept_text"]
    rows = got.collect()
    assert sorted((str(r.doc_id), r.n_lines, r.kept_text) for r in rows) == brute_lines(ROWS, n=n)
    assert all(r.n_lines - r.n_dropped == (len(r.kept_text.split("\n")) if r.n_lines > r.n_dropped else 0) for r in rows)
    assert line_dedup(df.limit(0)).count() == 0


def test_targets_against_iterated_clamping(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, None: 400, "": 0}, {"x": 7}, {"a": 1, "b": 1, "c": 1}, {"a": 0, "b": 0}, {}):
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        w = {s: k % 3 + 1 for k, s in enumerate(names)}
        total, done, left = sum(sizes.values()), {}, dict(w)
        while left:
            share = {s: (total - sum(done.values())) * w[s] / sum(left.values()) for s in left}
            over = [s for s in left if share[s] >= 3 * sizes[s]]
            if not over:
                done |= share
                break
            for s in over:
                done[s] = 3 * sizes[s]
                del left[s]
        got = {r.source: r.target for r in source_targets(df).collect()}
        assert got.keys() == done.keys() and all(abs(got[s] - done[s]) < 1e-6 * max(1, done[s]) for s in done)


def mix_rows():
    rng = np.random.default_rng(4)
    rows = [(k, f"s{k % 4}" if k % 9 else None, "w " * int(rng.integers(0, 40))) for k in range(400)] + [(1000, "big", "w " * 5000), (1001, "s1", None), (None, "s2", "a b"), (5, "s1", "w w"), (5, "s1", "w w")]
    return rows


def test_mixes_reach_their_targets(spark):
    rows = mix_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, text string, taken string")
    got = mix_sources(df).collect()
    again = {(r.doc_id, r.text): r.taken for r in mix_sources(df.repartition(7)).collect()}
    taken, size, target = Counter(), Counter(), {}
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r.taken <= 3 * r.size
        assert again[r.doc_id, r.text] == r.taken
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
        assert r.source_size > 0
    assert len(got) == len(rows)
    for s in target:
        assert abs(taken[s] - target[s]) <= 2 and target[s] <= 3 * size[s] + 1e-6  # rows equal in id and text can be two
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    text = {r[2] for r in rows}
    mix = mixed_documents(df).collect()
    assert sum(len((r.text or "").split()) for r in mix) == sum(taken.values())
    assert all(r.text in text or any(t and t.startswith(r.text) for t in text) for r in mix)
    assert mix_sources(df.limit(0)).count() == mix_taken(df.limit(0)).count() == 0


def test_equal_rows_share_what_is_taken_at_the_cut(spark):
    rows = [(1, "w " * 10, "a")] * 1000 + [(None, "v " * 4, "b")] * 300 + [(None, f"n{k} x", "b") for k in range(300)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = Counter(), {r.source: r.target for r in got}
    for r in got:
        taken[r.source] += r.taken
    assert all(target[s] - 1000 < taken[s] <= target[s] + 0.5 for s in target) and abs(sum(taken.values()) - 11_800) < 1000
    assert len({r.taken for r in got if r.doc_id == 1}) == 1


def test_netpbm_and_bmp_round_trips():
    rng = np.random.default_rng(1)
    for h, w in ((1, 64), (7, 64), (30, 3), (33, 9)):
        im = rng.integers(0, 256, (h, w), dtype=np.uint8)
        for stored in (M.encode_pgm(im), M.encode_bmp(im)):
            back, white = M.decode(stored)
            assert (back == im).all() and white == 255
    read = lambda b: (M.decode(b)[0].tolist(), M.decode(b)[1])
    assert read(b"P2 # note\n2 2\n9\n1 2 3 4") == ([[1, 2], [3, 4]], 9)
    assert read(b"P1\n3 2\n101\n0 1 0") == read(b"P4\n3 2\n\xa0\x40") == ([[0, 1, 0], [1, 0, 1]], 1)  # 1 is black there
    assert read(b"P3\n1 1\n255\n1 2 3") == read(b"P6\n1 1\n255\n\x01\x02\x03") == ([[[1, 2, 3]]], 255)
    assert read(b"P5\n1 1\n65535\n\x01\x02") == ([[258]], 65535)


#: Broken files: short, unknown, with sizes and samples that the format doesn't allow.
BAD = [b"", b"P5\n2 2\n255\nab", b"P9 1 1", b"BMxx", b"P5\n2", b"P2\n1 1\n255\n300", b"P1\n2 1\n1-", b"P3\n1 1\n255\n-1 2 3", b"P2\n1 1\n9\n10", b"P5\n1 1\n9\n\x0a", b"P5\n-5 5\n255\nabc", b"P5\n0 5\n255\n", b"P5\n99999999999 99999999999\n255\nx", b"P2\n2000000000 2000000000\n255\n1", b"P2\n1 1\n255\n99999999999999999999", b"P2\n1 1\n70000\n1", b"P5\n1 1\n0\n\0", b"P4\n9 9\n\0", M.encode_bmp(np.zeros((4, 4), np.uint8))[:-1], M.encode_bmp(np.zeros((4, 4), np.uint8))[:60], b"BM" + b"\xff" * 80, b"BM" + b"\0" * 80]


def test_broken_media_are_refused():
    for bad in BAD:
        with pytest.raises((ValueError, struct.error)):
            M.decode(bad)


def test_tiles_scale_by_the_maximum():
    same = lambda b: np.load(io.BytesIO(M.tile(*M.decode(b)))).flatten()[[0, -1]].tolist()
    assert same(b"P5\n2 1\n65535\n\xff\xff\x00\x00") == same(b"P1\n2 1\n0 1") == same(b"P2\n2 1\n7\n7 0") == same(M.encode_pgm(np.array([[255, 0]], np.uint8))) == [255, 0]


def test_area_resize_against_repeated_pixels():
    rng = np.random.default_rng(2)
    for h, w in ((1, 64), (5, 7), (40, 64)):
        im = rng.integers(0, 256, (h, w)).astype(float)
        for a, b in ((8, 9), (32, 32), (3, 5)):
            want = np.kron(im, np.ones((a, b))).reshape(a, h, b, w).mean((1, 3))
            assert np.allclose(want, M.area_resize(im, a, b))
    ramp = np.tile(np.arange(0, 90, 10), (8, 1))
    assert M.difference_hash(ramp) == "ff" * 8 and M.difference_hash(ramp[:, ::-1]) == "00" * 8


def test_media_columns_of_rows(spark):
    rows = [(1, b"P5\n2 2\n255\nabcd"), (1, b"P5\n2 2\n255\nabcd"), (2, None), (None, b""), *((4, b) for b in BAD)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, data binary, tile string")
    got = M.media_tiles(df).collect()
    good, bad = [r for r in got if r.error is None], [r for r in got if r.error]
    assert len(good) == 2 and len(bad) == 2 + len(BAD) and all(r.tile is r.dhash is r.height is None for r in bad)
    assert M.media_tiles(df, most_pixels=3).where("error is null").isEmpty() and M.media_tiles(df.limit(0)).count() == 0
    assert np.load(io.BytesIO(good[0].tile)).shape == (32, 32)


def test_media_query_on_the_documents(spark):
    got = {r.doc_id: r for r in QUERIES["op7_media_columns"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        raw = (d.text or "").encode()
        pay = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        stored = b"P5\n64 %d\n255\n" % (len(pay) // 64) + pay
        r = got[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        if len(pay) < 8192:  # areas as means over repeated samples
            rows = len(pay) // 64
            small = np.round(np.kron(np.frombuffer(pay, np.uint8).reshape(rows, 64), np.ones((8, 9))).reshape(8, rows, 9, 64).mean((1, 3)), 6)
            assert r.feature == np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def test_text_media_against_plain_computation(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "é" * 40), (5, "x" * 64), (6, "y" * 100_000), (1, "abc")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, feature string")
    got = M.text_media(df, keep_files=True).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = (dict(rows)[r.doc_id] or "").encode()
        pay = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest()) and bytes(r.media).endswith(pay)
        assert hashlib.sha256(r.tile).hexdigest() == r.tile_sha256 and len(r.feature) == 16
    assert M.text_media(df.limit(0)).count() == 0
