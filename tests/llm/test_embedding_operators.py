"""Nearest neighbours and hard negatives against brute force."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from faultline.llm import cross_polytope, hard_negatives, queries

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, vector int, _side int, _row int, rank int, place int, width int, table int"
EXTRA = ("x", 1, 2, 3, 4, 5, 6, 7)
ODD = [(1, None, 1), (None, [1.0, 2.0, 3.0, 4.0], 1), (3, [], 1), (4, [0.0] * 4, 2), (5, [1.0, None, 2.0, 3.0], 1), (6, [math.nan, 1.0, 1.0, 1.0], 1),
       (8, [math.inf, 1.0, 1.0, 1.0], 1), (9, [1.0, 2.0], 1), (11, [1e30, 1e30, 1e30, 1e30], 1), (12, [1.0, 2.0, 3.0, 4.0], None), (50, [2.0, 1.0], 3)]


def vectors(n, width, seed, groups=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    return [(100 + i, [float(np.float32(x)) for x in (centres[i % groups] + 0.3 * rng.normal(size=width)) / 3], i % 10) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


def write(spark, rows, folder):
    frame(spark, rows).repartition(3).write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def fine(v, zero=False):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


def nearest(rows, k=5):
    rows = {r[0]: r for r in sorted((r for r in rows if r[0] is not None and fine(r[1])), key=lambda r: r[1], reverse=True)}
    out = {}
    for q, v, _ in rows.values():
        if q % 50 == 0:
            v = np.array(v)
            scored = [(float(np.dot(v, w) / np.sqrt(np.dot(v, v)) / np.sqrt(np.dot(w, w))), i) for i, x, _ in rows.values() if i != q and len(x) == len(v) for w in [np.array(x)]]
            out[q] = sorted(((round(s, 9), i) for s, i in scored), key=lambda t: (-t[0], t[1]))[:k]
    return out


def found(spark, folder):
    out = {}
    for r in queries.QUERIES["op12_cross_polytope_search"](spark, folder).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((round(r.score, 9), r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_search_of_odd_vectors_and_ties(spark, tmp_path):
    copies = [(1000 + i, [3.0, 1.0, 0.5, 0.25], 1) for i in range(120)]
    rows = [*ODD, *vectors(60, 4, 1), *copies, *copies[:30], (1050, [9.0, 9.0, 9.0, 9.0], 4), (7, [6.0, 2.0, 1.0, 0.5], 2)]
    want, got = nearest(rows), found(spark, write(spark, rows, tmp_path))
    assert got == {q: w for q, w in want.items() if w}
    assert [i for _, i in got[1100]] == [7, 1000, 1001, 1002, 1003]


def test_search_finds_most_neighbours(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cross_polytope, "BLOCK_ROWS", 64)
    monkeypatch.setattr(cross_polytope, "BLOCK_QUERIES", 2)
    rows = vectors(1500, 24, 2)
    want, got = nearest(rows), found(spark, write(spark, rows, tmp_path))
    assert set(got) == set(want) and all(len(g) == 5 for g in got.values())
    assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) >= 0.95 * 5 * len(want)
    assert all(s == dict((i, s) for s, i in nearest_scores).get(i, s) for q in want for nearest_scores in [want[q]] for s, i in got[q])


def test_search_of_nothing(spark, tmp_path):
    assert found(spark, write(spark, [], tmp_path)) == {}
    assert found(spark, write(spark, [(50, [1.0, 2.0], 1)], tmp_path)) == {}


def mined(rows, k=5, n=10):
    kept = {}
    for i, v, label in sorted((r for r in rows if r[0] is not None and r[2] is not None and fine(r[1], zero=True)), key=lambda r: ((r[2] + (r[0] % 7 == 0)) % 10 if r[0] % 7 == 0 else r[2], r[1]), reverse=True):
        v = [math.floor(256 * x) for x in v]
        if sum(x * x for x in v) < 2 ** 62:
            kept[i] = (v, (label + 1) % 10 if i % 7 == 0 else label)
    out = []
    for a, (v, label) in kept.items():
        if a % 100:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (w, _) in kept.items() if i != a and len(w) == len(v)}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if kept[i][1] == label][:k]:
            window = [i for i in order if kept[i][1] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]][:n]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(window, 1)]
    return sorted(out)


def answer(spark, folder):
    out = queries.QUERIES["op13_hard_negatives"](spark, folder)
    return sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_negatives_of_odd_vectors_and_ties(spark, tmp_path):
    copies = [(1000 + i, [3.0, 1.0, 0.5, 0.25], i % 3) for i in range(40)]
    big = [(2000, [2e6, 1e6, 0.0, 0.0], 1), (2001, [2e6, 9e5, 0.0, 0.0], 1), (2002, [1e6, 9e5, 3.0, 0.0], 2), (2100, [-1.0, -2.0, 0.0, 0.0], 9), (2200, [0.0] * 4, 9)]
    rows = [*ODD, *vectors(80, 4, 3), *copies, *copies[:9], *big]
    got = answer(spark, write(spark, rows, tmp_path))
    assert got == mined(rows) and any(r[0] == 2000 for r in got)


def test_negatives_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 200)
    monkeypatch.setattr(hard_negatives, "BLOCK_COMPONENTS", 100)
    rows = vectors(1300, 20, 4)
    got = answer(spark, write(spark, rows, tmp_path))
    assert got == mined(rows) and got


def test_negatives_of_nothing(spark, tmp_path):
    assert answer(spark, write(spark, [], tmp_path)) == []
    assert answer(spark, write(spark, [(100, [1.0, 2.0], 1), (101, [1.0, 2.0], 2)], tmp_path)) == []


def test_intervals_hold_the_scores():
    rng = np.random.default_rng(5)
    values = rng.integers(-300, 300, (400, 50))
    batch = next(hard_negatives._coded([pa.RecordBatch.from_pydict({"id": list(range(400)), "label": [0] * 400, "vector": values.tolist()})]))
    rows, at = hard_negatives.Rows(batch), np.arange(400)
    pruned = 0
    for anchor in map(hard_negatives.Anchor, [*values[:40], values[0] * 0]):
        low, high = anchor.interval(rows, at)
        exact = values @ anchor.integer
        assert (low <= exact).all() and (exact <= high).all()
        pruned += (high < np.sort(exact)[-1]).sum()
    assert pruned > 0


def test_integers_beyond_longs(spark):
    df = spark.createDataFrame([([1.5, -0.001],), ([9e15, 1.0],), ([0.0],)], "v array<double>").select(hard_negatives.integers(F.col("v")).alias("v"))
    assert [r.v for r in df.collect()] == [[384, -1], None, [0]]
