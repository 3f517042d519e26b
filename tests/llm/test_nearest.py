"""Nearest neighbours against brute force: recall, scores, ranks, ties and odd rows."""

import numpy as np
import pytest

from repeatloom.llm import ann

SCHEMA = "vec_id long, embedding array<double>, likely string, part int"


def brute_force(ids, x, every=50, k=5):
    """(query_id, rank, vec_id, score) by exact cosines of vectors scaled by powers of two."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = u @ u[q]
        own = np.flatnonzero(ids != ids[q])
        order = own[np.lexsort((ids[own], -np.round(s[own], 12)))][:k]
        out[int(ids[q])] = [(r + 1, int(ids[i]), float(s[i])) for r, i in enumerate(order)]
    return out


def run(spark, rows, **more):
    got = {}
    for r in ann.nearest(spark.createDataFrame([(*row, "c", 1) for row in rows], SCHEMA).repartition(3), **more).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return got


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 16))
    ids = np.arange(4000)
    want = brute_force(ids, x)
    got = run(spark, zip(ids.tolist(), x.tolist()), shortlist=64)
    hits = sum(len({v for _, v, _ in want[q]} & {v for _, v, _ in got[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.9 * 5 * len(want)
    score = {(q, v): s for q in want for _, v, s in want[q]}
    for q, found in got.items():
        assert [r for r, *_ in found] == [1, 2, 3, 4, 5] and [s for *_, s in found] == sorted((s for *_, s in found), reverse=True)
        assert all(abs(s - score.get((q, v), s)) < 1e-12 for _, v, s in found)


def test_ranks_ties_and_scales(spark, monkeypatch):
    """With the whole table on the shortlist results are exact, in small parts and chunks too."""
    monkeypatch.setattr(ann, "PART_ROWS", 100)
    monkeypatch.setattr(ann, "QUERY_ROWS", 2)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    x[10:40] = x[50]  # ties with a query, and among its neighbours
    x[60] = x[100] * 2.0**-660
    x[61] = x[100] * 2.0**660
    x[62] = x[100] * 4
    ids = np.arange(300)
    want = brute_force(ids, x)
    got = run(spark, zip(ids.tolist(), x.tolist()), shortlist=300)
    assert {q: [(r, v) for r, v, _ in f] for q, f in got.items()} == {q: [(r, v) for r, v, _ in f] for q, f in want.items()}
    assert {v for _, v, _ in got[100][:3]} == {60, 61, 62} and [v for _, v, _ in got[50]] == [10, 11, 12, 13, 14]


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    odd = [(700, None), (701, [0.0] * 8), (702, [float("nan")] * 8), (703, [1.0]), (704, [None] + [1.0] * 7), (705, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (706, [])]
    assert run(spark, rows + odd, shortlist=100) == run(spark, rows, shortlist=100)
    again = rows + [rows[7]] * 500 + [rows[50]] * 3
    assert run(spark, again, shortlist=100) == run(spark, rows, shortlist=100)
    two = run(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (1, [1.0, 0.1])], shortlist=9)
    assert [(r, v) for r, v, _ in two[0]] == [(1, 1), (2, 1)] and two[0][0][2] > two[0][1][2]
    assert run(spark, [(50, [1.0, 2.0])]) == {} and run(spark, [(1, [1.0, 2.0])]) == {}
    assert ann.nearest(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("scale", [1e-200, 1e200])
def test_one_extreme_row_leaves_codebooks_sound(spark, scale):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(1500, 16)), rng.normal(size=(1, 16)) * scale])
    ids = np.arange(1501)
    want, got = brute_force(ids, x), run(spark, zip(ids.tolist(), x.tolist()), shortlist=64)
    assert sum(len({v for _, v, _ in want[q]} & {v for _, v, _ in got[q]}) for q in want) >= 0.9 * 5 * len(want)
