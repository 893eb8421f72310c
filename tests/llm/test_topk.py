import math

import numpy as np
import pytest

from tidewright.llm import topk


def brute(rows, k=10, every=100):
    vectors = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = set()
    for q, x in vectors:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in vectors if i != q)[:k]  # noqa: B905
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int")
    return {tuple(r) for r in topk.top_k(df, **options).collect()}


def as32(rows):
    return [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]


def random_rows(n, dim, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim)) * np.exp(r.normal(size=(n, 1)))
    return [(i, x[i].tolist()) for i in range(n)]


@pytest.mark.parametrize("n, dim", [(700, 16), (300, 3), (15, 8), (1, 4), (101, 1)])
def test_against_brute_force(spark, n, dim):
    rows = as32(random_rows(n, dim))
    assert found(spark, rows) == brute(rows)


def test_ties_go_to_smaller_ids(spark):
    rows = as32([(i, [1.0, 0.5]) for i in range(250)] + random_rows(1, 2)[:0])
    assert found(spark, rows) == brute(rows)


def test_rows_that_take_no_part(spark):
    rows = as32(random_rows(220, 4))
    rows[3], rows[100], rows[7] = (3, None), (100, [1.0, None, 2.0, 3.0]), (7, [float("nan"), 1.0, 1.0, 1.0])
    rows[8] = (8, [float("inf")] * 4)
    rows += [(None, [1.0] * 4), (500, []), (501, [2.0])]
    assert found(spark, rows) == brute(rows)


def test_few_candidates_in_waves_and_zero_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "WAVE_BYTES", 96)
    monkeypatch.setattr(topk, "ROWS", 16)
    monkeypatch.setattr(topk, "HEAD", 5)
    rows = as32([(i, v if i % 3 else [0.0] * 5) for i, v in random_rows(90, 5)])
    assert found(spark, rows, every=9, k=4) == brute(rows, 4, 9)


def test_empty(spark):
    assert found(spark, []) == set()
    assert found(spark, [(0, None)]) == set()


@pytest.mark.parametrize("size", [1e5, 1e9, 1e18, 1e37])
def test_components_of_any_size(spark, size):
    rows = as32([(i, [c * size if i % 7 == 0 else c for c in v]) for i, v in random_rows(160, 4, seed=3)])
    rows += [(200, rows[0][1]), (201, rows[0][1]), (300, [0.0] * 4)]
    held = {(q, r, i, max(-topk.MOST, min(topk.MOST, s))) for q, r, i, s in brute(rows, every=20)}
    assert found(spark, rows, every=20) == held


def test_negative_scores_beyond_64_bits(spark):
    rows = as32([(0, [-1e30, -1e30])] + [(i, [i * 1e28, 1.0]) for i in range(1, 40)])
    assert [i for _, _, i, _ in sorted(found(spark, rows, every=50))] == [i for _, _, i, _ in sorted(brute(rows, every=50))]


def test_sortable_bytes_sort_as_integers():
    values = sorted([0, 1, -1, 255, 256, -255, -256, 2**70, -(2**70), 2**70 + 1, 2**300, -(2**300), 2**2100, -(2**2100)])
    assert sorted(values, key=topk.sortable) == values


def test_one_broadcast_of_queries_lives_at_a_time(spark, monkeypatch):
    live, most = set(), []
    make = type(spark.sparkContext).broadcast

    def broadcast(self, value):
        made = make(self, value)
        live.add(id(made))
        most.append(len(live))
        destroy = made.destroy
        made.destroy = lambda *a: (live.discard(id(made)), destroy(*a))
        return made

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    monkeypatch.setattr(topk, "WAVE_BYTES", 96)
    rows = as32(random_rows(60, 3))
    assert found(spark, rows, every=10) == brute(rows, 10, 10)
    assert len(most) > 1 and max(most) == 1 and not live
