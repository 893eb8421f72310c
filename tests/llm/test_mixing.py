import re

import pytest

from tidewright.llm import mixing


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, weights=(5, 2, 1), share=1.5):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2 * sizes[s]
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return target


def test_targets_and_shares(docs, prose):
    rows = [(i, prose(i, 5 + i % 50), s) for i, s in enumerate((["b"] * 300 + ["a"] * 40 + ["é"] * 90 + [None] * 120 + ["Z"] * 10) * 2)]
    rows += [(5000, None, "b"), (5001, "", "only empty"), (5002, " \n", "a"), (None, "x y", None)]
    got = mixing.mix(docs(rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    want, taken = brute_targets(sizes), {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 3, s
    again = mixing.mix(docs(rows[::-1])).collect()
    key = lambda r: (r.doc_id or -1, r.taken)
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_certain_copies_come_before_the_sample(docs, prose):
    rows = [(i, prose(i, 20), "a") for i in range(50)] + [(99, "", "a")]
    got = [r for r in mixing.mix(docs(rows)).collect() if r.copies or r.doc_id != 99]
    assert {r.copies for r in got} == {1, 2} and abs(sum(r.taken for r in got) - 1500) <= 10


def test_inclusion_rates_over_seeds(spark):
    """Copies over many seeds are what the level says: the mean is in proportion to the root of the size up to the cap."""
    sizes = [1 + (7 * i) % 97 for i in range(600)]
    df = spark.createDataFrame([(i, "w " * z, "a") for i, z in enumerate(sizes)], "doc_id long, text string, source string").cache()
    want = 0.6 * sum(sizes)
    low, high = 0.0, 10.0
    for _ in range(80):
        level = (low + high) / 2
        low, high = (level, high) if sum(z * min(2, level * z**0.5) for z in sizes) < want else (low, level)
    seeds, taken = 4, [0] * len(sizes)
    for seed in range(seeds):
        rows = mixing.mix(df, share=0.6, seed=seed).collect()
        assert abs(sum(r.taken for r in rows) - want) <= 12
        for r in rows:
            assert abs(r.copies - min(2, level * r.size**0.5)) < 1 + 1e-6
            taken[r.doc_id] += r.copies
    for k in range(0, 96, 24):
        group = [i for i, z in enumerate(sizes) if k < z <= k + 24]
        rate, mean = sum(taken[i] for i in group) / seeds / len(group), sum(min(2, level * sizes[i] ** 0.5) for i in group) / len(group)
        assert abs(rate - mean) < 0.08, (k, rate, mean)


def test_equal_doc_ids_do_not_depend_on_the_layout(docs, prose):
    rows = [(i % 7, prose(i, 3 + i % 9), "a" if i % 3 else "b") for i in range(120)]
    key = lambda df: sorted((r.doc_id, r.text_hash, r.copies) for r in df.collect())
    assert key(mixing.mix(docs(rows), share=0.5)) == key(mixing.mix(docs(rows[::-1]).repartition(5), share=0.5))


def test_repeated_rows_and_empty_tables(docs):
    df = docs([(1, "a b c", "s"), (1, "a b c", "s"), (2, None, "s"), (3, "", None)])
    assert mixing.mix(df).count() == 4
    out = mixing.repeated(df)
    assert out.columns == df.columns and [r.doc_id for r in out.where("text like 'a%'").collect()] == [1, 1] * 2
    assert mixing.mix(docs([])).count() == 0 and mixing.repeated(docs([])).count() == 0
