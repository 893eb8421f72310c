import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import neardup
from tidewright.llm.components import components
from tidewright.llm.scratch import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, y in combinations(sets, 2):
        both = len(sets[x] & sets[y])
        if both and 100 * both >= 75 * len(sets[x] | sets[y]):
            lo, hi = sorted((find(x), find(y)))
            root[hi] = lo
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}


def edited(text, every, tag):
    words = text.split(" ")
    return " ".join(f"{tag}{i}" if i % every == every - 1 else w for i, w in enumerate(words))


def test_against_all_pairs(docs, prose, odd):
    rows = [(i, prose(i, 40 + 7 * i)) for i in range(20)]
    rows += [(100 + i, edited(rows[i % 5][1], 37 + i, f"e{i}x")) for i in range(20)]
    rows += [(200 + i, rows[3][1].upper() if i % 2 else rows[3][1].replace(" ", "\n")) for i in range(6)]
    rows += [(300 + i, t) for i, t in enumerate(odd)] + [(400 + i, t) for i, t in enumerate(odd)]
    assert found(docs(rows)) == brute(rows)


def test_chains_and_hot_groups_are_joined(docs, prose):
    base = prose(1, 200).split(" ")
    chain = [(i, " ".join(base[6 * i : 6 * i + 100])) for i in range(15)]  # neighbours are alike, ends are not
    group = [(100 + i, prose(2, 120) + f" t{i}") for i in range(120)]
    rows = chain + group
    assert found(docs(rows)) == brute(rows)


def test_passages_in_common_do_not_join(docs, prose):
    passage = prose(9, 60)
    rows = [(i, prose(50 + i, 80) + " " + passage) for i in range(40)]
    assert all(kept for _, _, kept in found(docs(rows)).values())


@pytest.mark.parametrize("few", [0, neardup.FEW])
def test_keys_of_few_documents_need_no_shingles(docs, prose, few, monkeypatch):
    """Half-alike documents share keys: few under a key are told apart by bits, and links between groups are still found."""
    seen, linkable = [], neardup.linkable
    monkeypatch.setattr(neardup, "FEW", few)
    monkeypatch.setattr(neardup, "linkable", lambda docs, nodes, scratch: (seen.append(nodes.count()), linkable(docs, nodes, scratch))[1])
    passages = [prose(700 + i, 100) for i in range(30)]
    rows = [(10 * i + j, p + " " + prose(9000 + 10 * i + j, 60)) for i, p in enumerate(passages) for j in range(4)]
    rows += [(1000 + i, edited(t, 61, "e")) for i, (_, t) in enumerate(rows[:40])]
    assert found(docs(rows)) == brute(rows)
    assert (seen[0] == 0) == (few > 0)


def test_null_ids_repeated_rows_and_empty_tables(docs, prose):
    t = prose(3, 50)
    got = neardup.near_duplicates(docs([(None, t), (None, None), (5, t), (5, t), (7, t)])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 0, True), (5, 5, True), (5, 5, True), (7, 5, False)]
    assert neardup.near_duplicates(docs([])).count() == 0


def test_the_index_finds_every_pair_within_the_distance():
    r = np.random.default_rng(0)
    for _ in range(200):
        a = r.integers(0, 1 << 16, neardup.POSITIONS)
        b = a.copy()
        at = r.permutation(neardup.POSITIONS)[: neardup.DISTANCE]
        b[at] += 1
        same = (a == b).reshape(neardup.CHUNKS, neardup.CHUNK).sum(axis=1)
        assert same.max() >= neardup.CHUNK - 1


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\x0bé", max_size=40), max_size=8))
def test_set_sizes(texts):
    sets, ends = neardup.shingle_sets(texts)
    assert np.diff(ends).tolist() == [len(shingles(t)) for t in texts]


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(5, 9), (9, 7), (3, 4), (4, 3), (7, 5)]])
def test_components(spark, edges):
    table = spark.createDataFrame(edges, "a long, b long")
    got = dict(map(tuple, components(table, Scratch(spark, "t")).collect()))
    want = {}
    for a, b in edges:
        if a != b:
            pool = {x for x in (a, b)} | {k for k, v in want.items() if v in {want.get(a), want.get(b)} - {None}}
            low = min(pool)
            want.update({x: low for x in pool})
    assert got == want
