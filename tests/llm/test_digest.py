import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import digest

RANKS = digest.rarity_ranks(np.arange(digest.SCORES)[::-1] ** 2)


def brute_score(window):
    n = len(window)
    return 1000 * -sum(c / n * math.log2(c / n) for c in Counter(window).values()) / math.log2(n)


@settings(max_examples=30, deadline=None)
@given(st.binary(min_size=64, max_size=300))
def test_scores(data):
    got = digest.window_scores(np.frombuffer(data, np.uint8))
    want = [brute_score(data[i : i + 64]) for i in range(len(data) - 63)]
    assert np.abs(got - np.array(want)).max() <= 0.51


def test_features_are_the_popular_minima(prose):
    data = prose(1, 400).encode()
    ranks = RANKS[digest.window_scores(np.frombuffer(data, np.uint8))]
    points = Counter()
    for i in range(len(ranks) - digest.NEIGHBOURS + 1):
        points[i + int(np.argmin(ranks[i : i + digest.NEIGHBOURS]))] += 1
    total = Counter()
    for i, p in points.items():
        total[data[i : i + 64]] += p
    want = sum(p >= digest.POPULAR for p in total.values())
    hashes, owner = digest.features([b"short", data, b"", data], RANKS)
    counts = np.bincount(owner, minlength=4)
    assert counts[1] == counts[3] == want and counts[2] == 0
    assert (hashes[owner == 1] == hashes[owner == 3]).all()


def test_likeness(prose):
    text = prose(2, 3000)
    half = text[: len(text) // 2] + prose(3, 1500)
    a, b, c, empty, short = digest.fingerprints([t.encode() for t in (text, half, prose(4, 3000), "", "ab")], RANKS)
    assert digest.likeness(a, a) == 1 and digest.likeness(empty, empty) == 1 and digest.likeness(a, empty) == 0
    assert 0.3 < digest.likeness(a, b) < 1 and digest.likeness(a, c) < 0.05 and digest.likeness(short, a) <= 1
    assert len(a[1]) == -(-a[0] // digest.CAPACITY)
    for x in (a, empty, short):
        back = digest.from_string(digest.as_string(x))
        assert back[0] == x[0] and np.array_equal(back[1], x[1])


def test_every_document_meets_the_next(docs, odd, prose, monkeypatch):
    monkeypatch.setattr(digest, "BLOCK_ROWS", 5)
    rows = [(3 * i, prose(i, 20 + 11 * i)) for i in range(17)] + [(1 + 3 * i, t) for i, t in enumerate(odd)] + [(900, prose(1, 31)), (903, prose(1, 31))]
    got = {r.doc_id: r for r in digest.against_edited(docs(rows)).collect()}
    order = sorted(rows, reverse=True)
    prints = {}
    for i, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        want = text[: len(text) - cut] + following[:cut]
        r = got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert r.near_next == pytest.approx(digest.likeness(digest.from_string(r.fingerprint), digest.from_string(got[order[(i + 1) % len(order)][0]].fingerprint)))
        if len(text) > 300 and " " in text:
            assert r.near_edited > 0.2
    assert len(got) == len(rows)


def test_one_row_null_ids_and_empty_tables(docs):
    one = digest.against_edited(docs([(1, "abcdef")])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one[0].near_next == 1
    assert digest.against_edited(docs([(None, "a"), (None, None), (2, "b"), (2, "b")])).count() == 4
    assert digest.against_edited(docs([])).count() == 0 and digest.digest(docs([])).count() == 0
