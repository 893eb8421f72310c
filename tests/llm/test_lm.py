import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import lm
from tidewright.llm.eliasfano import EliasFano
from tidewright.llm.scratch import Scratch


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=200), st.lists(st.integers(0, 2**40), max_size=30), st.integers(0, 12))
def test_elias_fano(values, asked, shift):
    x = np.sort(np.array(values, dtype=np.uint64) >> np.uint64(shift * 3))
    level = EliasFano.of(x, int(x[-1]) + 1 if len(x) else 1)
    assert np.array_equal(level.access(np.arange(len(x))), x)
    q = np.array([*values, *asked], dtype=np.uint64)
    at, found = level.successor(q)
    assert np.array_equal(at, np.searchsorted(x, q)) and np.array_equal(found, np.isin(q, x))


def tokens(text):
    return [w.lower() if w.isascii() else w for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [None]


def corpus(prose, odd):
    rows = [(i, prose(i % 25, 30 + i % 13, 60)) for i in range(120)]
    return rows + [(200 + i, t) for i, t in enumerate(odd)]


def test_counts_base_scores_and_probabilities(docs, prose, odd, monkeypatch):
    monkeypatch.setattr(lm, "WORD_BYTES", 2000)
    monkeypatch.setattr(lm, "PAIR_BYTES", 1500)
    monkeypatch.setattr(lm, "FLUSH", 500)
    rows = corpus(prose, odd)
    got = {r.doc_id: r for r in lm.scored(docs(rows)).collect()}
    count = Counter(t for i, text in rows if zlib.crc32(str(i).encode()) % 5 != 1 for t in tokens(text))
    n, v = sum(count.values()), len(count)
    for i, text in rows:
        own, r = tokens(text), got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(count[t] > 0 for t in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own))
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # texts repeat, so bigrams help


def test_trie_gives_the_interpolated_model(spark, docs, prose):
    texts = [prose(i, 40, 30) for i in range(20)]
    folder = Scratch(spark, "t").root
    model = lm.train(docs(list(enumerate(texts))), folder)
    words, pairs = Counter(), Counter()
    for t in texts:
        own = tokens(t)
        words.update(own)
        pairs.update(zip([None, *own[:-1]], own, strict=True))
    assert model.tokens == sum(words.values()) and model.words == len(words)
    unigram = lambda w: (words[w] + 0.5) / (model.tokens + 0.5 * (len(words) + 1))

    def p(h, w):
        share = model.shares[int(lm.magnitude(np.array([words[h]]))[0])]
        return share * pairs[h, w] / words[h] + (1 - share) * unigram(w) if words[h] else unigram(w)

    text = texts[3] + " w1 unheard w2 w1 unheard"
    own = tokens(text)
    want = sum(math.log10(p(h, w)) for h, w in zip([None, *own[:-1]], own, strict=True))
    assert lm.score(docs([(1, text)]), model).first().score == pytest.approx(want, abs=0.001 * len(own))
    for h in [None, "w1", "w2", "unheard"]:  # the probabilities after any context sum to 1
        assert sum(p(h, w) for w in words) + p(h, "unknown") == pytest.approx(1)


def test_nothing_to_learn_from(docs):
    assert lm.scored(docs([])).count() == 0
    only_held_out = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = lm.scored(docs([(only_held_out, "a b")])).first()
    assert r.held_out and r.n_tokens == 3 and r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) and math.isfinite(r.base_score)
    assert lm.scored(docs([(None, "a b"), (None, None)])).count() == 2
