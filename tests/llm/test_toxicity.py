import random

import numpy as np
import pytest

from tidewright.llm import toxicity
from tidewright.llm.toxicity import forward_backward

BAD = ["scumly", "idiotic", "trashen"]


def table(prose, n=400):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = prose(i, 40 + r.randrange(60), 900).split(" ")
        toxic = r.random() < 0.25
        if toxic:
            for _ in range(r.randrange(1, 5)):
                words[r.randrange(len(words))] = r.choice(BAD) if r.random() < 0.7 else "grobz" + r.choice(["a", "en", "ung", "ix"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def learned(spark, docs, prose):
    rows, labels = table(prose)
    marks = spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int")
    return docs(rows), marks, dict(rows), dict(labels)


def test_held_out_documents_are_told_apart(learned):
    df, marks, _, truth = learned
    got = toxicity.scored(df, marks).collect()
    assert len(got) == len(truth)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.95 and len(held) > 80
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_spans_are_the_toxic_words(learned, docs):
    df, marks, texts, _ = learned
    model = toxicity.trained(df, marks)
    text = "w1 é日 w2 Scumly idiotic! w3 w4 w5\nw6 grobzung w7"
    spans = toxicity.tag(docs([(1, text)]), model).first()["spans"]
    found = [text[s["start"] : s["end"]] for s in spans]
    assert " ".join(found).lower().split() == ["scumly", "idiotic", "grobzung"]


def test_kept_leaves_rows_as_they_are(learned, docs, odd):
    df, marks, _, _ = learned
    model = toxicity.trained(df, marks)
    df = docs([*enumerate(odd), (None, "scumly idiotic trashen scumly"), (50, "w1 w2"), (50, "w1 w2")])
    out = toxicity.kept(df, model)
    assert out.schema == df.schema and out.count() == len(odd) + 2
    assert toxicity.kept(docs([]), model).count() == 0


def test_no_labels_no_verdict(spark, docs, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.scored(docs(list(enumerate(odd))), none).collect()
    assert len(got) == len(odd) and all(r.predicted == 0 for r in got)
    one_sided = spark.createDataFrame([(1, 1, 1), (None, None, None)], "doc_id long, quality int, toxic int")
    assert all(r.predicted == 0 for r in toxicity.scored(docs([(1, "a")]), one_sided).collect())
    assert toxicity.scored(docs([]), one_sided).count() == 0


def test_forward_backward_is_the_sum_over_all_paths():
    r = np.random.default_rng(0)
    start, step = r.normal(size=2), r.normal(size=(2, 2))
    sizes = np.array([4, 2, 1])
    grid = r.normal(size=(3, 4))
    got, moves, starts, _ = forward_backward(grid, sizes, start, step)
    want_moves, want_starts = np.zeros((2, 2)), np.zeros(2)
    for i, n in enumerate(sizes):
        total, on = 0.0, np.zeros(n)
        m, s = np.zeros((2, 2)), np.zeros(2)
        for path in np.ndindex(*[2] * n):
            w = start[path[0]] + sum(grid[i, t] * path[t] for t in range(n)) + sum(step[path[t - 1], path[t]] for t in range(1, n))
            w = np.exp(w)
            total += w
            on += w * np.array(path)
            s[path[0]] += w
            for t in range(1, n):
                m[path[t - 1], path[t]] += w
        assert got[i, :n] == pytest.approx(on / total)
        want_moves += m / total
        want_starts += s / total
    assert moves == pytest.approx(want_moves) and starts == pytest.approx(want_starts)
