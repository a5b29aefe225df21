import random
from collections import Counter

import numpy as np
import pytest

from lograft.llm import repeats
from lograft.llm.fmindex import FMIndex
from lograft.llm.segments import runs, split
from tests.llm.helpers import docs, rows_of


def brute(texts, window=35):
    seen, words = Counter(), [split(t) for t in texts]
    for w in words:
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def corpus():
    rng = random.Random(2)
    word = lambda: rng.choice("abcdefghijkl") * rng.randrange(1, 4)
    passage = [[word() for _ in range(n)] for n in (34, 35, 36, 60, 120)]
    texts = [None, "", "a " * 34, "q " * 36, "x y " * 60, "x y " * 60, " ".join(passage[0]), " ".join(passage[0])]
    for _ in range(40):
        text = [word() for _ in range(rng.randrange(0, 200))]
        for p in rng.sample(passage, rng.randrange(0, 4)):
            at = rng.randrange(len(text) + 1)
            text[at:at] = p
        texts.append(rng.choice([" ", "\n", "\t "]).join(text))
    return texts


@pytest.mark.parametrize("bounds", [{}, {"crowd": 1, "shard_words": 300}])
def test_against_brute_force(spark, bounds):
    texts = corpus()
    df = docs(spark, list(enumerate(texts)), extra=True)
    got = {r[0]: r[1:] for r in rows_of(repeats.remove_repeats(df, **bounds))}
    assert got == dict(enumerate(brute(texts)))


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (None, text), (2, "short"), (2, "w " * 3), (None, None)]
    got = sorted(rows_of(repeats.remove_repeats(docs(spark, rows))), key=repr)
    assert got == sorted([(1, 40, 40, ""), (1, 40, 40, ""), (None, 40, 40, ""), (2, 1, 0, "short"), (2, 3, 0, "w w w"), (None, 0, 0, "")], key=repr)


def test_empty(spark):
    assert repeats.remove_repeats(docs(spark, [])).count() == 0


def test_runs_hold_every_window_once():
    for texts in (corpus(), ["a " * 100], ["b"]):
        words = [split(t) for t in texts]
        for w, (_, place, size, _) in zip(words, runs(words, 35)):
            windows = [p + k for p, n in zip(place, size) for k in range(n)]
            assert windows == list(range(max(0, len(w) - 34)))


def test_index_counts_by_weight():
    run = [f"w{i}".encode() for i in range(50)]
    assert not FMIndex([run], np.array([1]), 5).repeated().any()
    assert FMIndex([run], np.array([2]), 5).repeated().sum() == 16
