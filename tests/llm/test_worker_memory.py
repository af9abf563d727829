"""Workers of tokenising tasks drop what they kept before other tasks; a linear machine makes one matrix."""

import tracemalloc

import numpy as np

from grainmark.llm import language, textbytes
from grainmark.llm.queries import BYTE_VOCABULARY, vocabulary
from grainmark.llm.tokens import part_tokenizer


def former_machine(x, y, cost=10.0, rounds=30, seed=1):
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    square = (x * x).sum(axis=1) + 0.5 / cost
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(x)):
            slope = y[i] * (w @ x[i]) - 1 + alpha[i] * 0.5 / cost
            step = max(alpha[i] - slope / square[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return w


def test_a_machine_has_the_same_weights_in_less_memory():
    rng = np.random.default_rng(2)
    x = rng.random((600, 4096), np.float32)
    y = np.where(np.arange(600) % 2, 1.0, -1.0)
    matrix = 600 * 4097 * 8
    tracemalloc.start()
    got = language.linear_machine(x, y, rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got, former_machine(x, y, rounds=2))
    assert peak < 1.6 * matrix  # former_machine: over 1.9


def test_other_tasks_drop_the_tokenizer():
    path = vocabulary(BYTE_VOCABULARY)
    one = part_tokenizer(path)
    list(textbytes.tidy(lambda batches: iter(batches), keep=True)([1]))
    assert part_tokenizer(path) is one
    list(textbytes.tidy(lambda batches: iter(batches))([1]))
    assert not textbytes._KEPT
