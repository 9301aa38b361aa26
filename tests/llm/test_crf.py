import itertools

import numpy as np

from quarrylens.llm import crf


def paths(emit, trans):
    for labels in itertools.product(range(emit.shape[1]), repeat=len(emit)):
        score = sum(emit[i, y] for i, y in enumerate(labels)) + sum(trans[a, b] for a, b in itertools.pairwise(labels))
        yield labels, score


def test_viterbi_and_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    lengths = np.array([3, 0, 5, 1, 5, 2])
    emit, trans = rng.normal(size=(lengths.sum(), 2)), rng.normal(size=(2, 2))
    lanes = crf.Lanes.of(lengths)
    best = crf.viterbi(emit, trans, lanes)
    p, log_z, seen = crf.marginals(emit, trans, lanes, pairs=True)
    at, total, expected = 0, 0.0, np.zeros((2, 2))
    for n in lengths:
        if n:
            own = list(paths(emit[at : at + n], trans))
            z = np.logaddexp.reduce([s for _, s in own])
            total += z
            assert tuple(best[at : at + n]) == max(own, key=lambda x: x[1])[0]
            for i in range(n):
                assert np.isclose(p[at + i, 1], sum(np.exp(s - z) for y, s in own if y[i] == 1))
            for y, s in own:
                for a, b in itertools.pairwise(y):
                    expected[a, b] += np.exp(s - z)
        at += n
    assert np.isclose(log_z, total) and np.allclose(seen, expected)


def test_fit_learns_emissions_and_transitions():
    rng = np.random.default_rng(5)
    lengths = np.full(200, 10)
    labels = np.concatenate([np.repeat(rng.integers(0, 2, 2), 5) for _ in lengths])
    noisy = np.where(rng.random(len(labels)) < 0.2, 1 - labels, labels)
    model = crf.fit(noisy[:, None], labels, lengths, 2)
    found = crf.viterbi(model.emissions(noisy[:, None]), model.trans, crf.Lanes.of(lengths))
    assert (found == labels).mean() > (noisy == labels).mean() + 0.05
