import numpy as np

from quarrylens.llm import crf


def test_ways_over_rests_equal_the_whole_chain():
    rng = np.random.default_rng(2)
    rest, trans = rng.normal(size=2), rng.normal(size=(2, 2))
    emits, nears, wholes = [], [], []
    for _ in range(20):
        n = int(rng.integers(1, 90))
        near = np.unique(rng.integers(0, n, rng.integers(1, 6)))
        emit = np.tile(rest, (n, 1))
        emit[near] = rng.normal(size=(len(near), 2))
        emits.append(emit)
        nears.append(near)
        wholes.append(crf.marginals(emit, trans, crf.Lanes.of(np.array([n])))[near])
    gap = np.concatenate([np.diff(np.r_[-1, x]) - 1 for x in nears])
    tail = np.concatenate([len(e) - 1 - x for e, x in zip(emits, nears)])
    own = np.concatenate([e[x] for e, x in zip(emits, nears)])
    part = crf.marginals_between(own, gap, tail, crf.Rests.of(rest, trans), crf.Lanes.of(np.array([len(x) for x in nears])))
    assert np.allclose(np.concatenate(wholes), part, atol=1e-6)
