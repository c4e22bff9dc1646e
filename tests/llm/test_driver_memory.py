"""Training on the driver holds its matrix once, whatever the precision of the sums."""

import tracemalloc

import numpy as np

from geoloom.llm import toxicity


def test_svm_takes_no_second_copy_of_its_matrix():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120_000, 25)).astype(np.float32)
    x[:, -1] = 1
    y = (x[:, 0] + 0.3 * x[:, 1] + rng.normal(size=len(x)) > 0.5).astype(float)
    weight = np.full(len(x), 1 / len(x))
    tracemalloc.start()
    try:
        beta, bias = toxicity.train_svm(x, y, weight)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < x.nbytes
    # the gradient of the whole problem in double precision is zero there
    sign, design, found = np.where(y > 0, 1.0, -1.0), x.astype(np.float64), np.append(beta, bias)
    short = np.maximum(0, 1 - sign * (design @ found))
    ridge = np.append(np.full(24, 1e-3 * weight.sum()), 1e-9)
    assert np.abs(ridge * found - design.T @ (weight * sign * short)).max() < 1e-3
