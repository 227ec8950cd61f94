"""Ratios of a vocabulary of any size keep their places in the histogram of estimates."""

import numpy as np
import pytest

from barlattice.llm import lm


@pytest.mark.parametrize("types", [1_000, 400_000, 1_000_000, 20_000_000, 3_000_000_000])
@pytest.mark.parametrize("tokens", [1, 20, 5_000])
def test_no_ratio_is_clipped(types, tokens):
    total = types * tokens
    span = lm.span_of(total, types)
    ratios = np.array([types + 1.0, (types + 1) / 2, (types + 1) / total, 1.0])
    back = 2.0 ** ((lm.quantised(ratios, span) - 1 - span // 2) / lm.STEPS)
    assert back == pytest.approx(ratios, rel=2 ** (0.51 / lm.STEPS) - 1)
    assert lm.BUCKETS * span**2 < 2**63


def test_weights_of_a_large_vocabulary():
    """Half the tokens are certain pairs, half are uniform: the mixture is that of the exact estimates."""
    types, total, n = 50_000_000, 1_000_000_000, np.array([4000, 6000])
    span = lm.span_of(total, types)
    exact = np.array([[types + 1.0, 2.0e5], [0.0, 5.0e-2]])
    cells = (3 * span + lm.quantised(exact[:, 0], span)) * span + lm.quantised(exact[:, 1], span)
    w, p = np.array([0.4, 0.5, 0.1]), np.column_stack([exact, np.ones(2)])
    for _ in range(100):
        s = p * w / (p * w).sum(1, keepdims=True)
        w = ((n[:, None] * s).sum(0) + 1e-3) / (n.sum() + 3e-3)
    assert lm.fit_weights(cells, n, span=span)[3] == pytest.approx(w, abs=2e-3)
