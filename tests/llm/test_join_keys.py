"""The index keys of the Jaccard join: every two sets that link share one, and their number grows with the set only."""

import numpy as np
import pytest

from treeline.llm import op6_join


@pytest.mark.parametrize("percent", [40, 60, 80, 90])
@pytest.mark.parametrize("share", [0.0, 0.5, 0.9, 1.0])
def test_linked_sets_share_a_key(percent, share):
    r = np.random.default_rng(percent + int(share * 10))
    space = np.unique(r.integers(1, 1 << 63, 6000, dtype=np.uint64))
    frequent = np.sort(r.choice(space, int(share * len(space)), replace=False))
    for n in (1, 2, 3, 4, 5, 7, 9, 10, 16, 31, 33, 64, 120, 250, 1000, 2500):
        for _ in range(12):
            x = r.choice(space, n, replace=False)
            cut = r.integers(0, n // 3 + 2)
            y = np.concatenate([x[cut:], r.choice(space, r.integers(0, n // 4 + 2))])
            x, y = np.unique(x), np.unique(y)
            both = len(np.intersect1d(x, y))
            if len(y) and 100 * both >= percent * (len(x) + len(y) - both) and len(np.setxor1d(x, y)):
                assert len(np.intersect1d(op6_join.keys_of(x, frequent, percent), op6_join.keys_of(y, frequent, percent)))


def test_keys_of_frequent_shingles_stay_linear():
    x = np.unique(np.random.default_rng(1).integers(1, 1 << 63, 20_000, dtype=np.uint64))
    for percent in (80, 90):
        assert len(op6_join.keys_of(x, x, percent)) < 6 * (len(x) * (100 - percent) // 100)
