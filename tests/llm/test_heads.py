"""Look-ups in the broadcast heads of op9 against a binary search."""

from __future__ import annotations

import numpy as np
import pytest

from barspark.llm import interpolation


@pytest.mark.parametrize("n", [1, 2, 3, 500, 60_000])
@pytest.mark.parametrize("leading", [64, 12])
def test_keys_are_found_without_a_search_for_each(n, leading, monkeypatch):
    """``leading`` of 12: all keys agree in their other, leading bits."""
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, (1 << leading) - 1, min(n, 1 << leading - 2), dtype=np.uint64, endpoint=True))
    head = interpolation.Head(keys, keys, keys)
    ends = np.array([0, int(keys[0]), int(keys[-1]), (1 << 64) - 1], dtype=np.uint64)
    asked = np.concatenate([keys, keys + np.uint64(1), keys[::-1] - np.uint64(1), ends])
    want = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    head.find(asked)
    monkeypatch.setattr(np, "searchsorted", lambda *a, **k: pytest.fail("a binary search"))
    place, found = head.find(asked)
    assert np.array_equal(place, want) and np.array_equal(found, keys[want] == asked)
    assert not len(head.find(asked[:0])[0])
