from __future__ import annotations

import numpy as np
import pytest

from orrery.llm import suffixes
from orrery.llm.suffixes import suffix_array


@pytest.mark.parametrize("bits", [2, 5, 7])
def test_suffix_array_of_numbers_too_great_for_three_in_a_key(bits, monkeypatch):
    monkeypatch.setattr(suffixes, "_KEY_BITS", bits)
    rng = np.random.default_rng(bits)
    for depth in (1, 2, 3, 4, 9):
        values = rng.integers(0, 4, 80)
        keys = [values[i : i + depth].tolist() for i in suffix_array(values, depth).tolist()]
        assert keys == sorted(keys)


def test_suffix_array_of_more_than_two_million_words():
    """Three numbers of 22 bits do not fit one key."""
    values = np.array([2**21 + 5, 1, 2**21 + 5, 0, 2**21, 2**21 + 5, 0, 7, 2**21 - 1, 2**21 + 5, 1, 3] * 3)
    keys = [values[i : i + 6].tolist() for i in suffix_array(values, 6).tolist()]
    assert keys == sorted(keys)
