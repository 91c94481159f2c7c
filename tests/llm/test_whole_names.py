"""The words that gate a pattern are words the pattern needs."""

from __future__ import annotations

import pytest

from cadenza.llm import piirules as R


@pytest.mark.parametrize("verb", ["watched", "disagree", "said", "lives", "came", "walked", "will", "were", "are", "both"])
def test_coupled_names(verb):
    text = f"The guide and Jonas Klein {verb} late"
    assert ("person_name", "Jonas Klein") in [(k, text[a:b]) for k, a, b in R.find(text)]
