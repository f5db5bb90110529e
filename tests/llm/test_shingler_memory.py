"""The table of remembered words stays small and tells nothing in the result."""

import pytest

pytest.importorskip("siglake.llm.registry")
from siglake.llm.shingles import Shingler  # noqa: E402


def test_remembered_words():
    shingler, other = Shingler(5), Shingler(5, remembered=10)
    for k in range(60):
        words = [b"w%d" % i for i in range(10_000 * k, 10_000 * (k + 1))]
        assert (shingler.hashes(words) == other.hashes(words)).all()
        assert len(shingler.known) <= 200_000
