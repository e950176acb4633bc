"""The token-efficiency test on runs of letters and on runs that meet base spans."""

import random
import string

import pytest

from loomlog.llm import queries, secrets


@pytest.fixture(scope="module")
def encode():
    return secrets._encoding(queries.vocabulary(queries.BYTE_RANKS)).encode_ordinary


@pytest.mark.parametrize("size", [24, 32, 64])
@pytest.mark.parametrize("letters", [string.ascii_letters, string.ascii_letters + string.digits])
def test_random_runs(encode, size, letters):
    rng = random.Random(size)
    found = sum(secrets.spans_of("a " + "".join(rng.choices(letters, k=size)) + " b", encode) == [(2, 3, 2 + size)] for _ in range(200))
    assert found >= 190


def test_words_and_digests_are_left(encode):
    for text in ("internationalization_of_applications", "ElectroencephalographicallyMeasured", "-" * 40, "=" * 64, "0123456789ABCDEF" * 2):
        assert secrets.spans_of(text, encode) == []


def test_rest_of_a_run_that_meets_a_base_span(encode):
    rng = random.Random(1)
    rest = "".join(rng.choices(string.ascii_letters, k=40))
    text = "x " + "0a1b2c3d" * 4 + "_" + rest + " y"
    assert secrets.joined(secrets.spans_of(text, encode)) == f"hex:2:34,random:34:{len(text) - 2}"
    assert secrets.joined(secrets.spans_of("x token=abcdef1 " + rest, encode)) == "assign:2:15,random:16:56"
