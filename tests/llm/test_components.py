"""Connected components against union by brute force."""

import random

import pytest

from loomlog.llm import common


def expected(edges):
    root = {i: i for e in edges for i in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    looped = {i for i in root if all(a == b for a, b in edges if i in (a, b))}
    return {i: find(i) for i in root if i not in looped}


CHAIN = [(i, i + 1) for i in range(40)]
SHUFFLED = [(i * 29 % 101, (i + 1) * 29 % 101) for i in range(100)]  # a path whose ids go up and down
STAR = [(500, i) for i in range(300)] + [(-7, 299)]
DRAWN = [tuple(random.Random(n).sample(range(150), 2)) for n in range(90)]


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(2, 1), (1, 2), (2, 1), (3, 3)], CHAIN, SHUFFLED, STAR, DRAWN], ids=["none", "loop", "repeated", "chain", "path", "hub", "drawn"])
def test_smallest_id_reachable(spark, edges):
    got = common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert len({r["id"] for r in got}) == len(got)
    assert {r["id"]: r["component"] for r in got} == expected(edges)


def test_stars_are_left_after_one_look(spark, monkeypatch):
    written = []
    staged = common.staged
    monkeypatch.setattr(common, "staged", lambda df, name: written.append(name) or staged(df, name))
    got = common.connected_components(spark.createDataFrame([(9, 1), (8, 1), (7, 2)], "src long, dst long")).collect()
    assert {(r["id"], r["component"]) for r in got} == {(1, 1), (8, 1), (9, 1), (2, 2), (7, 2)}
    assert len(written) == 2  # the edges and each node's least neighbour
