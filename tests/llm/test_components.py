"""Groups of linked records against union-find."""

import random

import pytest

from pixloom.llm.components import connected_groups

SCHEMA = "left_ord bigint, right_ord bigint, node bigint"


def brute(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {x: root(x) for x in up}


def run(spark, pairs, **kw):
    rows = connected_groups(spark.createDataFrame([(a, b, 7) for a, b in pairs], SCHEMA), **kw).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.group_id for r in rows}


SHAPES = {
    "star": [(500, i) for i in range(1, 400)],
    "chain": [(i, i + 1) for i in range(400)],
    "random": [(random.Random(1).randrange(300), i) for i in range(300)] + [(random.Random(i).randrange(600), random.Random(i + 1).randrange(600)) for i in range(200)],
    "dirty": [(1, 1), (None, 2), (3, None), (4, 5), (5, 4), (4, 5), (5, 6), (9, 8)],
    "clique": [(a, b) for a in range(20) for b in range(a)],
    "tie": [(1, 2), (3, 4), (5, 6)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes(spark, shape):
    assert run(spark, SHAPES[shape]) == brute(SHAPES[shape])


def test_long_giant_is_contracted(spark):
    pairs = [(0, i) for i in range(1, 30)] + [(i + 1000, i + 1001) for i in range(200)] + [(29, 1000), (-5, 1200), (7000, 7001)]
    assert run(spark, pairs, bfs_rounds=2) == brute(pairs)


def test_empty(spark):
    assert run(spark, []) == {} and run(spark, [(1, 1), (None, None)]) == {}
