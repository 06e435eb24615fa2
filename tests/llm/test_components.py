import random

import pytest

from ridgeline.llm import components as C


def brute(pairs):
    p = {}

    def f(x):
        p.setdefault(x, x)
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = f(a), f(b)
            p[max(x, y)] = min(x, y)
    return {v: f(v) for v in p}


@pytest.mark.parametrize("part_edges", [200_000, 15])
def test_against_union_find(spark, part_edges):
    rng = random.Random(part_edges)
    name = lambda i: f"{(i * 7919) % 10007:05d}"
    pairs = [(name(0), name(i)) for i in range(1, 40)]  # a star
    pairs += [(name(100 + i), name(101 + i)) for i in range(60)]  # a long chain
    pairs += [(name(39), name(300)), (name(300), name(301)), (name(301), name(302))]  # a tail of the star
    pairs += [(name(400 + rng.randrange(40)), name(400 + rng.randrange(40))) for _ in range(30)]
    pairs += [(b, a) for a, b in pairs[:20]] + pairs[:10] + [("self", "self"), (name(1), name(1)), (None, "x"), ("y", None)]
    df = spark.createDataFrame([(a, b, "clash") for a, b in pairs], "hash_a string, hash_b string, v string")
    got = C.components(df, "hash_a", "hash_b", part_edges=part_edges).collect()
    assert len(got) == len({r.vertex for r in got})
    assert {r.vertex: r.label for r in got} == brute(pairs)


def test_only_loops_and_empty(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "a")], "a string, b string")
    assert [(r.vertex, r.label) for r in C.components(df, "a", "b").collect()] == [("a", "a")]
    assert C.components(df.limit(0), "a", "b").count() == 0


def test_chain_in_order_of_names_over_many_parts(spark):
    edges = spark.createDataFrame([(f"{i:04d}", f"{i + 1:04d}") for i in range(300)], "a string, b string")
    got = C.propagate(edges, part_edges=10, rounds=20).collect()
    assert len(got) == 301 and len({r.root for r in got}) == 1
    with pytest.raises(RuntimeError):
        C.propagate(edges, part_edges=10, rounds=1)
