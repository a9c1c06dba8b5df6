import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import hierarchy as H
from pagewright.plans import skew


def brute(links):
    """root, depth, on_circle and descendants of each id by walking."""
    nodes = {}
    for i, p in links:
        if i is not None:
            nodes[i] = min((x for x in (nodes.get(i), p) if x is not None), default=None)
    up = {i: p if p in nodes else None for i, p in nodes.items()}
    out = {}
    for i in up:
        seen, cur = [], i
        while cur is not None and cur not in seen:
            seen.append(cur)
            cur = up[cur]
        if cur is None:
            out[i] = (seen[-1], len(seen) - 1, False, seen[::-1])
        else:
            out[i] = (min(seen[seen.index(cur) :]), None, True, None)
    return out


def random_links(rng, n):
    ids = rng.sample(range(1, 10 * n), n)
    links = [(i, rng.choice([*ids, 10**6, None]) if rng.random() < 0.25 else ids[max(0, k - rng.randint(1, 6))] if k else None) for k, i in enumerate(ids)]
    links += rng.sample(links, n // 10)  # repeats
    links += [(None, ids[0]), (ids[0], ids[-1])]  # no id; another parent
    return links


@pytest.mark.parametrize("seed", range(3))
def test_random_forests(spark, seed):
    rng = random.Random(seed)
    links = random_links(rng, 120)
    forest = H.materialize(H.heavy_paths(spark.createDataFrame(links, "id bigint, parent bigint").withColumn("depth", F.lit("clash")).withColumn("root", F.lit(1))))
    got = {r.id: r for r in forest.collect()}
    want = brute(links)
    assert set(got) == set(want)
    for i, (root, depth, circle, _) in want.items():
        assert (got[i].root, got[i].on_circle) == (root, circle)
        if not circle:
            assert got[i].depth == depth
    paths = {r.id: r.path for r in H.chain_paths(forest).collect()}
    assert paths == {i: w[3] for i, w in want.items()}
    below = {(r.id, r.descendant) for r in H.descendants(forest.where("not on_circle"), forest.select("id")).collect()}
    assert below == {(a, i) for i, w in want.items() if w[3] for a in w[3][:-1]}
    for i, w in want.items():
        if not w[2]:
            assert got[i].size == 1 + sum(1 for a, _ in below if a == i)


def test_long_chain_and_hot_parent(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST_ROWS", 10)
    chain = [(i, i - 1 if i > 1 else None) for i in range(1, 301)]
    star = [(1000 + i, 7) for i in range(400)]
    got = {r.id: (r.root, r.depth) for r in H.heavy_paths(spark.createDataFrame(chain + star, "id bigint, parent bigint")).collect()}
    assert got[300] == (1, 299) and got[1399] == (1, 7) and len(got) == 700


def test_circles_of_all_sizes(spark):
    links = [(1, 1), (2, 3), (3, 2), (4, 5), (5, 6), (6, 4), (7, 6), (8, 7), (9, None)] + [(20 + i, 20 + (i + 1) % 11) for i in range(11)] + [(40, 25)]
    got = {r.id: (r.root, r.on_circle) for r in H.heavy_paths(spark.createDataFrame(links, "id bigint, parent bigint")).collect()}
    assert got[1] == (1, True) and got[3] == (2, True) and got[8] == (4, True) and got[9] == (9, False) and got[40] == (20, True) and got[30] == (20, True)


def test_empty(spark):
    empty = spark.createDataFrame([], "id bigint, parent bigint")
    forest = H.heavy_paths(empty)
    assert forest.count() == 0 and H.chain_paths(forest).count() == 0
