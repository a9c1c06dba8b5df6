import os
import random

import pytest

from pagewright.llm import packing as G
from pagewright.llm import tokens as K

needs_files = pytest.mark.skipif(not os.path.isdir(K.TOKENIZERS), reason="no tokenizer files here")


def test_operators_keep_solutions_whole():
    rng = random.Random(1)
    sizes = [rng.randint(1, 500) for _ in range(300)]
    population = G.evolve(G.first_population(sizes, 512, rng), sizes, 512, rng)
    for s in (*population, G.crossover(population[0], population[-1], sizes, 512, rng), G.mutate(population[0], sizes, 512, rng)):
        assert sorted(i for b in s for i in b) == list(range(300)) and max(sum(sizes[i] for i in b) for b in s) <= 512
    first = G.best_fit(sorted(range(300), key=sizes.__getitem__, reverse=True), sizes, 512, [])
    assert len(population[0]) <= len(first)


@pytest.mark.parametrize("n,low,high,capacity", [(1, 5, 5, 10), (4000, 1, 300, 512), (3500, 200, 300, 512), (2000, 400, 511, 512), (15000, 1, 480, 512)])
def test_pack(spark, n, low, high, capacity):
    rng = random.Random(n)
    items = [(1, capacity, f"d{i}", rng.randint(low, high)) for i in range(n)]
    rows = G.pack(spark.createDataFrame(items, "spec_id int, capacity bigint, name string, size bigint")).collect()
    assert sorted((r.name, r.size) for r in rows) == sorted((i[2], i[3]) for i in items)
    fill = {}
    for r in rows:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.size
    assert max(fill.values()) <= capacity
    sizes = [i[3] for i in items]
    plain = G.best_fit(sorted(range(n), key=sizes.__getitem__, reverse=True), sizes, capacity, [])
    assert len(fill) <= (len(plain) if n <= G.BLOCK else len(plain) * 1.01 + 1)  # of one block never more than best-fit decreasing


@needs_files
def test_containers(spark):
    rng = random.Random(2)
    texts = [None, "", " ", "word " * 5000, *[" ".join(rng.choices(["alpha", "数据", "beta"], k=rng.randint(1, 90))) for _ in range(300)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 as size", "2 as piece", "'x' as name", "3 as capacity")
    specs = spark.createDataFrame([(1, 64, "byte_bpe_50k"), (2, 4096, "byte_bpe_50k")], "spec_id int, capacity int, tokenizer string")
    rows = G.containers(docs, specs).collect()
    enc = K.encoder("byte_bpe_50k", K.TOKENIZERS)
    for spec, capacity in ((1, 64), (2, 4096)):
        mine = [r for r in rows if r.spec_id == spec]
        by_doc, fill = {}, {}
        for r in mine:
            by_doc.setdefault(r.doc_id, []).append(r)
            fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        assert max(fill.values()) <= capacity
        for i, t in enumerate(texts):
            n = len(enc.encode(t)) if t else 0
            parts = sorted(by_doc.get(i, []), key=lambda r: r.piece)
            assert sum(r.n_tokens for r in parts) == n and (len(parts) <= 1 or n > capacity)
            at = 0
            for r in parts:
                assert r.start_token == at
                at += r.n_tokens


@needs_files
def test_empty(spark):
    specs = spark.createDataFrame([(1, 64, "byte_bpe_50k")], "spec_id int, capacity int, tokenizer string")
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert G.containers(docs, specs).count() == 0
