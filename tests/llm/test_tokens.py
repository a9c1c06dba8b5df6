import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.llm import tokens as K

pytestmark = pytest.mark.skipif(not os.path.isdir(K.TOKENIZERS), reason="no tokenizer files here")


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{K.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def joined(text, cuts):
    enc = K.encoder("byte_bpe_50k", K.TOKENIZERS)
    edges = [0, *cuts, len(text)]
    return enc.join([enc.chunk(text[a:b]) for a, b in zip(edges, edges[1:])])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"ab 'lst\n\té中1\u00a0.!", "'ll", "  ", "\r\n", "𝒳", "日本", "\n\n\n"]), min_size=2, max_size=120).map("".join), st.data())
def test_any_cut_gives_the_ids_of_the_whole(whole, text, data):
    cuts = sorted(set(data.draw(st.lists(st.integers(1, len(text) - 1), max_size=12)))) if len(text) > 1 else []
    assert joined(text, cuts) == whole(text)


def test_corpus(spark, whole):
    rng = random.Random(3)
    words = ["alpha", "Straße", "数据页", "we'll", "don't", "  ", "\n\n", "12345", "<|endoftext|>", "🙂", "naïve", "…", "\t"]
    passages = [" ".join(rng.choices(words, k=rng.randint(30, 400))) for _ in range(12)]
    texts = [None, "", " ", "x", "<|endoftext|>", "a" * 30_000, "\n" * 9000, "中" * 9000, *["".join(rng.choices(passages, k=rng.randint(1, 6))) for _ in range(60)]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(20, texts[20])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("h", F.lit(1)).withColumn("ids", F.lit("clash")).withColumn("row_", F.lit(2))
    got = [(r.doc_id, list(r.ids)) for r in K.token_ids(df).collect()]
    assert len(got) == len(rows)
    assert sorted(got) == sorted((i, whole(t) if t else []) for i, t in rows)


def test_shared_chunks_are_encoded_once():
    passage = "".join(random.Random(1).choices("abcdefgh \n", k=6000))
    a, b = K.cut_points(["x" * 777 + passage, passage])
    chunks = lambda t, cuts: {t[i:j] for i, j in zip([0, *cuts], [*cuts, len(t)])}
    shared = chunks("x" * 777 + passage, a) & chunks(passage, b)
    assert sum(map(len, shared)) > 0.7 * len(passage)
    assert K.cut_points(["", "abc"]) == [[], []]


def test_empty(spark):
    assert K.token_ids(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
