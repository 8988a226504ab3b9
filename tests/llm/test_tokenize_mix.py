"""Token ids against the public library, and mixtures against their promises."""

from __future__ import annotations

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("textevidence.llm")
from textevidence.llm import mixing, tokenize  # noqa: E402
from textevidence.llm.common import TOKENIZER_DIR  # noqa: E402

PATH = tokenize.tokenizer_path("byte_bpe_50k")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary file")


@pytest.fixture(scope="module")
def encoder():
    return tokenize.Encoder(tokenize.Vocabulary(PATH))


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def ids(encoder, texts):
    flat, counts = encoder.encode(texts)
    return [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]


def test_perfect_hash(encoder):
    assert all(encoder.lookup(t) == i for i, t in enumerate(encoder.tokens))
    assert sorted(encoder.index) == list(range(encoder.n))
    assert encoder.lookup(b"\xff\xfe no such word") == -1


def test_known_texts(encoder, reference):
    texts = ["", "Hello, world!", "আমি ভাত খাই।", "  two  spaces \n\n", "<|endoftext|>", "don't 12345", "日本語のテキスト", "😀🏳️‍🌈", "x" * 5000, "á"]
    assert ids(encoder, texts) == [reference.encode(t, add_special_tokens=False).ids for t in texts]


def test_many_texts(encoder, reference):
    rng = np.random.default_rng(3)
    pool = [chr(c) for c in [*range(32, 127), *range(0xA1, 0x17F), *range(0x981, 0x9CE), *range(0x3041, 0x3090), *range(0x4E00, 0x4F00), 10, 32, 32, 32]]
    texts = ["".join(rng.choice(pool, rng.integers(0, 80))) for _ in range(500)]
    assert ids(encoder, texts) == [reference.encode(t, add_special_tokens=False).ids for t in texts]


def test_frame(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "Hello", "c"), (3, "Hello", "c")], "doc_id long, text string, ids string")
    rows = sorted((r["doc_id"], r["ids"]) for r in tokenize.encode(df).collect())
    assert rows == [(1, []), (2, []), (3, [15496]), (3, [15496])]
    assert tokenize.encode(df.where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 1 << 40))
def test_permutation(size, key):
    got = mixing.permute(np.arange(size), np.full(size, size), np.full(size, key))
    assert sorted(got.tolist()) == list(range(size))


def test_draws():
    quota = {"a": 700, "b": 200, "c": 100}
    rows = list(mixing.draw(quota, 7, 1))
    assert [sum(n[k] for _, _, n in rows) for k in range(3)] == [700, 200, 100]
    assert [sum(n) for _, _, n in rows] == [1000 * (k + 1) // 7 - 1000 * k // 7 for k in range(7)]
    for (_, used, n), (_, after, _) in zip(rows, rows[1:], strict=False):
        assert [a + b for a, b in zip(used, n, strict=True)] == after
    for first in range(7):  # any task finds the same counts
        assert list(mixing.draw(quota, 7, 1, first, first + 2)) == rows[first : first + 2]


def test_draws_of_any_size():
    """Beyond a thousand million blocks, too, shards are full and quotas are met."""
    quota = {"a": 7 * 10**12, "b": 2 * 10**12, "c": 10**12 + 1, "d": 1}
    total, shards = sum(quota.values()), 5 * 10**9
    for shard, used, n in [*mixing.draw(quota, shards, 3, 10**9, 10**9 + 3), *mixing.draw(quota, shards, 3, shards - 1)]:
        assert sum(n) == total * (shard + 1) // shards - total * shard // shards and min(n) >= 0
        assert sum(used) == total * shard // shards
    assert [a + b for a, b in zip(used, n, strict=True)] == [quota[s] for s in sorted(quota)]


@pytest.mark.parametrize(("good", "bad", "n"), [(7, 5, 6), (300, 900, 100), (50, 3, 40), (1, 10, 4)])
def test_hypergeometric(good, bad, n):
    import math
    import random

    rng = random.Random(5)
    got = [mixing.hypergeometric(good, bad, n, rng) for _ in range(4000)]
    mean, spread = n * good / (good + bad), n * good * bad * (good + bad - n) / (good + bad) ** 2 / (good + bad - 1)
    assert abs(np.mean(got) - mean) < 5 * math.sqrt(spread / 4000) + 1e-9 and abs(np.var(got) / spread - 1) < 0.12


def test_quotas():
    targets = {"a": (0.5, 1), "b": (0.5, 3), "none": (0.2, 1)}
    got = mixing.quotas({"a": 1000, "b": 100, "none": 0}, targets, 10)
    assert got == {"a": 30, "b": 30}  # b has ten blocks, used three times at most
    assert mixing.quotas({}, targets, 10) == {}


def test_mixture(spark):
    docs = spark.createDataFrame([(i, f"word number {i} and more words " * (1 + i % 4), "big" if i % 3 else "small") for i in range(300)] + [(900, None, "big"), (901, "", "small"), (902, "lost text", "other"), (903, "no source", None)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 4), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed = mixing.mixture(docs, targets, block_tokens=32).cache()
    report = {r["source"]: r for r in mixing.shares(mixed, targets).collect()}
    assert abs(report["big"]["actual_share"] - 2 / 3) < 0.02 and report["absent"]["tokens"] == 0
    assert all(r["most_uses"] <= r["max_repeats"] for r in report.values())
    uses = mixed.groupBy("source", "doc_id", "tok_start").count().groupBy("source").max("count").collect()
    assert all(n <= {"big": 1, "small": 4}[s] for s, n in uses)
    slots = mixed.select("shard", "slot").distinct().count()
    assert mixed.groupBy("shard", "slot").agg({"block": "min"}).count() == slots
    assert {r["doc_id"] for r in mixed.select("doc_id").collect()} <= set(range(300))
    lens = dict(tokenize.count_tokens(docs, ["doc_id"]).collect())
    assert all(0 <= r["tok_start"] < r["tok_end"] <= lens[r["doc_id"]] for r in mixed.collect())
    assert mixing.mixture(docs.where("false"), targets).count() == 0
