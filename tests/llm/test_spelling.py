"""Spelling variants against a comparison of all pairs of words; Bloom filters against the sets they stand for."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import bloom, spelling


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, least_chars, least_n, ratio):
    n = {w: k for w, k in Counter(x for x in words if x is not None).items() if len(w) >= least_chars and k >= least_n}
    links = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in links.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(links[w]), n.get(form.get(w))))
    return sorted(out)


def sample(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    return [w for w in words for _ in range(rng.choice([1, 2, 5, 25, 130]))]


@pytest.mark.parametrize("bits", [16, 1])
def test_variants_as_compared_pair_by_pair(spark, bits):
    """Also with a filter so small that it lets nearly everything pass: positives are confirmed."""
    words = sample(bits)
    got = spelling.variants(spark.createDataFrame([(w,) for w in words], "word string"), 2, 2, 5, bits_per_key=bits)
    assert sorted(tuple(r) for r in got.collect()) == brute(words, 2, 2, 5)


def test_edge_cases_of_words(spark):
    long = "x" * 30_000
    chain = [w for k, w in enumerate(["aaaabbbb", "aaaabbbc", "aaaabbcc", "aaaabccc", "aaaacccc", "aaadcccc"]) for _ in range(2**k)]
    words = [None, None, "", "", *[long] * 2, *[long[1:]] * 4, "\U0001f600bc", "\U0001f601bc", "\U0001f601bc", *chain, "tie", "tia", "tia", "tib", "tib"]
    got = spelling.variants(spark.createDataFrame([(w,) for w in words], "word string"), 1, 1, 2)
    want = brute(words, 1, 1, 2)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert dict((w, r) for w, _, r, *_ in want)["aaaabbbb"] == "aaadcccc"
    assert spelling.variants(spark.createDataFrame([], "word string")).collect() == []


def test_filters_know_their_keys_whatever_their_size(spark):
    rng = np.random.default_rng(5)
    h = rng.integers(0, 1 << 64, 20_000, np.uint64)
    other = rng.integers(0, 1 << 64, 20_000, np.uint64)
    shard = np.arange(len(h)) % 3
    keys = spark.createDataFrame(list(zip(h.view(np.int64).tolist(), shard.tolist(), strict=True)), "h long, shard int")
    counts = {k: int((shard == k).sum()) for k in range(3)}
    first, size = bloom.shards(counts, 4, 16, 64)
    known = bloom.build(keys, first, size, shard=F.col("shard"))
    for k in range(3):
        assert known.has(h[shard == k], k).all()
        assert known.has(other, k).mean() < 0.02
    assert not known.has(other, 3).any()  # an empty shard
    first, size = bloom.shards({0: 10**12, 1: 5}, 2, 16, 1)
    assert size.sum() <= (1 << 23) // 512 + 2  # the bound holds for any number of keys
