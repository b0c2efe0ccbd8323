"""Collocations against plain counts of all phrases, with forced collisions of fingerprints and texts cut into blocks."""

import random
import re
from collections import Counter

import pytest

from runlens.llm import collocations


def brute(docs, longest, least, share, top):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    held = {x: a for x, a in f.items() if len(x[1]) >= 2 and a >= least}
    inside = Counter()
    for (lang, w), a in held.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], a)
    out = []
    for lang in n:
        rows = []
        for (of, w), a in held.items():
            if of == lang and not 100 * inside[of, w] >= share * a:
                score, _, left, right = min((10**6 * a * a // (f[of, w[:k]] * f[of, w[k:]]), k, f[of, w[:k]], f[of, w[k:]]) for k in range(1, len(w)))
                rows.append((-score, -a, " ".join(w).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def sample(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "New", "york", "é", "CITY", "of", "x y", "to"]
    docs = []
    for i in range(n):
        parts = [rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "\r\n", "\v"]) for _ in range(rng.randint(0, 60))]
        docs.append(("".join(parts), ["en", "fr", None, "und", "en"][i % 5]))
    return [*docs, (None, "en"), ("", None), ("of the " * 400 + "; ", "en"), ("word", "xx")]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("longest", "how"), [(3, {}), (4, {"block_bytes": 64}), (3, {"bits": 7}), (2, {"bits": 5, "block_bytes": 200})])
def test_collocations_as_counted_plainly(spark, longest, how):
    """Few bits make phrases, words and languages collide; small blocks cut long texts and spread counts."""
    docs = sample(longest)
    got = collocations.collocations(spark.createDataFrame(docs, "text string, lang string").repartition(3), longest, 4, 50, 30, **how)
    assert rows(got) == brute(docs, longest, 4, 50, 30)


def test_other_columns_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b a b", "en", 1, 2)] * 3, "doc_id long, text string, lang string, phrase int, row int")
    assert [tuple(r) for r in collocations.collocations(docs, 3, 6, top=None).collect()] == [("en", 1, "a b", 6, 6, 6, 12, 10**6)]
    assert collocations.collocations(docs.limit(0)).collect() == []


def test_scores_past_64_bits_are_exact(spark):
    a, l, r = 3 * 10**12 + 1, 4 * 10**12 + 7, 5 * 10**12 + 11
    got = spark.createDataFrame([(a, l, r)], "a long, l long, r long").selectExpr(
        "(CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(18,0))) AS s"
    )
    assert got.first().s == 10**6 * a * a // (l * r)
