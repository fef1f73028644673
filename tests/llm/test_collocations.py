"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tribune.llm import collocations

SCHEMA = "text string, lang string, phrase string, size int, shard int"
_LOWER = {k: k + 32 for k in range(65, 91)}


def plain(rows, support, longest=4, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(_LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    f = {k: v for k, v in f.items() if v >= support}
    out = []
    for lang in n:
        found = []
        for (own, words), a in f.items():
            if own != lang or len(words) < 2:
                continue
            longer = [v for (o, w), v in f.items() if o == lang and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w)))]
            if any(100 * v >= 80 * a for v in longer):
                continue
            score, _, l, r = min((2000000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words)))
            found.append((-score, -a, " ".join(words).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(t, lang, "x", 1, 2) for t, lang in rows], SCHEMA).repartition(5)
    got = collocations.collocations(df, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert all(kind == "bigint" for name, kind in got.dtypes if name not in ("lang", "phrase"))
    return sorted(map(tuple, got.collect()))


def made(n, seed=1):
    rng = random.Random(seed)
    words = ["Aa", "b", "cÉ", "dd", "E", "ф", "g h", "-"]
    joins = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ; "]
    return [("".join(rng.choices(words, weights=[9, 8, 5, 3, 2, 1, 1, 1])[0] + rng.choice(joins) for _ in range(rng.randrange(0, 40))), rng.choice(["en", "en", "fr", None])) for _ in range(n)]


def test_against_plain(spark):
    rows = made(300) + [("Aa b cÉ dd. " * 60, "en")] * 3 + [(None, "en"), ("", None), (None, None), (" \t", "xx"), ("lone", "xx")]
    got = run(spark, rows, support=12)
    assert got == plain(rows, 12) and {r[0] for r in got} == {"en", "fr", "und"}


def test_first_ones(spark):
    rows = made(200, 2)
    assert run(spark, rows, support=8, top=7) == plain(rows, 8, top=7)


def test_long_texts_and_pieces(spark, monkeypatch):
    # a text longer than a segment, with and without separators; workers see the setting as they are started with the text
    rows = [("aa bb cc, dd ee. " * 300_000, "en"), ("no stop here " * 400_000, "en"), ("word" * 1_500_000, "en")]
    got = run(spark, rows)
    assert [r[2:6] for r in got if r[2] == "aa bb cc"] == [("aa bb cc", 300_000, 300_000, 300_000)]
    assert {r[6] for r in got} == {300_000 * 5 + 400_000 * 3 + 1}


@pytest.mark.parametrize("rows", [[], [("too rare", "en")], [(None, None)]])
def test_nothing(spark, rows):
    assert run(spark, rows) == []


def test_packing():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 2**48, size=5000, dtype=np.uint64))
    counts = rng.integers(1, 2**31, size=len(keys))
    k, c = collocations.unpack(collocations.pack(keys, counts))
    assert (k == keys).all() and (c == counts).all()


def test_support_of_a_shard_never_loses_a_phrase():
    rng = random.Random(4)
    for _ in range(500):
        own = [rng.randrange(0, 1000) for _ in range(collocations.SHARDS)]
        n = sum(own) or 1
        local = [max(1, -(-30 * x // n)) for x in own]
        spread = [rng.randrange(0, m) for m in local]  # below the support everywhere
        assert sum(spread) < 30


def test_the_map_holds_what_may_be_frequent_in_all(spark, monkeypatch):
    # thousands of phrases that a shard has often enough for its share, and all shards together do not
    rows = [(f"x{k} y{k} z{k}. " * 5 + f"often said {k % 3}", "en") for k in range(400)]
    seen, kept = [], collocations.candidate_map
    monkeypatch.setattr(collocations, "candidate_map", lambda frequent, bits: seen.append(frequent.selectExpr("sum(n)").first()[0]) or kept(frequent, bits))
    assert run(spark, rows) == plain(rows, 30)
    # often, said, 0, 1, 2, their pairs and triples
    assert seen == [5 + 4 + 3]


def test_bound_of_shards_never_loses_a_phrase():
    rng = random.Random(6)
    for _ in range(500):
        local = [rng.randrange(1, 8) for _ in range(collocations.SHARDS)]
        counts = [rng.randrange(0, 12) for _ in local]
        over = sum(c - m + 1 for c, m in zip(counts, local, strict=True) if c >= m)
        assert over + sum(local) - len(local) >= sum(counts)
