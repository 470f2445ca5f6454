"""Collocations and their automata against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import collocations
from tidewell.llm.automata import Automaton, sort_grams


def matrix(counts, k):
    out = np.zeros((len(counts), k), np.uint64)
    for i, g in enumerate(counts):
        out[i, : len(g)] = g
    return out, np.array(list(counts.values()), np.int64)


def shown(grams, weights):
    return {tuple(int(x) for x in g if x): int(w) for g, w in zip(grams, weights)}


@pytest.mark.parametrize("k, words, n", [(1, 3, 5), (2, 5, 60), (5, 2, 80), (5, 40, 300), (3, 4, 0)])
def test_automata_build_unite_and_compose(k, words, n):
    r = random.Random(k * 100 + n)
    draw = lambda: Counter({tuple(r.randint(1, words) * (2**60 + 7) % 2**64 for _ in range(r.randint(1, k))): r.choice([1, 1, 2, 300]) for _ in range(n)})
    a, b = draw(), draw()
    A, B = (Automaton.load(Automaton.build(*sort_grams(*matrix(x, k))).dump()) for x in (a, b))
    assert shown(*A.paths()) == a
    assert shown(*Automaton.union([A, B], 2)) == {g: c for g, c in (a + b).items() if c >= 2}
    asked = dict.fromkeys([*a, *b, (5,), (2**60 + 7,) * k], 1)
    assert A.compose(matrix(asked, k)[0]).tolist() == [a.get(g, 0) for g in asked]


def test_equal_states_are_one():
    grams = {(1, i): 1 for i in range(1, 50)} | {(i, 7): 3 for i in range(2, 50)}
    states = [len(w) for w in Automaton.build(*sort_grams(*matrix(grams, 2))).weights]
    assert states == [1, 2, 2]  # 49 first words share one state, all last words two


def plain(docs, least, top):
    fold = {c: c + 32 for c in range(65, 91)}
    f, n = {}, Counter()
    for lang, text in docs:
        own = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(fold)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 6):
                own.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        found = {g: a for g, a in own.items() if a >= least and len(g) > 1}
        inside = {g[i : i + m] for g, a in found.items() for m in range(2, len(g)) for i in range(len(g) - m + 1) if a >= found[g[i : i + m]]}
        rows = []
        for g, a in found.items():
            score, cut = min((1000 * a * n[lang] // (own[g[:k]] * own[g[k:]]), k) for k in range(1, len(g)))
            if g not in inside:
                rows.append((-score, -a, " ".join(g).encode(), own[g[:cut]], own[g[cut:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def corpus(seed, docs=150):
    r = random.Random(seed)
    words = ["The", "the", "of", "sea", "é", "New", "york", "city", "hall", "a b", "x" * 300]
    text = lambda: "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " - "]) for _ in range(r.randint(0, 60)))
    phrase = "new york city hall "
    return [(r.choice(["en", "en", "de", None]), r.choice([None, "", text(), text(), phrase * r.randint(1, 9)])) for _ in range(docs)]


@pytest.mark.parametrize("seed, least, top, shard, crowd", [(1, 5, 2000, 1 << 22, 500_000), (2, 20, 3, 64, 4)])
def test_phrases_equal_plain_counting(spark, monkeypatch, seed, least, top, shard, crowd):
    docs = corpus(seed)
    frame = spark.createDataFrame(docs, "lang string, text string").select("*", *[F.lit(1).alias(c) for c in ("word", "f", "gram")]).repartition(3)
    got = collocations.mine_collocations(frame, least=least, top=top, shard=shard, crowd=crowd)
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, least, top) != []


def test_clashing_numbers_are_salted_and_empty_tables_have_none(spark, monkeypatch):
    docs = corpus(3, 40)
    frame = spark.createDataFrame(docs, "lang string, text string")
    assert collocations.mine_collocations(frame.limit(0)).count() == 0
    real, seen = F.xxhash64, []

    def clashing(*columns):
        seen.append(1)
        return F.lit(7).cast("long") + real(*columns) * 0 if len(seen) == 1 else real(*columns)

    monkeypatch.setattr(collocations.F, "xxhash64", clashing)
    got = collocations.mine_collocations(frame, least=5).collect()
    assert len(seen) > 1 and sorted(tuple(r) for r in got) == plain(docs, 5, 2000)


def test_one_very_long_text(spark):
    text = "lorem ipsum dolor, " * 120_000
    got = collocations.mine_collocations(spark.createDataFrame([("en", text)], "lang string, text string")).collect()
    assert [(r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got] == [("lorem ipsum dolor", 120_000, 120_000, 120_000, 360_000, 3000)]
