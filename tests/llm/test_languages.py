"""Language ID: the background, many languages, long words, odd tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import langid
from tidewell.llm.queries import op10_language_id
from tidewell.llm.vocabulary import load_pieces, vocabulary_path

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return langid.learn_languages(docs.filter(~langid.held_out()))


def test_gibberish_and_other_scripts_are_rejected_and_documents_stay(spark, model):
    odd = ["zzxq qqwv jjkq xvbn qqzz", "asdfg hjkl qwerty zxcvb", "これは日本語の文章です。今日は天気がいい", "Это предложение на русском языке", "x" * 5000, "12 34", None, ""]
    frame = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    assert langid.drop_unidentified(frame, model).count() == 0
    held = spark.read.parquet(f"{SF}/documents.parquet").filter(langid.held_out())
    assert langid.drop_unidentified(held, model).count() >= 0.99 * held.count()


def test_five_hundred_and_one_languages_are_all_learned(spark):
    r = random.Random(1)
    words = [[f"{''.join(r.choice('abcdefghijklmnopqrstuvwxyz') for _ in range(5))}" for _ in range(4)] for _ in range(501)]
    rows = [(k, " ".join(words[k] * 3), f"l{k:03}") for k in range(501)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = langid.learn_languages(docs, rounds=1)
    assert learned.languages == sorted(f"l{k:03}" for k in range(501))
    found = langid.identify(docs.limit(60), learned)
    assert found.filter("lang = language.lang_pred").count() >= 59


def test_long_words_take_part_in_the_fit():
    path = vocabulary_path()
    table = np.random.default_rng(2).random((len(load_pieces(path)) + 1, 2)) / 1e5
    table[-1] = 1e-9
    model = langid.LanguageModel(["a"], table, path)
    for word in ("ander", "日本語ab", "x" * 40):
        direct, logs = model.expected(word, 0), model.expected_in_logs(model.segmenter.ends(word), 0)
        assert direct.keys() == logs.keys() and all(direct[k] == pytest.approx(logs[k], abs=1e-12) for k in direct)
    long = model.expected("abcdefgh" * 200, 0)
    lengths = {i: len(p) for i, (p, _) in enumerate(load_pieces(path))}
    assert sum(lengths[i] * n for i, n in long.items()) == pytest.approx(1601)
    assert model.word("ab" * 30_000)[0] == pytest.approx(2 * model.word("ab" * 15_000)[0], rel=1e-3)


def test_short_and_long_words_have_one_rule(model):
    for word in ("und", "the", "ñandú", "abc" * 9):
        assert model.word(word) == pytest.approx(model.short_words([word])[0])
    assert all(math.isfinite(x) for x in model.word("漢" * 3000))


def test_identify_of_odd_tables(spark, model):
    odd = [(None, None, 1), (None, "die und der", 2), (1, "", 3), (1, "the cat and the dog", 4), (1, "the cat and the dog", 4)]
    frame = spark.createDataFrame(odd, "doc_id long, text string, __language int")
    got = langid.identify(frame, model)
    assert got.count() == 5 and langid.identify(frame.limit(0), model).count() == 0
    kept = langid.drop_unidentified(frame, model)
    assert kept.columns == frame.columns and sorted(r["__language"] for r in kept.collect()) == [2, 4, 4]
    nothing = langid.learn_languages(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.language.lang_pred for r in langid.identify(frame, nothing).collect()} == {"und"}


def test_registered_query_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = op10_language_id(spark, SF)
    assert got.count() == docs.count()
    held = got.filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    assert got.filter("score < 0 or score > 1 or score is null").count() == 0
