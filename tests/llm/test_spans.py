"""Substring dedup: spans are compared with their source, also where hashes collide."""

import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidewell.llm import substring
from tidewell.llm.queries import op6_substring_dedup

SF = "/root/testdata/sf0.001"


def texts(seed):
    r = random.Random(seed)
    line = lambda n: " ".join(str(r.randrange(300)) for _ in range(n))
    passage = line(50)
    out = [line(r.choice([5, 13, 30])) for _ in range(12)]
    out += [line(8) + " " + passage[r.randrange(40) :] + " " + line(9) for _ in range(8)]
    return out + [out[3]] * 2 + ["w " * 60, None, ""]


@pytest.mark.parametrize("bits", [64, 9, 2])
def test_colliding_hashes_change_nothing(spark, bits):
    rows = list(enumerate(texts(bits)))
    done = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), bits=bits).collect()
    assert {r.doc_id: (r.deduped.n_words, r.deduped.n_removed, r.deduped.kept_sha256) for r in done} == brute.substring(rows)


def test_thue_morse_texts(spark):
    """Texts that collide under polynomials modulo 2**64."""
    word = lambda n, flip: " ".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))
    rows = [(0, word(2048, 0)), (1, word(2048, 1)), (2, "x " + word(1024, 0)), (3, word(1024, 1) + " y")]
    done = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.deduped.n_words, r.deduped.n_removed, r.deduped.kept_sha256) for r in done} == brute.substring(rows)


def test_hits_side_by_side_are_one_span(spark):
    r = random.Random(7)
    passage = " ".join(str(r.randrange(10**6)) for _ in range(400))
    rows = [(1, "a b " + passage), (2, "c " + passage + " d")]
    found = substring.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(x.doc, [(p.first, p.edges) for p in x.spans]) for x in found] == [(2, [(1, 388)])]


def test_clashing_columns_and_one_long_text(spark):
    r = random.Random(8)
    long = " ".join(str(r.randrange(50_000)) for _ in range(3_500_000))  # 20 MB
    rows = [(1, long[:2_000_000], 0), (2, long, 0), (None, "n", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __key int").withColumns({c: F.lit(5) for c in ("__doc", "__spans", "gram", "sdoc")})
    done = {x.doc_id: x for x in substring.remove_repeats(frame, with_text=False).collect()}
    assert done[2]["__doc"] == 5 and done[2].deduped.n_removed >= len(long[:2_000_000].split()) - 1 and done[1].deduped.n_removed == 0


def test_registered_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op6_substring_dedup(spark, SF).collect()} == brute.substring(rows)
