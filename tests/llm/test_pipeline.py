import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_whole_lines import whole_dedup
from tidewell.llm import langid, packing
from tidewell.llm.vocabulary import vocabulary_path

SF = "/root/testdata/sf0.001"


def test_every_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "x", 0), (9002, "", None, None, None), (9003, "12 34!", "en", "x", 6), (9004, "the and the of " * 9, None, "x", 1)], docs.schema)
    docs = docs.unionByName(odd)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in docs.collect()}
    model = langid.learn_languages(docs.filter(~langid.held_out()))
    want = {i for i, r in rows.items() if (p := model.texts([r.text])[0])[0] != "und" and p[1] >= 0.5}
    stages = dict(corpus_pipeline.STAGES)

    now = stages["language_id"](spark, docs, SF)
    assert now.columns == docs.columns
    kept = {r.doc_id: r.text for r in now.collect()}
    assert set(kept) == want and 9003 not in kept and len(kept) >= 199

    want = {i: t for i, (t, n) in whole_dedup(sorted(kept.items())).items() if not n or brute.words(t)}
    now = stages["line_dedup"](spark, now, SF)
    assert now.columns == docs.columns
    found = now.collect()
    assert {r.doc_id: r.text for r in found} == want and all(r.n_chars == len(r.text) for r in found)

    lead = brute.components([(i, brute.fingerprint(t)) for i, t in want.items()])
    want = {i: want[i] for i in set(lead.values())}
    now = stages["near_dedup"](spark, now, SF)
    assert {r.doc_id: r.text for r in now.collect()} == want

    bad = {i for i, t in want.items() if (o := brute.overlap(t, bench))[1] and 20 * o[1] >= o[0]}
    now = stages["decontamination"](spark, now, SF)
    assert {r.doc_id for r in now.collect()} == set(want) - bad and bad

    packed = stages["best_fit_packing"](spark, now, SF).collect()
    own = packing.WordTokenizer(vocabulary_path(packing.VOCABULARY))
    lengths = {i: len(own.ids(want[i])) // 4 + 1 for i in set(want) - bad}
    total, bins = {}, {}
    for r in packed:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert total == lengths
    for places in bins.values():
        places.sort()
        assert [p[0] for p in places] == [sum(x[1] for x in places[:k]) for k in range(len(places))] and sum(x[1] for x in places) <= 2048


def test_line_dedup_equals_brute_force(spark):
    from tidewell.llm import lines

    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + [None, "", "\n", "a\n" * 40, "a b\nc d\ne f", "a b\nc d\ne f"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.deduped.kept for r in lines.dedup_lines(frame).collect()}
    assert got == brute.line_dedup(list(enumerate(texts)))


def test_results_do_not_depend_on_clashing_columns_or_empty_tables(spark):
    from tidewell.llm import decontaminate, lines, quality, simhash, substring, tokens

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(20)
    names = ("n_words", "doc", "key", "tokens", "overlap", "spans", "gram", "first", "chunks", "fingerprint", "judged", "deduped", "length", "piece")
    crowded = docs.select("*", *[F.lit(1).alias(n) for n in names])
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    runs = {
        "tokens": lambda d: tokens.count_tokens(d).select("doc_id", "tokens"),
        "overlap": lambda d: decontaminate.find_contamination(d, bench).select("doc_id", "overlap"),
        "quality": lambda d: quality.judge_quality(d, quality.DecisionList(())).select("doc_id", "judged"),
        "lines": lambda d: lines.dedup_lines(d).select("doc_id", "deduped"),
        "substring": lambda d: substring.remove_repeats(d).select("doc_id", "deduped"),
        "simhash": lambda d: simhash.near_duplicates(d),
        "packing": lambda d: packing.pack_documents(d, with_ids=False).select("doc", "piece", "start", "length", "ids_crc32"),
    }
    for name, run in runs.items():
        assert sorted(map(str, run(crowded).collect())) == sorted(map(str, run(docs).collect())), name
        assert run(docs.limit(0)).count() == 0, name


def test_registered_pipeline(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "best_fit_packing"]


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test tables")
def test_text_queries_equal_sql(spark):
    """The three queries that SQL can express."""
    import duckdb

    from tests.test_queries import rows
    from tidewell.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for name in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in ORACLES.items():
        assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.execute(sql).fetchdf()), name
