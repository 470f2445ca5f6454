"""Many rules, joins by force, special tokens, clashing names, empty tables, null ids, one long text."""

import random
from array import array

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tidewell.llm import decontaminate, lines, packing, quality, simhash, tokens, urls, warc
from tidewell.llm.vocabulary import vocabulary_path

SF = "/root/testdata/sf0.001"
CLASH = ("__doc", "__key", "__gone", "__both", "__stats", "__words", "__host", "__path", "__best", "__target", "__salt", "__l", "__s", "__at", "__rank", "__before", "__overlap", "__other", "__spans", "__ids", "__lines", "__language", "n", "part")


def test_six_thousand_rules_go_as_a_table_with_the_same_result(spark):
    rules = urls.RULES + tuple(urls.host_rule("block" if i % 2 else "allow", f"site{i}.example/{'a/' * (i % 3)}") for i in range(6000)) + (urls.Rule("any:x9", "block", "x9", ()),)
    cases = [f"http://w.site{i}.example/a/a/q" for i in range(0, 6000, 37)] + ["http://b.net/", "http://casino.site4.example/", "http://zx9.org/", None, "none", "http://site1.example/A/"] * 2
    frame = spark.createDataFrame([(i, u, 1) for i, u in enumerate(cases)], "page_id long, url string, __best int")
    got = {r.page_id: r.judged for r in urls.judge_urls(frame, rules=rules).collect()}
    near = tuple(r for i, r in enumerate(rules) if i < len(urls.RULES) or (i - len(urls.RULES)) % 37 in (0, 1, 4) or not r.tokens)
    want = {r.page_id: r.judged for r in urls.judge_urls(frame, rules=near).collect()}
    assert got == want and len({x.matched for x in got.values()}) > 150
    assert urls.judge_urls(frame.limit(0), rules=rules).count() == 0


def test_decontamination_by_merge_joins_alone(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    by = {limit: decontaminate.find_contamination(docs, bench, limit=limit) for limit in (8 << 20, 0)}
    assert by[0].schema == by[8 << 20].schema
    assert sorted(map(str, by[0].collect())) == sorted(map(str, by[8 << 20].collect()))
    assert by[0].filter("overlap.n_hit > 0").count() > 0
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Broadcast" not in decontaminate.find_contamination(docs, bench)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_special_tokens_as_the_library_has_them(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary_path(packing.VOCABULARY))
    texts = ["<|startoftext|>", "a <|endoftext|> b", "<|ENDOFTEXT|> x<|endoftext|>y", "<| endoftext|>", "plain, it's", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc: array("I", bytes(r.ids)).tolist() for r in packing.pack_documents(frame, specials=True).collect()}
    assert got == {i: [*own.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}


def test_clashing_names_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    crowded = docs.withColumns({n: F.lit(i) for i, n in enumerate(CLASH)})
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    runs = {
        "tokens": lambda d: tokens.count_tokens(d), "overlap": lambda d: decontaminate.find_contamination(d, bench),
        "judged": lambda d: quality.judge_quality(d, quality.DecisionList(())), "deduped": lambda d: lines.dedup_lines(d, whole=True),
        "offset": lambda d: packing.pack(d.withColumns({"length": F.lit(5), "doc": F.col("doc_id"), "piece": F.lit(0), "ids_crc32": F.lit(0)})),
    }
    for column, run in runs.items():
        done = run(crowded)
        assert set(crowded.columns) <= set(done.columns), column
        assert all(done.filter(F.col(n) != i).isEmpty() for i, n in list(enumerate(CLASH))[:3]), column
        assert sorted(str(r[column]) for r in done.collect()) == sorted(str(r[column]) for r in run(docs).collect()), column
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(crowded).collect()) == sorted(r.doc_id for r in simhash.keep_one_of_each(docs).collect())


def test_every_stage_on_an_empty_table_null_ids_and_repeated_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = "die und der das ist nicht ein wort für alle menschen hier oben und unten\n" * 2
    odd = spark.createDataFrame([(None, text, None, None, None), (None, None, "de", "x", 0), (7, text, "de", "x", 1), (7, text, "de", "x", 1)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        done = stage(spark, odd, SF)
        assert done.count() <= 4 and (name == "best_fit_packing" or done.columns == docs.columns), name
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, odd, SF)
    assert kept.filter("doc_id = 7").count() == 2


def test_one_text_of_twenty_megabytes(spark):
    r = random.Random(3)
    text = "\n".join(" ".join(r.choice(("the", "and", "of", "cat", "house")) + str(r.randrange(99)) for _ in range(12)) for _ in range(280_000))
    assert len(text) > 20_000_000
    frame = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, text[5_000_000:5_002_000])], "item_id long, text string")
    n = len(text.split())
    assert tokens.count_tokens(frame).filter("doc_id = 1").first().tokens.n_tokens > n
    assert decontaminate.find_contamination(frame, bench).filter("doc_id = 1").first().overlap.n_words == n
    assert decontaminate.find_contamination(frame, bench).filter("overlap.n_hit > 150").count() == 1
    assert quality.judge_quality(frame, quality.DecisionList(())).filter("doc_id = 1").first().judged.n_words == n
    assert lines.dedup_lines(frame).filter("doc_id = 1").first().deduped.n_lines == 280_000
    assert simhash.near_duplicates(frame).filter("doc = 1").first().fingerprint & (2**64 - 1) == brute.fingerprint(text)
    assert packing.pack_documents(frame, with_ids=False).filter("doc = 1").agg(F.sum("length")).first()[0] > n


def test_archives_keep_extra_columns_out_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, "u", "a", 3), (2, "u", "a", 4)], "page_id long, url string, html string, lead int")
    rows = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_warc(warc.write_warc(frame)).collect()}
    assert rows == {1: ("revisit", 2), 2: ("response", None)}
    assert warc.read_warc(warc.write_warc(frame.limit(0))).count() == 0


@pytest.mark.parametrize("name", ["op3_quality_rules", "op5_warc", "op7_line_dedup", "op8_best_fit_packing", "op9_simhash_dedup", "op1_token_counts"])
def test_registered_queries_equal_brute_force(spark, name):
    from tests.llm.test_whole_lines import whole_dedup
    from tidewell.llm.queries import QUERIES

    got = QUERIES[name](spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    if name == "op3_quality_rules":
        assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {i: brute.quality_counts(t) for i, t in docs.items()}
        assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.kept and r.base_failed) for r in got)
    elif name == "op5_warc":
        pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
        last = {}
        for i, data in pages.items():
            last[data] = max(last.get(data, i), i)
        want = {i: (len(d), warc.payload_digest(d), "response" if last[d] == i else "revisit", None if last[d] == i else last[d]) for i, d in pages.items()}
        assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want
    elif name == "op7_line_dedup":
        assert {r.doc_id: r.n_removed for r in got} == {i: n for i, (_, n) in whole_dedup(sorted(docs.items())).items()}
    elif name == "op8_best_fit_packing":
        import zlib

        from tokenizers import Tokenizer

        own = Tokenizer.from_file(vocabulary_path(packing.VOCABULARY))
        want, bins = {}, {}
        for i, t in docs.items():
            ids = [*own.encode(t or "", add_special_tokens=False).ids, 0]
            for k in range(0, len(ids), 2048):
                part = ids[k : k + 2048]
                want[i, k // 2048] = (k, len(part), zlib.crc32(array("I", part).tobytes()))
        assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
        for r in got:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert all(at == sum(n for _, n in sorted(places)[:k]) for places in bins.values() for k, (at, _) in enumerate(sorted(places)))
        assert max(sum(n for _, n in p) for p in bins.values()) <= 2048 and len(bins) <= sum(n for _, n, _ in want.values()) / 2048 * 1.02 + 2
    elif name == "op9_simhash_dedup":
        prints = [(i, brute.fingerprint(t)) for i, t in docs.items()]
        lead = brute.components(prints)
        assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f:016x}", lead[i]) for i, f in prints}
    else:
        from tokenizers import Tokenizer, models, pre_tokenizers

        from tidewell.llm.vocabulary import load_pieces

        pieces = load_pieces(vocabulary_path())
        own = Tokenizer(models.Unigram(list(pieces), unk_id=0, byte_fallback=True))
        own.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        own.encode_special_tokens = True
        for r in got:
            assert r.n_tokens == len(own.encode(docs[r.doc_id] or "", add_special_tokens=False).ids)
