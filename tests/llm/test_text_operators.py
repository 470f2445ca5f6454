import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidewell.llm import components, decontaminate, langid, lines, packing, quality, simhash, substring, tokens, urls, warc
from tidewell.llm.vocabulary import load_pieces, vocabulary_path

SF = "/root/testdata/sf0.001"
VOCABULARY = "the of and to in that was with from for on by as is at were which this be are an it his not have".split()
ODD = [None, "", " ", "\n\n", "one", "a b c", "x" * 9000, "été ÇA Ünï ﬁ ① 日本語 İstanbul Σας", "tab\tand\u00a0nbsp\u2003em \x1csep", "a\r\nb\r\nc", "1234 5,6!! ### $$$"]


def rng_text(r, n):
    return " ".join(r.choice(VOCABULARY) + str(r.randrange(40)) for _ in range(n))


def table(spark, texts, extra=True):
    rows = [(i, t, "x", "y", -1) if extra else (i, t) for i, t in enumerate(texts)]
    names = "doc_id long, text string" + (", n_words string, spans string, verdict int" if extra else "")
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts with shared passages, copies, near copies, repeats and odd ones."""
    r = random.Random(5)
    texts = [rng_text(r, r.choice([3, 12, 13, 14, 40, 200])) for _ in range(60)]
    passage = rng_text(r, 60)
    texts += [rng_text(r, 20) + " " + passage + " " + rng_text(r, 10) for _ in range(8)]
    texts += [texts[5]] * 6 + [texts[4].replace("of", "off", 1), texts[3] + " tail"]
    texts += [texts[7] + "\n" + texts[7], "same line again\n" * 30, (rng_text(r, 9) + " ") * 12]
    long = rng_text(r, 3000)
    for i in range(6):
        w = long.split()
        w[100 * i] = "changed"
        texts.append(" ".join(w))
    return texts + ODD + [None, ""]


def test_token_counts_equal_the_tokenizer(spark, corpus):
    from tokenizers import Tokenizer, models, pre_tokenizers

    own = Tokenizer(models.Unigram(list(load_pieces(vocabulary_path())), unk_id=0, byte_fallback=True))
    own.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    own.encode_special_tokens = True
    real = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts = corpus + real
    got = {r.doc_id: r.tokens.n_tokens for r in tokens.count_tokens(table(spark, texts)).collect()}
    assert got == {i: len(own.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_simhash_groups_equal_brute_force(spark, corpus):
    texts = corpus + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    found = simhash.near_duplicates(table(spark, texts)).collect()
    want = [(i, brute.fingerprint(t)) for i, t in enumerate(texts)]
    assert {r.doc: r.fingerprint & (2**64 - 1) for r in found} == dict(want)
    assert {r.doc: r.component_id for r in found} == brute.components(want)
    kept = simhash.keep_one_of_each(table(spark, texts))
    assert {r.doc_id for r in kept.collect()} == set(brute.components(want).values())


def test_golay_keys_meet_at_four_errors():
    r = random.Random(1)
    some = [r.getrandbits(64) for _ in range(4000)]
    near = []
    for f in some:
        for bit in r.sample(range(64), r.randrange(5)):
            f ^= 1 << bit
        near.append(f)

    def keys(prints):
        out = [set() for _ in prints]
        for row, key in zip(*simhash.fingerprint_keys(np.array(prints, np.uint64).view(np.int64)), strict=True):
            out[row].add(int(key))
        return out

    assert all(a & b for a, b in zip(keys(some), keys(near), strict=True))


def test_dense_cluster_and_chain(spark):
    r = random.Random(3)
    center = r.getrandbits(63)
    prints = {center}
    while len(prints) < 300:
        f = center
        for bit in r.sample(range(63), r.randrange(1, 5)):
            f ^= 1 << bit
        prints.add(f)
    step = r.getrandbits(63)
    for i in range(12):  # neighbours differ by 4 bits, ends by 48
        prints.add(step)
        step ^= 15 << 4 * i
    prints |= {r.getrandbits(63) for _ in range(200)}
    rows = sorted(prints)
    for crowd in (64, 3):
        got = simhash.link_fingerprints(spark.createDataFrame([(f,) for f in rows], "fingerprint long"), crowd=crowd).collect()
        assert {x.fingerprint: x.group for x in got} == brute.components([(f, f) for f in rows])


def joined_on_f(spark, run):
    """Rows that joins on fingerprints alone made while run() ran."""
    store = spark._jsparkSession.sharedState().statusStore()
    known = store.executionsCount()
    run()
    made, executions = 0, store.executionsList()
    for at in range(known, executions.size()):
        found = executions.apply(at).executionId()
        values, nodes = store.executionMetrics(found), store.planGraph(found).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            if re.search(r"Join \[f#\d+L\], \[f#\d+L\], Inner", node.desc()):
                metrics = map(node.metrics().apply, range(node.metrics().size()))
                made += sum(int(values.apply(m.accumulatorId()).replace(",", "")) for m in metrics if m.name() == "number of output rows" and values.contains(m.accumulatorId()))
    return made


def test_settled_buckets_of_near_copies_are_not_compared_again(spark):
    """Every pair of 301 fingerprints is linked, so each bucket is one group after its smallest member has met the others."""
    center = random.Random(4).getrandbits(63)
    flips = [c for n in range(3) for c in itertools.combinations(range(0, 48, 2), n)]
    dense = [center ^ sum(1 << b for b in c) for c in flips]
    chain = [center ^ ((1 << 63) - 1) ^ ((1 << 4 * i) - 1) for i in range(1, 6)]  # neighbours differ by 4 bits, others by more
    rows = sorted(dense + chain)
    frame = spark.createDataFrame([(f,) for f in rows], "fingerprint long")
    got = []
    made = joined_on_f(spark, lambda: got.extend(simhash.link_fingerprints(frame).collect()))
    assert {x.fingerprint: x.group for x in got} == brute.components([(f, f) for f in rows])
    assert made < 1000  # each fingerprint has about a hundred keys


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 380)] + [(400, 400)]
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    lead = {i: i for i in range(500)}
    for _ in range(500):
        for a, b in pairs:
            lead[a] = lead[b] = min(lead[a], lead[b])
    assert got == {i: lead[i] for a, b in pairs if a != b for i in (a, b)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_substring_equals_brute_force(spark, corpus):
    done = substring.remove_repeats(table(spark, corpus)).collect()
    got = {r.doc_id: (r.deduped.n_words, r.deduped.n_removed, r.deduped.kept_sha256) for r in done}
    assert got == brute.substring(list(enumerate(corpus)))


def test_substring_of_repeated_rows_and_null_ids(spark):
    text = rng_text(random.Random(9), 30)
    rows = [(1, text), (1, text), (None, text), (2, text), (2, "other words")]
    done = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.deduped.n_removed) for r in done.collect()) == [(0, 0), (1, 0), (1, 0), (2, 0), (2, 30)]


def test_decontamination_in_parts_equals_whole(spark, corpus):
    r = random.Random(8)
    items = [(i, rng_text(r, n)) for i, n in enumerate([1, 4, 7, 13, 30, 60])] + [(6, None), (7, ""), (None, rng_text(r, 20))]
    docs = corpus + [f"Start {t.upper()} end {rng_text(r, 8)}" for _, t in items if t] + [items[4][1][20:] + " x " + items[4][1][:90]]
    frame = table(spark, docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda df: sorted((r.doc_id, r.overlap.n_words, r.overlap.n_hit, sorted(r.overlap.item_ids)) for r in df.collect())
    whole = rows(decontaminate.find_contamination(frame, bench))
    assert whole == rows(decontaminate.find_contamination(frame, bench, limit=200))
    want = []
    for i, t in enumerate(docs):
        w = [x for x in decontaminate.fold_words(t).decode().split(" ") if x]
        hit, ids = set(), set()
        for item, text in items:
            b = [x for x in decontaminate.fold_words(text).decode().split(" ") if x]
            n = min(13, len(b))
            grams = {tuple(b[j : j + n]) for j in range(len(b) - n + 1)} if n else set()
            for s in range(len(w) - n + 1) if n else ():
                if tuple(w[s : s + n]) in grams:
                    hit.update(range(s, s + n))
                    ids |= {str(item)} - {"None"}
        want.append((i, len(w), len(hit), sorted(ids)))
    assert whole == sorted(want)
    assert sum(x[2] > 0 for x in whole) >= 6
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.drop_contaminated(frame, none).count() == len(docs)


def test_quality_counts_equal_brute_force(spark, corpus):
    got = quality.judge_quality(table(spark, corpus), quality.DecisionList(())).collect()
    for r in got:
        j = r.judged
        assert (j.n_words, j.word_chars, j.n_symbols, j.n_dup_lines, j.n_repeat_words) == brute.quality_counts(corpus[r.doc_id]), corpus[r.doc_id]
        assert j.base_failed == (j.n_words < 20 or 100 * j.n_repeat_words > 30 * j.n_words) and j.kept == (not j.base_failed)


def test_decision_list_learns_thresholds(spark):
    r = random.Random(4)
    rows = [(r.random(), r.random(), r.random()) for _ in range(3000)]
    rows = [(a, b, c, (a > 0.8 and b <= 0.5) or c > 0.95) for a, b, c in rows]
    frame = spark.createDataFrame(rows, "a double, b double, c double, bad boolean")
    rules = quality.fit_decision_list(frame, features=("a", "b", "c"))
    right = frame.select((rules.bad() == F.col("bad")).alias("r")).filter("r").count()
    assert right >= 0.97 * len(rows) and 1 < len(rules.rules) <= 6
    assert quality.fit_decision_list(frame.filter("not bad"), features=("a", "b", "c")).rules == ()
    assert quality.fit_decision_list(frame.limit(0), features=("a", "b", "c")).rules == ()


def test_quality_on_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.learn_quality(docs, labels)
    judged = quality.judge_quality(docs, rules).join(labels, "doc_id")
    good = judged.filter("quality = 1 and not judged.base_failed").agg(F.avg(F.col("judged.kept").cast("int"))).first()[0]
    bad = judged.filter("quality = 0").agg(F.avg(F.col("judged.kept").cast("int"))).first()[0]
    assert good > 0.97 and bad < 0.35, (good, bad, str(rules))


def test_line_dedup(spark):
    r = random.Random(6)
    block = [rng_text(r, 8) for _ in range(14)]
    texts = ["\n".join([rng_text(r, 6) for _ in range(10)] + block + [rng_text(r, 6) for _ in range(10)]) for _ in range(5)]
    texts += ["single line", "\n\n\n\n", None, "", "\n".join(block), "a\n" * 500]
    frame = table(spark, texts)
    done = {x.doc_id: x.deduped for x in lines.dedup_lines(frame).collect()}
    assert done[0].n_removed == 0 and done[0].kept == texts[0]
    for i in range(1, 5):
        gone = [x for x in texts[i].split("\n") if x not in done[i].kept.split("\n")]
        assert len(gone) == done[i].n_removed >= 4 and set(gone) <= set(block)
        assert [x for x in texts[i].split("\n") if x not in gone] == done[i].kept.split("\n")
    assert done[5].kept == texts[5] and done[6].kept == texts[6] and done[7].kept is None and done[8].kept == ""
    assert done[9].n_removed >= 4
    kept = lines.drop_repeated_lines(table(spark, [texts[0], texts[0] + "\n", texts[7], texts[8]]))
    assert kept.columns == frame.columns and {x.doc_id for x in kept.collect()} >= {0, 2, 3}


def test_line_dedup_compares_bytes_of_chunks(spark):
    frame = table(spark, ["l1 a\nl2 b\nl3 c\nl4 d", "l1 a\nl2 b\nl3 c\nl4 d", "l1 a\nl2 b\nl3 c\nl4 e"])
    rows = frame.select("doc_id", lines.let(F.split("text", "\n"), lambda x: lines.chunk_spans(x, 4)).alias("c")).collect()
    found = {(r.doc, s.first, s.n) for r in lines.repeated_chunks(frame).collect() for s in r.gone}
    want, seen = set(), {}
    for r in sorted(rows):
        for c in r.c:
            part = tuple(frame.collect()[r.doc_id].text.split("\n")[c.first : c.first + c.n])
            if c.n >= 2 and seen.setdefault(part, r.doc_id) != r.doc_id:
                want.add((r.doc_id, c.first, c.n))
    assert found == want


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http://X.NET/a?b": ("x.net", "/a", "net/", "block"),
        "http://net": ("net", "", None, "allow"), "http://a.example.net/en/x#y": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://a.example.net/en": ("a.example.net", "/en", "net/", "block"), "https://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "https://badexample.com/de/": ("badexample.com", "/de/", None, "allow"), "//://q.org/fr/": ("q.org", "/fr/", "org/fr/", "allow"),
        "https://casino.example.com/en/": ("casino.example.com", "/en/", None, "block"), "https://xnet/en/": ("xnet", "/en/", None, "allow"),
        "http://a.org/FR/": ("a.org", "/FR/", None, "allow"), "x\n://h\nh.net/\n": ("h\nh.net", "/\n", "net/", "block"),
    }
    frame = spark.createDataFrame([(i, u, "z") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r.url: (r.judged.host, r.judged.path, r.judged.rule, r.judged.verdict) for r in urls.judge_urls(frame).collect()}
    assert got == cases
    assert urls.judge_urls(frame.limit(0)).count() == 0


def test_url_rule_is_filed_under_its_rarest_token(spark):
    frame = spark.createDataFrame([(f"http://a{i}.example.net/en/",) for i in range(9)] + [("http://example.org/",)], "url string")
    filed = urls.rarest_tokens(frame, F.concat(urls.host_of(F.col("url")), urls.path_of(F.col("url"))), (urls.host_rule("allow", "example.net/en/"),))
    assert filed["example.net/en/"] == "net"


def test_warc_round_trip(spark):
    pages = [(i, f"http://h/{i}\r\nX: y", t) for i, t in enumerate(["<p>a</p>" * 9, "", None, "é" * 40000, "<p>a</p>" * 9, "b"])] + [(None, None, "b"), (None, None, "c"), (9, "u", "d"), (9, "u", "d")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    manifest = warc.write_warc(frame)
    got = {}
    for r in warc.read_warc(manifest).collect():
        got.setdefault(r.page_id, []).append(r)
    assert sum(map(len, got.values())) == len(pages) == sum(r.records for r in manifest.collect())
    one = lambda i: got[i][0]
    assert (one(0).record_type, one(0).refers_to, one(0).payload_bytes, one(0).payload_digest) == ("revisit", 4, 72, warc.payload_digest(b"<p>a</p>" * 9))
    assert bytes(one(4).payload).decode() == pages[4][2] and one(3).payload_bytes == 80000 and bytes(one(3).payload).decode() == pages[3][2]
    assert (one(1).record_type, one(1).refers_to, one(2).record_type) == ("revisit", 2, "response")
    assert sorted(r.record_type for r in got[None]) == ["response", "revisit"] and [r.record_type for r in got[9]] == ["response"] * 2
    assert warc.read_warc(warc.write_warc(frame.limit(0))).count() == 0
    assert all(r.record_type == "response" for r in warc.read_warc(warc.write_warc(frame, least=1 << 30)).collect())


def test_warc_archives_are_zstandard_with_a_dictionary_frame():
    records = [warc.build_record(i, "http://x/", f"<html>{i} common words in every page</html>".encode(), None, False) for i in range(300)]
    data = warc.write_archive(records, size=4096)
    assert data[:4] == bytes.fromhex("5d2a4d18") and list(warc.read_archive(data)) == records
    assert len(data) < sum(map(len, records)) / 3
    with pytest.raises(ValueError):
        list(warc.read_archive(data[:-3]))


def test_packing_pieces_equal_the_tokenizer(spark, corpus):
    from array import array

    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary_path(packing.VOCABULARY))
    own.encode_special_tokens = True
    texts = corpus + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + ["<|endoftext|> it's WE'LL don't", "n\u0303 e\u0301 \u212b"]
    packed = packing.pack_documents(table(spark, texts)).collect()
    docs, bins = {}, {}
    for r in packed:
        docs.setdefault(r.doc, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    assert set(docs) == set(range(len(texts)))
    total = 0
    for i, text in enumerate(texts):
        ids = array("I", own.encode(text or "", add_special_tokens=False).ids + [0])
        parts = sorted(docs[i], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and array("I", b"".join(map(bytes, (r.ids for r in parts)))) == ids, text
        assert all(r.start == 2048 * r.piece and r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length for r in parts)
        assert all(r.length == 2048 for r in parts[:-1])
        total += len(ids)
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(bins) <= 1.02 * total / 2048 + 2


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_packing_keeps_every_capacity(by):
    r = random.Random(7)
    histogram = {n: r.randrange(1, 60) for n in r.sample(range(1, 151), 120)}
    capacity = packing.Capacity(200, 6, 24000) if by == "norm" else packing.Capacity(200, 9, 40000)
    runs = packing.plan_bins(histogram, capacity, by=by)
    bins, ranks = {}, {}
    for length, rank, n, first, offset in runs.tolist():
        for i in range(n):
            bins.setdefault(first + i, []).append((offset, length))
            ranks.setdefault(length, []).append(rank + i)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in histogram.items()}
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 200 and len(items) <= capacity.documents and sum(n * n for _, n in items) <= capacity.cost


def test_packing_hot_lengths_and_repeated_rows(spark):
    rows = [(i % 40, 0, 700, 5) for i in range(400)] + [(i, 1, 1, i) for i in range(300)]
    pieces = spark.createDataFrame(rows, "doc long, piece int, length long, ids_crc32 long")
    got = packing.pack(pieces, group=16).collect()
    places = {(r.sequence_id, r.offset) for r in got}
    assert len(places) == len(got) == 700 and len({r.sequence_id for r in got if r.length == 700}) == 200


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn_languages(docs.filter(~langid.held_out()))
    judged = langid.identify(docs, model).filter(langid.held_out())
    right = judged.agg(F.avg((F.col("language.lang_pred") == F.col("lang")).cast("int")), F.min("language.score"), F.max("language.score")).first()
    assert right[0] > 0.97 and 0 <= right[1] and right[2] <= 1
    odd = {r.text: (r.language.lang_pred, r.language.score) for r in langid.identify(table(spark, ODD), model).collect()}
    assert odd[None] == odd[""] == odd["\n\n"] == ("und", 0.0) and odd["x" * 9000][0] != "und"
    empty = langid.learn_languages(docs.limit(0))
    assert {r.language.lang_pred for r in langid.identify(table(spark, ODD), empty).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    import math

    path = vocabulary_path()
    names = {p: i for i, (p, _) in enumerate(load_pieces(path))}
    table = np.random.default_rng(1).random((len(names) + 1, 2)) / len(names)
    model = langid.LanguageModel(["a", "b"], table, path)

    def total(s, lang):
        if not s:
            return 1.0
        out = 0.0
        for n in range(1, len(s) + 1):
            piece = names.get(s[:n], -1 if n == 1 else None)
            if piece is not None:
                out += table[piece, lang] * total(s[n:], lang)
        return out

    words = ["ander", "theñ", "日本語ab", "a"]
    together = model.short_words(words)
    for i, word in enumerate(words):
        for lang in (0, 1):
            assert model.word(word)[lang] == pytest.approx(math.log(total("▁" + word, lang)))
            assert together[i, lang] == pytest.approx(model.word(word)[lang])
    assert model.word("abcd" * 100)[0] < -1000
