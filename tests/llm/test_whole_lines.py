"""Line dedup with whole=True: repeated passages go from their first to their last line. All windows of two lines are the brute force."""

import random

import corpus_pipeline
from tests.llm import brute
from tidewell.llm import lines
from tidewell.llm.queries import op7_line_dedup

SF = "/root/testdata/sf0.001"


def windows(text, least=2):
    """Runs of neighbouring lines with a word: [(first line, lines)]."""
    rows = text.split("\n")
    full = [i for i, x in enumerate(rows) if brute.words(x)]
    return [(a, tuple(rows[a : b + 1])) for a, b in zip(full, full[least - 1 :])]


def whole_dedup(docs, least=2):
    """(text left, lines gone) of (id, text) pairs of distinct ids: chunks and all windows."""
    found, lead, out = {}, {}, {}
    for i, text in docs:
        if text is not None:
            found[i] = windows(text, least) + [(f, tuple(p)) for f, p in brute.chunks(text) if sum(bool(brute.words(x)) for x in p) >= least]
            for first, part in found[i]:
                lead[part] = min(lead.get(part, (i, first)), (i, first))
    for i, text in docs:
        late = [(f, p) for f, p in found.get(i, ()) if lead[p][0] < i or f >= lead[p][1] + len(p)]
        gone = {k for f, p in late for k in range(f, f + len(p))}
        out[i] = (text if not gone else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone), len(gone))
    return out


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_planted_passages_go_whole(spark):
    r = random.Random(3)
    line = lambda: " ".join(str(r.randrange(10**6)) for _ in range(5))
    passages = [[line() for _ in range(n)] for n in (2, 2, 3, 3, 4, 6, 9)]
    texts = ["\n".join([line(), *p, line()]) for _ in range(3) for p in passages]
    done = {x.doc_id: x.deduped for x in lines.dedup_lines(frame(spark, texts), whole=True).collect()}
    for i, text in enumerate(texts):
        rows = text.split("\n")
        assert (done[i].kept, done[i].n_removed) == ((text, 0) if i < len(passages) else (rows[0] + "\n" + rows[-1], len(rows) - 2))


def test_whole_equals_brute_force_of_all_windows(spark):
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts = docs + [None, "", "\n", "a\n" * 500, "b\n\nc\n\nd", "x\nb\n\nc\ny", "b\nc", "e\nf\ne\nf\ne\nf", "a\na\nz", "one"]
    got = {r.doc_id: (r.deduped.kept, r.deduped.n_removed) for r in lines.dedup_lines(frame(spark, texts), whole=True).collect()}
    assert got == whole_dedup(list(enumerate(texts)))
    at = len(docs)
    assert got[at + 3] == ("a\na\n", 498) and got[at + 5] == ("x\ny", 3) and got[at + 6] == ("b\nc", 0) and got[at + 7] == ("e\nf", 4)


def test_whole_removes_what_chunks_remove_and_repeated_rows_alike(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    docs = frame(spark, texts)
    part = {r.doc_id: r.deduped.n_removed for r in lines.dedup_lines(docs).collect()}
    once = {r.doc_id: r.deduped.n_removed for r in lines.dedup_lines(docs, whole=True).collect()}
    assert all(once[i] >= n for i, n in part.items())
    twice = lines.dedup_lines(docs.unionByName(docs), whole=True).collect()
    assert len(twice) == 2 * len(texts) and {r.doc_id: r.deduped.n_removed for r in twice} == once


def test_coarse_chunks_find_what_lines_alone_miss(spark):
    """Lines that each stand alone in an earlier text have their leaders there; a chunk of them has its own."""
    r = random.Random(5)
    passages = [[" ".join(str(r.randrange(10**6)) for _ in range(4)) for _ in range(6)] for _ in range(12)]
    alone = [line for p in passages for line in p]
    texts = alone + [f"{k} first\n" + "\n".join(p) + f"\n{k} last" for k, p in enumerate(passages * 2)]
    gone = lambda spread: sum(x.deduped.n_removed for x in lines.dedup_lines(frame(spark, texts), whole=True, spread=spread).collect())
    want = sum(t.count("\n") - (s or "").count("\n") for (_, t), s in zip(enumerate(texts), brute.line_dedup(list(enumerate(texts)), spread=2).values()))
    assert gone(10**9) == 0 < gone(2) == want  # with one chunk to a text, and with chunks of about two lines


def test_hashes_and_bytes_of_every_removed_line_are_of_an_earlier_pair(spark):
    texts = [x.text for x in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    first = {}
    for i, text in enumerate(texts):
        for at, pair in windows(text or ""):
            first.setdefault(pair, (i, at))
    got = lines.repeated_chunks(frame(spark, texts), whole=True).collect()
    for x in got:
        rows = texts[x.doc].split("\n")
        for c in x.gone:
            part = tuple(rows[c.first : c.first + c.n])
            assert all(first[p] < (x.doc, c.first + at) for at, p in windows("\n".join(part)) if p in first)


def test_op7_removes_whole_passages(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.n_removed for r in op7_line_dedup(spark, SF).collect()}
    assert got == {i: n for i, (_, n) in whole_dedup(sorted(rows.items())).items()}


def test_stages_after_whole_line_dedup_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    want = {i: t for i, (t, n) in whole_dedup(sorted(texts.items())).items() if not n or brute.words(t)}
    now = stages["line_dedup"](spark, docs, SF)
    found = now.collect()
    assert now.columns == docs.columns and {r.doc_id: r.text for r in found} == want and all(r.n_chars == len(r.text) for r in found)

    lead = brute.components([(i, brute.fingerprint(t)) for i, t in want.items()])
    want = {i: want[i] for i in set(lead.values())}
    now = stages["near_dedup"](spark, now, SF)
    assert {r.doc_id: r.text for r in now.collect()} == want

    bad = {i for i, t in want.items() if (o := brute.overlap(t, bench))[1] and 20 * o[1] >= o[0]}
    now = stages["decontamination"](spark, now, SF)
    assert {r.doc_id for r in now.collect()} == set(want) - bad and bad
    assert {r.doc_id for r in stages["best_fit_packing"](spark, now, SF).collect()} == set(want) - bad
