"""Near copies by the similarity of five-word shingles, against all pairs."""

import random

import pytest

import corpus_pipeline
from tests.llm import brute
from tidewell.llm import similar, simhash

SF = "/root/testdata/sf0.01"


def grams(text, size=5):
    words = brute.words(text)
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def groups(rows, least=0.8):
    """Smallest id reachable over fingerprints within 4 bits or similar shingles."""
    sets = {i: grams((t or "").translate({c: c + 32 for c in range(65, 91)})) for i, t in rows}
    prints = {i: brute.fingerprint(t) for i, t in rows}
    lead = {i: i for i, _ in rows}

    def root(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for a in sets:
        for b in sets:
            if a < b:
                common = len(sets[a] & sets[b])
                alike = common and common >= least * len(sets[a] | sets[b]) - 1e-9
                if alike or (prints[a] ^ prints[b]).bit_count() <= 4:
                    x, y = sorted((root(a), root(b)))
                    lead[y] = x
    return {i: root(i) for i in lead}


def test_groups_equal_all_pairs(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for group in range(12):
        base = [word() for _ in range(rng.choice([60, 200, 400]))]
        for copy in range(rng.choice([1, 2, 9])):
            now = list(base)
            for _ in range(copy and rng.randrange(1, max(2, len(base) // 60))):
                now[rng.randrange(len(now))] = word().upper()
            rows.append((len(rows), " ".join(now)))
    rows += [(100, None), (101, ""), (102, "one two"), (103, "One  two"), (104, "x " * 200_000), (105, "x " * 150_000), (106, rows[0][1]), (107, rows[0][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r.doc: r.component_id for r in simhash.near_duplicates(frame, similarity=0.8).collect()}
    assert found == groups(rows) and len(set(found.values())) < len({r.component_id for r in simhash.near_duplicates(frame).collect()})
    kept = {r.doc_id for r in simhash.keep_one_of_each(frame, similarity=0.8).collect()}
    assert kept == set(groups(rows).values())
    assert simhash.near_duplicates(frame.limit(0), similarity=0.8).count() == 0


def test_crowds_do_not_change_the_groups(spark):
    """Thousands of keys in one bucket: a shared passage, and two dense groups that a chain of texts links."""
    rng = random.Random(1)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(60):
        now = list(base)
        for at in range(0, k, 4):
            now[at] = f"v{at}"
        rows.append((k, " ".join(now)))
    rng.shuffle(rows)
    frame = spark.createDataFrame([(i, i, t) for i, t in rows], "t long, g long, text string")
    texts = similar.add_sample_keys(frame).select("t", "g", "bands")
    want = groups([(i, t) for i, t in rows])
    for crowd in (1, 7, 64):
        found = {r.g: r.wider for r in similar.similar_groups(frame.select("t", "text"), texts, 0.8, crowd=crowd).collect()}
        linked = {i for i in want if sum(x == want[i] for x in want.values()) > 1}
        assert all(found[i] == found[want[i]] for i in linked), crowd


def test_recall_of_the_stage_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = {i: grams((t or "").translate({c: c + 32 for c in range(65, 91)})) for i, t in rows}
    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    common = {}
    for held in holders.values():
        if len(held) < 200:
            for x in held:
                for y in held:
                    if x < y:
                        common[x, y] = common.get((x, y), 0) + 1
    texts = dict(rows)
    pairs = [p for p, n in common.items() if texts[p[0]] != texts[p[1]] and n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    found = {r.doc: r.component_id for r in simhash.near_duplicates(docs, similarity=0.8).collect()}
    met = sum(found[a] == found[b] for a, b in pairs)
    assert not pairs or met >= 0.9 * len(pairs), (met, len(pairs))
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF).collect()}
    assert kept == set(found.values())


@pytest.mark.parametrize("text", ["", " \n", None])
def test_no_words_no_keys(text):
    assert similar.sample_keys(text, 5) is None and similar.sample_keys("a b", 5).shape == (similar.BANDS,)


def test_fingerprints_and_keys_take_one_python_worker_a_task(spark, monkeypatch):
    """Two functions in a row are two workers for each task, which executors keep for the stages that follow."""
    plans = []
    keep = simhash.Scratch.keep
    monkeypatch.setattr(simhash.Scratch, "keep", lambda self, df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(self, df))
    rows = [(1, "a b c d e f g"), (2, "A b c d e f g"), (3, None), (4, " "), (5, "x y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    simhash.near_duplicates(frame, similarity=0.8)
    assert max(plan.count("ArrowEvalPython") for plan in plans) == 1
    apart = similar.add_sample_keys(simhash.add_fingerprint(frame))
    together = simhash.add_fingerprint_and_keys(frame)
    assert together.columns == apart.columns and sorted(together.collect()) == sorted(apart.collect())


def joined_up(rows, least=0.8):
    """Smallest id reachable over pairs of texts that share a key and are similar enough, by all pairs."""
    sets, keys = {i: grams(t) for i, t in rows}, {i: set(similar.sample_keys(t, 5).tolist()) for i, t in rows}
    lead = {i: i for i, _ in rows}
    for _ in rows:
        before = dict(lead)
        for a in sets:
            for b in sets:
                if keys[a] & keys[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9:
                    lead[a] = lead[b] = min(lead[a], lead[b])
        if lead == before:
            return lead
    raise AssertionError


def test_families_and_fragments_of_one_text(spark):
    """Copies with edits of their own, families with edits in common, fragments and joined fragments of one text."""
    rng = random.Random(0)
    base = [f"w{k}" for k in range(160)]
    texts = [base]
    for family in range(4):
        common = rng.sample(range(160), rng.choice([4, 6, 9]))
        for copy in range(12):
            now = list(base)
            for at in common:
                now[at] = f"f{family}.{at}"
            for at in rng.sample(range(160), rng.choice([0, 1, 1, 2])):
                now[at] = f"c{family}.{copy}.{at}"
            texts.append(now)
    texts += [base[a : a + size] for size in (100, 110, 125, 140) for a in (0, 3, 8, 20)]
    texts += [[*base[:110], *(f"x{k % 3}.{j}" for j in range(35 + k))] for k in range(9)]
    rng.shuffle(texts)
    rows = list({" ".join(t): i for i, t in enumerate(texts)}.items())
    rows = [(i, t) for t, i in rows]
    frame = spark.createDataFrame([(i, i, t) for i, t in rows], "t long, g long, text string")
    keyed = similar.add_sample_keys(frame).select("t", "g", "bands")
    want = joined_up(rows)
    found = {r.g: r.wider for r in similar.similar_groups(frame.select("t", "text"), keyed, 0.8, crowd=3).collect()}
    assert len(set(want.values())) > 4 and {i: found.get(i, i) for i in want} == want


def test_pairs_follow_the_texts(spark, monkeypatch):
    """A large group of edited copies is no square of pairs; most of it is one group by fingerprint already."""
    rng = random.Random(2)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(500):
        now = list(base)
        for at in rng.sample(range(150), rng.choice([0, 1, 2, 3, 4, 8])):
            now[at] = f"c{k}.{at}"
        rows.append((k, 0 if rng.random() < 0.7 else k, " ".join(now)))
    frame = spark.createDataFrame(rows, "t long, g long, text string")
    counts = []
    verified = similar._verified
    monkeypatch.setattr(similar, "_verified", lambda pairs, *a: counts.append(pairs.count()) or verified(pairs, *a))
    similar.similar_groups(frame.select("t", "text"), similar.add_sample_keys(frame).select("t", "g", "bands"), 0.8).collect()
    assert sum(counts) <= 10 * len(rows), counts
