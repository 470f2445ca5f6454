"""Merkle proofs against a plain tree."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidewell.llm import merkle

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H(*[field(x) for x in (r[0], r[3], r[2], r[4], text)])
    leaves, proofs, by = [leaf(r, r[1]) for r in rows], [[] for _ in rows], {}
    for k, r in enumerate(rows):
        by.setdefault(r[3], []).append(k)

    def top(nodes):
        while len(nodes) > 1:
            above = []
            for i in range(0, len(nodes), 3):
                run = nodes[i : i + 3]
                for j, (_, members) in enumerate(run):
                    for k in members:
                        proofs[k].append(([h for h, _ in run[:j]], [h for h, _ in run[j + 1 :]]))
                above.append((H(*[h for h, _ in run]), [k for _, m in run for k in m]))
            nodes = above
        return nodes[0]

    subs, tops = {}, []
    for s in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        ks = sorted(by[s], key=lambda k: ((rows[k][0] is not None, rows[k][0] or 0), leaves[k]))
        tops.append(top([(leaves[k], [k]) for k in ks]))
        subs[s] = tops[-1][0]
    root = top(tops)[0] if tops else None
    out = []
    for k, r in enumerate(rows):
        text = r[1]
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
            text = text.replace("\n", "")
        at = leaf(r, text)
        for left, right in proofs[k]:
            at = H(*left, at, *right)
        out.append((r[0], leaves[k], subs[r[3]], root, H(*[x for a, b in proofs[k] for x in a + b]), at, at == root))
    return sorted(map(repr, out))


def made(n, sources, seed=1):
    r = random.Random(seed)
    return [(r.choice([None, 3, 3]) if r.random() < 0.1 else i, r.choice([None, "", "a\nb", f"x é\n\n{i}"]), r.choice([None, "en"]), r.choice(sources), r.choice([None, i])) for i in range(n)]


@pytest.mark.parametrize("n, sources", [(1, [None]), (2, ["a", "b"]), (40, [None, "a", "", "é"]), (100, ["a"] * 8 + ["b", None]), (30, list(map(str, range(25))))])
def test_proofs_equal_a_plain_tree(spark, n, sources):
    rows = made(n, sources)
    rows = rows + rows[:2] if n > 2 else rows  # repeated rows are leaves of their own
    frame = spark.createDataFrame(rows, KIND).select("*", *[F.lit(1).alias(c) for c in ("sid", "hash", "n", "part")])
    got = merkle.verify_manifest(frame, merkle.tampered_text())
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows)


def test_copies_of_crowded_ancestors_change_nothing(spark):
    rows = made(90, ["a"] * 5 + ["b"], seed=4)
    got = merkle.merkle_proofs(spark.createDataFrame(rows, KIND), crowd=2)
    shown = got.select("doc_id", "leaf", "subroot", "root", merkle.proof_hash(F.col("segment")).alias("p"), merkle.fold(F.col("leaf"), F.col("segment")).alias("f")).collect()
    want = {(w[1], w[2], w[3], w[4]) for w in map(eval, brute(rows))}
    assert {(r.leaf, r.subroot, r.root, r.p) for r in shown} == want and all(r.f == r.root for r in shown)


def test_empty_table_and_long_texts(spark):
    assert merkle.verify_manifest(spark.createDataFrame([], KIND)).count() == 0
    rows = [(i, "é\n" * 400_000 * i, "en", "a", 1) for i in range(4)]
    got = merkle.verify_manifest(spark.createDataFrame(rows, KIND), merkle.tampered_text()).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows)
