"""Sequences cut from chunks, and pages from a table in rank order."""

import random
from datetime import date, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators.pages import rank_index
from tidewell.plans import features


def by_windows(df, seq, h, cols, target, extra):
    """Sequences as frames of rows, a whole series in a task."""
    w = Window.partitionBy("symbol", "split").orderBy("i")
    past = F.collect_list(F.array(*[F.col(c).cast("double") for c in cols])).over(w.rowsBetween(-seq, -1))
    made = df.select("symbol", "split", "i", past.alias("x"), *[F.collect_list(c).over(w.rowsBetween(0, h - 1)).alias(n) for c, n in ((target, "y"), (extra, f"y_{extra}"))])
    return made.filter((F.size("x") == seq) & (F.size("y") == h))


def series(spark, n=1500):
    rng = random.Random(2)
    rows = []
    for symbol, size in (("a", n), ("b", 40), ("c", 8), ("d", 17)):
        for i in range(size):
            if rng.random() < 0.97 or symbol == "d":  # holes in the numbers
                rows.append((symbol, "train" if i < size * 0.8 else "test", i, rng.random(), None if rng.random() < 0.01 else rng.random(), rng.randrange(2)))
    return spark.createDataFrame(rows, "symbol string, split string, i int, p double, r double, up int").repartition(5)


def test_sequences_equal_frames_of_rows(spark):
    df = series(spark)
    for rows, seq, h in ((16, 3, 2), (200, 10, 5), (1024, 1, 1)):
        args = {"features": ("r", "p"), "target": "r", "extra": ("up",)}
        chunks = features.sequence_chunks(df, seq, h, rows=rows, **args)
        got = {(r.symbol, r.split, r.i): (r.x, r.y, r.y_up) for r in features.cut_sequences(chunks, seq, h).collect()}
        want = {(r.symbol, r.split, r.i): (r.x, r.y, r.y_up) for r in by_windows(df, seq, h, ("r", "p"), "r", "up").collect()}
        assert got == want and got
        assert features.sequences(df, seq, h, **args).count() == len(want)


def test_chunks_copy_little_and_split_a_series(spark):
    df = spark.range(30_000).selectExpr("'a' as symbol", "'all' as split", "id as i", "rand(1) as r")
    chunks = features.sequence_chunks(df, 60, 7, features=("r",), target="r")
    stored, held, n = chunks.agg(F.sum(F.size("x")), F.count("*"), F.sum("n")).first()
    assert stored <= 1.1 * 30_000 and held >= 28 and n == 30_000 - 60 - 7 + 1
    assert features.sequence_chunks(df.limit(0), 60, 7, features=("r",), target="r").count() == 0
    plan = features.sequences(df, 60, 7, features=("r",), target="r")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" in plan and "Window" in plan and plan.count("hashpartitioning(symbol") <= 5


def files_read(df):
    return {r[0].split("/")[-2] for r in df.select(F.input_file_name()).distinct().collect()}


def test_pages_are_those_of_a_whole_sort_and_read_one_part(spark):
    rng = random.Random(4)
    day = date(2024, 1, 1)
    rows = [(k, rng.choice([None, "a", "b", "c"]), day + timedelta(rng.randrange(30)), rng.choice([1.5, 1.5, 1.5, None, rng.random()])) for k in range(5000)]
    df = spark.createDataFrame(rows, "k int, s string, d date, v double").repartition(6)
    order = [F.desc_nulls_last("v"), F.asc("d"), F.asc_nulls_first("s")]
    index = rank_index(df, order, parts=12)
    assert index.total == 5000 and len(index.parts) > 6
    shares = [b - a for a, b in zip(index.starts, [*index.starts[1:], index.total], strict=True)]
    assert max(shares) < 1500  # 3,000 rows share a value, and are split
    want = [tuple(r) for r in df.orderBy(*order, F.xxhash64("k", "s", "d", "v")).collect()]
    seen = []
    for number in (1, 2, 3, 25, 49, 50):
        got = index.page(number, 100).collect()
        assert [tuple(r)[:4] for r in got] == want[(number - 1) * 100 : number * 100]
        assert all(r.total == 5000 and r.total_pages == 50 for r in got)
        seen.append(len(files_read(index.ranks((number - 1) * 100, number * 100))))
    assert max(seen) <= 2 and min(seen) == 1
    assert index.page(51, 100).count() == 0 and [r.total_pages for r in index.page(1, 7000).limit(1).collect()] == [1]


def test_page_of_nothing_and_of_clashing_columns(spark):
    empty = rank_index(spark.createDataFrame([], "rank int, total int"), [F.col("rank")])
    assert empty.total == 0 and empty.page(1, 10).count() == 0
    same = rank_index(spark.createDataFrame([(1,)] * 10, "k int"), [F.col("k")], parts=3)
    assert [r.k for r in same.page(2, 4).collect()] == [1] * 4
    named = rank_index(spark.createDataFrame([(k, -k, k) for k in range(9)], "rank int, total int, k int"), [F.desc("rank")], parts=3)
    assert [(r.rank, r.total, r.k) for r in named.page(2, 2).collect()] == [(6, 9, 6), (5, 9, 5)]
