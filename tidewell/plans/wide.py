"""Linear forecasters from sums of products: every fold from prefixes, and many inputs from blocks.

Rows are never copied once for each fold, nor is a matrix of products spelled
out as expressions: products are summed over stretches or blocks of rows, and what a
model needs is a sum or a difference of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.series import ROWS, halo_partition
from tidewell.plans.features import FEATURES, fold_table

#: Partial sums that one task merges in a round.
FAN_IN = 16


def _whole(parts: list[Column]) -> Column:
    """An array, or null if one of its parts is."""
    made = F.array(*parts)
    return F.when(~F.exists(made, lambda x: x.isNull()), made)


def lagged(rows: DataFrame, h: int, lags: int) -> DataFrame:
    """(symbol, i, v, y, base): the `lags` returns before row i and 1, the h returns from it on, and the price before it."""

    def add(part: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("i")
        # A row that is not the k-th before by number is none, as rows may be missing.
        near = lambda c, k: F.when(F.lag("i", k).over(w) == F.col("i") - k, F.lag(c, k).over(w))
        v = _whole([near("log_return", k) for k in range(lags, 0, -1)] + [F.lit(1.0)])
        y = _whole([near("log_return", -k) if k else F.col("log_return") for k in range(h)])
        return part.select("*", v.alias("v"), y.alias("y"), near("avg_close", 1).alias("base"))

    made = halo_partition(rows.select("symbol", "i", "avg_close", "log_return"), lags + 1, add, ahead=h - 1)
    return made.select("symbol", "i", "v", "y", "base").filter("v is not null and y is not null")


def _bounds(rows: DataFrame, h: int, seq: int, **options) -> DataFrame:
    """(symbol, folds): for each fold its training targets [a, b) and its validation targets [c, d), as row numbers."""
    first = F.greatest(F.col("train_start"), F.lit(1)) + seq  # row 0 has no return
    short = F.col("val_end") - F.col("train_end") < seq + h
    c = F.when(short, F.greatest(F.col("train_end"), first)).otherwise(F.col("train_end") + seq)
    found = fold_table(rows, h, **options).select("symbol", "fold", first.alias("a"), (F.col("train_end") - h + 1).alias("b"), c.alias("c"), (F.col("val_end") - h + 1).alias("d"))
    used = found.filter("b - a >= 10 and d - c >= 3")
    return used.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("fold", "a", "b", "c", "d"))).alias("folds"))


def walk_forward_prefix(rows: DataFrame, h: int = 7, *, seq: int = 60, lags: int = 5, ridge: float = 1e-3, folds: int = 6, train_days: int = 730) -> tuple[DataFrame, DataFrame]:
    """walk_forward_fitted for the linear model, from prefix sums: (metrics of each fold, their means by symbol).

    `rows` has symbol, i, avg_close and log_return. Sums of products are taken
    over the stretches between the bounds of all folds, once for each row; a
    fold's normal equations are the difference of two prefixes. A target
    with a null return before it (within `lags`) or among its h rows is in no fold.
    Folds with fewer than 10 training or 3 validation targets are skipped.
    """
    bounds = _bounds(rows, h, seq, folds=folds, train_days=train_days)
    seqs = lagged(rows, h, lags)
    width = lags + 1
    at = lambda c, i: F.get(c, F.lit(i))
    met = seqs.join(bounds, "symbol")
    cuts = F.array_sort(F.array_distinct(F.flatten(F.array(F.transform("folds", lambda f: f["a"]), F.transform("folds", lambda f: f["b"])))))
    stretch = met.withColumn("stretch", F.size(F.filter(cuts, lambda x: x <= F.col("i"))))
    products = [F.sum(at("v", i) * at("v", j)) for i in range(width) for j in range(i, width)] + [F.sum(at("v", i) * at("y", s)) for s in range(h) for i in range(width)]
    sums = stretch.groupBy("symbol", "stretch").agg(F.array(*products).alias("sums"), F.any_value("folds").alias("folds"))
    size = len(products)
    # At most two bounds for each fold, so a short list for each symbol.
    by_symbol = sums.groupBy("symbol").agg(F.collect_list(F.struct("stretch", "sums")).alias("parts"), F.any_value("folds").alias("folds"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upper = np.triu_indices(width)
        for batch in batches:
            out = []
            for symbol, parts, found in batch[["symbol", "parts", "folds"]].itertuples(index=False, name=None):
                edges = sorted({f[c] for f in found for c in ("a", "b")})
                each = np.zeros((len(edges) + 1, size))
                for p in parts:
                    each[p["stretch"]] = p["sums"]
                prefix = dict(zip(edges, np.cumsum(each, axis=0)[:-1], strict=True))
                for f in found:
                    total = prefix[f["b"]] - prefix[f["a"]]
                    gram = np.zeros((width, width))
                    gram[upper] = total[: len(upper[0])]
                    gram = gram + np.triu(gram, 1).T + ridge * np.eye(width)
                    weights = np.linalg.solve(gram, total[len(upper[0]) :].reshape(h, width).T).T
                    out.append((symbol, f["fold"], f["b"] - f["a"], f["d"] - f["c"], weights.tolist()))
            yield pd.DataFrame(out, columns=["symbol", "fold", "n_train", "n_val", "weights"])

    models = by_symbol.mapInPandas(solve, "symbol string, fold int, n_train long, n_val long, weights array<array<double>>")
    inside = F.filter("folds", lambda f: (f["c"] <= F.col("i")) & (F.col("i") < f["d"]))
    judged = met.select("symbol", "i", "v", "y", "base", F.explode(F.transform(inside, lambda f: f["fold"])).alias("fold")).join(models, ["symbol", "fold"])
    dot = lambda w: F.aggregate(F.zip_with("v", w, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    judged = judged.withColumn("p", F.transform("weights", dot))
    start = F.struct(*[F.lit(0.0).alias(c) for c in ("t", "p", "square", "size")])

    def step(a: Column, x: Column) -> Column:
        t, p = a["t"] + x["t"], a["p"] + x["p"]
        error = F.col("base") * (F.exp(t) - F.exp(p))
        return F.struct(t.alias("t"), p.alias("p"), (a["square"] + error * error).alias("square"), (a["size"] + F.abs(error)).alias("size"))

    judged = judged.withColumn("e", F.aggregate(F.zip_with("y", "p", lambda t, p: F.struct(t.alias("t"), p.alias("p"))), start, step))
    same = (F.signum(at("y", 0)) == F.signum(at("p", 0))).cast("double")
    out = judged.groupBy("symbol", "fold").agg(
        F.sqrt(F.sum("e.square") / (F.count("*") * h)).alias("rmse"), (F.sum("e.size") / (F.count("*") * h)).alias("mae"), (F.avg(same) * 100).alias("direction_pct"),
        F.first("n_train").alias("n_train"), F.first("n_val").alias("n_val"))
    return out, out.groupBy("symbol").agg(F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"), F.avg("direction_pct").alias("direction_pct"), F.count("*").alias("folds"))


# -- many inputs -------------------------------------------------------------------


def _design(rows: pd.DataFrame, features: tuple[str, ...], target: str, seq: int, h: int, block: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, X, Y) of the sequences of a block: row by row the features of seq rows and 1, and the h targets."""
    rows = rows.sort_values("i")
    i = rows["i"].to_numpy()
    values, came = rows[list(features)].to_numpy(float), rows[target].to_numpy(float)
    n = len(i) - seq - h + 1
    if n < 1:
        return np.zeros(0, int), np.zeros((0, seq * len(features) + 1)), np.zeros((0, h))
    x = np.lib.stride_tricks.sliding_window_view(values, seq, axis=0)[:n].transpose(0, 2, 1).reshape(n, -1)
    y = np.lib.stride_tricks.sliding_window_view(came, h)[seq : seq + n]
    at = i[seq : seq + n]
    # Rows in one piece (no gap, one split) that have all their values; each belongs to the block of its first target.
    split = rows["split"].to_numpy() if "split" in rows else np.zeros(len(i))
    ok = (at // size == block) & (i[seq + h - 1 : seq + h - 1 + n] - i[:n] == seq + h - 1) & (split[:n] == split[seq + h - 1 : seq + h - 1 + n])
    ok &= ~np.isnan(x).any(axis=1) & ~np.isnan(y).any(axis=1)
    return at[ok], np.hstack((x[ok], np.ones((ok.sum(), 1)))), y[ok]


def _spread(rows: DataFrame, seq: int, h: int, size: int) -> DataFrame:
    """rows with their block, copied into the blocks that look back on them or ahead to them."""
    reach = F.sequence(F.expr(f"greatest(i - {h - 1}, 0) div {size}"), F.expr(f"(i + {seq}) div {size}"))
    return rows.withColumn("block", F.explode(reach))


def fit_wide(rows: DataFrame, h: int, *, features: tuple[str, ...] = FEATURES, target: str = "log_return_1d", seq: int = 60, ridge: float = 1e-3, size: int = ROWS, split: str | None = "train") -> DataFrame:
    """(symbol, n, weights): h outputs, each linear in the `features` of `seq` rows and 1; weights has h rows of seq * features + 1.

    `rows` has symbol, i, features and, with `split`, the split to fit on. Every
    block of a series is summed by a task of its own, in one product of
    matrices; sums of 16 blocks at a time are merged until a symbol has one. A
    task holds a block and one matrix of products (2.3 MB for 541 inputs).
    Sequences lie in one split, have no gap and no null.
    """
    width = seq * len(features) + 1
    kept = rows.filter(F.col("split") == split) if split else rows
    columns = list(dict.fromkeys(["symbol", "i", *features, target, *(["split"] if split else [])]))
    spread = _spread(kept.select(*columns), seq, h, size)

    def products(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        _, x, y = _design(part, features, target, seq, h, int(key[1]), size)
        return pd.DataFrame([(key[0], int(key[1]), len(x), np.hstack((x.T @ x, x.T @ y)).tobytes())], columns=["symbol", "block", "n", "sums"])

    def merge(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block")
        total = np.zeros(width * (width + h))
        for s in part["sums"]:
            total += np.frombuffer(s)
        return pd.DataFrame([(key[0], int(key[1]), part["n"].sum(), total.tobytes())], columns=["symbol", "block", "n", "sums"])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for symbol, n, sums in batch[["symbol", "n", "sums"]].itertuples(index=False, name=None):
                s = np.frombuffer(sums).reshape(width, width + h)
                out.append((symbol, n, np.linalg.solve(s[:, :width] + ridge * np.eye(width), s[:, width:]).T.tolist()))
            yield pd.DataFrame(out, columns=["symbol", "n", "weights"])

    kind = "symbol string, block long, n long, sums binary"
    sums = spread.groupBy("symbol", "block").applyInPandas(products, kind).filter("n > 0")
    last = kept.agg(F.max(F.expr(f"(i + {seq}) div {size}"))).first()[0] or 0
    blocks = int(last) + 1
    while blocks > 1:
        blocks = -(-blocks // FAN_IN)
        sums = sums.withColumn("up", F.expr(f"block div {FAN_IN}")).groupBy("symbol", "up").applyInPandas(merge, kind)
    return sums.mapInPandas(solve, "symbol string, n long, weights array<array<double>>")


def apply_wide(rows: DataFrame, model: DataFrame, h: int, *, features: tuple[str, ...] = FEATURES, target: str = "log_return_1d", seq: int = 60, size: int = ROWS) -> DataFrame:
    """(symbol, i, step, predicted, actual) of every sequence; i is its first target's row.

    The model is copied once for each block of its symbol, not for each row.
    """
    spread = _spread(rows, seq, h, size)
    models = spread.select(F.col("symbol").alias("s"), F.col("block").alias("b")).distinct().join(model, F.col("s") == model["symbol"]).select("s", "b", "weights")

    def predict(key: tuple, part: pd.DataFrame, weights: pd.DataFrame) -> pd.DataFrame:
        at, x, y = _design(part, features, target, seq, h, int(key[1]), size)
        if not len(at) or weights.empty:
            return pd.DataFrame({"symbol": [], "i": [], "step": [], "predicted": [], "actual": []})
        made = x @ np.array([list(w) for w in weights["weights"].iloc[0]]).T
        return pd.DataFrame({"symbol": key[0], "i": np.repeat(at, h), "step": np.tile(np.arange(1, h + 1), len(at)), "predicted": made.ravel(), "actual": y.ravel()})

    return spread.groupBy("symbol", "block").cogroup(models.groupBy("s", "b")).applyInPandas(predict, "symbol string, i long, step int, predicted double, actual double")
