"""Quality rules: fixed base rules and a learned decision list.

The list is learned by sequential covering: a rule is a conjunction of
thresholds on text statistics. A conjunction grows by the threshold with the
largest information gain on the labelled rows it still covers, is pruned on
held-back rows, and the rows it covers leave the training set before the next
rule grows. The result is an ordered conditional expression that Spark runs
like any other. DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import SPACES, Scratch, let, unused

WINDOW = 8


def split_words(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def repeated_window_words(words: Column, width: int = WINDOW) -> Column:
    """Words in windows of `width` words that stand twice or more in the text.

    Window hashes are compared first; only texts with an equal pair sort
    (hash, place), compare the words of neighbours and count what is covered.
    """
    n = F.size(words)

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered))

    def covered(placed: Column) -> Column:
        def same(one: Column, other: Column) -> Column:
            equal = one["h"] == other["h"]
            for k in range(width):
                equal = equal & (F.get(words, one["i"] + k) == F.get(words, other["i"] + k))
            return equal

        twin = lambda p, at: F.coalesce(same(p, F.get(placed, at + 1)), F.lit(False)) | F.coalesce(same(p, F.get(placed, at - 1)), F.lit(False))
        return let(F.sort_array(F.transform(F.filter(placed, twin), lambda p: p["i"])), length)

    def length(places: Column) -> Column:
        gap = lambda p, at: F.least(F.lit(width), F.coalesce(F.get(places, at + 1) - p, F.lit(width)))
        return F.aggregate(F.transform(places, gap), F.lit(0), lambda a, x: a + x)

    # Single elements, as a slice copies the whole array first.
    windows = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    return F.when(n <= width, 0).otherwise(let(windows, count)).cast("long")


def text_statistics(text: Column) -> Column:
    """Struct of the counts that rules are made of, in one pass over the words."""
    body = F.coalesce(text, F.lit(""))

    def of_lines(lines: Column) -> Column:
        return let(F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda full: F.struct(F.size(full).cast("long").alias("n"), (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("dup")))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            repeated_window_words(words).alias("n_repeat_words"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
            F.regexp_count(body, F.lit(r"[A-Z]")).cast("long").alias("n_upper"),
            F.regexp_count(body, F.lit(r"[0-9]")).cast("long").alias("n_digits"),
            F.regexp_count(body, F.lit(r"[!?]")).cast("long").alias("n_shouts"),
            let(F.split(body, "\n"), of_lines).alias("lines"))

    return let(split_words(text), of_words)


#: Ratios that the learned rules put thresholds on, from the statistics above.
FEATURES = {
    "mean_word_chars": lambda s: s["word_chars"] / F.greatest(s["n_words"], F.lit(1)),
    "symbol_share": lambda s: s["n_symbols"] / F.greatest(s["word_chars"], F.lit(1)),
    "dup_line_share": lambda s: s["lines"]["dup"] / F.greatest(s["lines"]["n"], F.lit(1)),
    "repeat_share": lambda s: s["n_repeat_words"] / F.greatest(s["n_words"], F.lit(1)),
    "distinct_share": lambda s: s["n_distinct"] / F.greatest(s["n_words"], F.lit(1)),
    "upper_share": lambda s: s["n_upper"] / F.greatest(s["word_chars"], F.lit(1)),
    "digit_share": lambda s: s["n_digits"] / F.greatest(s["word_chars"], F.lit(1)),
    "shout_share": lambda s: s["n_shouts"] / F.greatest(s["n_words"], F.lit(1)),
    "words_per_line": lambda s: s["n_words"] / F.greatest(s["lines"]["n"], F.lit(1)),
}


@dataclass(frozen=True)
class Threshold:
    feature: str
    above: bool  # > cut if true, else <= cut
    cut: float

    def column(self, at: str = "") -> Column:
        c = F.col(f"{at}{self.feature}")
        return c > self.cut if self.above else c <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rows that any rule covers are bad; rules are tried in order."""

    rules: tuple[tuple[Threshold, ...], ...]

    def bad(self, at: str = "") -> Column:
        out = None
        for rule in self.rules:
            covered = F.lit(True)
            for t in rule:
                covered = covered & t.column(at)
            out = F.when(covered, True) if out is None else out.when(covered, True)
        return F.lit(False) if out is None else out.otherwise(False)

    def __str__(self) -> str:
        return "\n".join("bad if " + " and ".join(map(str, r)) for r in self.rules) or "no rule"


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """FOIL's gain of covering p bad and n good rows, out of p0 and n0."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0


def fit_decision_list(labelled: DataFrame, *, label: str = "bad", features: tuple[str, ...] = tuple(FEATURES), cuts: int = 24, rules: int = 6, terms: int = 3, least: int = 5, precision: float = 0.95) -> DecisionList:
    """Learns rules for rows whose `label` is true.

    The statistics are counts of bad and good rows in `cuts` quantile bins of
    each feature, aggregated by Spark for each growing step; only these few
    counts reach the driver. A quarter of the rows is held back: a rule loses
    its last thresholds while that does not lower its precision on them, and
    the list ends at the first rule below `precision` or covering fewer than
    `least` bad rows. Null features and labels are ignored; without rows of
    both kinds the list is empty.
    """
    rows = labelled.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("boolean").alias("bad")).dropna()
    held = F.pmod(F.xxhash64(*features), F.lit(4)) == 0
    bad_rows = rows.filter("bad")
    # Cuts from both kinds of rows, so that rare values have cuts of their own.
    steps = [i / cuts for i in range(1, cuts)]
    edges = {f: set() for f in features}
    for part in (bad_rows, rows.filter("not bad")):
        got = part.agg(*[F.percentile_approx(f, steps, 1000).alias(f) for f in features]).first()
        for f in features:
            edges[f].update(got[f] or [])
    edges = {f: sorted(e) for f, e in edges.items()}
    found: list[tuple[Threshold, ...]] = []
    for _ in range(rules):
        left = rows.filter(~DecisionList(tuple(found)).bad())
        rule = _grow(left.filter(~held), features, edges, terms)
        if not rule:
            break
        rule = _prune(left.filter(held), rule)
        p, n, _, _ = _cover(left, [rule])[0]
        if p < least or p / (p + n) < precision:
            break
        found.append(rule)
    return DecisionList(tuple(found))


def _cover(rows: DataFrame, candidates: list[tuple[Threshold, ...]]) -> list[tuple[int, int, int, int]]:
    """(bad covered, good covered, bad, good) of each candidate, in one aggregate."""
    sums = []
    for i, rule in enumerate(candidates):
        hit = F.lit(True)
        for t in rule:
            hit = hit & t.column()
        sums += [F.count_if(hit & F.col("bad")).alias(f"p{i}"), F.count_if(hit & ~F.col("bad")).alias(f"n{i}")]
    row = rows.agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n"), *sums).first()
    return [(row[f"p{i}"], row[f"n{i}"], row["p"], row["n"]) for i in range(len(candidates))]


def _histogram(rows: DataFrame, features, edges) -> dict[str, dict[tuple[int, bool], int]]:
    """Counts by feature, bin and label: one narrow group-by."""

    def bin_of(f: str) -> Column:  # how many cuts are below the value
        return F.size(F.filter(F.lit(edges[f] or [0.0]), lambda e: e < F.col(f)))

    bins = F.array(*[F.struct(F.lit(f).alias("f"), bin_of(f).alias("bin")) for f in features])
    counted = rows.select("bad", F.explode(bins).alias("b")).groupBy("b.f", "b.bin", "bad").count()
    out: dict = {f: {} for f in features}
    for r in counted.collect():  # features x bins x 2 rows
        out[r["f"]][(r["bin"], r["bad"])] = r["count"]
    return out


def _grow(rows: DataFrame, features, edges, terms: int) -> tuple[Threshold, ...]:
    rule: tuple[Threshold, ...] = ()
    for _ in range(terms):
        now = rows
        for t in rule:
            now = now.filter(t.column())
        counts = _histogram(now, features, edges)
        p0 = sum(v for (_, bad), v in counts[features[0]].items() if bad)
        n0 = sum(v for (_, bad), v in counts[features[0]].items() if not bad)
        if not p0 or not n0:
            break
        best = (0.0, None)
        for f in features:
            p = n = 0
            for i, cut in enumerate(edges[f]):  # bin i holds the values up to cut i
                p, n = p + counts[f].get((i, True), 0), n + counts[f].get((i, False), 0)
                for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                    best = max(best, (_gain(pp, nn, p0, n0), Threshold(f, above, float(cut))), key=lambda x: x[0])
        if best[1] is None or best[0] <= 0:
            break
        rule += (best[1],)
    return rule


def _prune(rows: DataFrame, rule: tuple[Threshold, ...]) -> tuple[Threshold, ...]:
    shorter = [rule[:i] for i in range(1, len(rule) + 1)]
    worth = [((p + 1) / (p + n + 2), -len(r)) for r, (p, n, _, _) in zip(shorter, _cover(rows, shorter), strict=True)]
    return shorter[max(range(len(shorter)), key=lambda i: worth[i])]


def with_features(docs: DataFrame, text: str = "text", into: str = "__both") -> DataFrame:
    """docs with the struct column `into`: s (the statistics) and f (the features)."""
    # The statistics are used many times over: bound once, then read.
    return docs.withColumn(into, let(text_statistics(F.col(text)), lambda s: F.struct(s.alias("s"), F.struct(*[make(s).cast("double").alias(name) for name, make in FEATURES.items()]).alias("f"))))


def learn_quality(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", fit_rows: int = 20_000, **options) -> DecisionList:
    """Fits the list on at most `fit_rows` labelled rows, those of the smallest id hash.

    Rows with a null id or label are left out. The sample bounds what the fit
    costs; judging covers all documents.
    """
    scratch = Scratch(docs.sparkSession)
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(quality).isNotNull())
    known = known.select(F.col(doc_id).alias("__id"), (F.col(quality) == 0).alias("bad")).orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)
    chosen = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(known), "__id")  # fit_rows bounds it
    rows = with_features(chosen, "__text").select("__both.f.*", "bad")
    return fit_decision_list(scratch.keep(rows), **options)


def judge_quality(docs: DataFrame, rules: DecisionList, *, text: str = "text", into: str = "judged") -> DataFrame:
    """Adds the struct column `into`: the statistics, base_failed and kept.

    Base rules: fewer than 20 words, or over 30 % of the words in repeated
    windows of 8 words. Null and empty texts have no words and fail; repeated
    rows are judged alike and an empty table stays empty. Texts are whole, of
    any length. A column named `into` is replaced, all others stay. No shuffle.
    """
    (both,) = unused(docs, "__both")
    rated = with_features(docs, text, both)
    s = F.col(f"{both}.s")
    failed = (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])
    result = F.struct(s["n_words"].alias("n_words"), s["word_chars"].alias("word_chars"), s["n_symbols"].alias("n_symbols"), s["lines"]["dup"].alias("n_dup_lines"), s["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"), (~failed & ~rules.bad(f"{both}.f.")).alias("kept"))
    return rated.withColumn(into, result).drop(both)
