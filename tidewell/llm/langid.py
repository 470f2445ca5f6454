"""Language ID with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
The probability of a word is the sum over all its segmentations into pieces,
found by the forward algorithm; that of a text is the product over its words.
Piece probabilities are learned by expectation-maximisation: expected piece
counts over all segmentations of the words of each language.

Beside the languages stands a background: mostly letters one by one, by their
frequency in all languages together, and now and then any piece. Text that no
language explains better than that has a score near 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import Scratch, held, unused
from tidewell.llm.vocabulary import BLANK, DEFAULT_VOCABULARY, load_pieces, piece_automaton, vocabulary_path

UNDETERMINED = "und"
#: Runs of letters, lower-cased; nothing else of a text is scored.
LETTERS = re.compile(r"[^\W\d_]+")
#: Probability of a character that is no piece, and the count added to each piece.
UNKNOWN, SMOOTHING = 1e-9, 0.05
#: The same for the background, and its share that goes to all pieces alike.
STRANGE, EVEN = 1e-6, 0.1
#: Probability of the background before a text is seen, against that of each language.
RARE = 1e-6
#: Numbers in the table of remembered words; new words are scored in parts of as many.
REMEMBERED, AT_ONCE = 1_200_000, 1_000_000
_TINY, _LEAST = 1e-120, 1e-300
#: Words of more characters are scored one by one, with scaling; a character that no piece has.
SHORT, GAP = 28, "\n"


@lru_cache(maxsize=2)
def piece_codes(path: str) -> ahocorasick.Automaton:
    """Finds every piece in a string; each match is 64 * id + length."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, (piece, _) in enumerate(load_pieces(path)):
        automaton.add_word(piece, 64 * i + len(piece))
    automaton.make_automaton()
    return automaton


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


class Segmenter:
    """Matches of vocabulary pieces in a word."""

    def __init__(self, path: str):
        self.automaton = piece_automaton(path)
        self.codes = piece_codes(path)

    def ends(self, word: str) -> list[list[tuple[int, int]]]:
        """For each end, the (start, piece id) of the pieces there; -1 is an unknown character."""
        s = BLANK + word
        out: list[list[tuple[int, int]]] = [[] for _ in s]
        for end, (length, _, piece) in self.automaton.iter(s):
            out[end].append((end + 1 - length, piece))
        for end, found in enumerate(out):
            if all(start != end for start, _ in found):
                found.append((end, -1))
        return out


class LanguageModel:
    """Piece probabilities of some languages and, last, the background: rows are pieces, the last row is unknown."""

    def __init__(self, languages: list[str], table: np.ndarray, path: str):
        self.languages, self.table, self.path = languages, table, path
        self.segmenter = Segmenter(path)
        self.reach = max(len(piece) for piece, _ in load_pieces(path))
        self._start()

    def _start(self) -> None:
        self.seen: dict[str, int] = {}
        self.scores = np.zeros((4096, self.table.shape[1]))

    def word(self, word: str) -> np.ndarray:
        """Log probability of a word in each column, over all segmentations; of any length."""
        k = self.table.shape[1]
        ends = self.segmenter.ends(word)
        alpha = np.ones((len(ends) + 1, k))
        logs = np.zeros(k)
        for end, found in enumerate(ends):
            at = [start for start, _ in found]
            alpha[end + 1] = (alpha[at] * self.table[[piece for _, piece in found]]).sum(axis=0)
            if end % 8 == 7 and alpha[end + 1].min() < _TINY:  # keep long words within range
                now = np.maximum(alpha[end + 1], _LEAST)
                scale = np.where(now < _TINY, now, 1.0)
                logs += np.log(scale)
                alpha[max(0, end + 1 - self.reach) : end + 2] /= scale
        return np.log(np.maximum(alpha[-1], _LEAST)) + logs

    def short_words(self, words: list[str]) -> np.ndarray:
        """Log probabilities of many words of up to SHORT characters at once.

        All words are searched in one pass, parted by a character that is in
        no piece. alpha[p] is the probability of all segmentations up to
        character p; the places of one distance from their word's start are
        filled together.
        """
        joined = GAP + "".join(BLANK + w + GAP for w in words)
        flat = np.fromiter(chain.from_iterable(self.segmenter.codes.iter(joined)), np.int64).reshape(-1, 2)
        found = np.stack((flat[:, 0], flat[:, 1] % 64, flat[:, 1] // 64), axis=1)
        sizes = np.array([len(w) + 2 for w in words])
        last = np.cumsum(sizes) - 1  # last character of each word
        gap = np.zeros(len(joined), bool)
        gap[0] = True
        gap[last + 1] = True
        single = np.zeros(len(joined), bool)
        single[found[found[:, 1] == 1, 0]] = True
        alone = np.flatnonzero(~single & ~gap)
        found = np.concatenate((found, np.stack((alone, np.ones_like(alone), np.full_like(alone, -1)), axis=1)))
        begin = np.repeat(last + 1 - sizes, sizes)  # gap before the word, for the characters up to the gap after it
        steps = found[:, 0] - begin[found[:, 0] - 1]
        order = np.lexsort((found[:, 0], steps))
        found, steps = found[order], steps[order]
        alpha = np.zeros((len(joined), self.table.shape[1]))
        alpha[gap] = 1.0
        bounds = np.searchsorted(steps, np.arange(1, steps[-1] + 2))
        for at, end in zip(bounds[:-1], bounds[1:], strict=True):
            part = found[at:end]
            value = alpha[part[:, 0] - part[:, 1]] * self.table[part[:, 2]]
            first = np.flatnonzero(np.concatenate(([True], part[1:, 0] != part[:-1, 0])))
            alpha[part[first, 0]] = np.add.reduceat(value, first)
        return np.log(np.maximum(alpha[last], _LEAST))

    def _learn_words(self, words: list[str]) -> None:
        """Scores new words and remembers them."""
        n = len(self.seen)
        while n + len(words) > len(self.scores):
            self.scores = np.concatenate((self.scores, np.zeros_like(self.scores)))
        short = [w for w in words if len(w) <= SHORT]
        step = max(1, AT_ONCE // (8 * self.table.shape[1]))
        for at in range(0, len(short), step):
            part = short[at : at + step]
            self.scores[n + at : n + at + len(part)] = self.short_words(part)
        for at, word in enumerate([*short, *(w for w in words if len(w) > SHORT)]):
            self.seen[word] = n + at
            if at >= len(short):
                self.scores[n + at] = self.word(word)

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, probability) of each text."""
        found = [words_of(t) for t in texts]
        new = set().union(*found).difference(self.seen)
        if (len(self.seen) + len(new)) * self.table.shape[1] > REMEMBERED:
            self._start()
            new = set().union(*found)
        if new and self.languages:
            self._learn_words(sorted(new))
        out = []
        for words in found:
            if not words or not self.languages:
                out.append((UNDETERMINED, 0.0))
                continue
            total = self.scores[np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))].sum(axis=0)
            total[-1] += math.log(RARE)
            best = int(total[: len(self.languages)].argmax())
            out.append((self.languages[best], float(1 / np.exp(np.clip(total - total[best], -700, 700)).sum())))
        return out

    def expected(self, word: str, language: int) -> dict[int, float]:
        """Expected number of each piece in a word of one language, of any length (forward-backward)."""
        ends = self.segmenter.ends(word)
        column = self.table[:, language]
        steps = [[(start, piece, p) for (start, piece), p in zip(found, column[[piece for _, piece in found]].tolist(), strict=True)] for found in ends]
        alpha = [1.0]
        for found in steps:
            alpha.append(sum([alpha[start] * p for start, _, p in found]))
        if alpha[-1] < 1e-250:
            return self.expected_in_logs(ends, language)
        beta = [0.0] * len(ends) + [1.0]
        out: dict[int, float] = {}
        for end in range(len(ends) - 1, -1, -1):
            after = beta[end + 1]
            for start, piece, p in steps[end]:
                part = p * after
                beta[start] += part
                if piece >= 0:
                    out[piece] = out.get(piece, 0.0) + alpha[start] * part / alpha[-1]
        return out

    def expected_in_logs(self, ends: list[list[tuple[int, int]]], language: int) -> dict[int, float]:
        """The same for words whose probability is beyond the range of numbers."""
        p = self.table[[piece for found in ends for _, piece in found], language]
        logs = np.log(np.maximum(p, _LEAST)).tolist()
        alpha, at = [0.0], 0
        for found in ends:
            alpha.append(_log_sum([alpha[start] + logs[at + i] for i, (start, _) in enumerate(found)]))
            at += len(found)
        beta: list[list[float]] = [[] for _ in ends] + [[0.0]]
        out: dict[int, float] = {}
        for end in range(len(ends) - 1, -1, -1):
            at -= len(ends[end])
            after = _log_sum(beta[end + 1]) if beta[end + 1] else -math.inf  # no way on from here
            for i, (start, piece) in enumerate(ends[end]):
                part = logs[at + i] + after
                beta[start].append(part)
                if piece >= 0:
                    out[piece] = out.get(piece, 0.0) + math.exp(alpha[start] + part - alpha[-1])
        return out


def _log_sum(values: list[float]) -> float:
    if len(values) == 1:
        return values[0]
    top = max(values)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            counts.update((lang, w) for w in words_of(text))
        if counts:
            yield pd.DataFrame([(a, b, n) for (a, b), n in counts.items()], columns=["lang", "word", "n"])


def letter_pieces(path: str) -> dict[str, int]:
    """Pieces of one character."""
    return {piece: i for i, (piece, _) in enumerate(load_pieces(path)) if len(piece) == 1}


def background(counts: dict[int, float], path: str) -> np.ndarray:
    """Column of the background: pieces of one character by their counts, and a share for all pieces alike."""
    seen = np.zeros(len(load_pieces(path)) + 1)
    for piece, n in counts.items():
        seen[piece] = n
    column = (1 - EVEN) * seen / max(seen.sum(), 1.0) + EVEN / (len(seen) - 1)
    column[-1] = STRANGE
    return column


def learn_languages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", vocabulary: str = DEFAULT_VOCABULARY, fit_rows: int = 1200, rounds: int = 2) -> LanguageModel:
    """Learns from about `fit_rows` documents of each language, those of the smallest id hash.

    Every language is learned, from whole texts; rows with a null text, id or
    language are left out. Only expected counts by language and piece reach
    the driver: their number is bounded by languages and vocabulary. Without
    rows the model has no language and answers "und". Repeated rows count as
    often as they stand there.
    """
    scratch = Scratch(docs.sparkSession)
    path = vocabulary_path(vocabulary)
    size = len(load_pieces(path))
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull())
    known = known.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(1_000_000)).alias("h"))
    shares = scratch.keep(known.groupBy("lang").agg(F.least(F.lit(1_000_000), F.floor(1_000_000.0 * fit_rows / F.count("*")) + 1).alias("share")))
    languages = sorted(r["lang"] for r in shares.select("lang").collect())
    if not languages:
        return LanguageModel([], np.stack([background({}, path)], axis=1), path)
    sample = known.join(shares, "lang").filter("h < share").select("lang", "text")
    words = sample.mapInPandas(_count_words, "lang string, word string, n long")
    words = scratch.keep(words.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    table = np.full((size + 1, len(languages)), 1.0 / size)
    table[-1] = UNKNOWN
    for _ in range(rounds):
        table = _expected_counts(words, languages, table, path, vocabulary) + SMOOTHING
        table[-1] = 0
        table /= table.sum(axis=0)
        table[-1] = UNKNOWN
    counted = words.mapInPandas(_count_letters(vocabulary), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    scratch.drop(words, shares)
    return LanguageModel(languages, np.column_stack((table, background({r["piece"]: r["n"] for r in counted}, path))), path)


def _count_letters(vocabulary: str):
    """Pieces of one character in all words, with the blank before each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = letter_pieces(vocabulary_path(vocabulary))
        for batch in batches:
            counts: Counter = Counter()
            for word, n in zip(batch["word"], batch["n"], strict=True):
                for c in BLANK + word:
                    if c in letters:
                        counts[letters[c]] += n
            yield pd.DataFrame({"piece": list(counts), "n": [float(n) for n in counts.values()]}).astype({"piece": "int32", "n": "float64"})

    return run


def _expected_counts(words: DataFrame, languages: list[str], table: np.ndarray, path: str, vocabulary: str) -> np.ndarray:
    shared = words.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = LanguageModel(languages, shared.value, vocabulary_path(vocabulary))
        place = {name: i for i, name in enumerate(languages)}
        counts: dict[tuple[int, int], float] = {}
        for batch in batches:
            for lang, word, n in zip(batch["lang"], batch["word"], batch["n"], strict=True):
                at = place[lang]
                for piece, expected in model.expected(word, at).items():
                    counts[at, piece] = counts.get((at, piece), 0.0) + n * expected
        if counts:
            yield pd.DataFrame([(a, b, v) for (a, b), v in counts.items()], columns=["language", "piece", "n"])

    got = words.mapInPandas(run, "language int, piece int, n double").groupBy("language", "piece").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros_like(table)
    out[got["piece"], got["language"]] = got["n"]
    return out


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text", into: str = "language") -> DataFrame:
    """Adds the struct column `into`: lang_pred and score (0 to 1).

    The score is the probability of the language among those learned, each as
    likely before, and the background, a millionth as likely: near 0 for gibberish and for scripts
    that no language was learned from. Null texts and texts without a letter
    are "und" with score 0; ties go to the first language by name. Whole texts
    are scored, repeated rows alike; an empty table stays empty. A column
    named `into` is replaced. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table))
    vocabulary = model.path.rsplit("/", 1)[-1]

    @F.pandas_udf("lang_pred string, score double")
    def judged(texts: pd.Series) -> pd.DataFrame:
        value = shared.value  # kept beside the model, so that no other value gets its id
        own = held(("languages", id(value)), lambda: (value, LanguageModel(*value, vocabulary_path(vocabulary))))[1]
        out: list[tuple[str, float]] = []
        part: list[str | None] = []
        size = 0
        for t in texts:  # in parts of about a million characters
            part.append(t)
            size += len(t or "")
            if size > 1_000_000:
                out += own.texts(part)
                part, size = [], 0
        return pd.DataFrame(out + own.texts(part), columns=["lang_pred", "score"])

    return docs.withColumn(into, judged.asNondeterministic()(F.col(text)))


def held_out(doc_id: str = "doc_id", parts: int = 5):
    """Rows that nothing is learned from: CRC-32 of the id as text, mod `parts`, is 0. Null ids: false."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == 0, F.lit(False))


def drop_unidentified(docs: DataFrame, model: LanguageModel, *, text: str = "text", least: float = 0.5) -> DataFrame:
    """Documents with a language of score `least` or more; columns as given.

    Null texts, texts without a letter, gibberish and scripts that were not
    learned go.
    """
    (into,) = unused(docs, "__language")
    judged = identify(docs, model, text=text, into=into)
    kept = judged.filter((F.col(f"{into}.lang_pred") != UNDETERMINED) & (F.col(f"{into}.score") >= least))
    return kept.drop(into)
