"""Token counts: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each
character; dynamic programming carries only the best score and the number of
pieces on the best path, so no segmentation is stored. Rules of the tokenizer
that are followed exactly:

* blanks become U+2581, a text begins with one, and no piece crosses a blank;
* of equal scores, the path whose last piece starts first wins;
* a character without a piece of its own may be an unknown piece at the lowest
  score less 10; neighbouring unknowns fuse and fall back to their UTF-8 bytes.

Texts are counted stretch by stretch. A stretch ends at a blank or at a
character that occurs in no piece at all, so counts of stretches add up, and a
bounded memory of recent stretches saves work on frequent words.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import held
from tidewell.llm.vocabulary import BLANK, DEFAULT_VOCABULARY, load_pieces, piece_automaton, vocabulary_path

#: Score of an unknown piece, less than the lowest of the vocabulary.
UNKNOWN_PENALTY = 10.0
#: Stretches that a Python worker remembers before it starts anew.
REMEMBERED = 400_000


class UnigramCounter:
    """Counts pieces of one text after another."""

    def __init__(self, path: str):
        pieces = load_pieces(path)
        self.automaton = piece_automaton(path)
        self.names = {p for p, _ in pieces}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.byte_fallback = all(f"<0x{b:02X}>" in self.names for b in range(256))
        letters = set("".join(self.names))
        alone = "".join(re.escape(c) for c in sorted(letters) if c != BLANK)
        # A blank with the word after it, or a run of characters outside the vocabulary.
        self.stretches = re.compile(f"{BLANK}[{alone}]*|[{alone}]+|[^{alone}{BLANK}]+")
        self.seen: dict[str, tuple[int, float]] = {}
        self.parts: dict[str, tuple[int, float]] = {}
        self.beside = {p[i : i + 2] for p in self.names for i in range(len(p) - 1)}

    def viterbi(self, s: str) -> tuple[int, float]:
        """Pieces and score of the best path through one stretch."""
        n = len(s)
        ends: list[list] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(s):  # for each end the longest piece, so the earliest start, first
            ends[end].append(match)
        scores, counts, runs = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)  # runs: unknowns up to here
        for end in range(n):
            found, at = ends[end], end + 1
            top = pieces = None
            for length, score, _ in found:
                total = scores[at - length] + score
                if top is None or total > top:
                    top, pieces = total, counts[at - length] + 1
            if not found or found[-1][0] != 1:
                total = scores[end] + self.unknown
                if top is None or total > top:
                    top, runs[at] = total, runs[end] + 1
                    pieces = counts[end] + (len(s[end].encode()) if self.byte_fallback else int(not runs[end]))
            scores[at], counts[at] = top, pieces
        return counts[n], scores[n]

    def stretch(self, s: str) -> tuple[int, float]:
        """A stretch in parts, between neighbours that stand side by side in no piece."""
        if not self.byte_fallback or len(s) < 2:
            return self.viterbi(s)
        beside, known = self.beside, self.parts
        tokens, score, begin = 0, 0.0, 0
        for at in range(1, len(s) + 1):
            if at < len(s) and s[at - 1 : at + 1] in beside:
                continue
            part = s[begin:at]
            got = known.get(part)
            if got is None:
                got = self.viterbi(part)
                if len(part) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[part] = got
            tokens, score, begin = tokens + got[0], score + got[1], at
        return tokens, score

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        s = text.replace(" ", BLANK)
        if s[0] != BLANK:
            s = BLANK + s
        seen, tokens, score = self.seen, 0, 0.0
        for stretch in self.stretches.findall(s):
            got = seen.get(stretch)
            if got is None:
                got = self.stretch(stretch)
                if len(stretch) <= 64:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[stretch] = got
            tokens += got[0]
            score += got[1]
        return tokens, score


def count_tokens(docs: DataFrame, text: str = "text", *, vocabulary: str = DEFAULT_VOCABULARY, into: str = "tokens") -> DataFrame:
    """Adds the struct column `into` (n_tokens long, score double) to every row.

    `vocabulary` is a public vocabulary's name or path; it is read on the
    executors. Null and empty texts have 0 tokens and score 0. A column of the
    name `into` is replaced; all others stay as they are. Repeated rows are
    counted alike, an empty table stays empty, and texts are whole, of any
    length. Equal scores go by the tokenizer's rule above. All pieces match as
    ordinary text, those named like control or byte pieces (<s>, <0x41>) too.
    No shuffle.
    """
    path = vocabulary if "/" in vocabulary else None

    @F.pandas_udf("n_tokens long, score double")
    def counted(texts: pd.Series) -> pd.DataFrame:
        place = path or vocabulary_path(vocabulary)
        counter = held(("unigrams", place), lambda: UnigramCounter(place))
        return pd.DataFrame([counter.count(t) for t in texts], columns=["n_tokens", "score"])

    return docs.withColumn(into, counted(F.col(text).cast("string")))
