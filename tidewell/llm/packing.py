"""Best-fit packing of token sequences under several capacities.

A sequence has room for so many tokens, documents and attention cost (the sum
of squared lengths). Vector best-fit places an item into the bin whose
remaining capacities, as a vector, suit it best: by the smallest weighted norm
of what would remain, or by the largest weighted dot product of item and
remainder.

Items of one length are alike, so the plan is made from the histogram of
lengths, whose size is bounded by the capacity and not by the data: bins in
equal states are filled together, and the plan is a list of runs (length,
range of ranks, first bin, offset). Tasks then look up the bin of each piece
by its rank among pieces of its length.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import Scratch, held, unused

VOCABULARY = "word_bpe_49k.json"
END_ID = 0
#: Stretches of text, and words, that a Python worker remembers.
REMEMBERED = 400_000


class WordTokenizer:
    """Ids of a public word-end tokenizer, with a memory of frequent stretches.

    The tokenizer drops white space and never merges across it, so the ids of
    a text are those of its stretches between white space, one after another.
    With `specials`, names of special tokens in a text become their ids, as in
    the library by default; without, they are ordinary text.
    """

    #: Characters whose lower case is one composed character: ASCII and Latin-1 letters.
    PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
    PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
    #: Bytes as the characters that stand for them in byte-level vocabularies: those that can be
    #: seen stand for themselves, the others follow on from 256.
    SEEN = (*range(33, 127), *range(161, 173), *range(174, 256))
    BYTES = {b: b for b in SEEN} | {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - set(SEEN)))}

    def __init__(self, path: str, specials: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials
        added = self.tokenizer.get_added_tokens_decoder().values() if specials else ()
        self.marks = {t.content[:2] for t in added}  # how special tokens begin
        self.stretches: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _exact(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _stretch(self, s: str) -> bytes:
        if not self.PLAIN.fullmatch(s):
            return self._exact(s)
        known, out = self.pieces, []
        for piece in self.PIECES.findall(s.lower()):
            ids = known.get(piece)
            if ids is None:
                # A piece is one pre-token, so the merges alone remain to be done.
                tokens = self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(self.BYTES))
                ids = array("I", [t.id for t in tokens]).tobytes()
                if len(known) >= REMEMBERED:
                    known.clear()
                known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def ids(self, text: str | None) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        # str.split() also splits at the four separators below; the tokenizer does not.
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f") or any(m in text for m in self.marks)
        if odd or not unicodedata.is_normalized("NFC", text):
            return self._exact(text)
        words = text.split()
        known = self.stretches
        found = list(map(known.get, words))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    word = words[i]
                    ids = self._stretch(word)
                    if len(word) <= 40:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[word] = ids
                    found[i] = ids
        return b"".join(found)


def _tokenize(vocabulary: str, limit: int, with_ids: bool, specials: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tidewell.llm.vocabulary import vocabulary_path

        path = vocabulary_path(vocabulary)
        tokenizer = held(("words", path, specials), lambda: WordTokenizer(path, specials))
        end = array("I", [END_ID]).tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc"], batch["text"], strict=True):
                ids = tokenizer.ids(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
                    if len(rows) >= 4000:
                        yield _pieces(rows)
                        rows = []
            if rows:
                yield _pieces(rows)

    return run


def _pieces(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["doc", "piece", "start", "length", "ids_crc32", "ids"])
    return frame.astype({"doc": "Int64"})


def token_pieces(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, limit: int = 2048, with_ids: bool = True, specials: bool = False) -> DataFrame:
    """(doc, piece, start, length, ids_crc32, ids): a row for each piece of each row of docs.

    A document is its ids and the end id; null and empty texts are the end id
    alone. Documents of more than `limit` ids are cut into pieces of `limit`,
    of which the last may be shorter. ids is packed little-endian unsigned
    32-bit numbers, null unless `with_ids`. A null id is kept; repeated rows
    have pieces of their own; an empty table has none. With `specials`, names
    of special tokens in a text become their ids, else they are text.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    return rows.mapInPandas(_tokenize(vocabulary, limit, with_ids, specials), "doc long, piece int, start long, length long, ids_crc32 long, ids binary")


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds: tokens, documents, and the sum of squared lengths.

    Without limits of their own, documents and cost are bounded by the tokens.
    """

    tokens: int = 2048
    documents: int | None = None
    cost: int | None = None

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.cost or self.tokens**2], np.int64)


def plan_bins(histogram: dict[int, int], capacity: Capacity = Capacity(), *, by: str = "norm", weights: tuple[float, float, float] = (1.0, 0.05, 0.05)) -> np.ndarray:
    """Runs (length, first rank, count, first bin, offset) that place every item.

    Longest items first. by="norm" minimises the weighted norm of what remains
    of a bin, by="dot" maximises the weighted dot product of item and
    remainder; equal values go to the oldest bin. No capacity is ever exceeded.
    """
    whole = capacity.vector()
    w = np.array(weights) / whole.astype(float) ** 2
    rest = np.zeros((1024, 3), np.int64)  # remaining capacities of each state
    first = np.zeros(1024, np.int64)  # its first bin
    count = np.zeros(1024, np.int64)  # its bins
    used, bins, runs = 0, 0, []

    def add(state: np.ndarray, at: int, n: int) -> None:
        nonlocal rest, first, count, used
        if used == len(rest):
            alive = np.flatnonzero((count[:used] > 0) & (rest[:used].min(axis=1) > 0))
            if len(alive) < used // 2:
                rest[: len(alive)], first[: len(alive)], count[: len(alive)] = rest[alive], first[alive], count[alive]
                used = len(alive)
            else:
                rest, first, count = np.concatenate((rest, rest * 0)), np.concatenate((first, first * 0)), np.concatenate((count, count * 0))
        rest[used], first[used], count[used] = state, at, n
        used += 1

    for length in sorted(histogram, reverse=True):
        item, left, rank = np.array([length, 1, length * length], np.int64), int(histogram[length]), 0
        most = int((whole // item).min())
        if most < 1:
            raise ValueError(f"an item of {length} tokens does not fit")
        while left:
            fits = np.flatnonzero((rest[:used] >= item).all(axis=1) & (count[:used] > 0))
            if len(fits):
                now = rest[fits]
                score = ((now - item) ** 2 * w).sum(axis=1) if by == "norm" else -(now * item * w).sum(axis=1)
                best = fits[np.argmin(score)]
                n = min(left, int(count[best]))
                runs.append((length, rank, n, int(first[best]), int(whole[0] - rest[best][0])))
                state, at = rest[best] - item, int(first[best])
                first[best] += n
                count[best] -= n
                if state.min() > 0:
                    add(state, at, n)
                left, rank = left - n, rank + n
            else:
                for copies, n in ((most, left // most), (left % most, 1)):
                    if not copies or not n:
                        continue
                    for c in range(copies):
                        runs.append((length, rank, n, bins, c * length))
                        rank += n
                    state = whole - item * copies
                    if state.min() > 0:
                        add(state, bins, n)
                    bins += n
                left = 0
    return np.array(runs, np.int64).reshape(-1, 5)


def _place(shared):
    @F.pandas_udf("sequence_id long, offset long")
    def placed(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        runs = shared.value  # sorted by length, then rank
        starts = held(("runs", id(runs)), lambda: (runs, runs[:, 0] * (1 << 44) + runs[:, 1]))[1]
        length, rank = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64)
        at = np.searchsorted(starts, length * (1 << 44) + rank, "right") - 1
        return pd.DataFrame({"sequence_id": runs[at, 3] + rank - runs[at, 1], "offset": runs[at, 4]})

    return placed


def pack(pieces: DataFrame, *, capacity: Capacity = Capacity(), length: str = "length", order: tuple[str, ...] = ("doc", "piece", "ids_crc32"), group: int = 2_500, scratch: Scratch | None = None, **options) -> DataFrame:
    """Adds sequence_id and offset to every piece; columns of these names are replaced.

    Only the histogram of lengths reaches the driver, at most one row for each
    length up to the capacity. Ranks are dealt in groups of about `group`
    pieces of one length, so a length that many pieces share is many groups.
    Equal pieces (repeated rows) get places of their own; an empty table stays
    empty. Lengths must be 1 or more and fit the capacity. `pieces` should be a written table: it is read
    three times and must be the same each time.
    """
    spark = pieces.sparkSession
    scratch = scratch or Scratch(spark)
    histogram = {r["l"]: r["n"] for r in pieces.groupBy(F.col(length).alias("l")).agg(F.count("*").alias("n")).collect()}
    runs = plan_bins(histogram, capacity, **options)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    shared = spark.sparkContext.broadcast(runs)
    salts = [max(1, -(-histogram.get(i, 0) // group)) for i in range(capacity.tokens + 1)]
    salt, l, s, before, rank, at = unused(pieces, "__salt", "__l", "__s", "__before", "__rank", "__at")
    salted = pieces.withColumn(salt, F.pmod(F.xxhash64(*order), F.get(F.lit(salts), F.col(length).cast("int"))))
    sizes = salted.groupBy(F.col(length).alias(l), F.col(salt).alias(s)).agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy(l).orderBy(s).rowsBetween(Window.unboundedPreceding, -1))
    sizes = scratch.keep(sizes.select(l, s, F.coalesce(ahead, F.lit(0)).alias(before)))
    ranked = salted.join(sizes, (F.col(length) == F.col(l)) & (F.col(salt) == F.col(s)))
    within = Window.partitionBy(l, s).orderBy(*order)
    ranked = ranked.withColumn(rank, F.col(before) + F.row_number().over(within) - 1)
    placed = ranked.withColumn(at, _place(shared)(F.col(length), F.col(rank)))
    placed = placed.withColumn("sequence_id", F.col(f"{at}.sequence_id")).withColumn("offset", F.col(f"{at}.offset"))
    return placed.drop(salt, l, s, before, rank, at)


def pack_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, capacity: Capacity = Capacity(), with_ids: bool = True, specials: bool = False, **options) -> DataFrame:
    """token_pieces() of docs, packed: every piece with its sequence and offset.

    With the default capacity documents and cost never bind before the tokens
    do: a sequence of 2048 tokens has at most 2048 documents and 2048 ** 2 cost.
    """
    scratch = Scratch(docs.sparkSession)
    pieces = token_pieces(docs, doc_id=doc_id, text=text, vocabulary=vocabulary, limit=capacity.tokens, with_ids=with_ids, specials=specials)
    pieces = scratch.keep(pieces if with_ids else pieces.drop("ids"))
    return pack(pieces, capacity=capacity, scratch=scratch, **options)
