"""The public piece vocabulary that token counts and language ID score with."""

from __future__ import annotations

import os
from functools import lru_cache

import ahocorasick

DEFAULT_VOCABULARY = "piece_bpe_32k.model"
BLANK = "▁"


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    """Place of a public vocabulary; a name with a slash is a path already."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def load_pieces(path: str) -> tuple[tuple[str, float], ...]:
    """(piece, score) of the whole vocabulary, in id order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple((model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size()))


@lru_cache(maxsize=2)
def piece_automaton(path: str) -> ahocorasick.Automaton:
    """Finds every piece in a string; each match has (length, score, id)."""
    automaton = ahocorasick.Automaton()
    for i, (piece, score) in enumerate(load_pieces(path)):
        automaton.add_word(piece, (len(piece), score, i))
    automaton.make_automaton()
    return automaton
