"""Ids and bytes of the public tokenizers' vocabularies, for any text.

The byte-level ids come from a fast encoder over the ranks of the vocabulary. Its pattern takes a
stack frame for each white-space character of a run, so a text with a very long run is given to the
tokenizer file's own encoder instead; both give the same ids."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: White space in a row from which on the tokenizer file's encoder is used.
LONG_RUN = 20_000
_RUN = re.compile(rf"(?<!\s)\s{{{LONG_RUN}}}")


def path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _ranks(ranks_path: str) -> dict[bytes, int]:
    with open(ranks_path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def byte_encoder(ranks_path: str | None = None, json_path: str | None = None) -> Callable[[str], list[int]]:
    """text -> ids of the byte-level vocabulary, special tokens' strings taken as plain text."""
    import public_tokenizers
    import tiktoken

    ranks_path = ranks_path or path("byte_bpe_50k.tiktoken")
    fast = tiktoken.Encoding(os.path.basename(ranks_path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(ranks_path), special_tokens={}).encode_ordinary
    slow = []

    def encode(text: str) -> list[int]:
        if len(text) < LONG_RUN or not _RUN.search(text):
            return fast(text)
        if not slow:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(json_path or path("byte_bpe_50k.json"))
            own.encode_special_tokens = True
            slow.append(own)
        return slow[0].encode(text, add_special_tokens=False).ids

    return encode


@lru_cache(maxsize=2)
def byte_tokens(ranks_path: str | None = None) -> list[bytes]:
    """The bytes of each id of the byte-level vocabulary."""
    ranks = _ranks(ranks_path or path("byte_bpe_50k.tiktoken"))
    out = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        out[i] = token
    return out


@lru_cache(maxsize=2)
def piece_encoder(model_path: str | None = None) -> Callable[[str | list[str]], list]:
    """text -> ids of the piece vocabulary, which puts a space before the text; texts -> lists."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=model_path or path("piece_bpe_32k.model"))
    return lambda text: own.encode(text, num_threads=1)


@lru_cache(maxsize=2)
def piece_tokens(model_path: str | None = None) -> list[bytes]:
    """The bytes of each id of the piece vocabulary: byte pieces are their byte, U+2581 is a space."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=model_path or path("piece_bpe_32k.model"))
    return [bytes([int(own.id_to_piece(i)[3:5], 16)]) if own.is_byte(i) else own.id_to_piece(i).replace("▁", " ").encode()
            for i in range(own.get_piece_size())]


def shape(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts with a space) of each id."""
    return np.array([len(t) for t in tokens], np.int64), np.array([t[:1] == b" " for t in tokens])
