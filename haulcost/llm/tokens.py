"""Token ids of whole texts under a public byte-level vocabulary; runs inside tasks."""

from __future__ import annotations

import base64
import json
from functools import cache
from typing import NamedTuple

import numpy as np
import tiktoken
from tokenizers import Tokenizer


class Coder(NamedTuple):
    """The fast encoder, and the ``tokenizers`` file for texts that it cannot take."""

    ranks: tiktoken.Encoding
    tokenizer_file: str | None


@cache
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@cache
def encoder(
    ranks_file: str | None = None, pattern: str | None = None, tokenizer_file: str | None = None
) -> Coder:
    """The worker's encoder; the 50,000-entry public vocabulary unless files are named.

    The vocabulary's ranks give the same ids as its ``tokenizers`` file, several
    times as fast; tests hold the two against each other. The file's added tokens
    count where they stand in a text, as they do in ``tokenizers``.
    """
    if ranks_file is None:
        import public_tokenizers

        ranks_file = public_tokenizers.path("byte_bpe_50k.tiktoken")
        pattern = public_tokenizers.PATTERN
        tokenizer_file = public_tokenizers.path("byte_bpe_50k.json")
    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    added = {}
    if tokenizer_file is not None:
        with open(tokenizer_file, encoding="utf-8") as file:
            added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    ranks = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
    return Coder(ranks, tokenizer_file)


def token_ids(text: str, coder: Coder) -> np.ndarray:
    try:
        return coder.ranks.encode_to_numpy(text, allowed_special="all").astype("<u4")
    except ValueError:  # a run too long for the pattern's stack
        if coder.tokenizer_file is None:
            raise
    ids = _tokenizer(coder.tokenizer_file).encode(text, add_special_tokens=False).ids
    return np.array(ids, "<u4")
