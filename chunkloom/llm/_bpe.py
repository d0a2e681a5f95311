"""Byte-level BPE of a rank file: ids of whole texts and where in the text each id begins."""

from __future__ import annotations

import base64
import os
from functools import cache

import numpy as np
import tiktoken

#: Folder of the rank file; the name is a parameter of the operators.
TOKENIZERS = os.environ.get("CHUNKLOOM_TOKENIZERS", "/opt/tokenizers")
DEFAULT = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
EOS = 50256  #: the id that the rank file leaves free
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLICE = 1 << 16  #: characters that one call of the encoder gets, about


@cache
def encoder(path: str = DEFAULT) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding (loaded once a worker) and the bytes of each id."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def _cut(text: str, at: int) -> int:
    """The first place from ``at`` on where a space follows another sign: no piece of the pattern spans it."""
    while True:
        at = text.find(" ", at)
        if at < 1:
            return len(text)
        if not text[at - 1].isspace():
            return at
        at += 1


def encode(text: str, path: str = DEFAULT) -> np.ndarray:
    """Ids of the whole text, the same as those of one call; long texts go to the encoder in slices."""
    enc = encoder(path)[0]._core_bpe  # spares a Python call a text; Arrow's strings have no lone surrogates
    if len(text) <= 2 * SLICE:
        return np.array(enc.encode_ordinary(text), np.int32)
    out, at = [], 0
    while at < len(text):
        end = _cut(text, at + SLICE)
        out += enc.encode_ordinary(text[at:end])
        at = end
    return np.array(out, np.int32)


def byte_starts(cps: np.ndarray) -> np.ndarray:
    """The byte of UTF-8 at which each code point begins, and the end (n + 1)."""
    return np.concatenate([[0], np.cumsum(1 + (cps > 0x7F) + (cps > 0x7FF) + (cps > 0xFFFF))]).astype(np.int64)


def decode(ids, path: str = DEFAULT) -> str:
    return encoder(path)[0].decode(list(map(int, ids)))
