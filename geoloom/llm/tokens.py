"""Token counts by a public byte-level BPE vocabulary; the file's path is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-token pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokenizer:
    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, rank in ranks.items():
            self.width[rank] = len(piece)

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def byte_starts(self, text: str) -> np.ndarray:
        """The byte at which each token of `text` starts, and the end."""
        ids = np.asarray(self.encoding.encode_ordinary(text), np.int64)
        return np.concatenate(([0], np.cumsum(self.width[ids])))


@lru_cache(maxsize=2)
def tokenizer(path: str = VOCABULARY) -> Tokenizer:
    """One per process and file."""
    return Tokenizer(path)
