"""A small model for the encoder hook: bags of hashed word tokens.

It stands in for a sentence model where none is installed: a Python object that
a worker loads once and that encodes lists of texts. Its vectors are those of the
hashing encoder, so SQL can check what goes through the hook.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np

from ..functions.text import passage_prefix_for, query_prefix_for
from .encode import ModelEncoder


class BagOfTokens:
    KNOWN = 1 << 18           # tokens whose hash is remembered

    def __init__(self):
        import regex
        self.split = regex.compile(r"[^\p{L}\p{N}]+").split
        self.known: dict[str, int] = {}

    def hashes(self, text: str) -> list[int]:
        out = []
        for t in self.split(text.lower()):
            if t:
                h = self.known.get(t)
                if h is None:
                    h = int(hashlib.md5(t.encode()).hexdigest()[:4], 16)
                    if len(self.known) < self.KNOWN:
                        self.known[t] = h
                out.append(h)
        return out


def encode_bags(dim: int, model: BagOfTokens, texts: list[str]) -> np.ndarray:
    return np.stack([np.bincount(np.array(model.hashes(t), np.int64) % dim, minlength=dim) for t in texts])


def bag_model(name: str, dim: int) -> ModelEncoder:
    """Encoder with the prefixes of the model family that ``name`` belongs to."""
    return ModelEncoder(name, dim, BagOfTokens, partial(encode_bags, dim), query_prefix_for(name), passage_prefix_for(name))
