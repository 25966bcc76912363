"""Sub-word tokenizers for budgets and token counts.

A tokenizer is any object with ``lengths(texts)`` (tokens of each text) and
``heads(texts, budgets)`` (each text cut to its first tokens); it runs on whole
Arrow batches and loads its vocabulary once per Python worker. Vocabularies are
files that the caller names; none is trained or shipped here.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package

_LOADED: dict = {}      # vocabularies of this worker process


@dataclass(frozen=True)
class RankTokenizer:
    """Byte-level BPE by a file of ranks (base64 token and rank per line) and the
    pattern that splits a text first. Special tokens are ordinary text."""

    path: str
    pattern: str

    def _vocabulary(self):
        if self not in _LOADED:
            import tiktoken
            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            sizes = np.zeros(max(ranks.values()) + 1, np.int64)
            for token, i in ranks.items():
                sizes[i] = len(token)
            _LOADED[self] = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={}), sizes
        return _LOADED[self]

    def ids(self, text: str) -> list[int]:
        return self._vocabulary()[0].encode_ordinary(text)

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(self.ids(t)) for t in texts]

    def heads(self, texts: list[str], budgets: list[int]) -> list[str]:
        """A token that ends inside a character goes with it."""
        _, sizes = self._vocabulary()
        out = []
        for t, n in zip(texts, budgets, strict=True):
            # a token has a byte at least: short texts fit unseen
            raw = t.encode()
            ids = self.ids(t) if len(raw) > n else []
            out.append(raw[:int(sizes[ids[:n]].sum())].decode("utf-8", "ignore") if len(ids) > n else t)
        return out


def _batch(fn, schema):
    ship_package(SparkSession.getActiveSession())
    return F.arrow_udf(fn, schema)


def token_count(text: Column, tokenizer) -> Column:
    """Tokens of a text; null for a null text."""
    def count(col: pa.Array) -> pa.Array:
        known = [t is not None for t in col.to_pylist()]
        n = iter(tokenizer.lengths([t for t in col.to_pylist() if t is not None]))
        return pa.array([next(n) if k else None for k in known], pa.int32())

    return _batch(count, T.IntegerType())(text)


def fit_pair(first: Column, second: Column, max_tokens: int, tokenizer) -> Column:
    """``struct<first string, over_budget boolean>``: ``first`` cut so that both
    texts have at most ``max_tokens`` tokens; ``second`` is never cut."""
    def cut(a: pa.Array, b: pa.Array) -> pa.Array:
        n = np.array(tokenizer.lengths([t or "" for t in b.to_pylist()]), np.int64)
        texts = a.to_pylist()
        heads = tokenizer.heads([t or "" for t in texts], np.maximum(max_tokens - n, 0).tolist())
        return pa.StructArray.from_arrays(
            [pa.array([h if t is not None else None for h, t in zip(heads, texts, strict=True)], pa.string()), pa.array(n > max_tokens)],
            names=["first", "over_budget"])

    out = T.StructType([T.StructField("first", T.StringType()), T.StructField("over_budget", T.BooleanType())])
    return _batch(cut, out)(first, second)
