"""Text -> unit vector encoders.

An encoder has two halves: ``features(col)`` is a native Spark expression
(runs in the JVM), ``encode_arrow(arr)`` turns one Arrow batch of features
into a ``list<float>`` array of unit vectors (runs once per Arrow batch in the
Python worker). A model-backed encoder keeps ``features`` as the text itself
and loads its model once per worker inside ``encode_arrow``.

The default :class:`HashingEncoder` needs no weights: lower-case, split on
non letters/digits, bucket = first 4 hex digits of ``md5(token)`` mod ``dim``,
token counts, L2 normalised and stored as float32.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import passage_prefix_for, query_prefix_for

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased word tokens (letters and digits), empties removed."""
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT, -1), lambda t: t != "")


def token_bucket(tok: Column, dim: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(tok), 1, 4), 16, 10).cast("int"), F.lit(dim))


def _unit_rows(counts: np.ndarray) -> np.ndarray:
    c = counts.astype(np.float64)
    norm = np.sqrt((c * c).sum(axis=1))
    safe = np.where(norm > 0, norm, 1.0)
    return (c / safe[:, None]).astype(np.float32)


def _as_list_array(mat: np.ndarray) -> pa.Array:
    n, d = mat.shape
    offsets = pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32) if n else np.zeros(1, np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(mat.reshape(-1), type=pa.float32()))


@dataclass
class HashingEncoder:
    dim: int = 256
    name: str = "hashing"
    query_prefix: str = ""
    passage_prefix: str = ""

    def features(self, text: Column) -> Column:
        return F.transform(tokens(text), lambda t: token_bucket(t, self.dim))

    def _counts(self, arr: pa.Array) -> np.ndarray:
        n = len(arr)
        lens = pc.fill_null(pc.list_value_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        vals = pc.list_flatten(arr).to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.repeat(np.arange(n, dtype=np.int64), lens)
        return np.bincount(rows * self.dim + vals, minlength=n * self.dim).reshape(n, self.dim)

    def encode_arrow(self, arr: pa.Array) -> pa.Array:
        return _as_list_array(_unit_rows(self._counts(arr)))

    def sparse_arrow(self, arr: pa.Array) -> pa.Array:
        """Per row: non-zero ``bucket``s (ascending), their ``cnt`` and unit
        ``weight`` (same float32 values as the dense vector)."""
        counts = self._counts(arr)
        w = _unit_rows(counts)
        r, c = np.nonzero(counts)
        offsets = pa.array(np.r_[0, np.cumsum(np.bincount(r, minlength=len(counts)))].astype(np.int32))
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(offsets, pa.array(c.astype(np.int32))),
             pa.ListArray.from_arrays(offsets, pa.array(counts[r, c].astype(np.int64))),
             pa.ListArray.from_arrays(offsets, pa.array(w[r, c], type=pa.float32()))],
            names=["bucket", "cnt", "weight"])


_MODELS: dict = {}      # models loaded in this worker process


@dataclass
class CallableEncoder:
    """Wraps ``fn(list[str]) -> ndarray[n, dim]`` (e.g. a sentence encoder).

    ``loader`` is called once per Python worker process and its result is
    passed to ``fn`` as the first argument; loaded models are told apart by
    ``name`` and loader. Vectors are L2-normalised here.
    """
    dim: int
    fn: Callable
    loader: Callable | None = None
    name: str = "callable"
    query_prefix: str = ""
    passage_prefix: str = ""

    def features(self, text: Column) -> Column:
        return text

    def encode_arrow(self, arr: pa.Array) -> pa.Array:
        key = (self.name, getattr(self.loader, "__module__", ""), getattr(self.loader, "__qualname__", ""))
        if self.loader is not None and key not in _MODELS:
            _MODELS[key] = self.loader()
        texts = [t if t is not None else "" for t in arr.to_pylist()]
        model = _MODELS.get(key)
        out = np.asarray(self.fn(model, texts) if self.loader else self.fn(texts), dtype=np.float64)
        return _as_list_array(_unit_rows(out) if out.size else np.zeros((0, self.dim), np.float32))


@dataclass
class ModelEncoder:
    """A model over texts: ``loader()`` gives it, ``encode(model, texts)`` an
    ``[n, dim]`` array; vectors are L2-normalised here.

    The model is loaded once per Python worker process. Rows come as a stream of
    Arrow batches: a window of them is sorted by text length and cut into model
    batches of at most ``batch_rows`` rows whose padded size (rows times longest
    text) is at most ``batch_chars``, so short texts are not padded to long ones
    and memory follows the texts, not the row count. Rows keep their order.
    """
    name: str
    dim: int
    loader: Callable
    encode: Callable
    query_prefix: str = ""
    passage_prefix: str = ""
    batch_rows: int = 4096
    batch_chars: int = 1 << 20
    window_rows: int = 1 << 14

    def features(self, text: Column) -> Column:
        return text

    def model(self):
        key = (self.name, self.loader.__module__, self.loader.__qualname__)
        if key not in _MODELS:
            _MODELS[key] = self.loader()
        return _MODELS[key]

    def model_batches(self, lengths: np.ndarray):
        """Row numbers of each model batch, shortest texts first."""
        order, at = np.argsort(lengths, kind="stable"), 0
        while at < len(order):
            to = at + 1
            while to < len(order) and to - at < self.batch_rows and (to + 1 - at) * lengths[order[to]] <= self.batch_chars:
                to += 1
            yield order[at:to]
            at = to

    def encode_texts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for rows in self.model_batches(np.array([len(t) for t in texts], np.int64)):
            out[rows] = _unit_rows(np.asarray(self.encode(self.model(), [texts[i] for i in rows]), np.float64).reshape(len(rows), self.dim))
        return out

    def encode_stream(self, arrays):
        """One array of vectors per array of texts, window by window."""
        window, held = [], 0
        for a in arrays:
            window.append(a)
            held += len(a)
            if held >= self.window_rows:
                yield from self._encode_window(window)
                window, held = [], 0
        yield from self._encode_window(window)

    def _encode_window(self, window):
        vectors, at = self.encode_texts([t or "" for a in window for t in a.to_pylist()]), 0
        for a in window:
            yield _as_list_array(vectors[at:at + len(a)])
            at += len(a)


def for_model(model: str | None, dim: int = 256) -> HashingEncoder:
    """Hashing encoder carrying the prefixes a model family would use."""
    return HashingEncoder(dim=dim, name=model or "hashing",
                          query_prefix=query_prefix_for(model), passage_prefix=passage_prefix_for(model))


def encode_column(encoder, text: Column) -> Column:
    from pyspark.sql import SparkSession

    from ..session import ship_package
    ship_package(SparkSession.getActiveSession())
    if hasattr(encoder, "encode_stream"):
        def stream(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from encoder.encode_stream(arrays)

        udf = F.arrow_udf(stream, T.ArrayType(T.FloatType()))
    else:
        udf = F.arrow_udf(encoder.encode_arrow, T.ArrayType(T.FloatType()))
    return udf(encoder.features(text))


def encode(df: DataFrame, encoder, text_col: str = "text", out_col: str = "embedding",
           prefix: str = "") -> DataFrame:
    """Add ``out_col`` = unit vector of ``prefix + text_col``; the source
    column is left unchanged (no prefix removal needed afterwards)."""
    src = F.concat(F.lit(prefix), F.col(text_col)) if prefix else F.col(text_col)
    return df.withColumn(out_col, encode_column(encoder, src))


SPARSE_TYPE = T.StructType([T.StructField("bucket", T.ArrayType(T.IntegerType())),
                            T.StructField("cnt", T.ArrayType(T.LongType())),
                            T.StructField("weight", T.ArrayType(T.FloatType()))])


def encode_sparse(df: DataFrame, encoder: HashingEncoder, id_col: str, text_col: str = "text") -> DataFrame:
    """Long form of the hashing encoder: ``(id, bucket, cnt, weight)``.

    Map-only: the Arrow kernel returns each row's non-zero buckets, which are
    exploded in place (no shuffle of token rows)."""
    from pyspark.sql import SparkSession

    from ..session import ship_package
    ship_package(SparkSession.getActiveSession())
    udf = F.arrow_udf(encoder.sparse_arrow, SPARSE_TYPE)
    s = df.select(F.col(id_col).alias("id"), udf(encoder.features(F.col(text_col))).alias("s"))
    z = s.select("id", F.explode(F.arrays_zip(F.col("s.bucket").alias("bucket"), F.col("s.cnt").alias("cnt"),
                                              F.col("s.weight").alias("weight"))).alias("z"))
    return z.select("id", "z.bucket", "z.cnt", "z.weight")
