"""Identity text to unit vector: built in, supplied, or by a model plug-in."""

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.functions.vectors import fit_width, l2_normalise
from likeness.schemas import VECTOR_DIM

# What a plug-in gives: called once per worker, it loads the model and returns
# a function from a list of texts to a 2-d array, one row per text.
ModelLoader = Callable[[], Callable[[list[str]], np.ndarray]]

BATCH = 64

# Texts that the built-in encoder counts at a time.
SLICE = 512

# Distinct numbers below this are told by marking them, others by sorting.
MOST_MARKED = 1 << 20
ASCII = 128


def model_encoder(load: ModelLoader, batch: int = BATCH) -> Callable[[Column], Column]:
    """A column function running a user-supplied model over Arrow batches."""
    @F.pandas_udf("array<float>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for series in texts:
            rows = series.tolist()
            vectors = []
            for start in range(0, len(rows), batch):
                vectors.extend(
                    np.asarray(model(rows[start:start + batch]), dtype=np.float32))
            yield pd.Series(vectors, index=series.index)
    return encode


def _trigram_counts(texts: list[str], dim: int) -> np.ndarray:
    """Hashed trigram counts of some texts; each distinct trigram is hashed once."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    found = np.maximum(sizes - 2, 0)
    row = np.repeat(np.arange(len(texts)), found)
    if not len(row):
        return np.zeros((len(texts), dim), np.int64)
    # Characters by their rank among those that occur, so that trigrams are small numbers.
    chars, code = _distinct(np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64), ASCII)
    # Where each trigram of a text begins among the characters of all.
    at = np.arange(len(row)) + np.repeat(np.cumsum(sizes) - sizes - np.cumsum(found) + found, found)
    n = len(chars)
    grams, gram = _distinct((code[at] * n + code[at + 1]) * n + code[at + 2], n ** 3)
    letters = list(map(chr, chars.tolist()))
    buckets = np.array([
        int(hashlib.md5((letters[g // n // n] + letters[g // n % n] + letters[g % n]).encode()).hexdigest()[:8], 16) % dim
        for g in grams.tolist()], np.int64)
    return np.bincount(row * dim + buckets[gram], minlength=len(texts) * dim).reshape(len(texts), dim)


def _distinct(values: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each value among them; without sorting if all are below a small ``room``."""
    if room > MOST_MARKED or values.max() >= room:
        return np.unique(values, return_inverse=True)
    marked = np.zeros(room, bool)
    marked[values] = True
    return np.flatnonzero(marked), (np.cumsum(marked) - 1)[values]


def hashed_trigrams(dim: int = VECTOR_DIM, nulls: bool = False) -> Callable[[Column], Column]:
    """The built-in encoder over Arrow batches; a null text is an empty one, or gives null with ``nulls``.

    Gives what :func:`likeness.functions.vectors.hashed_trigram_vector` gives, but
    that interprets some 80,000 lambda steps per text.
    """
    @F.arrow_udf("array<float>")
    def encode(texts: pa.Array) -> pa.Array:
        missing = texts.is_null() if nulls else None
        if nulls and texts.null_count == len(texts):
            return pa.nulls(len(texts), pa.list_(pa.float32()))
        unit = np.zeros((len(texts), dim), np.float32)
        # A slice of the batch at a time, as counts and quotients take eight bytes each.
        for start in range(0, len(texts), SLICE):
            part = slice(start, start + SLICE)
            counts = _trigram_counts(texts[part].fill_null("").to_pylist(), dim)
            length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            unit[part] = np.divide(
                counts, length, out=np.zeros(counts.shape), where=length > 0)
        offsets = np.arange(len(texts) + 1, dtype=np.int32) * dim
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(unit.ravel()), mask=missing)
    # Keeps Spark from computing the vector again for a filter on it.
    return encode.asNondeterministic()


def encode_texts(
    df: DataFrame,
    dim: int = VECTOR_DIM,
    model: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Add ``identity_vec``, at unit length and fitted to the width.

    The built-in encoder costs less than a shuffle. A model encodes each distinct
    text once; its vectors are then joined back.
    """
    if model is None:
        return df.withColumn(
            "identity_vec", hashed_trigrams(dim)(F.col("identity_text")))
    vectors = df.select("identity_text").distinct().withColumn(
        "identity_vec", fit_width(l2_normalise(model(F.col("identity_text"))), dim))
    return df.join(vectors, "identity_text")


def with_vectors(
    df: DataFrame,
    dim: int = VECTOR_DIM,
    model: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Stored vectors where there are any; the others are encoded."""
    if "identity_vec" not in df.columns:
        return encode_texts(df, dim, model)
    stored = F.col("identity_vec")
    if model is None:
        # One pass: texts of stored vectors are masked, and no vector is made or sent back for them.
        masked = F.when(stored.isNull(), F.coalesce("identity_text", F.lit("")))
        return df.withColumn("identity_vec", F.coalesce(stored, hashed_trigrams(dim, nulls=True)(masked)))
    missing = encode_texts(
        df.filter(stored.isNull()).select("identity_text").distinct(), dim, model)
    return df.join(missing.withColumnRenamed("identity_vec", "_encoded"), "identity_text", "left").withColumn(
        "identity_vec", F.coalesce("identity_vec", "_encoded")).drop("_encoded")
