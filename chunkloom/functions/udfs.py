"""Arrow-batched functions for what expressions can't state: sequential scanning, Unicode forms, hashing."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from chunkloom.config import Cleaning
from chunkloom.functions import textkit as T
from chunkloom.operators import roles


def each(f: Callable, kind: DataType, *columns: Column | str) -> Column:
    """``f``, a function of the kernel, on the values of every row; nulls are its own business."""

    @pandas_udf(kind)
    def run(*values: pd.Series) -> pd.Series:
        return pd.Series([f(*v) for v in zip(*values)], dtype=object)

    return run(*columns)


@pandas_udf(StringType())
def normalize(text: pd.Series, form: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else unicodedata.normalize(f, t) for t, f in zip(text, form)])


@pandas_udf(ArrayType(StringType()))
def sentences(text: pd.Series) -> pd.Series:
    return text.map(lambda t: T.sentences(t or ""))


@pandas_udf(StringType())
def tidy_spaces(text: pd.Series) -> pd.Series:
    return text.map(lambda t: T.tidy_spaces(t or ""))


@pandas_udf(StringType())
def slug(text: pd.Series) -> pd.Series:
    return text.map(lambda t: T.slug(t or ""))


def clean(text: Column | str, cfg: Cleaning | None = None) -> Column:
    cfg = cfg or Cleaning(normalize_quotes=True, remove_navigation=True, remove_urls=True, remove_headers=True, remove_footers=True)

    @arrow_udf(StringType())
    def run(t: pa.Array) -> pa.Array:
        # in slices: as objects of Python a batch of texts takes several times its size
        return pa.concat_arrays([pa.array([T.clean(x or "", cfg) for x in t.slice(at, 64).to_pylist()], pa.string()) for at in range(0, max(1, len(t)), 64)])

    return run(text)


@pandas_udf(StructType([StructField("segments", IntegerType()), StructField("sentences", IntegerType()), StructField("verb_ratio", DoubleType()), StructField("mean_words", DoubleType()), StructField("list_items", IntegerType()), StructField("numbered", IntegerType()), StructField("pairs", IntegerType()), StructField("questions", IntegerType()), StructField("words", IntegerType()), StructField("fenced", DoubleType()), StructField("table", DoubleType()), StructField("is_terms", BooleanType())]))
def shape(text: pd.Series) -> pd.DataFrame:
    names = ("segments", "sentences", "verb_ratio", "mean_words", "list_items", "numbered", "pairs", "questions", "words", "fenced", "table", "is_terms")
    found = [roles.shape_of(t or "") for t in text]
    return pd.DataFrame({n: [getattr(s, n) for s in found] for n in names})


@pandas_udf(StructType([StructField("role", StringType()), StructField("field", StringType()), StructField("confidence", DoubleType()), StructField("terms", ArrayType(StringType()))]))
def role(text: pd.Series, heading: pd.Series) -> pd.DataFrame:
    found = [roles.classify(t or "", h) for t, h in zip(text, heading)]
    return pd.DataFrame({"role": [r.role for r in found], "field": [r.field for r in found], "confidence": [r.confidence for r in found], "terms": [r.terms for r in found]})


@pandas_udf(ArrayType(StringType()))
def terms(text: pd.Series) -> pd.Series:
    return text.map(lambda t: roles.extract_terms(t or ""))


def tokenizer_count(text: Column | str, spec: str) -> Column:
    """Counts of the tokenizer that ``textkit.tokenizer`` gives for ``spec``, loaded once a worker."""

    @pandas_udf(LongType())
    def run(t: pd.Series) -> pd.Series:
        count = T.tokenizer(spec)
        return t.map(lambda x: count(x or ""))

    return run(text)


@lru_cache(1 << 16)
def _place(word: str, size: int) -> tuple[int, float]:
    h = hashlib.blake2b(word.encode(), digest_size=8).digest()
    return int.from_bytes(h[:4], "big") % size, 1.0 if h[4] & 1 else -1.0


def hash_embedding(text: Column | str, dimensions: int = 256) -> Column:
    """Signed hashed bag of words, of unit length; a text without words gives zeros.

    Where the signs of all its words cancel, the words together count as one.
    """
    size = max(8, dimensions)

    @pandas_udf(ArrayType(FloatType()))
    def run(t: pd.Series) -> pd.Series:
        out = []
        for x in t:
            v = np.zeros(size)
            words = T.casefold(x or "").split()
            for w in words:
                i, sign = _place(w, size)
                v[i] += sign
            n = np.linalg.norm(v)
            if words and not n:
                i, sign = _place(" ".join(words), size)
                v[i] = sign
                n = 1.0
            out.append((v / n if n else v).astype(np.float32))
        return pd.Series(out)

    return run(F.col(text) if isinstance(text, str) else text)
