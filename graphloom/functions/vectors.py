"""Vector arithmetic inside the JVM, and the codec of stored vectors."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VECTOR_NAME = re.compile(r"embedding|vector|(?:^|_)emb(?:_|$)|(?:^|_)vec(?:_|$)", re.I)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null for a vector without length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def literal(vector: list[float]) -> Column:
    return F.lit([float(x) for x in vector])


def without_vectors(df):
    """df less the columns whose names tell of vectors, in structs too."""
    def strip(column: Column, kind):
        gone = [f.name for f in kind.fields if _VECTOR_NAME.search(f.name)]
        return column.dropFields(*gone) if gone and len(gone) < len(kind.fields) else column

    kept = [f for f in df.schema.fields if not _VECTOR_NAME.search(f.name)]
    return df.select(*[strip(F.col(f"`{f.name}`"), f.dataType).alias(f.name) if f.dataType.typeName() == "struct" else F.col(f"`{f.name}`") for f in kept])


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_float32(encoded: pd.Series) -> pd.Series:
    """base64 of little-endian float32 to a list; null for what doesn't decode."""
    import base64
    import binascii

    def one(text):
        try:
            return None if text is None else np.frombuffer(base64.b64decode(text, validate=True), "<f4").tolist()
        except (binascii.Error, ValueError):
            return None

    return encoded.map(one)


@F.pandas_udf(T.StringType())
def encode_float32(vectors: pd.Series) -> pd.Series:
    import base64

    return vectors.map(lambda v: None if v is None else base64.b64encode(np.asarray(v, "<f4").tobytes()).decode())
