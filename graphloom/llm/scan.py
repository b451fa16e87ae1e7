"""One pass of a Python function over a text column, by Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.shipping import ship

#: (texts) -> one Arrow array for each field
TextFunction = Callable[[pa.Array], list]


def scan_text(df: DataFrame, text: str, fields: str | T.StructType, fn: TextFunction, keep: list[str] | None = None) -> DataFrame:
    """The columns keep of df (all by default) and the fields that fn makes of each text, with no shuffle.

    A kept column that has the name of a field is left out: the field replaces it. fn sees null texts as null.
    A kept text goes to Python once, as the column that it is.
    """
    ship(df.sparkSession)
    schema = T.StructType.fromDDL(fields) if isinstance(fields, str) else fields
    new = {f.name.lower() for f in schema}
    names = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    n, at = len(names), names.index(text) if text in names else len(names)
    source = df.select(*[F.col(f"`{c}`") for c in names], *([F.col(f"`{text}`").alias("\x01text")] if at == n else []))
    out = T.StructType([*source.schema.fields[:n], *schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], names=out.names)

    return source.mapInArrow(run, out)


def text_sample(texts: DataFrame, column: str, n: int, seed: int) -> DataFrame:
    """About n different values of a column of strings, 2 * n at most, chosen by a hash of the value: a share of the hashes that
    the number of different values fixes. What a task sends on is its part of the sample, however many tasks there are."""
    value = F.col(f"`{column}`")
    different = texts.agg(F.approx_count_distinct(F.xxhash64(value), 0.02).alias("n")).first().n
    share = F.pmod(F.xxhash64(F.lit(seed), value), F.lit(1 << 40)) < int(min(1.0, n / max(different, 1)) * (1 << 40))
    return texts.select(value.alias(column)).where(share).distinct().limit(2 * n)
