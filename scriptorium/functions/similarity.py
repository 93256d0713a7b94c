"""Similarity of two texts: Ratcliff-Obershelp on normalised Markdown, and the cheap edit ratio."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .text import normalize_markdown


def _ratio(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    return 1.0 if a == b else SequenceMatcher(a=a, b=b).ratio()


def with_edit_similarity(rows: DataFrame, prediction: str, reference: str, out: str = "similarity") -> DataFrame:
    """``rows`` with the ratio of matching characters of two columns' normalised texts; 1 if both are empty, null for null.

    Asymmetric, as the algorithm is. Texts are normalised natively; only the two normalised columns and the row cross to Python.
    """
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = len(columns)
            got = [_ratio(x, y) for x, y in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(got, pa.float64())], names=[*columns, out])

    made = rows.select(*columns, normalize_markdown(F.col(prediction)).alias("_a"), normalize_markdown(F.col(reference)).alias("_b"))
    return made.mapInArrow(run, StructType([*rows.schema.fields, StructField(out, DoubleType())]))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - edits / longer length, wholly native; another measure than ``edit_similarity``."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)
