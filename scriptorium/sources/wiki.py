"""Generated pages from plain articles in several languages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.markup import wiki_to_markdown
from ..functions.text import filled

MIN_CHARS, MIN_BREAKS, MIN_RENDERED = 1500, 2, 100


@F.arrow_udf(StringType())
def _rendered(titles: pa.Array, texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None or x is None else wiki_to_markdown(t, x) for t, x in zip(titles.to_pylist(), texts.to_pylist(), strict=True)], pa.string())


def usable(title: Column, text: Column) -> Column:
    """Articles with a title, enough text and enough paragraphs."""
    breaks = F.regexp_count(text, F.lit(r"\n\s*\n"))
    return filled(title).isNotNull() & (F.length(text) >= MIN_CHARS) & (breaks >= MIN_BREAKS)


def multilingual_pages(articles: DataFrame, *, languages: list[str], total: int, title: str = "title", text: str = "text", lang: str = "lang", order: str = "id") -> DataFrame:
    """Pages of the languages, each with the same quota of usable articles in order; articles are cut by quota before they are rendered."""
    quota = -(-total // max(1, len(languages)))
    rows = articles.where(F.col(lang).isin(languages) & usable(F.col(title), F.col(text)))
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy(lang).orderBy(order))).where(F.col("_k") <= quota).drop("_k")
    return ranked.withColumn("markdown", _rendered(title, text)).where(F.length("markdown") >= MIN_RENDERED)
