"""Near duplicates on word shingles: exact set-similarity join and classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut
from .components import connected_components
from .curation import shingles

SHINGLE_WORDS, SIMILARITY = 5, 0.8


def near_duplicate_classes(rows: DataFrame, *, text: str = "text", id_column: str = "doc_id", words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``id, class_id, links`` for every row: the smallest id of its class, and how many other texts it is directly near to.

    Texts with equal shingles are one text. Between different texts the join is exact: two sets of similarity t share one of
    the first n - ceil(t n) + 1 shingles of both, in any common order. The order is by number of texts, so shingles that stand in one text only come
    first and are never listed. Pairs that meet are measured on their whole sets. Rows without words are classes of their own.
    """
    key = F.col(id_column).alias("id")
    made = rows.select(key, F.array_sort(shingles(F.col(text), words)).alias("sh"))
    made = cut(made.select("id", "sh", F.when(F.col("sh").isNotNull(), F.sha2(F.array_join(F.transform("sh", lambda x: x.cast("string")), ","), 256)).alias("h")), "shingles")
    reps = made.where("h is not null").groupBy("h").agg(F.min("id").alias("rep"), F.first("sh").alias("sh"))
    reps = cut(reps.select("h", "rep", "sh", F.size("sh").alias("n")), "reps")
    exploded = reps.select("rep", "n", F.explode("sh").alias("s"))
    shared = exploded.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    listed = exploded.join(shared, "s")
    w = Window.partitionBy("rep")
    ranked = listed.withColumn("at", F.row_number().over(w.orderBy("df", "s")) + F.col("n") - F.count(F.lit(1)).over(w))
    prefix = cut(ranked.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).select("s", "rep", "n"), "prefix")
    a, b = (prefix.select("s", F.col("rep").alias(x), F.col("n").alias(f"n{x}")) for x in ("a", "b"))
    pairs = a.join(b, "s").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * similarity - 1e-9)).select("a", "b").distinct()
    sets = reps.select("rep", "sh")
    measured = pairs.join(sets.select(F.col("rep").alias("a"), F.col("sh").alias("sa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("sh").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    near = cut(measured.where(both >= similarity * (F.size("sa") + F.size("sb") - both) - 1e-9).select("a", "b"), "near")
    comps = connected_components(near)
    degree = near.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    classes = reps.select("h", "rep").join(comps, F.col("rep") == F.col("node"), "left").join(degree, "rep", "left")
    classes = classes.select("h", F.coalesce("component", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return made.select("id", "h").join(classes, "h", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
