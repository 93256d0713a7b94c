"""Joins and folds over page layouts and archives: stem pairing, collected annotations, entity runs, text lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_by_stem(left: DataFrame, right: DataFrame, *, stem: str = "stem", member: str = "member", rank: list[Column] | None = None) -> DataFrame:
    """The best member of either side for each stem, joined; ranks decide, then the first in order."""
    order = F.struct(*(rank or []), F.col("pos"), F.col(member))
    a = left.groupBy(stem).agg(F.min_by(member, order).alias("left_member"))
    b = right.groupBy(stem).agg(F.min_by(member, order).alias("right_member"))
    return a.join(b, stem)


def collect_children(parents: DataFrame, children: DataFrame, key: str, child: Column, order: str, out: str = "children") -> DataFrame:
    """Every parent with its children in order; childless parents get an empty list."""
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), child.alias("c")))).alias("_l"))
    joined = parents.join(lists, key, "left")
    return joined.withColumn(out, F.coalesce(F.transform("_l", lambda x: x["c"]), F.array())).drop("_l")


FEW_CHARS = 1 << 20
"""Characters of names that go to every task."""


def suffix_match(names: DataFrame, members: DataFrame, *, name: str = "name", member: str = "member") -> DataFrame:
    """For every name the smallest member that ends with it.

    The theta join is an equi-join on the hashes of a member's tails of the lengths that names have, and what meets is compared; the numbers of names by length, of
    which there are no more than the longest name has characters, are the only thing looked up beforehand. Lengths of few names, together at most ``FEW_CHARS``
    characters, meet the members where those are. For the others tails are shuffled: they are many times the members they are estimated by, and names may be
    as many as members, so that neither is ever broadcast.
    """
    counts = names.groupBy(F.length(name)).agg(F.count(F.lit(1))).collect()
    few, many, chars = [], [], 0
    for length, n in sorted((r for r in counts if r[0]), key=lambda r: (r[0] * r[1], r[0])):
        chars += length * n
        (few if chars <= FEW_CHARS else many).append(length)

    def met(lengths: list[int], hint: str) -> DataFrame:
        tails = members.select(F.col(member), F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("_length")).where(F.length(member) >= F.col("_length"))
        tails = tails.select(member, F.xxhash64(F.expr(f"right(`{member}`, _length)")).alias("_tail"))
        heads = names.where(F.length(name).isin(lengths)).select(name, F.xxhash64(name).alias("_tail")).hint(hint)
        return tails.join(heads, "_tail").where(F.endswith(member, name)).select(name, member)

    parts = [met(lengths, hint) for lengths, hint in ((few, "broadcast"), (many, "merge")) if lengths] or [met([], "merge")]
    return reduce(DataFrame.unionByName, parts).groupBy(name).agg(F.min(member).alias(member))


def runs(rows: DataFrame, *, key: str, order: list[str], label: str, chunk: Column | None = None) -> DataFrame:
    """Each row with the number of its run from 1: a new one begins wherever the label changes (null is a label).

    With ``chunk``, an expression that never falls along the order (a day of a time, say), a key's rows are numbered chunk by chunk and the
    chunks stitched by their first and last labels, so that no task sees a whole hot key.
    """
    if chunk is None:
        w = Window.partitionBy(key).orderBy(*order)
        change = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & (F.row_number().over(w) > 1), 0).otherwise(1)
        return rows.withColumn("_change", change).withColumn("run", F.sum("_change").over(w)).drop("_change")
    w = Window.partitionBy(key, "_chunk").orderBy(*order)
    inner = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) | (F.row_number().over(w) == 1), 0).otherwise(1)
    cut = rows.withColumn("_chunk", chunk).withColumn("_change", inner)
    ends = cut.groupBy(key, "_chunk").agg(
        F.min_by(F.struct(label), F.struct(*order)).alias("_first"), F.max_by(F.struct(label), F.struct(*order)).alias("_last"), F.sum("_change").alias("_inner")
    )
    k = Window.partitionBy(key).orderBy("_chunk")
    opens = F.when((F.row_number().over(k) > 1) & F.lag("_last").over(k).eqNullSafe(F.col("_first")), 0).otherwise(1)
    ends = ends.withColumn("_opens", opens)
    shifts = ends.select(key, "_chunk", (F.sum(F.col("_opens") + F.col("_inner")).over(k) - F.col("_inner")).alias("_shift"))
    numbered = cut.withColumn("run", F.sum("_change").over(w))
    return numbered.join(shifts, [key, "_chunk"]).withColumn("run", F.col("run") + F.col("_shift")).drop("_chunk", "_change", "_shift")


def run_texts(rows: DataFrame, *, key: str, order: list[str], label: str, text: str, drop: str | None = None) -> DataFrame:
    """Consecutive rows of one label joined into one text; a dropped label closes a run and gives none."""
    tagged = runs(rows, key=key, order=order, label=label)
    if drop is not None:
        tagged = tagged.where(F.col(label) != drop)
    return tagged.groupBy(key, "run", label).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text]), " ").alias("text"), F.count(F.lit(1)).alias("size"))


def text_lines(words: Column, least: float = 10.0, share: float = 0.8) -> Column:
    """Words (structs x0, y0, y1, text) as lines of text, top to bottom.

    Words are folded in order of (y, x): a word further from the line's running centre than the threshold opens a line. The threshold is
    ``share`` of the words' median height, at least ``least``.
    """
    heights = F.array_sort(F.transform(words, lambda w: w["y1"] - w["y0"]))
    n = F.size(heights)
    median = (F.get(heights, F.floor((n - 1) / 2).cast("int")) + F.get(heights, F.floor(n / 2).cast("int"))) / 2
    threshold = F.greatest(F.lit(least), F.coalesce(median, F.lit(0.0)) * share)
    ordered = F.array_sort(F.transform(words, lambda w: F.struct(((w["y0"] + w["y1"]) / 2).alias("y"), w["x0"].alias("x"), w["text"].alias("t"))))
    state = "struct<cy:double,lines:array<array<struct<x:double,t:string>>>>"
    start = F.struct(F.lit(None).cast("double").alias("cy"), F.array().alias("lines")).cast(state)

    def step(acc: Column, w: Column) -> Column:
        word = F.array(F.struct(w["x"].cast("double").alias("x"), w["t"].alias("t")))
        new = acc["cy"].isNull() | (F.abs(w["y"] - acc["cy"]) > threshold)
        grown = F.concat(F.slice(acc["lines"], 1, F.greatest(F.size(acc["lines"]) - 1, F.lit(0))), F.array(F.concat(F.element_at(acc["lines"], -1), word)))
        return F.struct(F.when(new, w["y"]).otherwise((acc["cy"] + w["y"]) / 2).cast("double").alias("cy"), F.when(new, F.concat(acc["lines"], F.array(word))).otherwise(grown).alias("lines"))

    lined = F.aggregate(ordered, start, step, lambda acc: acc["lines"])
    return F.transform(lined, lambda line: F.array_join(F.transform(F.array_sort(line), lambda w: w["t"]), " "))


def layout_regions(annotations: Column) -> Column:
    """A Markdown list of annotations (structs label, bbox)."""
    from ..functions.text import box_line

    return F.concat(F.lit("## Layout Regions\n\n"), F.array_join(F.transform(annotations, lambda a: box_line(a["label"], a["bbox"])), "\n"))


def reshape_cells(cells: Column, columns: Column) -> Column:
    """A flat array of cells as rows of ``columns`` cells."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(cells) / columns).cast("int") - 1)), lambda i: F.slice(cells, i * columns + 1, columns))


def main_file(files: DataFrame, *, key: str, path: str = "path", text: str = "text") -> DataFrame:
    """The main file of every package: most structure first, then the shorter, then the smaller path."""
    t = F.col(text)
    score = (
        F.when(F.contains(t, F.lit("\\documentclass")), 10).otherwise(0)
        + F.when(F.contains(t, F.lit("\\begin{document}")), 8).otherwise(0)
        + F.regexp_count(t, F.lit(r"\\section"))
        + F.regexp_count(t, F.lit(r"\\subsection"))
    )
    scored = files.select(key, path, F.coalesce(score, F.lit(0)).alias("score"))
    return scored.groupBy(key).agg(F.min_by(F.struct(path, "score"), F.struct(-F.col("score"), F.length(path), F.col(path))).alias("m")).select(key, "m.*")
