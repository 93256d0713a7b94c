"""Page policy: complexity and routing, Markdown validation, document assembly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_of, lines, strip, unescaped_dollars

# Weights and thresholds of the routing score.
WEIGHTS = {"visual_density": 0.20, "formula_density": 0.20, "table_density": 0.18, "handwriting": 0.12, "chart": 0.08, "tiny_text": 0.07, "photo": 0.05}
BLOCK_WEIGHT, BLOCKS_FULL = 0.10, 24.0
STANDARD, HARD = 0.34, 0.62
# Signals that make a page hard alone, with their reason and the hint they give.
HARD_REASONS = (
    ("formula_density", 0.08, "formula_density", "formula"), ("table_density", 0.12, "table_density", "table"), ("handwriting", 0.40, "handwriting", "handwriting"),
    ("chart", 0.35, "chart", "chart"), ("tiny_text", 0.45, "long_tiny_text", None), ("photo", 0.35, "photo_distortion", None), ("orientation", 0.20, "orientation_uncertainty", None),
)
# Decode modes with visual tokens, output tokens, crops, repairs and hints.
MODES = {"fast": (96, 3072, 0, 0, ()), "standard": (160, 5120, 2, 1, ("table",)), "hard": (256, 8192, 4, 2, ("formula", "handwriting", "table"))}


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.cast("double")))


def complexity(signals: dict[str, Column], blocks: Column) -> Column:
    score = F.lit(BLOCK_WEIGHT) * clamp(blocks / BLOCKS_FULL)
    for name, weight in WEIGHTS.items():
        score = score + F.lit(weight) * clamp(signals[name])
    return clamp(score)


def _by_mode(mode: Column, at: int) -> Column:
    out = F.lit(None)
    for name, row in MODES.items():
        value = row[at]
        out = F.when(mode == name, F.array(*map(F.lit, value)).cast("array<string>") if isinstance(value, tuple) else F.lit(value)).otherwise(out)
    return out


def route(pages: DataFrame, signals: dict[str, Column], blocks: Column) -> DataFrame:
    """Mode, score, reasons, hints and budgets of every page."""
    reasons = F.array_compact(F.array(*[F.when(signals[s] >= t, reason) for s, t, reason, _ in HARD_REASONS]))
    hints = F.array_compact(F.array(*[F.when(signals[s] >= t, hint) for s, t, _, hint in HARD_REASONS if hint]))
    made = pages.withColumns({"complexity_score": complexity(signals, blocks), "_reasons": reasons, "_hints": hints})
    mode = F.when((F.size("_reasons") > 0) | (F.col("complexity_score") >= HARD), "hard").when(F.col("complexity_score") >= STANDARD, "standard").otherwise("fast")
    made = made.withColumn("mode", mode)
    return made.withColumns(
        {
            "reasons": F.when(F.size("_reasons") > 0, F.col("_reasons")).otherwise(F.array(F.lit("low_complexity"))),
            "hints": F.array_sort(F.array_distinct(F.concat("_hints", _by_mode(F.col("mode"), 4)))),
            "repair_budget": _by_mode(F.col("mode"), 3),
            "visual_token_budget": _by_mode(F.col("mode"), 0),
        }
    ).drop("_reasons", "_hints")


def uneven_tables(c: Column) -> Column:
    """Number of blocks of two or more lines with pipes whose pipe counts differ: a fold over the lines' counts."""
    counts = F.transform(F.concat(lines(c), F.array(F.lit(""))), lambda x: count_of(x, "|").cast("int"))
    state = "struct<n:int,lo:int,hi:int,bad:int>"
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("bad")).cast(state)

    def step(acc: Column, k: Column) -> Column:
        grown = F.struct((acc["n"] + 1).alias("n"), F.when(acc["n"] == 0, k).otherwise(F.least(acc["lo"], k)).alias("lo"), F.greatest(acc["hi"], k).alias("hi"), acc["bad"].alias("bad"))
        closed = F.struct(F.lit(0).alias("n"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), (acc["bad"] + F.when((acc["n"] >= 2) & (acc["lo"] != acc["hi"]), 1).otherwise(0)).alias("bad"))
        return F.when(k > 0, grown).otherwise(closed)

    return F.aggregate(counts, start, step, lambda acc: acc["bad"])


def findings(c: Column, *, html_tables: bool = True) -> Column:
    """The findings of one Markdown text, as structs (severity, code)."""

    def finding(severity: str, code: str) -> Column:
        return F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"))

    rest = unescaped_dollars(F.replace(c, F.lit("$$"), F.lit("")))
    single = F.array_compact(
        F.array(
            F.when(count_of(c, "```") % 2 != 0, finding("error", "unbalanced_code_fence")),
            F.when(count_of(c, "$$") % 2 != 0, finding("error", "unbalanced_display_math")),
            F.when(rest % 2 != 0, finding("warning", "unbalanced_inline_math")),
            F.when(F.lit(not html_tables) & F.contains(F.lower(c), F.lit("<table")), finding("error", "html_table_disallowed")),
        )
    )
    return F.concat(single, F.array_repeat(finding("warning", "table_shape_inconsistent"), uneven_tables(c)))


def _of_severity(severity: str) -> Callable[[Column], Column]:
    return lambda finding: finding["severity"] == severity


def validate(rows: DataFrame, text: str, *, html_tables: bool = True, max_errors: int = 2) -> DataFrame:
    """``rows`` with the findings of a text, their numbers, whether it is valid and whether it needs a repair."""
    made = rows.withColumn("findings", findings(F.col(text), html_tables=html_tables))
    made = made.withColumns({f"{s}_count": F.size(F.filter("findings", _of_severity(s))) for s in ("error", "warning")})
    return made.withColumns({"valid": F.col("error_count") == 0, "repair_required": (F.col("error_count") >= max_errors) | (F.col("error_count") > 0)})


def validate_pages(pages: DataFrame) -> DataFrame:
    """Page validation: that of the Markdown, and an error for a page without blocks."""
    made = validate(pages, "markdown")
    empty = F.coalesce(F.size("blocks"), F.lit(0)) <= 0
    return made.withColumns({"error_count": F.col("error_count") + F.when(empty, 1).otherwise(0), "valid": F.col("valid") & ~empty})


def repeated_lines(pages: DataFrame, key: str, line: str, least: int) -> DataFrame:
    """The lines that stand in ``line`` on at least ``least`` pages of a document."""
    counts = pages.where(F.col(line).isNotNull()).groupBy(key, line).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") >= least).select(key, line)


def assemble(pages: DataFrame, *, key: str, number: str, text: str, min_repeat: int = 2, marker: str | None = None) -> DataFrame:
    """One text per document: pages in order, without their repeated first and last lines, empty pages left out.

    Candidates come from all original pages; the last line is looked for in what is left after the first line is gone. Counts are
    aggregated and joined by document and line, which spreads a document with many pages. The result holds a document's text in one row, so only
    there its pages meet.
    """
    made = pages.select(key, number, lines(F.col(text)).alias("ls"))
    bare = F.filter(F.transform("ls", strip), lambda x: x != "")
    made = made.withColumns({"head": F.get(bare, 0), "foot": F.when(F.size(bare) > 0, F.element_at(bare, -1))})
    heads = repeated_lines(made, key, "head", min_repeat).withColumn("head_again", F.lit(True))
    feet = repeated_lines(made, key, "foot", min_repeat).withColumnsRenamed({"foot": "last"}).withColumn("foot_again", F.lit(True))
    joined = made.join(heads, [key, "head"], "left")
    at = F.array_position(F.transform("ls", strip), F.col("head")).cast("int")
    joined = joined.withColumn("ls", F.when(F.col("head_again"), F.concat(F.slice("ls", 1, at - 1), F.slice("ls", at + 1, F.size("ls")))).otherwise(F.col("ls")))
    rest = F.filter(F.transform("ls", strip), lambda x: x != "")
    joined = joined.withColumn("last", F.when(F.size(rest) > 0, F.element_at(rest, -1))).join(feet, [key, "last"], "left")
    back = F.array_position(F.reverse(F.transform("ls", strip)), F.col("last")).cast("int")
    gone = F.size("ls") - back + 1
    kept = F.when(F.col("foot_again"), F.concat(F.slice("ls", 1, gone - 1), F.slice("ls", gone + 1, F.size("ls")))).otherwise(F.col("ls"))
    page = joined.select(key, number, strip(F.array_join(kept, "\n")).alias("t"))
    sep = f"\n\n{marker}\n\n" if marker else "\n\n"
    ordered = F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), F.col("t").alias("t"))))
    return page.groupBy(key).agg(F.array_join(F.filter(F.transform(ordered, lambda x: x["t"]), lambda t: t != ""), sep).alias("text"))
