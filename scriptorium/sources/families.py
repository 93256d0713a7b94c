"""Source families: how rows of each kind become canonical samples, and the registry of sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions.text import chart_block, first_filled, normalize_target, standalone_formula
from ..operators.layout import text_lines
from .archives import manifest_pairs
from .pairs import IMAGES, annotated_pairs, archive_pairs, manifest_and_stems, structure_pairs
from .tables import sample_rows

Family = Callable[[DataFrame, str, str], DataFrame]


def _ids(rows: DataFrame) -> list[Column]:
    return [F.col(c) for c in ("id", "image_id", "uid") if c in rows.columns]


def _family(target: Callable[[DataFrame], Column], target_type: str, tags: list[str]) -> Family:
    def make(rows: DataFrame, source_id: str, bundle_id: str) -> DataFrame:
        return sample_rows(rows, source_id=source_id, bundle_id=bundle_id, target=target(rows), target_type=target_type, ids=_ids(rows), tags=tags)

    return make


def _formula(rows: DataFrame) -> Column:
    names = [c for c in ("label", "latex", "formula", "latex_formula", "text") if c in rows.columns]
    return F.when(first_filled(*map(F.col, names)).isNotNull(), standalone_formula(first_filled(*map(F.col, names))))


def _regions(rows: DataFrame) -> Column:
    def line(a: Column) -> Column:
        box = [F.regexp_replace(F.get(a["bbox"], i).cast("string"), r"\.0$", "") for i in range(4)]
        return F.format_string("- category_%s: x=%s, y=%s, w=%s, h=%s", a["category_id"].cast("string"), *box)

    return F.concat(F.lit("## Layout Regions\n"), F.array_join(F.transform("annotations", line), "\n"))


def _receipt(rows: DataFrame) -> Column:
    """Key-value entities, then the words as lines of text."""
    entities = F.array_join(F.transform(F.array_sort(F.map_entries("entities")), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"])), "\n")
    words = F.transform(F.arrays_zip(F.col("words").alias("w"), F.col("bboxes").alias("b")), lambda x: F.struct(*[F.get(x["b"], i).cast("double").alias(n) for n, i in (("x0", 0), ("y0", 1), ("y1", 3))], x["w"].alias("text")))
    return F.concat(F.lit("## Receipt Fields\n\n"), entities, F.lit("\n\n## Receipt OCR\n\n"), F.array_join(text_lines(words), "\n"))


def _as_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


FAMILIES: dict[str, Family] = {
    "formula": _family(_formula, "latex_formula", ["formula"]),
    "formula_large": _family(_formula, "latex_formula", ["formula", "large_scale"]),
    "layout": _family(_regions, "layout_annotation", ["layout"]),
    "receipt_words": _family(_receipt, "receipt_markdown", ["receipt"]),
    "receipt_tree": _family(lambda r: M.receipt_markdown("ground_truth"), "receipt_markdown", ["receipt"]),
    "form": _family(lambda r: M.form_markdown(_as_json("words", "ner_tags")), "form_markdown", ["form"]),
    "table": _family(lambda r: M.table_markdown(_as_json(*[c for c in ("filename", "cells", "cols") if c in r.columns])), "table_markdown", ["table"]),
    "chart": _family(lambda r: chart_block(F.col("text")), "chart_markdown", ["chart"]),
    "text_line": _family(lambda r: normalize_target(F.col("text")), "text_line", ["handwriting"]),
    "json": _family(lambda r: M.json_markdown(_as_json(*r.columns)), "json", []),
}

def _paired(read: Callable[[DataFrame], DataFrame], key: str, target_type: str, tags: list[str]) -> Family:
    """Archive members as rows, paired by ``read``, as samples."""

    def make(members: DataFrame, source_id: str, bundle_id: str) -> DataFrame:
        rows = read(members)
        rows = rows.withColumn("split", F.col("split_assignment")) if "split_assignment" in rows.columns else rows
        return sample_rows(rows, source_id=source_id, bundle_id=bundle_id, target=F.col("canonical_target"), target_type=target_type, ids=[F.col(key)], tags=tags)

    return make


def _stems(members: DataFrame) -> DataFrame:
    return manifest_and_stems(members, manifest_pairs(members))


def _annotated(members: DataFrame) -> DataFrame:
    return annotated_pairs(members.where(F.col("member").rlike(IMAGES)), members.where(F.lower("member").endswith(".xml")), M.voc_markdown)


def _finished(rows: DataFrame, source_id: str, bundle_id: str) -> DataFrame:
    """Rows that are samples already."""
    return rows.withColumns({"source_id": F.lit(source_id), "bundle_id": F.lit(bundle_id)})


FAMILIES |= {
    "archive_pairs": _paired(archive_pairs, "stem", "page_markdown_projection", ["handwriting", "historical"]),
    "archive_pairs_by_folder": _paired(lambda m: archive_pairs(m, page_dir=True, split_from_path=True), "stem", "page_markdown_projection", ["handwriting", "layout", "historical"]),
    "manifest_and_stems": _paired(_stems, "sample_id", "latex_formula", ["formula", "printed", "large_scale"]),
    "structure_pairs": _paired(structure_pairs, "stem", "aux_annotation", ["table", "topology"]),
    "annotated_pairs": _paired(_annotated, "stem", "aux_annotation", ["table"]),
    "finished": _finished,
}

# The ids of the known sources, and the family that reads each.
KNOWN_SOURCES = {
    "arxiv_source_pdf": "finished", "pmc_oa_pdf_xml": "finished", "publaynet": "layout", "doclaynet": "layout", "pubtables_1m": "annotated_pairs", "scitsr": "structure_pairs", "mathwriting": "formula", "im2latex_100k": "formula",
    "crohme": "formula", "bentham": "archive_pairs", "read_2016": "archive_pairs_by_folder", "funsd": "form", "cord": "receipt_tree", "sroie": "receipt_words", "chartqa": "json", "plotqa": "chart", "fintabnet_family": "table", "iam": "text_line",
    "unimer_1m": "manifest_and_stems", "european_multilingual_synthetic": "finished", "approved_exact_full_page_targets": "finished", "synthetic_from_exact": "finished", "model_failures_plus_exact_truth": "finished",
    "sft_and_repair_prompt_packs": "finished", "curated_non_overlap_holdouts": "finished",
}

SOURCES: dict[str, tuple[str, Family]] = {k: (f, FAMILIES[f]) for k, f in KNOWN_SOURCES.items()}
"""Registered sources: id to its family's name and function."""


def register_source(source_id: str, family: str | Family) -> None:
    """Add a source: one of the families by name, or any function of rows, source id and bundle id."""
    SOURCES[source_id] = (family, FAMILIES[family]) if isinstance(family, str) else (getattr(family, "__name__", "own"), family)


def samples_of(rows: DataFrame, source_id: str, bundle_id: str) -> DataFrame:
    """The samples of a registered source's rows; an unregistered one becomes JSON."""
    return SOURCES.get(source_id, ("json", FAMILIES["json"]))[1](rows, source_id, bundle_id)
